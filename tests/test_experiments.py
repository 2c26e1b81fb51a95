"""Statistics that resume, plans of grids, logs, and the command line."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pathlight.plans import experiments as E

ROOT = Path(__file__).resolve().parents[1]
STATISTICS = "graph_name string, estimator string, epsilon double, delta double, k int, run_id long, m long"


def test_recording_again_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "statistics")
    assert E.recorded(spark, path, STATISTICS).count() == 0
    rows = [("a", "x", 0.1, 0.05, 0, 1, 10), ("a", "x", 0.1, 0.05, 0, 2, 20), ("b;ü/", "x", 0.01, 0.05, 3, 1, 30)]
    E.record(spark.createDataFrame(rows, STATISTICS), path)
    E.record(spark.createDataFrame([("a", "x", 0.1, 0.05, 0, 2, 21)], STATISTICS), path)
    got = E.recorded(spark, path, STATISTICS)
    assert sorted((r["graph_name"], r["run_id"], r["m"]) for r in got.collect()) == [("a", 1, 10), ("a", 2, 21), ("b;ü/", 1, 30)]
    grid = spark.createDataFrame([r[:6] for r in rows] + [("a", "x", 0.1, 0.05, 0, 3)], STATISTICS.rpartition(",")[0])
    assert [r["run_id"] for r in E.to_do(grid, got).collect()] == [3]
    E.record(spark.createDataFrame([("a", "x", 0.1, 0.05, 0, 3, 9)], STATISTICS), path)
    assert E.to_do(grid, E.recorded(spark, path, STATISTICS)).count() == 0


def test_graph_with_every_run_has_none_to_do(spark, tmp_path):
    """A graph whose whole grid was recorded is told with 0 runs to do, as in the SQL, and not left out."""
    import datetime

    from pathlight.plans import queries

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, user, "view", 1.0) for user, ids in ((0, range(0, 70, 2)), (1, (2, 4, 4))) for i in ids]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.grid_resume(spark, str(tmp_path)).select("graph_name", "recorded", "to_do")
    assert sorted(map(tuple, got.collect())) == [("0", 35, 0), ("1", 2, 33)]


def test_runs_of_all_events_are_recorded(spark, tmp_path):
    """Events of odd numbers and of every user count, as in the SQL."""
    import datetime

    import duckdb
    from pathlight.plans import queries

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, user, "view", 1.0) for user, ids in ((0, (1, 2, 3)), (4, (5,)), (39, (6, 7, 7, 42)), (40, (36,))) for i in ids]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.grid_resume(spark, str(tmp_path)).select("graph_name", "recorded", "to_do")
    due = duckdb.connect().sql(queries.SQL["grid_resume"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(due) == [("0", 3, 32), ("39", 2, 33), ("4", 1, 34)]


def test_reasons_to_skip(spark):
    grid = [("g", "x", e) for e in (0.1, 0.05, 0.01)] + [("g", "y", 0.1), ("g", "y", 0.05), ("new", "x", 0.1), ("new", "x", 0.01)]
    done = [("g", "x", 0.05, 0), ("g", "y", 0.1, 1), ("g", "y", 0.1, 1), ("new", "x", 0.2, 0), ("other", "x", 0.1, 0)]
    got = E.planned(
        spark.createDataFrame(grid, "graph_name string, estimator string, epsilon double"),
        spark.createDataFrame(done, "graph_name string, estimator string, epsilon double, terminated int"), 2,
    )
    found = {(r["graph_name"], r["estimator"], r["epsilon"]): (r["finished"], r["reason"]) for r in got.collect()}
    assert found == {
        ("g", "x", 0.1): (0, None), ("g", "x", 0.05): (1, "hopeless"), ("g", "x", 0.01): (0, "hopeless"), ("g", "y", 0.1): (2, "enough"),
        ("g", "y", 0.05): (0, None), ("new", "x", 0.1): (0, None), ("new", "x", 0.01): (0, "hopeless"),
    }


def test_logs(spark, tmp_path):
    logs = {
        "done.log": "start\n[INFO ]: Iteration 1, taking 50 samples\n[INFO ]: Iteration 2, taking 9 samples\ndone (1500 millisecs)\nx done (9 millisecs)\ndone (250.5 millisecs)\nINFO: Getting results...done\n",
        "cut.log": "[INFO ]: Iteration 1, taking 70 samples\ndone (12 millisecs)\n",
        "bad.log": "[INFO ]: Iteration 1, taking many samples\ndone (soon millisecs)\n\nINFO: Getting results...done",
    }
    for name, text in logs.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rpartition("/")[2]: (r["m"], r["time"], r["terminated"]) for r in E.parse_logs(E.read_logs(spark, str(tmp_path))).collect()}
    assert got == {"done.log": (50, 0.2505, 1), "cut.log": (0, 0.0, 0), "bad.log": (0, 0.0, 1)}


def run(*args):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "SPARK_LOCAL_IP": "127.0.0.1"}
    return subprocess.run([sys.executable, "-m", "pathlight", *args], capture_output=True, text=True, env=env, timeout=600, cwd=env.get("TMPDIR", "/tmp"))


@pytest.mark.parametrize("args", [("1.5", "0.1", "g"), ("0.1", "0", "g"), ("0.1", "0.1"), ("-k", "-1", "0.1", "0.1", "g"), ("-v", "-2", "0.1", "0.1", "g"), ("x", "0.1", "g")])
def test_wrong_arguments_end_with_1(args):
    done = run(*args)
    assert done.returncode == 1 and "usage" in done.stderr


def test_command_line(tmp_path):
    graph = tmp_path / "graph.txt"
    graph.write_text("# a star and a tail\n" + "".join(f"0 {i}\n" for i in range(1, 9)) + "8 9\n")
    done = run("-v", "0.001", "-o", str(tmp_path / "out"), "0.2", "0.1", str(graph))
    assert done.returncode == 0, done.stderr
    assert "diameter: " in done.stdout and "phase=2" in done.stderr
    rows = dict(x.split(",") for f in (tmp_path / "out").glob("part-*") for x in f.read_text().split())
    assert len(rows) == 10 and abs(float(rows["0"]) - 70 / 90) < 0.2 and float(rows["9"]) == 0
    assert run("0.2", "0.1", str(tmp_path / "none.txt")).returncode == 1
