"""Rows of null and shared ids in near-duplicate removal."""

from pathlight.llm import simhash

FOX, SEA = "the quick brown fox jumps over the lazy dog by the river", "nothing but water and wind from here to the far cold shore"
HILL = "seven small houses stand on a green hill behind our old school"


def test_unrelated_rows_of_null_or_shared_ids_stay(spark):
    rows = [(None, FOX), (None, SEA), (4, HILL), (4, "one more text under an id that is taken already by others"), (None, HILL), (None, FOX)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for i, t in rows[:4])


def test_copies_are_filled_one_after_the_other(spark):
    from pathlight.llm import mixing

    rows = [(1, "a b c d e f g h i j", "s")] * 7 + [(2, "p q r", "t"), (None, "x y", "t"), (None, "x y", "t"), (3, None, "t"), (4, "", None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, _copy int").repartition(4)
    due = mixing.mix_sources(docs).groupBy("doc_id").sum("taken").collect()
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    words = {}
    for r in got.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in map(tuple, due) if n}
    assert sum(words.values()) == 77 and 0 < words[1] < 70
