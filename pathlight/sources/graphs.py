"""Edge lists, catalogues and results: readers, cleaning and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _pair(lines: DataFrame) -> DataFrame:
    """The first two fields of each line as ids; null where there is no number."""
    parts = _fields(F.col("value"))
    return lines.select(
        F.try_element_at(parts, F.lit(1)).try_cast("long").alias("src"),
        F.try_element_at(parts, F.lit(2)).try_cast("long").alias("dst"),
        "value",
    )


def read_edge_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``edges(src, dst)`` of a text with two ids a line; lines that start with ``#`` are comments.

    Fields are separated by white space of any kind and number; further columns are ignored. Blank lines and lines
    without two ids are dropped, or raise where ``strict``. Spark reads folders, globs and compressed files alike.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    pairs = _pair(lines)
    bad = F.col("src").isNull() | F.col("dst").isNull()
    if strict:
        failed = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value")))
        return pairs.select(F.when(bad, failed.cast("long")).otherwise(F.col("src")).alias("src"), "dst")
    return pairs.where(~bad).select("src", "dst")


def read_raw_graph(spark: SparkSession, path: str) -> DataFrame:
    """``edges(src, dst)`` of a downloaded graph: lines that hold ``#`` or ``%`` anywhere are comments.

    Only the first two fields are ids, so weights and times add no nodes.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike("[#%]"))
    return _pair(lines).where("src is not null and dst is not null").select("src", "dst")


def simplify(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Distinct edges without self-loops and nulls; undirected graphs hold both directions of each edge."""
    clean = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    if not directed:
        clean = clean.unionByName(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return clean.distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame, dense: bool = False) -> DataFrame:
    """``nodes(id)``: the distinct ends of the edges, or with ``dense`` all numbers from 0 to the greatest id."""
    if dense:
        top = edges.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0]
        return edges.sparkSession.range(0, 0 if top is None else top + 1)
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def graph_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row ``(n_nodes, n_edges, max_id, max_out_degree, max_in_degree)``; undirected edges count twice."""
    nodes = nodes_of(edges) if nodes is None else nodes
    out = edges.groupBy("src").count().agg(F.sum("count").alias("m"), F.max("count").alias("o"))
    into = edges.groupBy("dst").count().agg(F.max("count").alias("i"))
    ids = nodes.agg(F.count("*").alias("n_nodes"), F.max("id").alias("max_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return ids.crossJoin(out).crossJoin(into).select(
        "n_nodes", zero("m").alias("n_edges"), "max_id", zero("o").alias("max_out_degree"), zero("i").alias("max_in_degree")
    )  # three rows of one aggregate each


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_name, directed)`` of a ``;``-separated catalogue whose second column is ``D`` or ``U``."""
    rows = spark.read.csv(path, sep=";", header=True, schema="graph_name string, directed string")
    return rows.withColumn("directed", F.upper(F.trim("directed")))


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.select("graph_name", "directed").write.mode("overwrite").csv(path, sep=";", header=True)


def missing_graphs(catalogue: DataFrame, present: DataFrame) -> DataFrame:
    """Names of the catalogue that ``present(graph_name)`` lacks."""
    return catalogue.select("graph_name").join(present.select("graph_name"), "graph_name", "left_anti")


def write_graph(edges: DataFrame, path: str, sep: str = " ") -> None:
    """Two ids a line, separated by a blank or a tab."""
    edges.select("src", "dst").write.mode("overwrite").csv(path, sep=sep, header=False)


def write_scores(scores: DataFrame, path: str, k: int | None = None) -> None:
    """``id,estimate`` lines of all nodes, or of the first ``k`` by estimate; members of a tie by id."""
    rows = scores.select("node", "bc")
    if k is not None:
        rows = rows.orderBy(F.desc("bc"), "node").limit(k)
    rows.write.mode("overwrite").csv(path, header=False)


#: Columns of the statistics of a run.
STATISTICS = (
    "graph_name string, epsilon double, delta double, k int, type int, m_hat_enabled int, emp_peel_enabled int, "
    "emp_peel_a double, alpha double, m long, time double, diameter int, first_samples long, first_time double, "
    "eps_mcera double, iter_index_mcera int, top1_est double, top1_ub double, avg_spl_est double, avg_spl_ub double, "
    "samples_bound double, time_bfs double, time_critical double, eps_final_topk double"
)


def append_statistics(rows: DataFrame, path: str) -> None:
    """Append rows of ``STATISTICS``; each part file has its header."""
    rows.write.mode("append").csv(path, sep=";", header=True)


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=STATISTICS)
