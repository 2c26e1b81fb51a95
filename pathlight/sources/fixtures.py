"""Graphs derived from business tables: consecutive customers, shared parts, links of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlight.operators.ranking import global_row_number, with_next


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: from each purchaser over 40 to the next one by time."""
    bought = _table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 40")
    rows = with_next(bought.select("user_id", "ts", "event_id"), [F.col("ts"), F.col("event_id")], ["user_id"])
    return rows.select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst")).where("src <> dst").distinct()


def user_gap(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    """Directed: from each purchaser to the next one if less than ``minutes`` later."""
    bought = _table(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = with_next(bought.select("user_id", "ts", "event_id"), [F.col("ts"), F.col("event_id")], ["user_id", "ts"])
    near = rows.where((F.col("next_ts") - F.col("ts")) < F.expr(f"interval {minutes} minute"))
    return near.select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst")).where("src <> dst").distinct()


def cust_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed: consecutive customers of finished urgent orders."""
    done = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority like '1%'")
    rows = with_next(done.select("o_custkey", "o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], ["o_custkey"])
    return rows.select(F.col("o_custkey").alias("src"), F.col("next_o_custkey").alias("dst")).where("src <> dst").distinct()


def geo_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected tree of regions, nations, customers and suppliers, each edge once."""
    nation = _table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1_000_000).cast("long").alias("src"), (F.col("n_regionkey") + 2_000_000).cast("long").alias("dst")
    )
    customer = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("src"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("dst")
    )
    supplier = _table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 3_000_000).cast("long").alias("src"), (F.col("s_nationkey") + 1_000_000).cast("long").alias("dst")
    )
    return nation.unionByName(customer).unionByName(supplier).distinct()


def supp_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected: suppliers and the parts of their large orders, each edge once."""
    large = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return large.select((F.col("l_suppkey") + 1_000_000).cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")).distinct()


def page_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected: pages and the relative addresses that they link to, numbered in order, each edge once."""
    found = _table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("address")
    )
    ids = global_row_number(found.select("address").distinct(), [F.col("address")], "at")
    return found.join(ids, "address").select(F.col("page_id").alias("src"), (F.col("at") + 1_000_001).alias("dst")).distinct()
