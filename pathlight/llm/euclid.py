"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.operators.components import connected_components
from pathlight.plans.lineage import cut

#: Width of a quantised step; the distance of unit vectors is 0.447 at cosine 0.9 and 1.414 at cosine 0.
WIDTH = 2.0
#: Unrelated vectors that a bucket is laid out for, and the chance that a pair at the threshold shares a bucket.
LOAD, RECALL = 32, 0.93
#: Vectors of one bucket that meet in one block.
BLOCK = 256


def same_step(distance: float, width: float = WIDTH) -> float:
    """Probability that a Gaussian projection puts two points at ``distance`` on one step."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(n: int, threshold: float, recall: float = RECALL, load: int = LOAD) -> tuple[int, int]:
    """Projections of a table and number of tables for ``n`` vectors.

    Unrelated vectors fill a bucket with ``load`` at most in the mean; a pair exactly at the threshold is found with
    probability ``recall``, closer pairs with more.
    """
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2.0))
    k = max(6, math.ceil(math.log(max(n / load, 1)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(dim: int, k: int, tables: int, seed: int):
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((dim, k * tables))
    offsets = rng.uniform(0, WIDTH, k * tables)
    mix = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                steps = np.floor((_unit(_matrix(batch.column(1))) @ directions + offsets) / WIDTH).astype(np.int64)
                keys = (steps.reshape(-1, tables, k) * mix).sum(axis=2) ^ (np.arange(tables) * 0x5851F42D4C957F2D)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.record_batch([batch.column(0), lists], names=["nid", "keys"])

    return run


def _links_in_blocks(threshold: float):
    """Rows come sorted by block; for each vector of a block its links counted once and a link towards its root.

    A pair that also shares an earlier table is left to that one. Left and right are the block's two parts; only pairs
    across them count unless both are the same part.
    """

    def solve(rows: dict[str, np.ndarray], out: list) -> None:
        x = _unit(rows["v"])
        cos = np.einsum("ij,kj->ik", x, x) if len(x) < 4 else x @ x.T
        link = cos >= threshold
        np.fill_diagonal(link, False)
        left, right = rows["left"], rows["right"]
        link &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        if not link.any():
            return
        a, b = np.nonzero(link)
        keys, table = rows["keys"], rows["table"][0]
        first = ~(keys[a, :table] == keys[b, :table]).any(axis=1) if table else np.ones(len(a), bool)
        counted = np.bincount(a[first], rows["w"][b[first]], len(x)).astype(np.int64)
        label = np.arange(len(x))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            low = low[low]
            if (low == label).all():
                break
            label = low
        has = np.flatnonzero(link.any(axis=1))
        out.append((rows["nid"][has], counted[has], rows["nid"][label[has]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: i for i, n in enumerate(batch.schema.names)}
            cols = {n: batch.column(at[n]).to_numpy(zero_copy_only=False) for n in ("g", "nid", "w", "table", "left", "right")}
            cols["v"], cols["keys"] = _matrix(batch.column(at["v"])), np.stack(batch.column(at["keys"]).to_numpy(zero_copy_only=False))
            if rest is not None:
                cols = {n: np.concatenate([rest[n], cols[n]]) for n in cols}
            edges = np.flatnonzero(np.diff(cols["g"])) + 1
            stops = [0, *edges.tolist()]
            out: list = []
            for a, b in zip(stops, stops[1:], strict=False):
                if b - a > 1:
                    solve({n: c[a:b] for n, c in cols.items()}, out)
            rest = {n: c[stops[-1] :] for n, c in cols.items()}
            if out:
                yield to_batch(out)
        out = []
        if rest is not None and len(rest["g"]) > 1:
            solve(rest, out)
        if out:
            yield to_batch(out)

    def to_batch(out: list) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.record_batch(cols, names=["nid", "links", "root"])

    return run


def near_links(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, seed: int = 11
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row.

    Pairs are found in buckets of quantised Gaussian projections and linked only if their cosine, in double precision,
    is ``threshold`` or more. Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, and so do vectors of different lengths. Equal vectors are one node whose rows all link with one another,
    so copies cost nothing; a bucket of any size is compared in blocks of ``BLOCK`` vectors, each pair of blocks in
    one group, so no task gathers a bucket and no pairs are emitted. ``component_id`` is the smallest id reachable,
    ``kept`` marks the rows whose id it is. Repeated rows are vectors of their own. Null ids link but are never the
    smallest; a component of null ids alone has a null id and none is kept. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("nid", F.when(fine, F.xxhash64("v", F.size("v"))))
    nodes = rows.where("nid is not null").groupBy("nid").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    nodes = cut(nodes)
    found = None
    for dim, n in [(r["dim"], r["n"]) for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()]:
        part = _linked(nodes.where(F.size("v") == dim), dim, n, threshold, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    found = cut(found)
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("nid", "root"), "nid", "root").withColumnRenamed("node", "nid")
    of = nodes.select("nid", "w", "low").join(links, "nid", "left").join(parts, "nid", "left")
    of = of.withColumn("component", F.coalesce("component", "nid"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(low, "component").select("nid", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id")
    joined = rows.join(of, "nid", "left")
    component = F.when(F.col("nid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _linked(nodes: DataFrame, dim: int, n: int, threshold: float, seed: int) -> DataFrame:
    """``(nid, links, root)`` of the blocks in which a vector of ``dim`` components has links."""
    k, tables = layout(n, threshold)
    keys = cut(nodes.select("nid", "v").mapInArrow(_keys(dim, k, tables, seed), "nid long, keys array<long>"))
    placed = keys.select("nid", F.posexplode("keys").alias("table", "key"))
    sizes = placed.groupBy("table", "key").agg(F.count("*").alias("m")).where("m > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = placed.join(sizes, ["table", "key"])
    own = F.pmod(F.xxhash64("nid", "key"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    placed = placed.select(
        "nid", "table", F.xxhash64("table", "key", a, b).alias("g"), (F.col("own") == a).alias("left"), (F.col("own") == b).alias("right")
    )
    full = placed.join(nodes.select("nid", "v", "w").join(keys, "nid"), "nid")
    blocks = full.repartition("g").sortWithinPartitions("g").select("g", "nid", "w", "table", "left", "right", "v", "keys")
    return blocks.mapInArrow(_links_in_blocks(threshold), "nid long, links long, root long")
