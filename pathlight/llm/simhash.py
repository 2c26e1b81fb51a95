"""SimHash near-duplicates: pigeonhole blocks over the distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.llm import similar
from pathlight.llm.common import as_bytes, pieces
from pathlight.operators.components import connected_components
from pathlight.operators.skew import split_join
from pathlight.plans.lineage import cut

#: Words of a shingle, seed of the hash, differing bits of a link.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Block groups with more distinct fingerprints than this are split once more instead of being paired.
PAIR_LIMIT = 12


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a text; 0 if it has no word."""
    return simhash(similar.shingle_hashes(text, shingle, seed))


def simhash(h: np.ndarray) -> int:
    """64 majorities over the bits of hashes; 0 if there are none."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # long texts by parts
        bits = np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row, the fingerprint as a signed 64-bit number. Null text is empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def _masks(bits: list[int], max_bits: int) -> list[int]:
    """Masks of the blocks that a pair must share: ``max_bits`` + 2 blocks of ``bits``, any two of them chosen.

    At most ``max_bits`` blocks can hold a difference, so two of the ``max_bits`` + 2 are equal.
    """
    blocks = [bits[i :: max_bits + 2] for i in range(max_bits + 2)]
    return [sum(1 << b for b in x + y) for x, y in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(fps: DataFrame, masks: list[int], extra: str | None = None) -> DataFrame:
    """A row ``(key, fp)`` for each mask; ``extra`` keeps groups of different origin apart."""
    keys = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]
    cols = ([F.col(extra)] if extra else []) + [F.col("fp"), F.explode(F.array(*keys)).alias("key")]
    return fps.select(*cols)


def links(fps: DataFrame, max_bits: int = MAX_BITS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints ``fp``, enough to connect all that differ in ``max_bits`` or fewer.

    Block groups of up to ``pair_limit`` fingerprints are joined with themselves and the pairs verified by Hamming
    distance. A larger group, of fingerprints that share two blocks, is split instead of paired: each member gives
    itself and its 64 neighbours at one bit, and members that meet at the same neighbour, all within two bits of one
    another, hang on the smallest of them, verified like the others. This is exact for two bits and linear in the group.
    """
    if max_bits != 2:
        raise ValueError("blocks and neighbours are laid out for two differing bits")
    rows = _blocks(fps, _masks(list(range(64)), max_bits))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    sizes = cut(sizes)
    # A group of two is its smallest and largest member: verified without a join.
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    twos = sizes.where("n = 2").select(F.col("low").alias("src"), F.col("high").alias("dst"))
    few = rows.join(sizes.where(f"n between 3 and {pair_limit}").select("key"), "key")
    pairs = few.select("key", F.col("fp").alias("src")).join(few.select("key", F.col("fp").alias("dst")), "key")
    pairs = pairs.where("src < dst").select("src", "dst")
    hot = rows.join(sizes.where(f"n > {pair_limit}").select("key"), "key").select("fp").distinct()
    return twos.unionByName(pairs).unionByName(_meet(hot)).where(near).distinct()


def _meet(fps: DataFrame) -> DataFrame:
    """Links of fingerprints that meet at a neighbour of one bit or less."""
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
    spots = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = spots.groupBy("at").agg(F.min("fp").alias("src"), F.max("fp").alias("other"), F.count("*").alias("n"))
    shared = least.where("n > 1")
    first = shared.select("src", F.col("other").alias("dst"))
    more = spots.join(shared.where("n > 2").select("at", "src"), "at").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return first.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id that links of fingerprints reach.

    Texts without a word have fingerprint 0 and link like any other. Documents of equal fingerprints are one node, so
    thousands of copies cost one. Repeated rows come back as they are. Null ids take part but are never the smallest;
    a component of null ids alone has a null id. No rows: no rows. Other columns are ignored.
    """
    prints = cut(with_fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    parts = connected_components(links(nodes.select("fp")))
    roots = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", "n", F.coalesce("component", "fp").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    # Fingerprints of thousands of copies, and components of thousands of fingerprints, are told to all tasks.
    of = cut(split_join(cut(roots), cut(smallest), ["root"], "members").select("fp", "component_id", "n"))
    return split_join(prints, of, ["fp"], "n").select("doc_id", "fp", "component_id")


def _rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, order=None) -> DataFrame:
    """``(_rk, doc_id, fp)`` of every row: row key, id and fingerprint.

    With ``order``, the broadcast common shingles, also what ``similar.similar_sets`` wants: key of the set of shingles
    (null without a word), its size, parity map, folded map, and prefix.
    """
    folds = [f"b{i}" for i in range(similar.FOLDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = [similar.shingle_hashes(t, shingle, SEED) for t in as_bytes(batch.column(2))]
            fps = np.array([simhash(h) for h in hashes], np.uint64).view(np.int64)
            columns, names = [batch.column(0), batch.column(1), pa.array(fps)], ["_rk", "doc_id", "fp"]
            if order is not None:
                sets = [similar.shingle_set(h) for h in hashes]
                maps = [similar.parity(u) for _, u in sets]
                small = np.array([similar.folded(m) for m in maps]).view(np.int64).reshape(-1, similar.FOLDED)
                columns += [
                    pa.array([k if len(u) else None for k, u in sets], pa.int64()),
                    pa.array([len(u) for _, u in sets], pa.int64()),
                    pa.array([m.tobytes() for m in maps], pa.binary()),
                    *[pa.array(small[:, i]) for i in range(similar.FOLDED)],
                    pa.array([similar.prefix(u, *order.value) for _, u in sets], pa.list_(pa.int64())),
                ]
                names += ["sk", "n", "bits", *folds, "prefix"]
            yield pa.record_batch(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", sk long, n long, bits binary, " + ", ".join(f"{b} long" for b in folds) + ", prefix array<long>"
    return docs.select("_rk", F.col(id_col), F.col(text_col)).mapInArrow(run, f"_rk long, doc_id {kind}, fp long" + (more if order is not None else ""))


def _similar_links(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``(src, dst)``: fingerprints of texts whose sets of shingles have a similarity of 0.8 or more."""
    some = rows.where("sk is not null")
    pairs = similar.similar_sets(docs, some, text_col, shingle, SEED)
    nodes = cut(some.groupBy("sk").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")))
    a, b = (nodes.select(F.col("sk").alias(x), F.col("fp").alias(y)) for x, y in (("a", "src"), ("b", "dst")))
    # Equal sets have one fingerprint unless shingles are repeated; those few more hang on the least.
    few = cut(nodes.where("fp <> other").select("sk", F.col("fp").alias("dst")))
    same = some.select("sk", F.col("fp").alias("src")).distinct().join(similar.small_side(few), "sk").select("src", "dst")
    ends = pairs.join(a, "a").join(b, "b").select("src", "dst")
    return ends.unionByName(same).where("src <> dst").distinct()


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: bool = False
) -> DataFrame:
    """One document of each group of near-duplicates: the row of the smallest id.

    Near-duplicates are texts whose fingerprints differ in ``MAX_BITS`` or fewer and, with ``similarity``, also those
    whose sets of shingles have a Jaccard similarity of 0.8 or more, all of them. Of repeated rows one stays. A row
    with a null id stays only if its group has no other id. Null and empty texts are one group. No rows give no rows;
    other columns come back as they are, whatever their names.
    """
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # by place, so that no name clashes
    id_at, text_at = at[id_col], at[text_col]
    keyed = docs.toDF(*at.values())
    keyed = keyed.withColumn("_rk", F.xxhash64(id_at, text_at, F.length(text_at)))
    order = None
    if similarity:
        order = docs.sparkSession.sparkContext.broadcast(similar.common_shingles(keyed, text_at, shingle, SEED))
    rows = cut(_rows(keyed, id_at, text_at, shingle, order))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rk")).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    found = links(nodes.select("fp"))
    if similarity:
        found = found.unionByName(_similar_links(keyed, rows, text_at, shingle))
    parts = connected_components(found).withColumnRenamed("node", "fp")
    roots = nodes.join(parts, "fp", "left").select("first", F.coalesce("component", "fp").alias("root"))
    kept = roots.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._rk").alias("_rk"))
    times = cut(rows.groupBy("_rk").agg(F.count("*").alias("times")).join(kept.withColumn("kept", F.lit(True)), "_rk", "left"))
    # Few rows go as a rule, so those that go, or stay once, are told to all tasks; otherwise the texts are shuffled once.
    special = cut(times.where("kept is null or times > 1").select("_rk", F.coalesce("kept", F.lit(False)).alias("kept")))
    told = similar.small_side(special)
    alone = keyed.join(told, "_rk", "left_anti")
    repeated = keyed.join(told.where("kept").select("_rk"), "_rk", "left_semi").dropDuplicates(["_rk"])
    return alone.unionByName(repeated).drop("_rk").toDF(*docs.columns)
