"""Pairs of texts whose sets of shingles have a Jaccard similarity of 0.8 or more, all of them exactly.

Texts of similarity s share at least s of the shingles of either, so in any common order of all shingles they share one
among the first 1 - s of each (the prefix). The order puts common shingles last. It comes from a sample and says only
how many pairs are looked at; which pairs are found does not depend on it.

A pair is first held against the parity maps of its sets: bit i says whether an odd number of shingles fall on i, so two
maps differ in no more bits than the sets differ in shingles, and a pair whose maps differ in more than the similarity
allows is passed over without a look at its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import as_bytes, pieces
from pathlight.operators.components import connected_components
from pathlight.plans.lineage import cut

#: One text in so many gives the order; shingles that it has so often come last, the commonest so many of them.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 500_000
#: In groups of one prefix shingle with more texts than this each is compared with the next ``NEXT`` before others are.
PAIR_LIMIT, NEXT = 12, 2
#: Members of one side of a join of a group with itself, which is put off, by rounds in which each member is compared
#: with the next ``WIDER`` in another order, while it would look at over ``WORTH`` pairs a member.
BLOCK, WIDER, WORTH, MOST_ROUNDS = 1024, 32, 1000, 2
#: Keys of eight bytes that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Longs of the parity map that every set has beside its own.
FOLDED = 4


def shingle_hashes(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of a text in their order; a text of fewer words is one shingle, one of no word has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    pairs = zip(starts[:n].tolist(), stops.tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, n)


def shingle_set(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Key of the set of some hashes, and the set in order."""
    u = np.unique(h.view(np.int64))
    return int(np.uint64(xxhash.xxh64_intdigest(u.tobytes(), 1)).view(np.int64)), u


def parity(u: np.ndarray) -> np.ndarray:
    """Parity map of a set in 64-bit words, a power of two of them that grows with the set, ``FOLDED`` at least."""
    bits = max(64 * FOLDED, 1 << max(len(u) // 2, 1).bit_length())
    odd = np.bincount((u & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int = FOLDED) -> np.ndarray:
    """A parity map as one of ``size`` words."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def may_be_similar(u: bytes, v: bytes, m: int, n: int) -> bool:
    """Whether sets of ``m`` and ``n`` shingles with these parity maps can have a similarity of 0.8."""
    x, y = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
    size = min(len(x), len(y))
    return 9 * int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= m + n


def common_shingles(docs: DataFrame, text_col: str, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts has often, and how often; at most ``MOST_COMMON`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(shingle_hashes(t, shingle, seed))[1] for t in as_bytes(batch.column(0))]
            yield pa.record_batch([pa.array(np.concatenate(sets))], names=["key"])

    some = docs.select(F.col(text_col)).where(F.xxhash64(text_col) % SAMPLE == 0)
    counts = cut(some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON))
    least, total = COMMON, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        total += r["n"]
        if total > MOST_COMMON:
            least = r["c"] + 1
            break
    found = counts.where(F.col("c") >= least).orderBy("key").toArrow()
    return found.column("key").to_numpy(), found.column("c").to_numpy()


def prefix(u: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which it shares one with any set of similarity 0.8."""
    n = len(u)
    length = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, u), len(common) - 1)
        u = u[np.argsort(np.where(common[at] == u, times[at], 0), kind="stable")]
    return u[:length]


def _near(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(m, n) >= 4 * np.maximum(m, n)


def _grouped(limit: int):
    """From ``(key, sk, n)`` in order the pairs to look at, ``key`` null, and the members of large groups, ``b`` null.

    Small groups give all their pairs, large ones each member with the next ``NEXT``. The first and the last group of a
    partition may go on in another one and so count as large.
    """
    names = ["key", "a", "b", "n"]

    def pairs(s: np.ndarray, n: np.ndarray, at: np.ndarray, d: int) -> pa.RecordBatch:
        at = at[_near(n[at], n[at + d])]
        return pa.record_batch([pa.nulls(len(at), pa.int64()), pa.array(s[at]), pa.array(s[at + d]), pa.array(n[at])], names=names)

    def emit(k: np.ndarray, s: np.ndarray, n: np.ndarray, large: set, told: int) -> Iterator[pa.RecordBatch]:
        """Whole groups; those of ``large`` keys count as such, and of the first ``told`` rows all has been said."""
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(starts, len(k)))
        small = np.repeat(sizes <= limit, sizes)
        for d in range(1, min(limit, len(k))):
            same = k[d:] == k[:-d]
            if not same.any():
                break
            at = np.flatnonzero(same & (small[d:] if d > NEXT else True))
            at = at[at + d >= told]
            if len(at):
                yield pairs(s, n, at, d)
        told_large = np.repeat((sizes > limit) | np.isin(k[starts], list(large)), sizes)
        told_large[:told] = False
        at = np.flatnonzero(told_large)
        if len(at):
            yield pa.record_batch([pa.array(k[at]), pa.array(s[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told, large = [np.zeros(0, np.int64)] * 3, 0, set()
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            k, s, n = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(held))
            if first:
                first = False
                large.add(int(k[0]))
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield from emit(k[:last], s[:last], n[:last], large, told)
                told = 0
            held = [k[last:], s[last:], n[last:]]
            if len(held[0]) > 16 * limit:  # the open group is large: its last rows are enough to go on
                large = {int(held[0][0])}
                yield from emit(*held, large, told)
                told = NEXT
                held = [x[-NEXT:] for x in held]
            elif last:
                large = large & {int(held[0][0])}
        if len(held[0]):
            yield from emit(*held, {int(held[0][0])}, told)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the members ``(key, o, sk, n, part)`` of a group with the next ``WIDER`` of another part."""
    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        k, s, n, p = (np.concatenate((x, batch.column(i).to_numpy())) for x, i in zip(held, (0, 2, 3, 4), strict=True))
        old = len(held[0])
        for d in range(1, min(WIDER, len(k) - 1) + 1):
            at = np.flatnonzero((k[d:] == k[:-d]) & (p[d:] != p[:-d]))
            at = at[at + d >= old]
            at = at[_near(n[at], n[at + d])]
            a, b = s[at], s[at + d]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        held = [x[-WIDER:] for x in (k, s, n, p)]


def similar_sets(docs: DataFrame, sets: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``(a, b)``: keys of sets, enough to connect all of similarity 0.8 or more.

    ``docs`` has the row key ``_rk``; ``sets`` has a row ``(sk, _rk, n, bits, b0, ..., prefix)`` of each text, copies
    included: key and size of the set, its parity map, the folded one, and its prefix. Texts that share a prefix shingle
    are paired. Where more than ``PAIR_LIMIT`` share one, each is compared with the next ones, in other orders again where
    that leaves a group in many parts; then those pairs are looked at that are not connected by what was found, so a
    large group of near copies costs its size and not its square. The
    groups are dealt by ranges of (key, set), so no task gets a large one whole, and so are the pairs inside it.
    """
    light = ["_rk", "n", "bits", *[f"b{i}" for i in range(FOLDED)]]
    nodes = cut(sets.groupBy("sk").agg(F.min(F.struct(*light)).alias("x")).select("sk", "x.*"))
    once = sets.groupBy("sk").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    ranged = once.select(F.explode("prefix").alias("key"), "sk", "n").repartitionByRange("key", "sk").sortWithinPartitions("key", "sk")
    found = cut(ranged.mapInArrow(_grouped(PAIR_LIMIT), "key long, a long, b long, n long"))
    pairs = found.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = _verified(pairs, docs, nodes, text_col, shingle, seed)
    large = found.where("key is not null").select("key", F.col("a").alias("sk"), "n").distinct()
    large = cut(large)
    for turn in range(MOST_ROUNDS + 1):
        parts = connected_components(links, "a", "b").withColumnRenamed("node", "sk")
        placed = cut(large.join(parts, "sk", "left").select("key", "sk", "n", F.coalesce("component", "sk").alias("part")))
        sizes = placed.groupBy("key", "part").agg(F.count("*").cast("double").alias("c")).groupBy("key")
        mixed = sizes.agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("parts")).where("parts > 1")
        mixed = cut(mixed.select("key", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), ((F.col("m") * F.col("m") - F.col("same")) / 2).alias("pairs")))
        cost = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("m").alias("m")).first()
        if cost["m"] is None:
            return links
        if cost["pairs"] <= WORTH * cost["m"] or turn == MOST_ROUNDS:
            break
        order = placed.join(mixed.select("key"), "key").select("key", F.xxhash64(F.lit(turn), "sk").alias("o"), "sk", "n", "part")
        order = order.repartitionByRange("key", "o").sortWithinPartitions("key", "o")
        nxt = order.mapInArrow(_neighbours, "a long, b long").distinct()
        links = links.unionByName(_verified(nxt, docs, nodes, text_col, shingle, seed))
    mixed = mixed.select("key", "blocks")
    folds = [f"b{i}" for i in range(FOLDED)]
    left = placed.join(mixed, "key").join(nodes.select("sk", *folds), "sk")
    side = {x: [F.col("sk").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"), *[F.col(c).alias(c + x) for c in folds]] for x in "ab"}
    a = left.select("key", F.pmod(F.xxhash64("sk", "key"), F.col("blocks")).cast("int").alias("block"), *side["a"])
    b = left.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *side["b"])
    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in folds), F.lit(0))
    rest = a.join(b, ["key", "block"]).where("pa <> pb and a < b and 5 * least(na, nb) >= 4 * greatest(na, nb)")
    rest = rest.where(9 * apart <= F.col("na") + F.col("nb")).select("a", "b").distinct()
    return links.unionByName(_verified(rest, docs, nodes, text_col, shingle, seed))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity is 0.8 or more, first by their parity maps, then by their texts."""

    def by_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            keep = [may_be_similar(*x) for x in zip(*cols, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def by_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            keep = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                u, v = (shingle_set(shingle_hashes(t, shingle, seed))[1] for t in (x, y))
                keep.append(9 * len(np.intersect1d(u, v, assume_unique=True)) >= 4 * (len(u) + len(v)))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    maps = {x: nodes.select(F.col("sk").alias(x), F.col("bits").alias(f"u{x}"), F.col("n").alias(f"n{x}")) for x in "ab"}
    both = pairs.join(maps["a"], "a").join(maps["b"], "b").select("a", "b", "ua", "ub", "na", "nb")
    close = cut(both.mapInArrow(by_maps, "a long, b long"))
    wanted = close.select(F.explode(F.array("a", "b")).alias("sk")).distinct().join(nodes.select("sk", "_rk"), "sk")
    texts = docs.select("_rk", F.col(text_col).alias("_t")).join(small_side(cut(wanted)), "_rk")
    texts = cut(texts.groupBy("sk").agg(F.first("_t").alias("_t")))  # a row may be repeated
    of = {x: texts.select(F.col("sk").alias(x), F.col("_t").alias(f"_t{x}")) for x in "ab"}
    read = close.join(of["a"], "a").join(of["b"], "b").select("a", "b", "_ta", "_tb")
    return cut(read.mapInArrow(by_texts, "a long, b long"))


def small_side(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, to be broadcast if it has at most ``most`` rows and shuffled otherwise."""
    return F.broadcast(keys) if keys.count() <= most else keys

