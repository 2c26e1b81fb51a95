"""Exact removal of repeated byte strings by bucket-pointer refinement.

Two equal strings of ``WINDOW`` bytes hold the same q-grams, so the leftmost q-gram of the least hash in each is the
same: a bucket. Runs of neighbouring windows that share their bucket's q-gram are one row, about two rows for each
``WINDOW`` bytes. A bucket met once repeats nothing. In a bucket whose runs are all of one content every window
repeats. Only the runs of the other buckets, at the borders of repeated passages, send their bytes on. There a bucket is
first split by the bytes that all its windows of a class share, a class being some neighbouring distances between the
start of a window and its q-gram, and then the buckets of q-grams are refined by sorting on the buckets at later offsets
until they stand for whole windows. A split that is still too large for a task is split again by narrower classes, whose
windows share more bytes, and so on; the windows of a class of one distance share all their bytes, so a split of such a
class is a repeated window as it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import as_bytes, pieces
from pathlight.operators.skew import LEAST, PARTS, split_join
from pathlight.plans.lineage import cut

#: Bytes of the strings that must not repeat, and of the first buckets' q-grams.
WINDOW, QGRAM = 200, 32
#: Bytes of text whose q-grams are hashed at once; numpy holds some forty times as much meanwhile.
SECTION = 1 << 18
#: Distances of a class, how many times fewer a narrower class has, and runs of a split bucket that are refined together;
#: more of them are split again.
CLASS, NARROWER, MOST_RUNS = 43, 6, 1_000
#: Bytes that one call of ``refine`` is given, give or take a bucket; it holds some eighty times as much meanwhile.
AT_ONCE = 1 << 18
_POS = np.uint64((1 << 24) - 1)


def _runs(buf: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First and last start of each run of windows, and the hash of its q-gram; windows lie inside one text."""
    n = len(buf)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    words = np.ndarray((n,), np.uint64, padded.data, 0, (1,))
    m = n - QGRAM + 1
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for o in range(8, QGRAM, 8):
        h += words[o : o + m]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    low, span = (h & ~_POS) | np.arange(m, dtype=np.uint64), 1
    width = window - QGRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    starts = len(low)
    inside = np.zeros(starts + 1, np.int8)
    begin = np.concatenate(([0], ends[:-1]))
    long = ends - begin >= window
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    change = np.empty(starts, bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    edge = np.zeros(starts, bool)
    edge[begin[(begin < starts)]] = True
    first = np.flatnonzero(change | edge)
    last = np.append(first[1:], starts) - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    return first, last, h[(low[first] & _POS).astype(np.int64)].view(np.int64), (low[first] & _POS).astype(np.int64)


def _sections(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts put together to about ``SECTION`` bytes: which text, offset in it, bytes, ends. Long texts are split with
    ``window`` - 1 bytes of overlap, at places that depend on the text alone."""
    which, offsets, parts, held = [], [], [], 0

    def out():
        return which, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])

    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for at in range(0, len(t) - window + 1, SECTION):
            part = t[at : at + SECTION + window - 1]
            which.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
            if held >= SECTION:
                yield out()
                which, offsets, parts, held = [], [], [], 0
    if parts:
        yield out()


def text_runs(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """For each section: text number, first and last window start in the text, bucket, hash of the run's bytes, place
    of the q-gram in the run, and a function that gives a run's bytes."""
    for which, offsets, data, ends in _sections(texts, window):
        first, last, bucket, gram = _runs(np.frombuffer(data, np.uint8), ends, window)
        part = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends[:-1]))[part]
        digest = xxhash.xxh3_64_intdigest
        content = [digest(data[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        content = np.array(content, np.uint64).view(np.int64)
        shift = np.array(offsets)[part] - begin
        yield (
            np.array(which)[part], first + shift, last + shift, bucket, content, gram - first,
            lambda i, data=data, first=first, last=last: data[first[i] : last[i] + window],
        )


def refine(rows: list[bytes], groups: np.ndarray, anchors: np.ndarray, window: int = WINDOW, q: int = QGRAM) -> list[np.ndarray]:
    """For each row of bytes a mask of the windows that another row of its group holds at the same distance from the
    anchor. Rows of a group differ, and equal windows of a group always stand at one distance from their anchors.

    Bucket-pointer refinement over all rows at once: the first buckets are the distinct q-grams at one distance in
    one group; a bucket of length n at i becomes one of length n + d by sorting on the buckets at i and at i + d,
    with the new buckets used again for the next length. Positions whose bucket has one member are dropped, as no
    longer string that covers them can repeat.
    """
    data = np.frombuffer(b"".join(rows), np.uint8)
    sizes = np.array([len(r) for r in rows])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(data)) - begin[of]
    distance = place - np.asarray(anchors)[of] + 4096
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data),), np.uint64, padded.data, 0, (1,))
    top = len(data)

    def number(keys: list[np.ndarray], live: np.ndarray) -> np.ndarray:
        """Bucket numbers of the live positions, -1 elsewhere and for buckets of one."""
        out = np.full(top, -1, np.int64)
        if not len(live):
            return out
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(live), bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        ids = np.cumsum(new) - 1
        single = np.bincount(ids)[ids] == 1
        ids[single] = -1
        out[live[order]] = ids
        return out

    room = sizes[of] - place  # bytes to the row's end
    live = np.flatnonzero(room >= 8)
    bucket = number([np.asarray(groups)[of[live]], distance[live], words[live]], live)
    length = 8
    while length < window:
        step = min(length, window - length)
        live = np.flatnonzero((bucket >= 0) & (room >= length + step))
        live = live[bucket[live + step] >= 0]
        # Buckets of the first q bytes hold group and distance, so pairs of them do as well.
        bucket = number([bucket[live], bucket[live + step]], live)
        length += step
    hit = bucket >= 0
    return [hit[b : b + s - window + 1] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _bounds(mask: np.ndarray) -> np.ndarray:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    edge[1::2] -= 1
    return edge.astype("<i4")


def _emit_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            keys = batch.column(0).to_numpy()
            rids = batch.column(1).to_numpy()
            texts = [t or b"" for t in as_bytes(batch.column(2))]
            # Equal texts of a batch give their rows once, with their number.
            _, first, times = np.unique(keys, return_index=True, return_counts=True)
            for which, _, _, bucket, content, _, _ in text_runs([texts[i] for i in first], window):
                order = np.lexsort((content, bucket, which))
                w, b, c = which[order], bucket[order], content[order]
                new = np.concatenate(([True], (w[1:] != w[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(w))) * times[w[at]]
                yield pa.record_batch(
                    [pa.array(keys[first[w[at]]]), pa.array(rids[first[w[at]]]), pa.array(b[at]), pa.array(c[at]), pa.array(n)],
                    names=["tk", "rid", "bucket", "content", "n"],
                )

    return run


def _emit_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts = [t or b"" for t in as_bytes(batch.column(0))]
            wanted = [{(x["bucket"], x["content"]) for x in row} for row in batch.column(1).to_pylist()]
            out = []
            for which, _, _, bucket, content, gram, data in text_runs(texts, window):
                keys = zip(which.tolist(), bucket.tolist(), content.tolist(), gram.tolist(), strict=True)
                for i, (w, b, c, g) in enumerate(keys):
                    if (b, c) in wanted[w]:
                        wanted[w].remove((b, c))
                        out.append((b, c, g, data(i)))
            if out:
                b, c, g, d = zip(*out, strict=True)
                yield pa.record_batch(
                    [pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(g, pa.int32()), pa.array(d, pa.binary())],
                    names=["bucket", "content", "gram", "data"],
                )

    return run


def _refine_sorted(window: int):
    """Rows ``(sub, bucket, content, gram, shift, data)`` come sorted by ``sub``, a split bucket of a bounded size;
    whole ones are refined together. ``shift`` is where ``data`` begins in the run, ``gram`` where the q-gram is in it."""

    def solve(held: list[tuple]) -> pa.RecordBatch | None:
        held = list({x[:3]: x for x in held}.values())
        sub, b, c, g, shift, d = zip(*held, strict=True)
        groups = np.unique(np.array(sub), return_inverse=True)[1]
        masks = refine(list(d), groups, np.array(g), window)
        found = [(x, y, (_bounds(m) + z).astype("<i4").tobytes()) for x, y, z, m in zip(b, c, shift, masks, strict=True) if m.any()]
        if not found:
            return None
        b, c, r = zip(*found, strict=True)
        return pa.record_batch(
            [pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.binary())], names=["bucket", "content", "ranges"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in pieces(batches, 2048):
            for row in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if size >= AT_ONCE and row[0] != held[-1][0]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _split(spans: DataFrame, window: int, width: int) -> DataFrame:
    """``(sub, bucket, content, lo, hi)``: a row for each class of ``width`` distances in ``lo..hi`` that a run has windows of.

    Windows that start at distances from ``lo`` to ``hi`` before the q-gram all hold the bytes from ``lo`` before it to
    where the window at ``hi`` ends. Runs of a bucket that share such a window agree on those bytes, of which ``sub`` is a
    hash, so only runs of one ``sub`` have to be compared. At a width of 1 they are the window, and ``sub`` is its MD5.
    """
    reach = F.octet_length("data") - window  # the last window's start
    rows = spans.withColumn("low", F.explode(F.sequence("lo", "hi", F.lit(width))))
    rows = rows.withColumn("high", F.least(F.col("low") + width - 1, F.col("hi")))
    rows = rows.where((F.col("high") >= F.col("gram") - reach) & (F.col("low") <= F.col("gram")))
    shared = F.substring(F.col("data"), F.col("gram") - F.col("low") + 1, F.lit(window) - F.col("high") + F.col("low"))
    sub = F.md5(shared) if width == 1 else F.xxhash64("bucket", "low", shared)
    return rows.select(sub.alias("sub"), "bucket", "content", "gram", F.col("low").alias("lo"), F.col("high").alias("hi"))


def _as_ranges(windows: DataFrame) -> DataFrame:
    """``(bucket, content, ranges)`` of windows ``(bucket, content, at)``, of which a run has no more than distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(2).to_pylist():
                mask = np.zeros(max(at) + 1, bool)
                mask[at] = True
                out.append(_bounds(mask).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["bucket", "content", "ranges"])

    starts = windows.groupBy("bucket", "content").agg(F.collect_list("at").alias("at"))
    return starts.mapInArrow(run, "bucket long, content long, ranges binary")


def _shared_windows(spans: DataFrame, window: int, most_runs: int) -> DataFrame:
    """``(bucket, content, ranges)``: the windows of the runs ``(bucket, content, gram, data)`` that others of the bucket hold."""
    width = max(1, min(CLASS, window - QGRAM + 1))
    rows = spans.select("*", F.lit(0).alias("lo"), F.lit(window - QGRAM).alias("hi"))
    parts = []
    while True:
        subs = cut(_split(rows, window, width))
        sizes = cut(subs.groupBy("sub").agg(F.count("*").alias("k")).where("k > 1").withColumn("big", F.col("k") > most_runs))
        met = split_join(subs, sizes, ["sub"], "k")
        if width == 1:
            parts.append(_as_ranges(met.select("bucket", "content", (F.col("gram") - F.col("lo")).alias("at"))))
            break
        met = cut(met)
        full = met.drop("gram").join(spans, ["bucket", "content"])
        begin = F.greatest(F.lit(0), F.col("gram") - F.col("hi"))
        size = F.col("gram") - F.col("lo") + window - begin
        few = full.where("not big").select(
            "sub", "bucket", "content", (F.col("gram") - begin).alias("gram"), begin.alias("shift"), F.substring(F.col("data"), begin + 1, size).alias("data")
        )
        few = few.repartition("sub").sortWithinPartitions("sub")
        parts.append(few.mapInArrow(_refine_sorted(window), "bucket long, content long, ranges binary"))
        if met.where("big").isEmpty():
            break
        rows = full.where("big").select("bucket", "content", "gram", "data", "lo", "hi")
        width = max(1, width // NARROWER)
    ranges = reduce(DataFrame.unionByName, parts)
    return ranges.groupBy("bucket", "content").agg(F.collect_list("ranges").alias("parts")).select("bucket", "content", _joined("parts").alias("ranges"))


def _joined(parts: str):
    """Binary values of an array one after the other; a range may come twice, which is no matter."""
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with its columns renamed by place, so that no name clashes, and the hashes of the text, by which flags
    come back, and of the id; and the new name of the text."""
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    named = docs.toDF(*at.values())
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    keyed = named.withColumn("_tk", F.xxhash64(text, F.octet_length(text))).withColumn("_rid", F.xxhash64(F.col(at[id_col])))
    return keyed, at[text_col]


def repeated_runs(keyed: DataFrame, text_col: str, window: int = WINDOW, most_runs: int = MOST_RUNS) -> DataFrame:
    """``(_k, flags)``: for each text with repeated windows its runs ``(bucket, content, ranges)`` that hold some.

    Null ``ranges`` are all windows of the run; else pairs of first and last start, relative to the run's. ``keyed`` has
    the keys ``_tk`` of the text and ``_rid`` of the id, either of which may repeat; null and short texts have no runs,
    and no rows give none. A bucket, run or text may be as frequent as a third of all rows: the facts on such ones are
    broadcast instead of gathering their rows.
    """
    schema = "tk long, rid long, bucket long, content long, n long"
    runs = cut(keyed.select("_tk", "_rid", text_col).mapInArrow(_emit_runs(window), schema))
    buckets = runs.groupBy("bucket").agg(
        F.sum("n").alias("all"), F.count("*").alias("rows"), F.min("content").alias("low"), F.max("content").alias("high")
    )
    buckets = cut(buckets.where("`all` > 1").select("bucket", (F.col("low") != F.col("high")).alias("mixed"), "rows"))
    # Written once, for what follows reads it several times; it is the part of the runs that may repeat.
    met = cut(split_join(runs, buckets, ["bucket"], "rows").select("tk", "rid", "bucket", "content", "n", "mixed"))
    plain = met.where("not mixed").select("tk", "bucket", "content", F.lit(None).cast("binary").alias("ranges"))
    mixed = met.where("mixed")
    contents = mixed.groupBy("bucket", "content").agg(
        F.sum("n").alias("all"), F.count("*").alias("rows"), F.min(F.struct("rid", "tk")).alias("one")
    )
    contents = cut(contents.select("bucket", "content", "all", "rows", "one.rid", "one.tk"))
    wanted = contents.groupBy(F.col("tk").alias("_tk"), F.col("rid").alias("_rid")).agg(
        F.collect_list(F.struct("bucket", "content")).alias("wanted")
    )
    texts = keyed.join(wanted, ["_tk", "_rid"]).select(text_col, "wanted")
    spans = texts.mapInArrow(_emit_bytes(window), "bucket long, content long, gram int, data binary")
    spans = cut(spans)
    ranges = _shared_windows(spans, window, most_runs)
    known = contents.select("bucket", "content", "all", "rows").join(ranges, ["bucket", "content"], "left")
    known = known.where("`all` > 1 or ranges is not null")
    known = cut(known.select("bucket", "content", F.when(F.col("all") == 1, F.col("ranges")).alias("ranges"), "rows"))
    edges = split_join(mixed, known, ["bucket", "content"], "rows").select("tk", "bucket", "content", "ranges")
    flags = plain.unionByName(edges).groupBy("tk", "bucket", "content").agg(F.first("ranges").alias("ranges"))
    return flags.groupBy(F.col("tk").alias("_k")).agg(F.collect_list(F.struct("bucket", "content", "ranges")).alias("flags"))


def covered(text: bytes, flags: dict[tuple[int, int], bytes | None], window: int = WINDOW) -> np.ndarray:
    """First and past-the-last byte of each maximal run of bytes that repeated windows cover, in turn."""
    depth = np.zeros(len(text) + 1, np.int32)
    for _, first, last, bucket, content, _, _ in text_runs([text], window):
        for a, b, key in zip(first.tolist(), last.tolist(), zip(bucket.tolist(), content.tolist(), strict=True), strict=True):
            if key in flags:
                ranges = flags[key]
                pairs = [0, b - a] if ranges is None else np.frombuffer(ranges, "<i4").tolist()
                for x, y in zip(pairs[::2], pairs[1::2], strict=True):
                    depth[a + x] += 1
                    depth[a + y + window] -= 1
    mask = np.cumsum(depth[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))


def _flagged(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``docs`` with columns by place, their ``flags``, and whether the ``whole`` text repeats, the last two.

    A text that very many rows have is told to all tasks as such: it repeats from end to end, and its rows need no flags
    and stay where they are.
    """
    keyed, text = _keyed(docs, id_col, text_col)
    flags = repeated_runs(keyed, text, window)
    times = cut(keyed.groupBy(F.col("_tk").alias("_h")).agg(F.count("*").alias("rows")).where(F.col("rows") > LEAST))
    limit = max(LEAST, docs.count() / PARTS)
    hot = times.where(F.col("rows") > limit).select("_h", F.lit(True).alias("whole"))
    told = keyed.join(F.broadcast(hot), keyed["_tk"] == hot["_h"], "left")
    key = F.when(F.col("whole").isNull(), F.col("_tk")).otherwise(F.xxhash64("_rid", "_tk"))
    told = told.withColumn("_key", key)
    joined = told.join(flags, (told["_key"] == flags["_k"]) & told["whole"].isNull(), "left")
    return joined.drop("_k", "_tk", "_rid", "_key", "_h").select(*keyed.columns[:-2], "flags", "whole")


def _edges(text: bytes, flags: dict | None, whole: bool | None, window: int) -> np.ndarray:
    """First and past-the-last byte of each removed run, in turn."""
    if whole:
        return np.array([0, len(text)]) if len(text) >= window else np.zeros(0, np.int64)
    return covered(text, flags, window) if flags else np.zeros(0, np.int64)


def _flag_maps(column: pa.Array) -> list[dict | None]:
    return [None if row is None else {(x["bucket"], x["content"]): x["ranges"] for x in row} for row in column.to_pylist()]


def removed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed)`` of every row.

    Each byte covered by a ``window``-byte string that starts anywhere else too, in this or another document, is
    removed; all strings are judged on the input. ``removed`` lists first and past-the-last byte of each maximal
    removed run. Null and empty texts have no bytes; shorter ones than ``window`` lose none. Repeated rows are
    documents of their own, so they repeat one another. No rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            cols = [[], [], [], [], []]
            marks = zip(as_bytes(batch.column(1)), _flag_maps(batch.column(2)), batch.column(3).to_pylist(), strict=True)
            for text, flags, whole in marks:
                text = text or b""
                edges = _edges(text, flags, whole, window)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                row = (len(text), int((edges[1::2] - edges[::2]).sum()), len(edges) // 2, kept.hexdigest(), edges.tolist())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"
    rows = _flagged(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, window)
    return rows.mapInArrow(run, schema)


def _whole_characters(text: bytes, edges: np.ndarray) -> bytes:
    """The text without the removed runs, each shortened to whole characters."""
    out, at = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated strings cut out of its texts and ``n_chars``, where there is one, set anew.

    Every row stays, with an empty text if nothing is left of it; a null text stays null. Removed runs are shortened
    to whole characters, so that the rest is valid text.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            out = []
            flags, whole = _flag_maps(batch.column(len(names))), batch.column(len(names) + 1).to_pylist()
            for text, flag, all_of_it in zip(as_bytes(batch.column(names.index(text_col))), flags, whole, strict=True):
                if text is not None and (flag or all_of_it):
                    text = _whole_characters(text, _edges(text, flag, all_of_it, window))
                out.append(None if text is None else text.decode())
            columns = list(batch.columns)[: len(names)]
            columns[names.index(text_col)] = pa.array(out, pa.string())
            yield pa.record_batch(columns, names=names)

    rows = _flagged(docs, id_col, text_col, window).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length(text_col).cast("long"))
    return rows.select(*names)
