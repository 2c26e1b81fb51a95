"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

Features are hashed by CRC-32. A section of texts is cut into words once; the distinct features of it are told apart by
word numbers, gathered by equal length into matrices of bytes, and the CRCs of a matrix are updated column by column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlight.llm.common import as_bytes, pieces
from pathlight.operators.ranking import global_row_number
from pathlight.plans.lineage import stored

#: Buckets of features, longest run of words that is one, and words a document needs to be drawn.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
#: Bytes of text of a section; bytes beyond which a feature is hashed by itself, as few have its length; cells of a matrix.
SECTION, LONG_FEATURE, CELLS = 1 << 20, 512, 1 << 22

#: Everything but letters, digits and bytes above ASCII separates words.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_CRC = _crc_table()


def crcs(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of a byte buffer: one matrix for each length, updated column by column."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(lengths[group[0]])
        if n > LONG_FEATURE:
            out[group] = [zlib.crc32(buffer[s : s + n]) for s in starts[group].tolist()]
            continue
        rows = max(1, CELLS // max(n, 1))
        for part in (group[i : i + rows] for i in range(0, len(group), rows)):
            columns = buffer[starts[part] + np.arange(n)[:, None]]  # one contiguous row for each byte position
            c = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in columns:
                c = _CRC[(c ^ column) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
            out[part] = ~c
    return out


def _cuts(text: bytes, size: int) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text in parts of about ``size`` bytes, each with the number of words repeated from the part before."""
    spaced, at, carry = text.translate(_SPACED), 0, []
    while True:
        end = len(spaced) if len(spaced) - at <= size else spaced.find(b" ", at + size)
        end = len(spaced) if end < 0 else end
        words = carry + spaced[at:end].split()
        yield words, len(carry)
        if end >= len(spaced):
            return
        carry, at = words[1 - LONGEST :], end


def sections(texts: list[bytes | None], size: int = SECTION) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of several texts one after the other, the text of each, and which are repeated from a former section."""
    words: list[bytes] = []
    of, again, held = [], [], 0
    for i, text in enumerate(texts):
        for part, carried in _cuts(text or b"", size):
            words += part
            of.append((i, len(part)))
            again.append((carried, len(part) - carried))
            held += sum(map(len, part))
            if held >= size:
                yield words, np.repeat(*np.array(of).T), np.repeat([True, False] * len(again), np.ravel(again))
                words, of, again, held = [], [], [], 0
    if words:
        yield words, np.repeat(*np.array(of).T), np.repeat([True, False] * len(again), np.ravel(again))


def section_buckets(words: list[bytes], of: np.ndarray, again: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of every feature of a section; features that end in a repeated word were in a former one."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    buffer = np.frombuffer(b" ".join(words), np.uint8)
    texts, places, firsts, runs, distinct, keys = [], [], [], [], 0, ids
    for k in range(1, LONGEST + 1):
        n = len(words) - k + 1
        if n <= 0:
            break
        if k > 1:
            # A feature is the number of its words but the last and that of the last.
            keys = keys[:n] * len(number) + ids[k - 1 :]
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        keys = back.astype(np.int64)  # small numbers again; features across two texts have numbers that nothing uses
        ok = np.flatnonzero((of[:n] == of[k - 1 :]) & ~again[k - 1 :])
        texts.append(of[ok])
        places.append(keys[ok] + distinct)
        firsts.append(begins[first])
        runs.append(ends[first + k - 1] - begins[first])
        distinct += len(first)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = crcs(buffer, np.concatenate(firsts), np.concatenate(runs)).astype(np.int64) % buckets
    return np.concatenate(texts), found[np.concatenate(places)]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of the features of all texts in the only column; a task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for section in sections(as_bytes(batch.column(0))):
                counts += np.bincount(section_buckets(*section, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(hit), pa.array(counts[hit])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 ln(share in the target / share in the corpus)), counts raised by one.

    ``corpus`` and ``target`` are ``bucket_counts``. ``buckets`` numbers come to the driver.
    """
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    counted = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    counted = counted.select("bucket", count("s").alias("s"), count("t").alias("t"))
    whole = Window.partitionBy()  # one row for each bucket
    ratio = ((F.col("t") + 1) * (F.sum("s").over(whole) + buckets)) / ((F.col("s") + 1) * (F.sum("t").over(whole) + buckets))
    rows = counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").toArrow()
    return rows.column("gain").to_numpy().astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the weight is the sum of the gains of the document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = shared.value
        for batch in pieces(batches):
            n = batch.num_rows
            words, features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for section in sections(as_bytes(batch.column(1))):
                text, bucket = section_buckets(*section, len(of_bucket))
                words += np.bincount(section[1][~section[2]], minlength=n)
                features += np.bincount(text, minlength=n)
                weight += np.bincount(text, of_bucket[bucket], n).astype(np.int64)  # whole numbers far below 2 ** 53
            yield pa.record_batch([batch.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """A Gumbel variable in thousandths, the same for an id in every run; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, without replacement, in proportion to exp(weight / 1000).

    Returns ``(doc_id, n_words, n_features, weight, score, rank)`` of every row; the rank, from 1, is null where a
    document is not drawn. The draw is the highest sums of weight and noise (ties: the smaller id, null last), found
    by a range-partitioned sort. Texts are read twice, to count and to weigh; the counts are one row a bucket.

    Null and empty texts have no feature and weight 0. Repeated rows are drawn each. An empty target gives gains by the
    corpus alone. No rows give no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs.select(text_col)), bucket_counts(target.select(target_col)))
    rows = weigh(docs, gain, id_col, text_col)
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * percent // 100
    ranked = global_row_number(rows.where(able), [F.desc("score"), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1).cast("long"))
    return ranked.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
