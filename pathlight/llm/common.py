"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's form of the white space that separates words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANKS}", "")
    trimmed = F.regexp_replace(trimmed, f"{BLANKS}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANKS))).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()


#: What operators keep in this Python worker for their next tasks: by operator how to give it up.
KEPT: dict[str, Callable[[], None]] = {}


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, operator: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what a task holds at once is small.

    What operators other than ``operator`` keep in the worker is given up first, as their tasks have ended.
    """
    for other in [x for x in KEPT if x != operator]:
        KEPT.pop(other)()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
