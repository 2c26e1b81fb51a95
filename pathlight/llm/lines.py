"""Lines that stand in several documents, dropped everywhere but in the first of them; SQL functions only.

The lines' hashes are range-partitioned and sorted by hash and document, so the first document of a line is met first.
What comes out is no text but a keep bitmap for each document that loses a line; texts meet it in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.operators.skew import least_in_group
from pathlight.plans.lineage import stored

#: Code points of a key from which on a line may be dropped.
LEAST_CHARS = 10
_WHITE, _UPPER, _LOWER = " \t\n\v\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # then all of lower() is A-Z
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell rows apart: the id, and 128 bits of the text for ids that are null or repeated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``(id, t1, t2, keep)`` of every document that loses a line.

    ``keep`` is the bitmap in compressed form: ``(word, bits)`` of each stretch of 64 lines in which one is dropped,
    in order, a bit of 1 for a line that stays; stretches that are not listed stay whole. ``t1`` and ``t2`` are
    hashes of the text. Equal keys are told by 128 bits of hash.

    Null texts lose nothing. A null id comes after all others. Rows of one id are one document: they all keep the
    lines of which theirs is the smallest id. No rows give no rows; other columns are ignored.
    """
    lines = docs.select(*_identity(id_col, text_col), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    hashed = keyed.select("id", "t1", "t2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    found = least_in_group(stored(hashed, "lines"), ["h1", "h2"], "id", F.col("id").asc_nulls_last(), "stays")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = found.where(~F.col("stays")).groupBy("id", "t1", "t2", (F.col("pos") / 64).cast("int").alias("word"))
    words = words.agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("id", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _every_word(keep: Column) -> Column:
    """The bitmap's words up to the last one listed."""
    before = lambda i: F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
    gap = lambda e, i: F.array_repeat(F.lit(-1).cast("long"), e["word"] - before(i) - 1)
    return F.flatten(F.transform(keep, lambda e, i: F.concat(gap(e, i), F.array(e["bits"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of the lines kept, and ``n_lines`` and ``n_dropped`` (before and dropped).

    A text that loses nothing stays as it is, null included. Columns of these two names are replaced.
    """
    words = bitmaps.select("id", "t1", "t2", _every_word(F.col("keep")).alias("_words"))
    own = _identity(id_col, text_col)
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*rest).alias("_rest"), F.col(text_col).alias("_text"), F.struct(*own).alias("_own"))
    same = F.col("_own.id").eqNullSafe(F.col("id")) & (F.col("_own.t1") == F.col("t1")) & (F.col("_own.t2") == F.col("t2"))
    joined = rows.join(words, same, "left").select("_rest", "_text", "_words")
    lines = split_lines(F.col("_text"))
    bit = lambda i: F.call_function("shiftright", F.coalesce(F.get("_words", (i / 64).cast("int")), F.lit(-1).cast("long")), (i % 64).cast("int")).bitwiseAND(F.lit(1))
    kept = F.filter(lines, lambda _, i: bit(i) == 1)
    dropped = F.aggregate("_words", F.lit(0), lambda a, w: a + 64 - F.bit_count(w))
    made = joined.select(
        "_rest",
        F.when(F.col("_words").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.size(lines).cast("long").alias("_n"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("_d"),
    )
    named = [F.col("_text").alias(text_col), F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped")]
    return made.select(*named, *[F.col("_rest")[c].alias(c) for c in rest])


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without the repeated lines; see ``keep_bitmaps`` and ``apply_bitmaps`` for the cases."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, least_chars), id_col, text_col)
