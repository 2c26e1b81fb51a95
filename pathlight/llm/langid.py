"""Language identification by compression with a dictionary of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlight.llm.common import pieces

#: Documents of a language whose text goes into its dictionary, those of the smallest hash of their id.
SAMPLE_DOCS = 64
#: Characters of each of them at most, and bytes of a dictionary.
SAMPLE_CHARS, DICT_BYTES = 4_000, 96 << 10
#: Languages that are learned at most, those of the most documents; ``lang`` may hold any dirt.
MOST_LANGS = 64
#: Bytes of normalised text that are compressed at once: all of it is, block by block.
BLOCK = 2_048
LEVEL = 3
#: A text is rejected if the second-best language needs less than this share more bytes.
MARGIN = 0.002
#: Below this share the distinct words are compressed again, closely and in short blocks.
NARROW, CLOSE_LEVEL, CLOSE_BLOCK = 0.07, 19, 256
#: Blanks after each such block: zstandard stores a block that hardly shrinks, and sizes then say nothing.
PAD = b" " * 64
UNDETERMINED = "und"

_NOT_LETTERS = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}").search


def normalise(text: str) -> bytes:
    """Lower-case words with one blank between; ASCII digits and punctuation become blanks."""
    return b" ".join(text.lower().encode().translate(_NOT_LETTERS).split())


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionary content by language, from a bounded sample of the labelled rows.

    Rows with a null or undetermined language or without text are left out. The sample is what the driver gets:
    ``SAMPLE_DOCS`` documents of a language, ``SAMPLE_CHARS`` characters of each and ``DICT_BYTES`` of all at most, of
    ``MOST_LANGS`` languages at most; equal numbers of documents give the first by name. No rows give no language.
    """
    lang, text = F.col(lang_col), F.col(text_col)
    rows = docs.where(lang.isNotNull() & (lang != UNDETERMINED) & (F.length(text) > 0))
    order = Window.partitionBy("lang").orderBy("h", "text")
    langs = rows.groupBy(lang.alias("_l")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_l").limit(MOST_LANGS).select("_l")
    rows = rows.join(F.broadcast(langs), lang == F.col("_l"), "left_semi")
    picked = rows.select(
        lang.alias("lang"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("text")
    )
    picked = picked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    parts: dict[str, list[bytes]] = {}
    for row in sorted(picked.select("lang", "r", "text").collect(), key=lambda x: (x["lang"], x["r"])):
        parts.setdefault(row["lang"], []).append(normalise(row["text"]))
    return {k: b" ".join(v)[:DICT_BYTES] for k, v in parts.items()}


def compressor(content: bytes, level: int):
    d = zstd.ZstdCompressionDict(content.ljust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    made = zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return made.compress


def filled(content: bytes, size: int = DICT_BYTES) -> bytes:
    """The content as often as it takes to fill a dictionary of ``size`` bytes; the last bytes are the content's end."""
    content = content or b" "
    return (content * -(-size // len(content)))[-size:]


class Model:
    """Compressors of all languages; the one whose dictionary gives the fewest bytes names the language."""

    def __init__(self, contents: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin = sorted(contents), margin
        # Dictionaries of one size, each filled by saying its own content again, so a language of which little is known
        # changes nothing for the others.
        full = [filled(contents[k]) for k in self.langs]
        self.fast = [compressor(c, LEVEL) for c in full]
        self.close = [compressor(c, CLOSE_LEVEL) for c in full]

    def sizes(self, text: bytes) -> np.ndarray:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return np.array([sum(len(f(b)) for b in blocks) for f in self.fast], float)

    def close_sizes(self, text: bytes) -> np.ndarray:
        """Sizes of the distinct words, so that one word said a thousand times counts once."""
        words = list(dict.fromkeys(text.split()))
        blocks, at = [b""], 0
        for w in words:
            if len(blocks[at]) >= CLOSE_BLOCK:
                blocks.append(b"")
                at += 1
            blocks[at] += b" " + w
        return np.array([sum(len(f(b + PAD)) for b in blocks) for f in self.close], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected; the score is the share that the second best needs more."""
        if not self.langs or not text or not _LETTER(text):
            return UNDETERMINED, 0.0, True
        words = normalise(text) or b" "
        best, score = self.best(self.sizes(words))
        if score < NARROW:
            best, score = self.best(self.close_sizes(words))
        return self.langs[best], score, score < self.margin

    @staticmethod
    def best(sizes: np.ndarray) -> tuple[int, float]:
        order = np.argsort(sizes, kind="stable")
        return int(order[0]), float(1 - sizes[order[0]] / sizes[order[1]]) if len(order) > 1 else 1.0


def identify(
    docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN
) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row, the score in 0..1.

    A text that is null or has no letter is
    ``und`` with score 0, as is every text if no language was learned; both are rejected. A narrow margin keeps the
    best language and sets ``rejected``. Equal sizes give the first language by name and score 0. Whole texts are
    compressed, in blocks. Repeated rows stay; no rows give no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(contents, margin)
        for batch in pieces(batches):
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.record_batch([batch.column(0), *added], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, contents: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows whose language is identified; columns as in ``docs``, whatever their names.

    Null texts and texts without a letter go, as they are undetermined; repeated rows stay, each judged by its text.
    With no language learned all rows go; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(contents, margin)
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            keep = [not model.predict(t)[2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
