"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import as_bytes, pieces
from pathlight.operators.levels import LevelTable
from pathlight.plans.lineage import scratch_path, shuffles_end_with_queries

#: The token that ends a text; no word holds a line feed.
END = b"\n"
#: Times that a context with its next word must occur to be a node of the tree.
MIN_COUNT = 3
#: Words a context may have; the tree ends before where no context passes the test.
DEPTH = 4
#: Nats that a context must gain over its suffix, summed over its training occurrences, to stay in the tree.
MIN_GAIN = 12.0
#: Taken off the count of each next symbol and given to the shorter context.
DISCOUNT = 0.5
#: Tokens of the texts that are worked on together, as one row; a longer text makes a chunk of its own.
CHUNK = 1 << 19
#: Keys, by their hash, that a task counts at once, about.
SHARD = 1 << 20
#: Steps of a back-off's log10 in one: the bytes beyond are noise that can't be packed.
STEPS = 2.0**36
#: What chunks ask about: grams (their counts) and contexts (whether they are kept).
GRAMS, CONTEXTS = 0, 1


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only) and the end."""
    return [*(text or b"").lower().split(), END]


@dataclass
class Model:
    """What all chunks need to know: training tokens, distinct ones, the root's discount, and the options."""

    min_count: int
    min_gain: float
    depth: int
    total: int = 0
    distinct: int = 0
    discount: float = 0.5

    @property
    def unseen(self) -> float:
        """Probability of a token outside the training words, as one symbol."""
        return max(self.discount * self.distinct / self.total, 1e-12) if self.total else 1.0


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of a gram from those of the gram without its last and without its first word."""
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (after << np.uint64(31) | after >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _chunk_schema(kind: str) -> str:
    """A chunk: its texts, and the numbers of their tokens among its words, which are sorted hashes."""
    return f"chunk long, doc_id array<{kind}>, held_out array<boolean>, n_tokens long, starts binary, ids binary, words binary"


_ASKED = "shard long, chunk long, kind int, keys binary, values binary"
_ANSWERS = "chunk long, kind int, shard long, answer binary"


def _packed(x: np.ndarray) -> bytes:
    """Numbers, first bytes first, so that what they have in common lies together and is compressed well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unpacked(x: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _zipped(x: np.ndarray) -> bytes:
    """Packed and compressed, so that what chunks and shards tell one another is small before Spark moves it."""
    return zstd.ZstdCompressor(level=1).compress(_packed(x))


def _unzipped(x: bytes, dtype: str) -> np.ndarray:
    return _unpacked(zstd.ZstdDecompressor().decompress(x), dtype)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each stands, and for each place the number of its value."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


def _cut(size: int, id_type: pa.DataType):
    """Texts as chunks of about ``size`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, memory = TaskContext.get().partitionId() << 32, _Hashes()
        held, docs, flags, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal chunk, n
            starts = np.cumsum([0, *map(len, held)])[:-1]
            words, ids = np.unique(np.concatenate(held), return_inverse=True)
            columns = {
                "chunk": pa.array([chunk], pa.int64()),
                "doc_id": pa.array([list(docs)], pa.list_(id_type)),
                "held_out": pa.array([list(flags)], pa.list_(pa.bool_())),
                "n_tokens": pa.array([len(ids)], pa.int64()),
                "starts": pa.array([starts.astype("<i8").tobytes()], pa.binary()),
                "ids": pa.array([_packed(ids.astype("<i4"))], pa.binary()),
                "words": pa.array([_packed(words)], pa.binary()),
            }
            chunk, n = chunk + 1, 0
            for x in (held, docs, flags):
                x.clear()
            if len(memory) > 1_000_000:
                memory.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in pieces(batches, 256):
            for i, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                ws = tokens(text)
                held.append(np.fromiter(map(memory.__getitem__, ws), np.uint64, len(ws)))
                docs.append(i)
                flags.append(held_out)
                n += len(ws)
                if n >= size:
                    yield out()
        if held:
            yield out()

    return run


@dataclass
class Level:
    """Grams of one length that are nodes: by position the number of the gram that ends there, -1 if it is none.

    By number its hash, its count, the numbers of the grams of the level before without its last and first word, and
    log10 of its last word's probability after the others by the longest context that is kept, and whether this chunk
    answers for it.
    """

    at: np.ndarray
    keys: np.ndarray
    n: np.ndarray
    before: np.ndarray
    after: np.ndarray
    resolved: np.ndarray
    own: np.ndarray


class Chunk:
    """The levels of a chunk as far as they were answered."""

    def __init__(self, chunks: pa.Table, answers: pa.Table, model: Model):
        self.row, self.model = chunks.to_pylist()[0], model
        self.starts = np.frombuffer(self.row["starts"], "<i8")
        self.ids = _unpacked(self.row["ids"], "<i4")
        self.words = _unpacked(self.row["words"], "<u8")
        self.train = np.repeat(~np.array(self.row["held_out"], bool), np.diff(np.append(self.starts, len(self.ids))))
        self.answers: dict = {}  # by kind and depth, in the order of the hashes
        parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "depth", "shard", "answer")), strict=True))
        for kind, depth, _, answer in parts:
            self.answers.setdefault((kind, depth), []).append(_unzipped(answer, "<f8" if kind == CONTEXTS else "<i8"))
        self.levels: list[Level] = []
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []  # by depth of the context: whether a node of the level is kept, and its back-off

    def answer(self, kind: int, depth: int, keys: np.ndarray) -> np.ndarray:
        """The answers about keys, which are sorted, as answers are."""
        return np.concatenate(self.answers[kind, depth]) if len(keys) else np.zeros(0, np.float64 if kind == CONTEXTS else np.int64)

    def contexts(self, level: Level) -> np.ndarray:
        """For each position the number of the gram that ends before it in its text, -1 if it is no node."""
        before = np.full(len(level.at), -1, np.int64)
        before[1:] = level.at[:-1]
        before[self.starts] = -1
        return before

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams one word longer than the last level's whose parts are nodes: sorted hashes, both parts, places, positions.

        A gram is at most as frequent as its parts, so none that is frequent enough is missed.
        """
        level = self.levels[-1]
        before = self.contexts(level)
        ok = np.flatnonzero((before >= 0) & (level.at >= 0))
        first, second = before[ok], level.at[ok]
        keys, one, place = _distinct(_joined(level.keys[first], level.keys[second]))
        return keys, first[one], second[one], place, ok

    def build(self, grams: int, contexts: int) -> None:
        """The levels, with grams of up to ``grams`` words beside the first and contexts of up to ``contexts`` words."""
        m = self.model
        self.counts = self.answer(GRAMS, 0, self.words) >> 1
        nodes = np.flatnonzero(self.counts >= m.min_count)
        number = np.full(len(self.words), -1, np.int64)
        number[nodes] = np.arange(len(nodes))
        c, none = self.counts[nodes], np.zeros(0, np.int64)
        root = np.log10((c - m.discount) / max(m.total, 1))
        self.levels.append(Level(number[self.ids], self.words[nodes], c, none, none, root, none))
        for d in range(1, grams + 1):
            last, (keys, first, second, place, ok) = self.levels[-1], self.candidates()
            told = self.answer(GRAMS, d, keys)
            n = told >> 1
            nodes = np.flatnonzero(n)
            number = np.full(len(keys), -1, np.int64)
            number[nodes] = np.arange(len(nodes))
            here = np.full(len(self.ids), -1, np.int64)
            here[ok] = number[place]
            level = Level(here, keys[nodes], n[nodes], first[nodes], second[nodes], np.zeros(0), told[nodes] & 1 == 1)
            if d <= contexts:
                self._resolve(d, level)
            self.levels.append(level)

    def _resolve(self, d: int, level: Level) -> None:
        """Which contexts of ``d`` words are kept, and with that the probabilities of the level's words."""
        last = self.levels[d - 1]
        used = self.used(last)
        back = np.full(len(last.keys), np.nan)
        back[used] = self.answer(CONTEXTS, d, last.keys[used])
        kept = ~np.isnan(back)
        self.kept.append((kept, back))
        level.resolved = np.where(kept[level.before], np.log10(self.share(level, last)), last.resolved[level.after])

    def used(self, level: Level) -> np.ndarray:
        """The grams of a level that a word follows."""
        before = self.contexts(level)
        met = np.zeros(len(level.keys), bool)
        met[before[before >= 0]] = True
        return np.flatnonzero(met)

    @staticmethod
    def share(level: Level, last: Level) -> np.ndarray:
        """Discounted share that a context's next words have of it."""
        return (level.n - DISCOUNT) / last.n[level.before]

    def ask_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the candidates and how often they occur in the training texts of this chunk."""
        keys, _, _, place, ok = self.candidates()
        return keys, np.bincount(place[self.train[ok]], minlength=len(keys))

    def ask_contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the contexts met, and for each the sums of gain, discounted count and shorter context's share, and its
        count.

        The sums are over the nodes of the last level that this chunk answers for, so that each node counts once. Where
        there are none the count is 0 too; counts are packed smaller than shares.
        """
        level, last = self.levels[-1], self.levels[-2]
        p, lower = self.share(level, last), 10.0 ** last.resolved[level.after]
        of, own, used = level.before[level.own], level.own, self.used(last)
        sums = [np.bincount(of, x[own], len(last.keys))[used] for x in (level.n * np.log(p / lower), level.n - DISCOUNT, lower)]
        return last.keys[used], np.stack([*sums, np.where(sums[1] > 0, last.n[used], 0)], axis=1)

    def scores(self) -> np.ndarray:
        """log10 probability of each token by the longest context."""
        m = self.model
        root = np.full(len(self.words), np.log10(m.unseen))
        seen = self.counts > 0
        root[seen] = np.log10((self.counts[seen] - m.discount) / max(m.total, 1))
        logs = root[self.ids]
        for d, (kept, back) in enumerate(self.kept, 1):
            level, before = self.levels[d], self.contexts(self.levels[d - 1])
            ok = np.flatnonzero(before >= 0)
            ok = ok[kept[before[ok]]]
            logs[ok] += back[before[ok]]
            ok = ok[level.at[ok] >= 0]
            logs[ok] = level.resolved[level.at[ok]]
        return logs


def _asked(kind: int, keys: np.ndarray, values: np.ndarray, chunk: int, shards: int) -> pa.Table:
    """What a chunk asks, a row for each shard of the hashes; keys are sorted, and so are the shards."""
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    at = np.flatnonzero(np.diff(shard, prepend=np.uint64(shards)))
    ends = np.append(at, len(keys))[1:]
    columns = {
        "shard": pa.array(shard[at].astype(np.int64)),
        "chunk": pa.array(np.full(len(at), chunk, np.int64)),
        "kind": pa.array(np.full(len(at), kind, np.int32)),
        "keys": pa.array([_zipped(keys[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary()),
        "values": pa.array([_zipped(np.ascontiguousarray(values[i:j].T).reshape(-1)) for i, j in zip(at, ends, strict=True)], pa.binary()),
    }
    return pa.table(columns)


def _ask(model: Model, step: int, shards: int):
    """What chunks ask, knowing the grams of ``step`` words beside the first: their contexts, and the grams of a word more."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(chunks, answers, model)
        number, out = c.row["chunk"], []
        if step < 0:
            times = np.bincount(c.ids[c.train], minlength=len(c.words))
            return _asked(GRAMS, c.words, times, number, shards)
        c.build(step, step - 1)
        if step > 0:
            out.append(_asked(CONTEXTS, *c.ask_contexts(), number, shards))
        if step < model.depth:
            out.append(_asked(GRAMS, *c.ask_grams(), number, shards))
        return pa.concat_tables(out)

    return run


def _answer(limit: int, min_gain: float):
    """Answers to what all chunks ask about the hashes of a shard.

    Grams: twice how often they occur in all, which is 0 below ``limit``, and one more for the one chunk that answers for
    the gram. Contexts: the back-off of those that are kept, in steps of ``STEPS``, else no number. A context stays if its next symbols, as counted, gain
    at least ``min_gain`` nats over its suffix, which is their number times the divergence restricted to the symbols
    that are nodes.
    """

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("chunk")  # sums are taken in the same order in every run
        kind = asked.column("kind")[0].as_py()
        parts = [_unzipped(k, "<u8") for k in asked.column("keys").to_pylist()]
        values = [_unzipped(v, "<i8" if kind == GRAMS else "<f8") for v in asked.column("values").to_pylist()]
        _, first, place = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        if kind == GRAMS:
            n = np.bincount(place, np.concatenate(values), len(first)).astype(np.int64)
            n[n < limit] = 0
            out = n[place] << 1
            out[first] |= 1
        else:
            *sums, counts = np.concatenate([x.reshape(4, -1) for x in values], axis=1)
            gain, taken, below = (np.bincount(place, x, len(first)) for x in sums)
            n = np.ones(len(first))
            n[place[counts > 0]] = counts[counts > 0]
            mass = taken / n
            left, rest = 1 - mass, 1 - below
            kept = (gain >= min_gain) & (left > 1e-9) & (rest > 1e-9)
            back = np.full(len(first), np.nan)
            back[kept] = np.rint(np.log10(left[kept] / rest[kept]) * STEPS) / STEPS
            out = back[place]
        answers = [_zipped(x) for x in np.split(out, np.cumsum([len(x) for x in parts])[:-1])]
        return pa.table({"chunk": asked.column("chunk"), "kind": asked.column("kind"), "shard": asked.column("shard"), "answer": pa.array(answers, pa.binary())})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens, distinct ones and those seen once and twice, from answers about words; and contexts that are kept."""
    for batch in batches:
        n = np.zeros(5, np.int64)
        for kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if kind == CONTEXTS:
                n[4] += int((~np.isnan(_unzipped(x, "<f8"))).sum())
            else:
                c = _unzipped(x, "<i8")
                c = c[c & 1 == 1] >> 1
                c = c[c > 0]
                n[:4] += [c.sum(), len(c), (c == 1).sum(), (c == 2).sum()]
        yield pa.RecordBatch.from_pydict({k: pa.array([int(v)]) for k, v in zip(("n", "v", "n1", "n2", "kept"), n, strict=True)})


def _finish(model: Model, depth: int, id_type: pa.DataType, by_token: bool):
    """Scores of the texts of a chunk by contexts of up to ``depth`` words."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(chunks, answers, model)
        c.build(depth, depth)
        row = c.row
        logs, of = c.scores(), c.counts[c.ids]
        base = np.log10((of + 1) / (model.total + (model.distinct + 1)))
        n = np.diff(np.append(c.starts, len(c.ids)))
        columns = {
            "doc_id": pa.array(row["doc_id"], id_type),
            "held_out": pa.array(row["held_out"], pa.bool_()),
            "n_tokens": pa.array(n),
            "n_known": pa.array(np.add.reduceat((of > 0).astype(np.int64), c.starts)),
            "train_tokens": pa.array(np.full(len(n), model.total, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, c.starts)),
            "score": pa.array(np.add.reduceat(logs, c.starts)),
        }
        if by_token:
            columns["token_scores"] = pa.array([x.tolist() for x in np.split(logs, c.starts[1:])], pa.list_(pa.float64()))
        return pa.table(columns)

    return run


class _Chunks:
    """A table of chunks, bucketed by their number, so that answers meet them without an exchange of the chunks."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.spark, self.path, self.name = spark, scratch_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Rows are megabytes, so their sizes are looked at one by one.
        options = {"path": self.path, "compression": "zstd", "parquet.block.size": 32 << 20}
        options |= {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
        df.write.format("parquet").options(**options).bucketBy(self.buckets, "chunk").saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def met(self, answers: DataFrame, run, schema: str) -> DataFrame:
        return self.rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN,
    depth: int = DEPTH, chunk: int = CHUNK, by_token: bool = False,
) -> DataFrame:
    """Learn from the rows where ``train`` holds and score every row.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, with ``by_token`` also
    ``token_scores``. ``base_score`` sums log10((c + 1) / (N + (V + 1))) over the tokens. ``score`` is the tree's: the
    longest context that it holds gives the probability of a next word that is its node, and its back-off times that
    of the shorter context otherwise; without context a word of count c has (c - d) / N and all unseen words together
    d * V / N, with d from the words seen once and twice. Every context's probabilities sum to one over the training
    words and the unseen one. A node is any context of up to ``depth`` words that occurs ``min_count`` times or more
    with its next word; neither words nor nodes have a greatest number.

    Texts are read once and become chunks of about ``chunk`` tokens, which does not change results. For each depth the
    chunks ask, once for each distinct gram, how often it occurs in all, and tasks that hold a share of the hashes answer
    them; nothing is broadcast. Words and grams are told by 64 bits of hash. Null and empty texts are the end alone. With
    nothing to learn from, N and V are 0, the base score of a text is 0 and so is its score. Repeated rows stay. No
    rows give no rows. Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    held, text = ~F.coalesce(train, F.lit(False)), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text.alias("t"))
    schema = _chunk_schema(kind)
    chunks = _Chunks(rows.mapInArrow(_cut(chunk, id_type), schema))
    shards = max((chunks.rows.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD, chunks.buckets)
    model = Model(min_count, min_gain, depth)
    table = LevelTable(docs.sparkSession, "answers", "chunk")
    answers = docs.sparkSession.createDataFrame([], _ANSWERS + ", depth int")
    known = 0  # words of the longest contexts that are known
    with shuffles_end_with_queries(docs.sparkSession):
        for step in range(-1, depth + 1):
            asked = chunks.met(answers, _ask(model, step, shards), _ASKED)
            told = asked.groupBy("kind", "shard").applyInArrow(_answer(min_count if step >= 0 else 1, min_gain), _ANSWERS)
            of_grams, of_contexts = F.lit(step + 1), F.lit(step)
            told = told.withColumn("depth", F.when(F.col("kind") == GRAMS, of_grams).otherwise(of_contexts))
            table.add(told, step, deal=True)
            answers = table.rows()
            s = table.rows(step).select("kind", "answer").mapInArrow(_summed, "n long, v long, n1 long, n2 long, kept long")
            s = s.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in s.columns]).first() if step != 0 else None
            if step < 0:
                model.total, model.distinct = s["n"], s["v"]
                if s["n1"] and s["n2"]:
                    model.discount = s["n1"] / (s["n1"] + 2 * s["n2"])
                if not depth:
                    break
            elif step > 0:
                known = step
                if not s["kept"]:
                    break
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.met(answers, _finish(model, known, id_type, by_token), result + (", token_scores array<double>" if by_token else ""))
