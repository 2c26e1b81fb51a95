"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import KEPT, pieces

#: Above every rank.
NONE = 1 << 60
#: Bytes that one of the two halves of a Python worker's memory of encoded pieces may hold, those of one entry beside
#: its piece and ids, and the longest piece that is remembered.
REMEMBERED, ENTRY, LONGEST = 64 << 20, 200, 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file whose lines hold a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of the lowest rank is merged until no pair has a rank.

    Leaf i of the tree holds the rank of the pair that starts at the live token at byte i, each inner node the lesser
    of its children. A merge changes three leaves at most, so a piece of n bytes takes O(n log n).
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get = ranks.get
    tree = [NONE] * size + [get(piece[i : i + 2], NONE) for i in range(n - 1)] + [NONE] * (size - n + 1)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))  # of the live token that starts here
    before = list(range(-1, n - 1))  # start of the live token before
    while (low := tree[1]) != NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        j = end[i]
        stop = end[i] = end[j]
        h = before[i]
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]], NONE)
        else:
            rank = NONE
        # The new ranks of the pairs that start at the merged token, at its second part and at the token before.
        for at in (i, j, h):
            if at == j:
                rank = NONE
                if j >= n - 1:
                    continue
            elif at == h:
                if h < 0:
                    break
                rank = get(piece[h:stop], NONE)
            k = size + at
            tree[k] = rank
            while k > 1:
                other = tree[k ^ 1]
                if other < rank:
                    rank = other
                k >>= 1
                if tree[k] == rank:
                    break
                tree[k] = rank
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def ascii_pattern(pattern: str) -> str:
    """The pattern for ASCII texts in the standard library's syntax, which splits them faster."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        part = pattern[at : at + 5]
        if part in ("\\p{L}", "\\p{N}"):
            chars = "A-Za-z" if part[3] == "L" else "0-9"
            out.append(chars if inside else f"[{chars}]")
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        if step == 1 and pattern[at] in "[]":
            inside = pattern[at] == "["
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


class Memory(dict):
    """Encoded pieces; what falls out of the young half, once full, stays in the old one until that is replaced.

    Both halves are bounded in bytes, whatever the texts; long pieces, which hardly come twice, are not remembered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old, self.held = ranks, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            rank = self.ranks.get(data)
            ids = np.array([rank] if rank is not None else merge(data, self.ranks), "<u4").tobytes()
        if len(piece) <= LONGEST:
            self.held += ENTRY + 4 * len(piece) + len(ids)
            if self.held > REMEMBERED:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ascii_pattern(pattern), re.ASCII).findall
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known = Memory(self.ranks)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        found = self.find_ascii(text) if text.isascii() else self.find(text)
        return b"".join(map(self.known.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker, kept for its later tasks until another operator's begin."""
    return Codec(path, pattern)


def _kept_codec(path: str, pattern: str) -> Codec:
    KEPT["bpe"] = codec.cache_clear
    return codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the text's ids as bytes of little-endian unsigned 32-bit numbers, for each row.

    Null and empty texts have no ids. Every match of ``pattern`` is encoded separately, without special tokens. The
    rank file is read on the executors from ``path``, a parameter. Repeated rows stay; no rows give no rows; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _kept_codec(path, pattern)
        for batch in pieces(batches, operator="bpe"):
            ids = [c.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that ``ids`` stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _kept_codec(path, pattern)
        for batch in pieces(batches, operator="bpe"):
            out = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and decoded texts, ``with_ids`` the ``ids`` too.

    The same cases as in ``encode``: null and empty texts have no ids and the digests of nothing, repeated rows stay, no
    rows give no rows, other columns are ignored, and a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _kept_codec(path, pattern)
        for batch in pieces(batches, operator="bpe"):
            n, ids_sha, decoded_sha, every = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode(text) if text else b""
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                every.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(every), "<i4"))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
