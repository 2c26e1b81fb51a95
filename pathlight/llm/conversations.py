"""Repair of conversation structure: the cheapest edits that make the roles alternate, with an audit of the edits.

Every row of a conversation is a symbol of its role and fault. A symbol is a min-plus matrix over the states of the role
pattern whose entries carry a rope of edits. Pairs of symbols that are frequent over all conversations become rules of a
grammar (Re-Pair); the matrix of a rule is made once, out of those of its parts, and used in every conversation.
Texts take no part in any of this: rows are known by a digest, and the edits meet the texts in one sorted shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pathlight.llm.common import pieces
from pathlight.operators.skew import least_in_group
from pathlight.plans.lineage import stored

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; those that may end a conversation.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
#: Where a role of each class (s, u, a, other) leads from each state that may take it.
MOVES = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIALS = "sua"
#: Symbols: 2 * class + truncated, and one for rows that must go, blank or duplicate.
MUST_GO = 8
#: Costs: a role changed, a row deleted, a row inserted, a truncated row left.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {(0, 1), (1, 2), (2, 1)}
_WHITE = " \t\n\v\f\r"
#: Rules of the grammar and passes that look for them at most, symbols that a rule stands for, and rows of a segment.
MOST_RULES, ROUNDS, LONGEST_RULE, SEGMENT = 128, 12, 1024, 10_000
#: Bytes of repaired text that a task holds of one conversation.
CHUNK = 1 << 20
_BREAK = 255


# Matrices and ropes: an entry is None or (cost, rope); a rope is a string or a pair of ropes.


def text_of(rope) -> str:
    """The edits of a rope."""
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and text_of(new[1]) < text_of(old[1]))


def product(a: list, b: list) -> list:
    """Min-plus product; equal costs go to the edits that are least in ASCII.

    Edits between two states over the same rows and of the same cost are no prefixes of one another, since inserted
    rows cost; so the least of a whole is made of the least of its parts.
    """
    out = [[None] * len(b[0]) for _ in a]
    for i, row in enumerate(a):
        for m, x in enumerate(row):
            for j, y in enumerate(b[m]) if x else ():
                if y and _better(new := (x[0] + y[0], (x[1], y[1])), out[i][j]):
                    out[i][j] = new
    return out


def _inserts() -> list:
    """Rows inserted at one place: none, one, or from the beginning two."""
    one = [[None] * 4 for _ in STATES]
    for i in STATES:
        one[i][i] = (0, "")
        for moves in MOVES[1:3]:
            if i in moves:
                one[i][moves[i]] = (INSERT, "I")
    return product(one, one)


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> list:
    """Rows inserted before a row, and what may be done with it."""
    out = [[None] * 4 for _ in STATES]
    kind, extra = divmod(symbol, 2)
    for i in STATES:
        out[i][i] = (DELETE, "D")
        if symbol == MUST_GO:
            continue
        for cost, letter, moves in [(0, "K", MOVES[kind]), (REROLE, "R", MOVES[1]), (REROLE, "R", MOVES[2])]:
            if i in moves and _better(new := (cost + extra * TRUNCATED, letter), out[i][moves[i]]):
                out[i][moves[i]] = new
    return product(INSERTS, out)


def grammar_matrices(rules: list[tuple[int, int]]) -> list:
    """Matrices of all symbols and rules, bottom-up; ropes are shared."""
    out = [symbol_matrix(s) for s in range(MUST_GO + 1)]
    for left, right in rules:
        out.append(product(out[left], out[right]))
    return out


def encode(symbols: bytes, rules: list[tuple[int, int]]) -> bytes:
    """The sequence with the rules put in, in their order."""
    for i, pair in enumerate(rules):
        symbols = symbols.replace(bytes(pair), bytes([MUST_GO + 1 + i]))
    return symbols


class Audit:
    """Edits of one conversation, fed with its encoded symbols: the cheapest way to each state so far.

    What all ways have in common is settled, so that what is compared stays short.
    """

    def __init__(self, matrices: list):
        self.matrices = matrices
        self.settled: list[str] = []
        self.ways: list = [(0, ""), None, None, None]

    def _take(self, matrix: list) -> None:
        out: list = [None] * 4
        for way, row in zip(self.ways, matrix, strict=True):
            for j, y in enumerate(row) if way else ():
                if y and ((old := out[j]) is None or way[0] + y[0] <= old[0]):
                    new = (way[0] + y[0], way[1] + y[1])
                    if old is None or new < old:
                        out[j] = new
        self.ways = out

    def feed(self, encoded: bytes) -> None:
        for n, symbol in enumerate(encoded, 1):
            self._take(self.matrices[symbol])
            if n % 64 == 0 or n == len(encoded):
                live = [w[1] for w in self.ways if w]
                common = len(os.path.commonprefix(live))
                if common > 256:
                    self.settled.append(live[0][:common])
                    self.ways = [w and (w[0], w[1][common:]) for w in self.ways]

    def end(self) -> tuple[int, str]:
        self._take([[y and (y[0], text_of(y[1])) for y in row] for row in INSERTS])
        cost, rest = min(self.ways[s] for s in ENDS if self.ways[s])
        return cost, "".join([*self.settled, rest])


def learn_grammar(sequences: DataFrame, most_rules: int = MOST_RULES, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Re-Pair over all ``sequences(symbols, n)``: the most frequent pairs become rules, until none occurs twice.

    A pass counts the pairs of all sequences (at most one number for each two of some hundred symbols) and takes the
    most frequent ones that share no symbol. The grammar only shortens the work; any grammar gives the same edits.
    """
    rules: list[tuple[int, int]] = []
    lengths = [1] * (MUST_GO + 1)
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], rules=tuple(rules)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << 16, np.int64)
            for batch in pieces(batches, 4096):
                parts = [encode(s, rules) + bytes([_BREAK]) for s in batch.column(0).to_pylist()]
                flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
                times = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(p) for p in parts])
                at = np.arange(len(flat))
                begun = np.maximum.accumulate(np.where(np.diff(flat, prepend=-1) != 0, at, 0))
                # Of a run of equal symbols only every other pair counts, as pairs do not overlap.
                ok = (flat[:-1] != flat[1:]) | ((at - begun)[:-1] % 2 == 0)
                total += np.bincount((flat[:-1] * 256 + flat[1:])[ok], times[:-1][ok], 1 << 16).astype(np.int64)
            hit = np.flatnonzero(total)
            yield pa.record_batch([pa.array(hit), pa.array(total[hit])], names=["pair", "n"])

        counts = sequences.select("symbols", "n").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")
        rows = [(r["n"], *divmod(r["pair"], 256)) for r in counts.collect()]
        rows = sorted((-n, a, b) for n, a, b in rows if _BREAK not in (a, b) and lengths[a] + lengths[b] <= LONGEST_RULE)
        used: set[int] = set()
        for n, a, b in rows:
            if len(rules) < most_rules and not {a, b} & used and -n * 20 >= -rows[0][0]:
                used |= {a, b}
                rules.append((a, b))
                lengths.append(lengths[a] + lengths[b])
        if not used:
            break
    return rules


# Rows, segments of conversations and decisions.

_KEY = ["turn", "role", "digest"]


def marked(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, blank, cut, text)``: null roles and texts as one space, and what a row shows by itself.

    ``blank``: no character but white space. ``cut``: the last other character ends no sentence.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    bare = F.btrim(text, F.lit(_WHITE))
    return rows.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), text.alias("text"),
    )


def _class(role: Column) -> Column:
    """0 to 2 for roles that begin with s, u or a, else 3."""
    place = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    return F.when((place == 0) | (role == ""), F.lit(3)).otherwise(place - 1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in pieces(batches, 2048):
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: StructType, most: int = 1024) -> Iterator[pa.RecordBatch]:
    arrow, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += row.pop("_size", 1)
        if len(held) >= most or size >= CHUNK:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _schema(df: DataFrame, names: list[str], more: str) -> StructType:
    return StructType([df.schema[n] for n in names] + StructType.fromDDL(more).fields)


def known_rows(rows: DataFrame) -> DataFrame:
    """The distinct rows of ``marked`` ones with ``copies``, ``is_first`` (no equal role and text before) and ``kind``.

    Repeated rows are told once, so what follows works on digests. A role and text that one conversation repeats over
    and over is dealt in slices.
    """
    own = rows.groupBy("conv_id", *_KEY, "blank", "cut").agg(F.count("*").alias("copies"))
    own = stored(own.withColumn("kind", _class(F.col("role"))), "conversation-rows")
    return least_in_group(own, ["conv_id", "role", "digest"], "turn", F.col("turn").asc_nulls_first(), "is_first")


def counts(known: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated)``; turns that are null leave no gap."""
    lone = F.col("is_first") & ~F.col("blank")
    return known.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("is_first").cast("int"))).alias("duplicate"),
        F.count_if(lone & F.col("cut")).alias("truncated"),
    )


def segments(known: DataFrame) -> DataFrame:
    """Conversations as strings of symbols, in parts of at most ``SEGMENT`` distinct rows, of ``known_rows``.

    A part is placed by its first row (``turn``, ``role``, ``digest``) and lists the ``turns``, ``roles``, ``digests``
    and ``copies`` of its rows; ``illegal`` are the neighbours that the pattern has not, ``edges`` the classes of its
    first and last row. Rows are range-partitioned by conversation and turn, so a long conversation is many tasks' work.
    """
    order = ["conv_id", *_KEY]
    rows = known.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _schema(rows, order, "symbols binary, edges binary, illegal long, turns array<long>, roles array<string>, digests array<binary>, copies array<long>")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cur: dict | None = None
        for r in _groups(batches):
            n, kind = r["copies"], r["kind"]
            if cur is None or cur["conv_id"] != r["conv_id"] or len(cur["turns"]) >= SEGMENT:
                if cur is not None:
                    yield _closed(cur)
                cur = {c: r[c] for c in order} | {"symbols": [], "edges": [kind, kind], "illegal": 0, "turns": [], "roles": [], "digests": [], "copies": []}
            elif (cur["edges"][1], kind) not in LEGAL:
                cur["illegal"] += 1
            cur["illegal"] += n - 1  # a role beside itself
            cur["edges"][1] = kind
            symbol = MUST_GO if r["blank"] or not r["is_first"] else 2 * kind + r["cut"]
            cur["symbols"].append(bytes([symbol]) + bytes([MUST_GO]) * (n - 1))
            for c in _KEY:
                cur[c + "s"].append(r[c])
            cur["copies"].append(n)
        if cur is not None:
            yield _closed(cur)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(parts(batches), schema)

    return rows.select(*order, "blank", "cut", "copies", "is_first", "kind").mapInArrow(run, schema)


def _closed(part: dict) -> dict:
    return part | {"symbols": b"".join(part["symbols"]), "edges": bytes(part["edges"]), "_size": 64 * len(part["turns"])}


class _Walk:
    """Goes along an audit and tells the edits of one row after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.rows_end = len(audit.rstrip("I"))

    def _role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "a" if self.state == ASSISTANT else "u"

    def edits(self, role: str, copies: int) -> str:
        """K and D as in the audit, U and A change the role, u and a are rows inserted before (and after the last row)."""
        told = []
        while copies or (self.rows_end == self.at < len(self.audit)):
            letter = self.audit[self.at]
            self.at += 1
            if letter == "I":
                told.append(self._role())
                continue
            copies -= 1
            if letter == "R":
                told.append(self._role().upper())
            else:
                told.append(letter)
            if letter == "K":
                if self.state == START and role.startswith("s"):
                    self.state = SYSTEM
                else:
                    self._role()
            if self.at < self.rows_end and not copies:
                break
        return "".join(told)


def decide(parts: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Verdicts and edits of conversations from their ``segments``.

    Rows with a ``cost`` are verdicts: ``(conv_id, illegal, cost, audit)``; the others are the edits of a segment:
    ``turns``, ``roles``, ``digests``, ``edits``. A conversation's audit is one value, so its segments (neither its rows
    nor its texts) come to one task, the symbols of all of them before the rows of any.
    """
    shared = parts.sparkSession.sparkContext.broadcast(rules)
    head = parts.select("conv_id", F.lit(0).alias("phase"), *_KEY, "symbols", "edges", "illegal")
    body = parts.select("conv_id", F.lit(1).alias("phase"), *_KEY, "turns", "roles", "digests", "copies")
    both = head.unionByName(body, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "phase", *_KEY)
    schema = _schema(parts, ["conv_id"], "illegal long, cost long, audit string, turns array<long>, roles array<string>, digests array<binary>, edits array<string>")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rules = shared.value
        matrices = [[[y and (y[0], text_of(y[1])) for y in row] for row in m] for m in grammar_matrices(rules)]
        phase, way, walk, illegal, last = 1, Audit(matrices), _Walk(""), 0, 0
        for r in _groups(batches):
            if r["phase"] == 0:
                if phase == 1:  # another conversation
                    way, illegal = Audit(matrices), 0
                elif (last, r["edges"][0]) not in LEGAL:
                    illegal += 1
                phase, last = 0, r["edges"][1]
                illegal += r["illegal"]
                way.feed(encode(r["symbols"], rules))
                continue
            if phase == 0:
                phase = 1
                cost, audit = way.end()
                walk = _Walk(audit)
                yield {"conv_id": r["conv_id"], "illegal": illegal, "cost": cost, "audit": audit, "_size": len(audit)}
            edits = [walk.edits(role, n) for role, n in zip(r["roles"], r["copies"], strict=True)]
            yield {c: r[c] for c in ("conv_id", "turns", "roles", "digests")} | {"edits": edits, "_size": 64 * len(edits)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(told(batches), schema)

    return both.mapInArrow(run, schema)


@dataclass
class Repair:
    """``verdicts``: one row a conversation; ``edits``: what to do with each distinct row, see ``_Walk.edits``."""

    verdicts: DataFrame
    edits: DataFrame
    rules: list[tuple[int, int]]


def repair(rows: DataFrame) -> Repair:
    """The cheapest edits of ``rows(conv_id, turn, role, text)`` that give role initials ``(s?(ua)+)?``.

    Rows of a conversation are taken by turn (null first), then role, then MD5 of the text. A row may be kept, be given
    the role user or assistant (2), or be deleted (3, required for a blank row or one whose role and text came before);
    rows without text may be inserted (2); a row left that ends in the middle of a sentence costs 1 more. Of the cheapest
    audits (initials of the edits in order) the least in ASCII is taken.

    ``verdicts``: ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``, a null id being one
    conversation. Null roles and texts are one space. Repeated rows are duplicates. No rows give no rows; other columns
    are ignored.
    """
    known = stored(known_rows(marked(rows)), "known-rows")
    parts = stored(segments(known), "segments")
    rules = learn_grammar(stored(parts.groupBy("symbols").agg(F.count("*").alias("n")), "sequences"))
    told = stored(decide(parts, rules), "decisions")
    found = told.where(F.col("cost").isNotNull()).select(F.col("conv_id").alias("_id"), "illegal", "cost", "audit")
    counted = counts(known)
    verdicts = counted.join(found, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    each = told.where(F.col("edits").isNotNull()).select("conv_id", F.explode(F.arrays_zip("turns", "roles", "digests", "edits")).alias("e"))
    edits = each.select("conv_id", F.col("e.turns").alias("turn"), F.col("e.roles").alias("role"), F.col("e.digests").alias("digest"), "e.edits")
    return Repair(verdicts, edits, rules)


_ROLES = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows after the edits, of edits and texts sorted by row with the edits first; copies of a text are passed over."""
    edits = None
    for r in _groups(batches):
        if r["edits"] is not None:
            edits = r["edits"]
            continue
        for n, e in enumerate(edits or ""):
            if e != "D":
                text = "" if e in "ua" else r["text"]
                yield {c: r[c] for c in ("conv_id", *_KEY)} | {"n": n, "edit": e, "new_role": _ROLES.get(e, r["role"]), "text": text, "_size": len(text) + 64}
        edits = None


def _merged(rows: DataFrame, fixed: Repair) -> DataFrame:
    """Texts and edits in the order of the rows: one range shuffle, which spreads a long conversation."""
    order = ["conv_id", *_KEY]
    texts = marked(rows).select(*order, F.lit(None).cast("string").alias("edits"), "text")
    both = fixed.edits.select(*order, "edits", F.lit(None).cast("string").alias("text")).unionByName(texts)
    return both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("edits").asc_nulls_last())


def repaired_rows(rows: DataFrame, fixed: Repair) -> DataFrame:
    """``(conv_id, turn, role, digest, n, edit, new_role, text)``: the rows after repair.

    Rows stand in the order of ``conv_id, turn, role, digest, n``, the first four being those of the row that an edit
    stands at; ``role`` is the old role. ``edit``: K, U or A (role changed), u or a (inserted). Cases as in ``repair``.
    """
    both = _merged(rows, fixed)
    schema = _schema(both, ["conv_id", *_KEY], "n int, edit string, new_role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_repaired(batches), schema)

    return both.mapInArrow(run, schema)


def repaired_digests(rows: DataFrame, fixed: Repair) -> DataFrame:
    """``(conv_id, sha256)`` of ``role:text`` of the repaired rows, joined by line feeds, where any are left.

    Conversations inside one range of rows and of up to ``CHUNK`` bytes are hashed where they are; of others the bytes
    go on in chunks to one task each, which holds one chunk at a time.
    """
    both = _merged(rows, fixed)
    schema = _schema(both, ["conv_id", *_KEY], "no int, chunk binary, sha256 string")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cur, first = None, True

        def chunk(c: dict) -> dict:
            out = c["place"] | {"no": c["no"], "chunk": b"".join(c["held"]), "_size": c["size"]}
            c["no"], c["held"], c["size"] = c["no"] + 1, [], 0
            return out

        for r in _repaired(batches):
            if cur is None or cur["place"]["conv_id"] != r["conv_id"]:
                if cur is not None:
                    if first or cur["no"]:
                        yield chunk(cur)
                    else:
                        yield {"conv_id": cur["place"]["conv_id"], "sha256": hashlib.sha256(b"".join(cur["held"])[1:]).hexdigest()}
                    first = False
                cur = {"place": {c: r[c] for c in ("conv_id", *_KEY)}, "no": 0, "held": [], "size": 0}
            line = f"\n{r['new_role']}:{r['text']}".encode()
            cur["held"].append(line)
            cur["size"] += len(line)
            if cur["size"] >= CHUNK:
                yield chunk(cur)
        if cur is not None:
            yield chunk(cur)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(parts(batches), schema)

    made = stored(both.mapInArrow(run, schema), "repaired")
    schema2 = _schema(made, ["conv_id"], "sha256 string")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, sha, any_ = None, None, False
        for batch in pieces(batches, 1):
            r = batch.to_pylist()[0]
            if not any_ or r["conv_id"] != conv:
                if any_:
                    yield {"conv_id": conv, "sha256": sha.hexdigest()}
                conv, sha, any_ = r["conv_id"], hashlib.sha256(r["chunk"][1:]), True
            else:
                sha.update(r["chunk"])
        if any_:
            yield {"conv_id": conv, "sha256": sha.hexdigest()}

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(whole(batches), schema2)

    open_ = made.where(F.col("sha256").isNull()).repartition("conv_id").sortWithinPartitions("conv_id", *_KEY, "no")
    return made.where(F.col("sha256").isNotNull()).select("conv_id", "sha256").unionByName(open_.select("conv_id", "chunk").mapInArrow(end, schema2))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults planted by crc32 of ``conv_id:turn`` modulo 20, nulls (ids and turns too) as one space there.

    0 drops the row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(one("role"))
    copies = F.when(code == 3, F.lit(2)).otherwise(F.lit(1))
    made = rows.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"))
    return made.drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row for each conversation id: what ``repair`` tells about the ``damaged`` rows, and the digest after repair.

    Conversations without a row after the damage have zeros, an empty audit and the digest of an empty text.
    """
    rows = damaged(conversations)
    fixed = repair(rows)
    digests = repaired_digests(rows, fixed).select(F.col("conv_id").alias("_id"), "sha256")
    ids = conversations.select(F.col("conv_id").alias("_of")).distinct()
    found = ids.join(fixed.verdicts, F.col("_of").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(digests, F.col("_of").eqNullSafe(F.col("_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return found.select(F.col("_of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))
