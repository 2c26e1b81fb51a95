"""Line dedup, importance resampling and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import LONG
from pathlight.llm import conversations, lines, queries, resample
from pathlight.llm.common import table
from pathlight.operators import skew
from pyspark.sql import functions as F

WHITE = " \t\n\v\f\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows):
    """``(kept, n, dropped)`` of ``(id, text)`` rows, a null id after all others."""
    rank = lambda i: (i is None, i or 0)
    key = lambda x: lower(x.strip(WHITE))
    first = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), rank(i)), rank(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if first.get(key(x), rank(i)) == rank(i)]
        out.append(("\n".join(kept), len(every), len(every) - len(kept)))
    return out


def line_rows():
    r = random.Random(3)
    pool = ["a line of some length %d" % i for i in range(40)] + ["ÀÉ grüße Über ALLES", "àÉ grüße über alles", "short", "", "  \t"]
    pool += ["  A Line of SOME length 1\r", "\va line of some length 2\f", "ten chars!", "nine char", "日本語の長い行はここにあります"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 300 if i % 20 == 0 else 12)))) for i in range(60)]
    common = "\n".join("line that nearly all have" for _ in range(3))
    rows += [(100 + i, common + f"\nand one of its own {i}") for i in range(80)]
    return rows + [(None, "a line of some length 3\nwithout an id at all"), (None, None), (200, None), (201, ""), (5, rows[5][1]), (5, rows[5][1]), (202, LONG + "\n" + common)]


@pytest.mark.parametrize("least", [1_000, 1])
def test_lines_equal_plain(spark, least, monkeypatch):
    """With any limit of what counts as a large group the result is that of the plain version."""
    monkeypatch.setattr(skew.least_in_group, "__defaults__", (least,))
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("id", "t1", "t2", "keep", "pos", "line", "n_lines", "stays", "_h", "_salt", "_words", "_rest"):
        docs = docs.withColumn(name, F.lit("x"))
    got = lines.drop_repeated(docs)
    assert set(got.columns) >= {"doc_id", "text", "n_lines", "n_dropped", "id", "_words"}
    found = sorted((str(r["doc_id"]), r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect())
    assert found == sorted((str(i), *want) for (i, _), want in zip(rows, plain_lines(rows), strict=True))


def test_lines_keep_texts_that_lose_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "x\n\n"), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeated(docs).collect()} == {1: None, 2: "x\n\n", 3: ""}
    assert lines.drop_repeated(docs.where("false")).collect() == []
    assert lines.keep_bitmaps(docs).collect() == []


def test_keep_bitmap_lists_stretches_with_drops(spark):
    """Line 70 of the second document is dropped: one stretch, with one bit of 0."""
    mine = [f"line number {i:04d}" for i in range(200)]
    docs = spark.createDataFrame([(1, "the line in both"), (2, "\n".join([*mine[:70], "the line in both", *mine[70:]]))], "doc_id long, text string")
    (row,) = lines.keep_bitmaps(docs).collect()
    assert row["id"] == 2
    assert [(k["word"], k["bits"]) for k in row["keep"]] == [(1, ~(1 << 6))]


# Resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in runs]


def plain_resample(docs, targets, percent=5):
    s = Counter(itertools.chain(*(plain_features(t)[1] for _, t in docs)))
    t = Counter(itertools.chain(*(plain_features(x)[1] for x in targets)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)}
    rows = []
    for i, text in docs:
        n, found = plain_features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return rows, [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling_equals_plain(spark, sf, percent):
    docs = table(spark, sf, "documents").select("doc_id", "text").where("doc_id < 120")  # a fixture, not a query
    rows = [tuple(r) for r in docs.collect()]
    rows += [(900, None), (901, ""), (902, "... ,"), (903, "Ünï çødé 中文字符 " * 30), (904, "x" * 3000 + " y Z"), (None, "null id " * 30), (905, "tie " * 25), (905, "tie " * 25)]
    rows.append((906, "many words of a long text " * 60_000))
    targets = [r["text"] for r in table(spark, sf, "benchmark").collect()] + [None]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("weight", F.lit("w")).repartition(4)
    got = resample.resample(given, spark.createDataFrame([(t,) for t in targets], "text string"), percent).collect()
    want, drawn = plain_resample(rows, targets, percent)
    key = lambda r: str(r)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score")) for r in got), key=key) == sorted(want, key=key)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    assert resample.resample(none, one).collect() == []
    (r,) = resample.resample(one, none).collect()
    assert (r["n_features"], r["rank"]) == (6, None)


def test_crcs_by_length():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 5, 5, 9, 600]))) for _ in range(300)]
    ends = np.cumsum([len(p) for p in parts])
    got = resample.crcs(np.frombuffer(b"".join(parts), np.uint8), ends - np.array([len(p) for p in parts]), np.array([len(p) for p in parts]))
    assert got.tolist() == [zlib.crc32(p) for p in parts]


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 20])
def test_sections_do_not_matter(size):
    texts = [b"a b c d e f g a b c", None, b"", b"one", b"two words", b"word " * 200, "é日本 x".encode()]
    found = defaultdict(Counter)
    for section in resample.sections(texts, size):
        for text, bucket in zip(*resample.section_buckets(*section), strict=True):
            found[int(text)][int(bucket)] += 1
    for i, t in enumerate(texts):
        assert found[i] == Counter(plain_features((t or b"").decode())[1])


# Conversations


def plain_repair(rows):
    """Best ``(cost, audit, repaired)`` over all edits of ``(role, text, must_go, cut)`` rows, by a search of states."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    inserts = [("u", "user:"), ("a", "assistant:")]
    ways = {"": (0, "", ())}

    def grow(ways):
        for _ in range(3):
            for state, (c, audit, out) in list(ways.items()):
                for initial, line in inserts:
                    to = move.get((state, initial))
                    new = (c + 2, audit + "I", (*out, line))
                    if to is not None and (to not in ways or new[:2] < ways[to][:2]):
                        ways[to] = new
        return ways

    for role, text, must_go, cut in rows:
        after = {}
        for state, (c, audit, out) in grow(ways).items():
            options = [(state, (c + 3, audit + "D", out))]
            if not must_go:
                options += [(move.get((state, role[:1])), (c + cut, audit + "K", (*out, f"{role}:{text}")))]
                options += [(move.get((state, x[0])), (c + 2 + cut, audit + "R", (*out, f"{x}:{text}"))) for x in ("user", "assistant")]
            for to, new in options:
                if to is not None and (to not in after or new[:2] < after[to][:2]):
                    after[to] = new
        ways = after
    ways = grow(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def plain_verdicts(rows):
    """Of ``(conv, turn, role, text)`` rows the verdict of each conversation."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, marked, n = set(), [], Counter()
        for _, role, text in own:
            bare = text.strip(WHITE)
            blank, dup = not bare, (role, text) in seen
            cut = not blank and not dup and bare[-1] not in ".!?"
            n["blank"] += blank
            n["duplicate"] += dup and not blank
            n["truncated"] += cut
            seen.add((role, text))
            marked.append((role, text, blank or dup, cut))
        n["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, kept = plain_repair(marked)
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, sha)
    return out


def conversation_rows():
    r = random.Random(11)
    texts = ["Yes.", "No!", "why?", "cut off", " ", "", None, "Übung.", "line\nbreak.", "again", "x.\t "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown", "u"]
    rows = []
    for conv in range(70):
        for i in range(r.randint(1, 14)):
            rows.append((conv, r.choice([i, i, i, 2 * i, None]), r.choice(roles[: r.choice([2, 3, 10])]), r.choice(texts) if r.random() < 0.5 else f"text {conv} {i}."))
    rows += [(None, 1, "user", "null id."), (None, None, "user", "null id and turn."), (None, 5, "user", "null id."), (99, None, None, None)]
    rows += [(77, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(500)]
    rows += [(78, i, "user", "always the same.") for i in range(300)] + [(79, 3, "user", "one row many times.")] * 40
    rows += [(80, i, ("user", "assistant", "assistant", "system")[i * i % 4], f"{i}") for i in range(300)]
    return rows + [(81, 1, "user", "x " * 900_000 + "."), (81, 2, "assistant", "y " * 900_000 + ".")]


@pytest.mark.parametrize(("segment", "least"), [(10_000, 1_000), (7, 1)])
def test_repair_equals_plain(spark, segment, least, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(skew.least_in_group, "__defaults__", (least,))
    rows = conversation_rows()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for name in ("cost", "kind", "copies", "digest", "edits", "_id", "n"):
        given = given.withColumn(name, F.lit(1))
    fixed = conversations.repair(given)
    shas = {r["conv_id"]: r["sha256"] for r in conversations.repaired_digests(given, fixed).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r["conv_id"]: (*(r[c] for c in names), shas.get(r["conv_id"], empty)) for r in fixed.verdicts.collect()}
    assert got == plain_verdicts(rows)
    assert len(fixed.rules) > 5
    order = ["conv_id", "turn", "role", "digest", "n"]
    lines_of = defaultdict(list)
    for r in conversations.repaired_rows(given, fixed).orderBy(*order).collect():
        lines_of[r["conv_id"]].append(f"{r['new_role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines_of.items()} == shas


def test_repair_of_nothing_and_of_dropped_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_damaged(none).collect() == []
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (r,) = conversations.repair_damaged(spark.createDataFrame([(5, turn, "user", "gone.")], none.schema)).collect()
    assert (r["conv_id"], r["gaps"], r["cost"], r["audit"], r["repaired_sha256"]) == (5, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (1, None) for t in [*range(60), None]]
    got = Counter(map(tuple, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code:
            want[(c, t, "user" if code == 4 else role, {1: "", 2: "One Two Three"}.get(code, text))] += 1 + (code == 3)
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_any_grammar_gives_the_same_edits(seed):
    r = random.Random(seed)
    symbols = bytes(r.choice([2, 4, 2, 4, 2, 4, 3, 5, 8, 0, 6]) for _ in range(700))
    rules: list = []
    for _ in range(20):
        size = conversations.MUST_GO + 1 + len(rules)
        rules.append((r.randrange(size), r.randrange(size)) if r.random() < 0.3 else (2, 4) if len(rules) == 0 else (r.choice([2, 4, 9, 10]) % size, r.choice([2, 4, 9]) % size))
    plain = conversations.Audit([[[y and (y[0], conversations.text_of(y[1])) for y in row] for row in m] for m in conversations.grammar_matrices([])])
    coded = conversations.Audit([[[y and (y[0], conversations.text_of(y[1])) for y in row] for row in m] for m in conversations.grammar_matrices(rules)])
    plain.feed(symbols)
    coded.feed(conversations.encode(symbols, rules))
    assert plain.end() == coded.end()


def test_new_queries_have_whole_tables(spark, sf):
    docs = table(spark, sf, "documents").count()
    for name in ("op12_range_lines", "op13_crc_resampling"):
        assert queries.QUERIES[name](spark, sf).count() == docs
    assert queries.QUERIES["op11_repair_grammar"](spark, sf).count() == table(spark, sf, "conversations").select("conv_id").distinct().count()
