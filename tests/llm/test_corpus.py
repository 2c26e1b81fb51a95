"""Operators that compare or count over the whole corpus."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import LONG, ROWS
from pathlight.llm import euclid, mixing, queries, simhash, suffix, suffixtree, warc
from pathlight.llm.common import id_remainder, table
from pathlight.operators import skew
from pyspark.sql import functions as F


def flags(rows):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def test_suffix_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op3_suffix_refinement(spark, sf).collect()}
    for d, want in zip(docs, brute.repeats([d["text"] for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def awkward_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg é") for _ in range(r.randint(1, 9)))
    base = " ".join(word() for _ in range(400))
    out = [base, base[10:700], *[base[:900]] * 3, base[:199], base[:200], "ab" * 400, "x" * 150 + base[300:520] + "y" * 150, "q" * 1000, None, ""]
    for _ in range(25):  # one passage in many different surroundings, with edits
        at = r.randint(0, 300)
        out.append(word() * 30 + base[at : at + r.randint(190, 420)] + word() * 30)
        cut = list(base[at : at + 600])
        cut[r.randint(0, len(cut) - 1)] = "#"
        out.append("".join(cut))
    return out


@pytest.mark.parametrize(("most_runs", "least"), [(1_000, 1_000), (1, 1), (2, 2), (4, 2)])
def test_suffix_on_awkward_texts(spark, most_runs, least, monkeypatch):
    """With any limits on what a task refines and on what counts as frequent the result is that of the plain version."""
    monkeypatch.setattr(suffix.repeated_runs, "__defaults__", (200, most_runs))
    monkeypatch.setattr(suffix, "LEAST", least)
    monkeypatch.setattr(skew.split_join, "__defaults__", (skew.PARTS, least))
    texts = awkward_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert flags(suffix.removed_runs(docs).collect()) == sorted(brute.repeats(texts))


def test_suffix_sections_do_not_matter(spark, monkeypatch):
    texts = [t for t in awkward_texts() if t]
    want = [suffix.text_runs([t.encode()]) for t in texts]
    want = [sorted(zip(*[x.tolist() for x in s[:4]])) for w in want for s in w]
    together = defaultdict(list)
    for s in suffix.text_runs([t.encode() for t in texts]):
        for row in zip(*[x.tolist() for x in s[:4]]):
            together[row[0]].append((0, *row[1:]))
    long_enough = [i for i, t in enumerate(texts) if len(t.encode()) >= 200]
    assert [sorted(together[i]) for i in long_enough] == want


def test_suffix_holds_little_at_once():
    """What a task holds while it hashes texts does not grow with the number of texts."""
    text = random.Random(1).randbytes(4_000)
    peaks = []
    for n in (64, 512):
        tracemalloc.start()
        for _ in suffix.text_runs([text] * n):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 25 << 20 and peaks[1] < 1.5 * peaks[0]


def test_workers_give_up_what_other_operators_keep():
    """A codec and its memory stay for the next task of the codec, not for those of others."""
    from pathlight.llm import bpe
    from pathlight.llm.common import pieces

    path, pattern = queries.tokenizer()
    kept = bpe._kept_codec(path, pattern)
    list(pieces(iter([]), operator="bpe"))
    assert bpe._kept_codec(path, pattern) is kept
    list(pieces(iter([])))
    assert bpe._kept_codec(path, pattern) is not kept


def test_suffix_edges(docs, empty):
    rows = suffix.removed_runs(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] >= 200 and by[7]["n_removed"] >= 200 and by[2]["n_bytes"] == by[5]["n_removed"] == 0
    assert by[4]["n_removed"] == by[4]["n_bytes"] == len(LONG)
    kept = suffix.remove_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[4] == "" and texts[2] is None and texts[5] == "einzig"
    assert suffix.removed_runs(empty).count() == suffix.remove_repeats(empty).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Smallest id by links of two bits or fewer; ``fps`` is a list of (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_simhash_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    fps = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
    want, parts = dict(fps), plain_components(fps)
    rows = queries.op6_simhash_blocks(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["fingerprint"] == f"{want[r['doc_id']]:016x}" and r["component_id"] == parts[r["doc_id"]]


def near_fingerprints(n=160):
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(4)]
    out = {s ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for s in seeds for _ in range(n // 4)}
    return sorted(out | {0, 1, 1 << 63, (1 << 64) - 1})


@pytest.mark.parametrize("pair_limit", [2, 12, 1000])
def test_simhash_links_of_near_fingerprints(spark, pair_limit):
    fps = near_fingerprints()
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(signed[f],) for f in fps], "fp long")
    from pathlight.operators.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, pair_limit=pair_limit)).collect()}
    parts = plain_components([(signed[f], f) for f in fps])
    groups = Counter(parts.values())
    # Components are compared as sets, for roots are smallest in signed order here and there.
    assert {k for k, v in parts.items() if groups[v] > 1} == set(got)
    assert len({(parts[k], got[k]) for k in got}) == len({parts[k] for k in got}) == len(set(got.values()))


def test_simhash_edges(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(r["component_id"])
    assert by[3] == by[9] == by[2] == {2} and by[5] == {5} and by[None] == {None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 4, 5, 6, 7, 10, None]))
    assert simhash.near_duplicates(empty).count() == 0


def vectors(seed=2, dim=24):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    rows = [c + r.standard_normal(dim) * s for c in centres for s in (0.05, 0.1, 0.2, 0.3, 0.35) for _ in range(20)]
    rows += list(r.standard_normal((200, dim))) + [rows[0], rows[0] * 3]
    return [[float(np.float32(x)) for x in v] for v in rows]


def test_embeddings_against_brute_force(spark):
    data = vectors()
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [1.0, 2.0], [float("inf")] * 24]
    rows = [(i, v, 1) for i, v in enumerate(data + odd)]
    out = {r["vec_id"]: r for r in euclid.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(5)).collect()}
    assert len(out) == len(rows)
    x = np.array(data)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    got = np.array([out[i]["n_links"] for i in range(len(data))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0
    for i, v in enumerate(odd, len(data)):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True), v
    assert all(r["component_id"] <= i and r["kept"] == (r["component_id"] == i) for i, r in out.items())
    n = len(data)
    assert out[n - 1]["component_id"] == out[n - 2]["component_id"] == out[0]["component_id"]


def test_embeddings_of_one_large_group(spark, monkeypatch):
    r = np.random.default_rng(0)
    c = r.standard_normal(16)
    rows = [(i, [float(v) for v in c + r.standard_normal(16) * 0.01]) for i in range(700)] + [(700 + i, [float(v) for v in c]) for i in range(50)]
    out = euclid.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component_id"] for r in out} == {0} and min(r["n_links"] for r in out) >= 740


def test_embeddings_edges(spark, sf):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert euclid.near_links(none).count() == 0
    only_bad = spark.createDataFrame([(1, None), (1, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(str(r["component_id"]) for r in euclid.near_links(only_bad).collect()) == ["1", "1", "None"]
    assert queries.op7_pstable_cosine(spark, sf).count() == table(spark, sf, "embeddings").count()


def test_suffix_tree_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    toks = {d["doc_id"]: suffixtree.tokens((d["text"] or "").encode()) for d in docs}
    held = {i for i in toks if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in toks.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.op9_suffix_tree_score(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = toks[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        want = sum(math.log10((c[w] + 1) / (n + (v + 1))) for w in ws)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, -want)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def plain_tree(texts, min_count=3, min_gain=12.0, depth=4):
    """A slow suffix tree over all words; gives the log10 probability of a text."""
    toks = [suffixtree.tokens((t or "").encode()) for t in texts]
    c1 = Counter(w for ws in toks for w in ws)
    total, v = sum(c1.values()), len(c1)
    n1, n2 = (sum(c == k for c in c1.values()) for k in (1, 2))
    disc = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    root = {w: (c - disc) / total for w, c in c1.items()}
    grams = [{(w,): c for w, c in c1.items() if c >= min_count}]
    for d in range(1, depth + 1):
        grams.append({g: c for g, c in Counter(tuple(ws[i : i + d + 1]) for ws in toks for i in range(len(ws) - d)).items() if c >= min_count})
    kept = {}

    def prob(ctx, w):
        if not ctx:
            return root[w]
        if ctx in kept:
            p, back = kept[ctx]
            return p[w] if w in p else back * prob(ctx[1:], w)
        return prob(ctx[1:], w)

    for d in range(1, depth + 1):
        of = defaultdict(dict)
        for g, c in grams[d].items():
            of[g[:-1]][g[-1]] = c
        level = {}
        for ctx, nxt in of.items():
            p = {w: (c - 0.5) / grams[d - 1][ctx] for w, c in nxt.items()}
            low = {w: prob(ctx[1:], w) for w in nxt}
            if sum(c * math.log(p[w] / low[w]) for w, c in nxt.items()) >= min_gain and sum(p.values()) < 1 - 1e-9 and sum(low.values()) < 1 - 1e-9:
                level[ctx] = (p, (1 - sum(p.values())) / (1 - sum(low.values())))
        kept |= level
        if not level:
            break
    unseen = max(disc * v / total, 1e-12)

    def of_text(text):
        ws, out = suffixtree.tokens((text or "").encode()), 0.0
        for i, w in enumerate(ws):
            back, known = 1.0, w in root
            for d in range(min(depth, i), 0, -1):
                ctx = tuple(ws[i - d : i])
                if ctx in kept:
                    p, b = kept[ctx]
                    if w in p:
                        back *= p[w]
                        break
                    back *= b
            else:
                back *= root[w] if known else unseen
            out += math.log10(back)
        return out

    return of_text, kept


def sentences(n, seed=4):
    r = random.Random(seed)
    parts = ["a b", "a c d", "e", "b b a", "x y z u v", "q y z u w"]
    return [" ".join(r.choice([*parts, f"r{r.randrange(60)}"]) for _ in range(30)) for _ in range(n)]


@pytest.mark.parametrize("chunk", [40, 1 << 19])
def test_suffix_tree_equals_plain_version(spark, chunk):
    texts = [*sentences(80), None, "", "never seen words a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = F.col("doc_id") % 4 != 0
    want, kept = plain_tree([t for i, t in enumerate(texts) if i % 4])
    assert {len(c) for c in kept} >= {1, 2, 3}
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(docs, train, chunk=chunk).collect()}
    assert len(got) == len(texts)
    assert all(abs(got[i] - want(t)) < 1e-6 for i, t in enumerate(texts))


def test_suffix_tree_messages_are_small():
    """Numbers of words, answers about grams and back-offs are told in few bytes once compressed."""

    def small(*values):
        return sum(len(pa.compress(x, codec="lz4", asbytes=True)) for x in values)

    r = np.random.default_rng(3)
    keys = [np.unique(r.choice(np.arange(1, 60_001, dtype=np.uint64), 20_000)) << np.uint64(40) for _ in range(6)]
    asked = pa.concat_tables([suffixtree._asked(suffixtree.GRAMS, k, np.ones(len(k), np.int64), i, 1) for i, k in enumerate(keys)])
    told = suffixtree._answer(3, 12.0)(asked).column("answer").to_pylist()
    assert small(*told) < 0.8 * sum(map(len, keys))
    sums = [np.stack([np.full(len(k), 20.0), np.full(len(k), 3.5), r.random(len(k)) / 2, np.full(len(k), 9)], axis=1) for k in keys[:1]]
    asked = suffixtree._asked(suffixtree.CONTEXTS, keys[0], sums[0], 0, 1)
    assert small(*asked.column("values").to_pylist()) < 9 * len(keys[0])
    told = suffixtree._answer(3, 12.0)(asked).column("answer").to_pylist()
    assert small(*told) < 7 * len(keys[0])
    want = np.log10((1 - 3.5 / 9) / (1 - sums[0][:, 2]))
    assert np.abs(suffixtree._unzipped(told[0], "<f8") - want).max() < 1e-11


def test_suffix_tree_is_a_distribution(spark):
    texts = sentences(60)
    _, kept = plain_tree(texts, min_gain=1.0)
    words = sorted({w.decode() for t in texts for w in suffixtree.tokens(t.encode())} - {"\n"})
    befores = ("a b", "x y z", "q y z u", "e", "a")
    assert {len(c) for c in kept} >= {1, 2, 3} and any(tuple(b.encode().split()) in kept for b in befores)
    # After each of these the probabilities of all words, the end and the unseen one sum to one.
    asked = [(b, w) for b in befores for w in [*words, "never-seen", ""]]
    rows = [(-1, t) for t in texts] + [(i, f"{b} {w}") for i, (b, w) in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixtree.score(docs, F.col("doc_id") < 0, min_gain=1.0, by_token=True).where("held_out").collect()
    sums = Counter()
    for r in got:
        assert abs(sum(r["token_scores"]) - r["score"]) < 1e-9
        before = asked[r["doc_id"]][0]
        sums[before] += 10 ** r["token_scores"][len(before.split())]
    assert len(sums) == 5 and all(abs(x - 1) < 1e-6 for x in sums.values())


def test_suffix_tree_has_all_nodes(spark):
    """A rare word stands in contexts and follows them however many tokens there are."""
    rare = ["zig zag zog"] * 12
    docs = spark.createDataFrame(list(enumerate([*sentences(400), *rare])), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["token_scores"] for r in suffixtree.score(docs, F.lit(True), by_token=True).collect()}
    want, kept = plain_tree([*sentences(400), *rare])
    assert (b"zig",) in kept and 10 ** got[400][1] > 0.9
    assert abs(sum(got[400]) - want("zig zag zog")) < 1e-6


def test_suffix_tree_edges(docs, empty):
    assert len(suffixtree.score(docs, id_remainder(F.col("doc_id"), 7) != 2).collect()) == len(ROWS)
    rows = suffixtree.score(docs, F.lit(False)).collect()
    assert len(rows) == len(ROWS) and {(r["base_score"], r["n_known"], r["train_tokens"]) for r in rows} == {(0.0, 0, 0)}
    assert suffixtree.score(empty, F.lit(True)).count() == 0


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        out = {s: 3.0 * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def check_mix(rows, sizes_by_source):
    total = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        total[r["source"]] += r["taken"]
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes_by_source[r["source"]]
    want = plain_targets(sizes_by_source)
    for s, rs in by.items():
        assert abs(rs[0]["target"] - want[s]) < 1e-6 * max(1, want[s]) and abs(total[s] - want[s]) <= 1
        epochs = int(want[s] // sizes_by_source[s]) if sizes_by_source[s] else 0
        assert all(r["taken"] >= epochs * r["size"] for r in rs)
        assert sum(0 < r["taken"] - epochs * r["size"] < r["size"] for r in rs) <= 1


def test_mix_equals_plain_version(spark, sf):
    docs = table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for d in docs.collect():
        sizes[d["source"]] += len(d["text"].encode().split())
    check_mix(rows, sizes)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_mix_caps_small_sources(spark):
    rows = [(i, "w " * 1000, "big") for i in range(20)] + [(100 + i, "w " * 3, f"small{i}") for i in range(5)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {"big": 20_000} | {f"small{i}": 3 for i in range(5)}
    check_mix(out, sizes)
    assert all(r["taken"] == 9 for r in out if r["source"] != "big")


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 10, "s", 1.0 if i % 2 else 0.05) for i in range(2000)] + [(5000 + i, "w " * 10, "t", 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    out = mixing.mix_sources(df, quality=F.col("q"), weights=(1, 1)).where("source = 's' and taken > 0").collect()
    assert sum(r["doc_id"] % 2 for r in out) > 0.6 * len(out)


def test_mix_edges(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 9))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert abs(words - sum(r["taken"] for r in rows)) <= 2
    assert mixing.mix_sources(empty).count() == mixing.apply_mix(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    body = "x€" * 5000
    rows = [(3, "http://a/\r\nInjected: 1", body), (2, "http://b", body), (5, None, body), (7, "http://c", None), (8, "http://d", ""), (9, "u", "<p>é"), (2, "http://b", body)]
    pages = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, n int")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder, chunk=4096, roll=1000)
    chunks = warc.read_archives(spark, folder, chunk=1024)
    assert chunks.where("octet_length(chunk) > 1024").count() == 0 and chunks.where("record_id like '%:2'").count() > 10
    data = defaultdict(bytes)
    for r in chunks.where("record_type = 'response' and record_id <> 'urn:pathlight:page:2'").orderBy("record_id", "chunk_no").collect():
        data[r["record_id"].split(":")[-1]] += bytes(r["chunk"])
    assert data == {"7": b"", "9": "<p>é".encode()}
    import base64
    import hashlib

    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.page_records(chunks).collect())
    n = len(body.encode())
    assert got == sorted(
        [(2, n, digest(body), "response", 0)] * 2 + [(3, n, digest(body), "revisit", 2), (5, n, digest(body), "revisit", 2)]
        + [(7, 0, digest(""), "response", 0), (8, 0, digest(""), "revisit", 7), (9, 5, digest("<p>é"), "response", 0)]
    )


def test_warc_small_payloads_and_no_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "page_id long, url string, html string")
    assert warc.record_table(pages, min_bytes=2).where("record_type = 'revisit'").count() == 0
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_warc_detects_damage(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "a", "some payload")], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    file = next((tmp_path / "w").glob("*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"some", b"same")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"file://{tmp_path}/w").collect()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    out = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if out is None else out, sf)
        if name != "encode":
            assert out.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix", "encode"]
    assert 0 < out.count() <= 3 * docs.count() and corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, out.collect()))


def test_pipeline_stages_on_odd_rows(spark, docs, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
        assert stage(spark, docs, "").count() >= 1
