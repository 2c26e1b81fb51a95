"""Near copies by similarity of shingles."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pathlight.llm import similar, simhash
from pyspark.sql import functions as F


def sets(rows):
    return {i: set(similar.shingle_hashes((t or "").encode(), 5, simhash.SEED).tolist()) for i, t in rows}


def close(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def near_copies(n_base=12, copies=25):
    r = random.Random(3)
    rows = []
    for b in range(n_base):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        for c in range(copies if b == 0 else 4):
            words = list(base)
            for _ in range(r.randint(1, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            rows.append((1000 * b + c, " ".join(words)))
    return rows


@pytest.mark.parametrize(("limit", "worth"), [(2, 1000), (12, 0)])
def test_keep_one_by_similarity_equals_plain_components(spark, limit, worth, monkeypatch):
    monkeypatch.setattr(similar, "PAIR_LIMIT", limit)
    monkeypatch.setattr(similar, "WORTH", worth)
    rows = near_copies()
    of, root = sets(rows), {i: i for i, _ in rows}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    changed = 0
    for i, _ in rows:
        for j, _ in rows:
            bits = (fps[i] ^ fps[j]).bit_count()
            if i < j and (bits <= 2 or close(of[i], of[j])):
                changed += bits > 2
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert changed > 50  # pairs that fingerprints miss
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted({find(i) for i, _ in rows})


def test_prefixes_of_similar_sets_meet():
    r = random.Random(4)
    import numpy as np

    common = np.arange(0, 400, 3)
    times = np.array([r.randint(3, 9) for _ in common])
    for _ in range(300):
        a = set(r.sample(range(400), r.randint(1, 60)))
        b = set(a)
        for _ in range(r.randint(0, len(a) // 8)):
            b.discard(r.choice(sorted(b)))
            b.add(r.randrange(400))
        if close(a, b):
            one, two = (set(similar.prefix(np.array(sorted(x)), common, times).tolist()) for x in (a, b))
            assert one & two
