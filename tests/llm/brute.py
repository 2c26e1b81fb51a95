"""Slow, plain versions of the operators for comparison."""

import hashlib
from collections import Counter


def repeats(texts, window=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        mask = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                mask[i : i + window] = [True] * window
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        kept = bytes(b for b, m in zip(d, mask) if not m)
        out.append((len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out
