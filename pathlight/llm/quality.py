"""Quality rules whose cutoffs are certified on labelled holdouts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import as_bytes, pieces
from pathlight.plans.lineage import cut

SYMBOLS = b"#*$%&|<>"
#: Words of a window whose repetition counts.
REPEAT = 8
#: Base rule: fewer words, or a larger share of repeated words, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: At most this share of the good documents of a stratum may be rejected, at this overall confidence.
RISK, DELTA = 0.02, 0.05
#: Where a cutoff lies between the greatest value of the good documents that propose and the median of the bad ones
#: above that: settings go from the safest to the strictest.
LEVELS = (0.5, 0.25, 0.0)
#: One labelled document in so many proposes, the others decide.
PROPOSE = 4
#: Strata whose cutoffs are broadcast at most; more are joined.
FEW_STRATA = 10_000
#: Rules: a document is rejected if one of these exceeds its cutoff.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "top_word_share")

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MIX = np.random.default_rng(8).integers(1, 1 << 62, REPEAT, dtype=np.int64) * 2 + 1


def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words that lie in a window of ``size`` words met twice or more, the first meeting included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words))
    windows = np.zeros(n, np.int64)
    for j in range(size):
        windows = windows * 31 + (h[j : j + n] ^ (h[j : j + n] >> 29)) * _MIX[j]
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(times) == n:
        return 0
    hit = np.flatnonzero(times[back] > 1)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, hit, 1)
    np.add.at(depth, hit + size, -1)
    return int((np.cumsum(depth) > 0).sum())


def measure(text: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the values of ``RULES``."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0) + (0.0,) * len(RULES)
    joined = b"".join(words)
    chars = len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    letters = len(joined) - len(joined.translate(None, _LETTERS))
    upper = len(joined) - len(joined.translate(None, _UPPER))
    top = max(Counter(words).values())
    return (
        n, chars, symbols, dup, repeat,
        symbols / chars, dup / len(lines), repeat / n, upper / max(letters, 1), joined.count(b"!") / n, top / n,
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(doc_id, stratum, *COUNTS, *RULES)`` of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "stratum", *COUNTS, *RULES]
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RULES)
        for batch in pieces(batches):
            cols = zip(*[measure(t) for t in as_bytes(batch.column(2))], strict=True)
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, stratum string, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{r} double" for r in RULES])
    return docs.select(F.col(id_col), F.col(stratum_col).cast("string"), F.col(text_col)).mapInArrow(run, schema)


def upper_bound(x: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial share after ``x`` of ``n``, at confidence 1 - ``delta``."""
    if x >= n:
        return 1.0

    def below(p: float) -> float:  # probability of x or fewer
        logs = [
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(x + 1)
        ]
        top = max(logs)
        return math.exp(top) * sum(math.exp(v - top) for v in logs)

    low, high = x / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid >= 1 or below(mid) <= delta:
            high = mid
        else:
            low = mid
    return high


def _rejects(cuts: Column) -> Column:
    out = F.lit(False)
    for i, r in enumerate(RULES):
        out = out | F.coalesce(F.col(r) > cuts[i], F.lit(False))
    return out


def settings_of(caught: list[int], tops: list[float | None], medians: list[float | None], levels: tuple = LEVELS) -> list[list[float]]:
    """Cutoffs by setting and rule, each setting rejecting what the one before does and more.

    Rules come in, at the safest level, in the order of the bad documents that they catch, ties in their own order; then
    all of them move on to the next levels. A rule that catches none has an infinite cutoff.
    """
    useful = sorted((i for i in range(len(RULES)) if caught[i]), key=lambda i: (-caught[i], i))
    cut_at = lambda i, level: tops[i] + level * (medians[i] - tops[i])
    out = []
    for k in range(1, len(useful) + 1):
        out.append([cut_at(i, levels[0]) if i in useful[:k] else math.inf for i in range(len(RULES))])
    out += [[cut_at(i, x) if i in useful else math.inf for i in range(len(RULES))] for x in levels[1:] if useful]
    return out


def chosen(wrong: list[int], n: int, risk: float, delta: float) -> int:
    """The last setting before the first whose exact bound of the false rejections exceeds ``risk``; -1 for none."""
    for j, x in enumerate(wrong):
        if upper_bound(x, n, delta) > risk:
            return j - 1
    return len(wrong) - 1


def proposes(id_col: str = "doc_id") -> Column:
    """Whether a labelled document proposes; the others decide."""
    return F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(PROPOSE)) == 0


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: ``(pooled, stratum, cuts, level, n_good, n_rejected, bound)``, the pooled ones with a null stratum.

    ``labelled`` has ``doc_id, stratum, good`` and the rules' values. A part of the labelled documents, by a hash of the
    id, proposes the settings of each stratum, and of all strata pooled: see ``settings_of``. The others decide: the
    settings are tested in their order, and the last one before the first whose exact upper bound of the false rejections
    exceeds ``risk`` is taken. Such a fixed sequence needs no correction within a stratum; over the strata and the pool
    ``delta`` is divided by their number. Where not even the first setting passes, for want of labels, there is no row.
    Null strata are one stratum. No labels give no rows.
    """
    every = labelled.withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True))))
    every = every.withColumn("stratum", F.when(~F.col("pooled"), F.col("stratum"))).withColumn("part", proposes())
    every = cut(every.select("pooled", "stratum", "good", "part", *RULES))
    same = lambda a, b: a["stratum"].eqNullSafe(b["_s"]) & (a["pooled"] == b["_p"])
    first = every.where("part")
    group = [F.col("stratum").alias("_s"), F.col("pooled").alias("_p")]
    tops = first.groupBy(*group).agg(*[F.max(F.when(F.col("good"), F.col(r))).alias(f"top_{r}") for r in RULES])
    beyond = first.join(tops, same(first, tops)).where("not good")
    over = [F.when(F.col(r) > F.col(f"top_{r}"), F.col(r)) for r in RULES]
    bad = beyond.groupBy("_s", "_p", *[f"top_{r}" for r in RULES]).agg(
        F.array(*[F.count(c) for c in over]).alias("caught"), F.array(*[F.percentile(c, 0.5) for c in over]).alias("medians")
    )
    bad = bad.select("_s", "_p", F.array(*[F.col(f"top_{r}") for r in RULES]).alias("tops"), "caught", "medians")

    def propose(frames):
        import pandas as pd

        for f in frames:
            plain = lambda xs: [None if x is None or x != x else float(x) for x in xs]
            rows = [(r["_s"], bool(r["_p"]), settings_of([int(c) for c in r["caught"]], plain(r["tops"]), plain(r["medians"]))) for r in f.to_dict("records")]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["_s", "_p", "settings"])

    proposed = cut(bad.mapInPandas(propose, "_s string, _p boolean, settings array<array<double>>"))
    tested = every.where("good and not part")
    tested = tested.join(proposed, same(tested, proposed))
    most = len(RULES) + len(LEVELS) - 1
    wrong = [F.count_if((F.size("settings") > j) & _rejects(F.try_element_at("settings", F.lit(j + 1)))) for j in range(most)]
    counts = tested.groupBy("_s", "_p").agg(F.count("*").alias("n"), F.array(*wrong).alias("wrong"))
    counts = counts.join(proposed.select(F.col("_s").alias("s2"), F.col("_p").alias("p2"), "settings"), F.col("_s").eqNullSafe(F.col("s2")) & (F.col("_p") == F.col("p2")))
    share = delta / (labelled.select("stratum").distinct().count() + 1)

    def certify(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                wrong, n = [int(x) for x in r["wrong"]][: len(r["settings"])], int(r["n"])
                j = chosen(wrong, n, risk, share)
                if j >= 0:
                    cuts = [float(x) for x in r["settings"][j]]
                    rows.append((bool(r["_p"]), r["_s"], cuts, j, n, wrong[j], upper_bound(wrong[j], n, share)))
            yield pd.DataFrame(rows, columns=["pooled", "stratum", "cuts", "level", "n_good", "n_rejected", "bound"])

    schema = "pooled boolean, stratum string, cuts array<double>, level int, n_good long, n_rejected long, bound double"
    return counts.select("_s", "_p", "n", "wrong", "settings").mapInPandas(certify, schema)


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every row.

    ``labels`` has ``doc_id`` and ``quality`` (1 is good); a document counts as good if it is labelled so by any of
    its labels, as bad if by none; others do not take part in the test. ``kept`` is false if the base rule fails or a
    certified rule of the document's stratum rejects. Strata without a certified setting of their own take that of all
    strata pooled, whose bound is one of the pool and not of each of them; without that either, they lose documents by
    the base rule alone. Null strata are one stratum; null texts have no words and fail. Repeated rows stay, no rows give
    no rows, other columns are ignored.
    """
    rows = cut(measures(docs, stratum_col=stratum_col))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") == 1).alias("good"))
    found = rows.where("not base_failed").join(known, F.col("doc_id") == F.col("_id"))
    certified = cut(cutoffs(found.where("good is not null"), risk, delta))
    own = certified.where("not pooled").select(F.col("stratum").alias("_s"), "cuts")
    own = F.broadcast(own) if own.count() <= FEW_STRATA else own
    pooled = certified.where("pooled").select("cuts").first()
    shared = F.array(*[F.lit(float(x)) for x in (pooled["cuts"] if pooled else [math.inf] * len(RULES))])
    out = rows.join(own, rows["stratum"].eqNullSafe(own["_s"]), "left")
    kept = ~F.col("base_failed") & ~_rejects(F.coalesce("cuts", shared))
    return out.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), *RULES)
