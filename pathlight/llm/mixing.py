"""Mixing sources to target weights by weighted random order (Efraimidis and Spirakis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlight.llm.common import BLANKS, n_words
from pathlight.operators.ranking import global_row_number, running_sum_before
from pathlight.plans.lineage import cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is used more often than this.
MAX_EPOCHS = 3


def letter_share(text: Column) -> Column:
    """Default quality weight: the share of letters among the characters, at least 0.05; 0.05 for null or empty."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.length(text)
    return F.greatest(F.lit(0.05), F.coalesce(F.when(F.length(text) > 0, letters), F.lit(0.05)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From ``(source, source_size)`` the ``(source, source_size, target)`` that share the total by weight.

    The weights repeat over the sources in code-point order, null last. No target exceeds ``max_epochs`` times its
    source's size; what is cut off goes to the others by weight until none is above. Each pass raises the common
    level ``target / weight`` from two sums over the sources, so nothing but two numbers reaches the driver. Sources
    come once each; one of size 0, or a null size, has target 0. No sources give no rows.
    """
    ranked = global_row_number(sizes, [F.col("source").isNull(), F.col("source")], "_rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    cap = F.coalesce(F.col("source_size"), F.lit(0)).cast("double") * max_epochs
    ranked = cut(ranked.select("source", "source_size", pick.alias("_w"), cap.alias("_cap")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("_cap") <= F.col("_w") * level
        row = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0)).alias("free"),
        ).first()
        if not row["free"]:
            break
        raised = (total - row["fixed"]) / row["free"]
        if raised <= level:
            break
        level = raised
    target = F.least("_cap", F.greatest(F.lit(0.0), F.col("_w") * level))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    seed: int = 17,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: ``doc_id, source, size, source_size, target, taken`` and ``content_hash`` (of id and
    text). Every source first runs through its complete epochs, all its documents once each. What is then left of its
    target is filled in the order of the keys ``-ln(u) / quality``, u being a hash of seed, id and text in (0, 1): the
    smallest keys are a weighted sample without replacement. The words of the last document taken end where the
    target is reached. The order depends on values only, so reruns agree.

    Null text: size 0, nothing taken. Null sources are one source, the last. Null quality counts as 0.05. Repeated rows
    are separate documents whose keys tie. No rows: no rows. Other columns are ignored.
    """
    text = F.col(text_col)
    h = F.xxhash64(F.lit(seed), F.col(id_col), text)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    q = F.greatest(F.lit(1e-6), F.coalesce(quality if quality is not None else letter_share(text), F.lit(0.05)))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(text).alias("size"),
            (-F.log(u) / q).alias("_key"),
            h.alias("content_hash"),
        )
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs).withColumnRenamed("source", "_src")
    summed = running_sum_before(base, "source", [F.col("_key"), F.col("doc_id"), F.col("content_hash")], "size", "_before")
    full = summed.join(targets, summed["source"].eqNullSafe(targets["_src"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_before")))
    return full.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        "content_hash",
    )


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, in the columns of ``docs``.

    A document taken n times and a part is n whole rows and one row whose text is the part's words joined by
    blanks; a document of which nothing is taken is no row. ``n_chars``, where there is one, is that of the row's text.
    Rows of equal id and text, which tie, are numbered and filled one after the other, so that they give no word more
    than was taken. Null ids and sources take part like others; null and empty texts, of no words, give no row. No rows
    give no rows; other columns come back as they are, whatever their names.
    """
    mix = mix_sources(docs, seed=seed)
    mix = mix.groupBy(F.col("doc_id").alias("_id"), F.col("content_hash").alias("_h")).agg(
        F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_rows")
    )
    mix = cut(mix.where("_taken > 0"))
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # by place, so that no name clashes
    text, doc_id = F.col(at["text"]), F.col(at["doc_id"])
    hashed = docs.toDF(*at.values()).withColumn("_hash", F.xxhash64(F.lit(seed), doc_id, text))
    on = doc_id.eqNullSafe(mix["_id"]) & (hashed["_hash"] == mix["_h"])
    rows = hashed.join(mix, on)
    if mix.where("_rows > 1").isEmpty():
        rows = rows.withColumn("_copy", F.lit(0).cast("long"))
    else:
        numbered = global_row_number(rows.where("_rows > 1"), [F.col("_id"), F.col("_hash")], "_no")
        least = numbered.groupBy(F.col("_id").alias("_lid"), F.col("_hash").alias("_lh")).agg(F.min("_no").alias("_least"))
        numbered = numbered.join(least, numbered["_id"].eqNullSafe(least["_lid"]) & (numbered["_hash"] == least["_lh"]))
        numbered = numbered.withColumn("_copy", F.col("_no") - F.col("_least")).drop("_no", "_least", "_lid", "_lh")
        rows = rows.where("_rows = 1").withColumn("_copy", F.lit(0).cast("long")).unionByName(numbered)
    # All copies run through the epochs that all of them have in full; what is left fills one after the other.
    epochs = F.floor(F.col("_taken") / (F.col("_rows") * F.col("_size")))
    left = F.col("_taken") - epochs * F.col("_rows") * F.col("_size") - F.col("_copy") * F.col("_size")
    rows = rows.withColumn("_share", epochs * F.col("_size") + F.least(F.col("_size"), F.greatest(F.lit(0).cast("long"), left)))
    whole = F.floor(F.col("_share") / F.col("_size")).cast("int")
    rest = (F.col("_share") - whole * F.col("_size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_part", F.explode(parts))
    words = F.split(F.regexp_replace(text, f"^{BLANKS}", ""), BLANKS)
    head = F.array_join(F.slice(words, F.lit(1), F.col("_part")), " ")
    rows = rows.withColumn(at["text"], F.when(F.col("_part") < 0, text).otherwise(head))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(at["text"]).cast("long"))
    return rows.select(*at.values()).toDF(*docs.columns)
