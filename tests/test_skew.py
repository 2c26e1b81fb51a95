"""Joins that keep frequent keys apart."""

from pathlight.operators.skew import split_join


def test_split_join_equals_plain_join(spark):
    rows = spark.createDataFrame([(i % 7 if i < 90 else 100, i) for i in range(300)] + [(None, 1)], "k int, v int").repartition(4)
    facts = rows.groupBy("k").count().where("k is not null and k <> 3").withColumnRenamed("count", "n").selectExpr("k", "k * 10 as f", "n").cache()
    want = sorted(map(tuple, rows.join(facts.drop("n"), "k").collect()))
    for parts, least in ((100_000, 1_000), (2, 10), (10_000, 0)):
        got = split_join(rows, facts, ["k"], "n", parts, least)
        assert got.columns == ["k", "v", "f"] and sorted(map(tuple, got.collect())) == want
    assert split_join(rows, facts.where("false"), ["k"], "n").count() == 0


def test_next_row_crosses_partitions(spark):
    from pathlight.operators.ranking import with_next
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 500):
        rows = spark.range(n).select((F.col("id") * 37 % 1009).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x")).repartition(7)
        got = with_next(rows, [F.col("t")], ["x", "t"])
        order = Window.orderBy("t")
        want = rows.select("t", "x", F.lead("x").over(order).alias("next_x"), F.lead("t").over(order).alias("next_t"))
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
