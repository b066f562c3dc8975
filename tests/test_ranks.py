"""Row numbers by pieces against one window, with a hot group, ties, nulls and times."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import ranks


def test_equal_to_one_window(spark):
    rnd = random.Random(7)
    rows = [(None if rnd.random() < 0.02 else "hot" if rnd.random() < 0.4 else f"g{rnd.randrange(50)}", None if rnd.random() < 0.03 else rnd.choice([rnd.random() * 100, 7.0, 8.0]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").withColumn("ts", F.timestamp_seconds(F.col("v").cast("long")))
    for order in (["v", "id"], ["ts", "id"], ["id"]):
        expected = df.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy(*order)))
        got = ranks.numbered(df, group=["g"], order=order, name="n")
        assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in expected.collect())
    assert ranks.numbered(df.limit(0), group=["g"], order=["v"]).count() == 0


def test_a_hot_group_is_cut(spark):
    """Of one group of all rows, no window's partition holds more than a few hundredths."""
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    assert ranks.numbered(df, group=["g"], order=["v"]).where("seq <> v + 1").count() == 0
    cuts = sorted(set(df.approxQuantile("v", [i / ranks.PIECES for i in range(1, ranks.PIECES)], 0.01)))
    sizes = df.groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v")))).count().collect()
    assert max(r["count"] for r in sizes) < 0.1 * 20_000
