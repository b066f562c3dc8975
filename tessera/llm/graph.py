"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import drop_stored, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Each round hangs every node under the smallest neighbour it has, so that the depth of a tree shrinks
    geometrically.  Minima are aggregated before they are shuffled, and each round's links are a written table.  The join
    of a node with very many links to its minimum is one key, which adaptive execution splits.  Self links and nulls are
    ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        root = stored(large.groupBy("a").agg(F.min("b").alias("m")), "root")
        under = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(under.unionByName(root.withColumnRenamed("m", "b")).distinct(), "links")
        for old in (now, least, large, root):
            drop_stored(old)
        now = new
        heads = now.select(F.col("b").alias("a")).distinct()
        if now.join(heads, "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    out = stored(now.toDF("node", "component").unionByName(roots), "components")
    drop_stored(now)
    return out
