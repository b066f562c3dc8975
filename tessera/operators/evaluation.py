"""Evaluation of rankings against relevance judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_relevant(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, first) for every judged query; first is null where no relevant document was ranked."""
    hits = ranked.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return qrels.select("query_id").distinct().join(hits, "query_id", "left")


def recall_and_mrr(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of queries whose first relevant document is within k, and mean reciprocal rank; one row."""
    first = first_relevant(ranked, qrels)
    return first.agg(F.count("*").alias("queries"), *[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def hit_and_macro_recall(ranked: DataFrame, qrels: DataFrame, *, k: int) -> DataFrame:
    """Hit rate and macro recall at k: per query the share of all its relevant documents that is ranked; one row."""
    total = qrels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    got = ranked.where(F.col("rank") <= k).join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"))
    both = total.join(got, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)), 4).alias("hit_rate"), F.round(F.avg(F.col("found") / F.col("relevant")), 4).alias("macro_recall"))


def coverage(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Counts of matched, missing (query without judgment) and orphaned (judgment without query) ids; one row."""
    q, j = queries.select("query_id").distinct(), judged.select("query_id").distinct()
    sides = q.withColumn("q", F.lit(1)).join(j.withColumn("j", F.lit(1)), "query_id", "full")
    return sides.agg(F.count_if(F.col("q").isNotNull() & F.col("j").isNotNull()).alias("matched"), F.count_if(F.col("j").isNull()).alias("missing"), F.count_if(F.col("q").isNull()).alias("orphaned"))
