"""Event journal and store queries: sequences, pages, latest rows, idempotency and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import numbered


def sequenced(df: DataFrame, *, thread: str, order: list[str], base: int = 0) -> DataFrame:
    """Adds ``seq``: base + position in the thread, however long it is."""
    return numbered(df, group=[thread], order=order).withColumn("seq", F.lit(base) + F.col("seq"))


def keyset_page(df: DataFrame, *, before: int | None, limit: int) -> DataFrame:
    """One page of a thread's rows (seq): the last ``limit`` before the cursor, ascending, with the next cursor (null on the first page)."""
    older = df if before is None else df.where(F.col("seq") < before)
    got = older.orderBy(F.desc("seq")).limit(limit + 1).withColumn("_n", F.row_number().over(W.orderBy(F.desc("seq"))))
    page = got.withColumn("_more", F.max("_n").over(W.partitionBy()) > limit).where(F.col("_n") <= limit)
    return page.withColumn("next_cursor", F.when(F.col("_more"), F.min("seq").over(W.partitionBy()))).drop("_n", "_more")


def tail(df: DataFrame, *, thread: str, order: str, n: int) -> DataFrame:
    """The last n rows of every thread."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(thread).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, *, thread: str, order: list[str]) -> DataFrame:
    """The latest row of every thread, by an aggregate that combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(thread).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def stale(df: DataFrame, *, status: Column, ts: str, cutoff: Column) -> DataFrame:
    return df.where(status & (F.col(ts) < cutoff))


def first_claim(df: DataFrame, *, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The first row of every idempotency key."""
    return df.groupBy(*key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in keep], F.count("*").alias("attempts"))


def alternation(df: DataFrame, *, thread: str, order: str, role: str) -> DataFrame:
    """Per thread: messages, and how many repeat the role of the one before."""
    before = F.lag(role).over(W.partitionBy(thread).orderBy(order))
    return df.withColumn("_same", F.col(role) == before).groupBy(thread).agg(F.count("*").alias("messages"), F.count_if("_same").alias("repeats"))


def completed_history(df: DataFrame, *, thread: str, order: str, role: str, n: int = 20) -> DataFrame:
    """Messages up to the last one of the assistant, and of these the last n."""
    ends = df.where(F.col(role) == "assistant").groupBy(thread).agg(F.max(order).alias("_end"))
    return tail(df.join(ends, thread).where(F.col(order) <= F.col("_end")).drop("_end"), thread=thread, order=order, n=n)


def timeline(df: DataFrame, *, item: list[str], state: str, latency: str) -> DataFrame:
    """One row per item: events, greatest latency and final state by precedence running, failed, timed_out, completed."""
    has = lambda s: F.bool_or(F.col(state) == s)
    final = F.when(has("running"), "running").when(has("failed"), "failed").when(has("timed_out"), "timed_out").otherwise("completed")
    return df.groupBy(*item).agg(F.count("*").alias("events"), F.max(latency).alias("duration"), final.alias("final_state"))


def child_counts(parents: DataFrame, children: DataFrame, *, key: str, name: str = "children") -> DataFrame:
    """Parents with their number of children, 0 included; children are counted before the join."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
