"""Domain rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.plans.base import query, table


@query("""WITH i AS (SELECT c_custkey, (c_custkey % 20)::INT AS years, (c_custkey % 12)::INT AS months, c_acctbal::DECIMAL(18,2) AS wage, CASE WHEN c_nationkey < 5 THEN NULL ELSE 1500.00 END::DECIMAL(18,2) AS average FROM customer),
c AS (SELECT *, wage > average * 3 AS capped, years + CASE WHEN months BETWEEN 1 AND 5 THEN 0.5 WHEN months >= 6 THEN 1 ELSE 0 END AS m, wage > 0 AND years + months > 0 AS ok FROM i),
b AS (SELECT *, CASE WHEN coalesce(capped, false) THEN least(m, 12) ELSE m END AS mm, CASE WHEN coalesce(capped, false) THEN average * 3 ELSE wage END AS basis FROM c)
SELECT c_custkey, CASE WHEN ok THEN mm::DECIMAL(8,2) END AS compensation_months, CASE WHEN ok THEN basis::DECIMAL(18,2) END AS wage_basis, CASE WHEN ok THEN capped END AS cap_applied,
CASE WHEN ok THEN round(basis * mm, 2)::DECIMAL(20,2) END AS n1, CASE WHEN ok THEN round(2 * basis * mm, 2)::DECIMAL(20,2) END AS n2 FROM b""")
def compensation_calc(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 20).cast("int").alias("years"), (F.col("c_custkey") % 12).cast("int").alias("months"), F.col("c_acctbal").alias("wage"), F.when(F.col("c_nationkey") >= 5, F.lit(1500.0)).alias("average"))
    return rules.compensation(people, years="years", months="months", wage="wage", average="average").select("c_custkey", "compensation_months", "wage_basis", "cap_applied", "n1", "n2")


@query("""WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value < 50))) AS old, list_sort(list_distinct(list(event_type) FILTER (value >= 50))) AS new, list_sort(list_distinct(list(event_type) FILTER (value > 250))) AS done FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(list_concat(coalesce(old, []), list_filter(coalesce(new, []), lambda x: NOT list_contains(coalesce(old, []), x))), lambda x: NOT list_contains(coalesce(done, []), x)), ',') AS items FROM e""")
def profile_merge(spark: SparkSession, sf: str) -> DataFrame:
    types = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("event_type"))))
    e = table(spark, sf, "events").groupBy("user_id").agg(types(F.col("value") < 50).alias("old"), types(F.col("value") >= 50).alias("new"), types(F.col("value") > 250).alias("done"))
    return e.select("user_id", F.array_join(rules.merge_lists(F.col("old"), F.col("new"), F.col("done")), ",").alias("items"))


@query("""SELECT user_id, event_type AS factor, arg_max(value, (ts, event_id)) AS value, min((ts, event_id)).event_id AS first_event FROM (SELECT user_id, event_type, value, ts, event_id FROM events) GROUP BY user_id, event_type"""
       .replace("min((ts, event_id)).event_id", "arg_min(event_id, (ts, event_id))"))
def factor_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of each factor, and the event that first named it (which gives their order)."""
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("factor")).agg(F.max_by("value", order).alias("value"), F.min_by("event_id", order).alias("first_event"))
