"""Event journal, conversation and store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import journal as jn
from tessera.operators.rules import any_of_groups
from tessera.plans.base import query, table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def parent_child_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jn.child_counts(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, key="c_custkey", name="orders")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_thread(spark: SparkSession, sf: str) -> DataFrame:
    return jn.latest(_events(spark, sf), thread="user_id", order=["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-10 00:00:00'")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jn.stale(_events(spark, sf), status=F.col("event_type").isin("view", "click"), ts="ts", cutoff=F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id", "user_id")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return jn.sequenced(_events(spark, sf), thread="user_id", order=["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("""WITH s AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events WHERE user_id = 7),
p AS (SELECT * FROM s WHERE seq < 20 ORDER BY seq DESC LIMIT 10)
SELECT event_id, seq, CASE WHEN (SELECT count(*) FROM s WHERE seq < (SELECT min(seq) FROM p)) > 0 THEN (SELECT min(seq) FROM p) END AS next_cursor FROM p""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page of ten messages of thread 7 before sequence 20."""
    rows = jn.sequenced(_events(spark, sf).where("user_id = 7"), thread="user_id", order=["ts", "event_id"])
    return jn.keyset_page(rows, before=20, limit=10).select("event_id", "seq", "next_cursor")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def tail_window(spark: SparkSession, sf: str) -> DataFrame:
    return jn.tail(table(spark, sf, "conversations"), thread="conv_id", order="turn", n=3).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (same) AS repeats FROM (SELECT conv_id, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations) GROUP BY conv_id")
def message_alternation(spark: SparkSession, sf: str) -> DataFrame:
    return jn.alternation(table(spark, sf, "conversations"), thread="conv_id", order="turn", role="role")


@query("""WITH e AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, turn, role FROM (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS n FROM conversations c JOIN e ON c.conv_id = e.conv_id WHERE turn <= m) WHERE n <= 20""")
def completed_history(spark: SparkSession, sf: str) -> DataFrame:
    return jn.completed_history(table(spark, sf, "conversations"), thread="conv_id", order="turn", role="role").select("conv_id", "turn", "role")


@query(r"""SELECT conv_id, turn, len(qs) AS questions FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^\n。！？?!]*[？?]'), lambda q: trim(q)), lambda q: length(q) > 1) AS qs FROM conversations)""")
def question_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(tx.questions(F.col("text"))).alias("questions"))


@query("""SELECT conv_id, turn, (contains(lower(text), 'the') OR contains(lower(text), 'der')) AND (contains(lower(text), 'and') OR contains(lower(text), 'und')) AS passed, length(text) <= 400 AS short_enough FROM conversations""")
def term_group_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", any_of_groups(F.col("text"), [["the", "der"], ["And", "und"]]).alias("passed"), (F.length("text") <= 400).alias("short_enough"))


@query("SELECT user_id, event_type, event_id, attempts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS attempts FROM events) WHERE n = 1")
def idempotency_first_claim(spark: SparkSession, sf: str) -> DataFrame:
    return jn.first_claim(_events(spark, sf), key=["user_id", "event_type"], order=["ts", "event_id"], keep=["event_id"])


@query("""WITH s AS (SELECT user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 300 THEN 'running' WHEN value > 200 THEN 'timed_out' ELSE 'completed' END AS state FROM events)
SELECT user_id, event_type, count(*) AS events, max(value) AS duration, CASE WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'timed_out') THEN 'timed_out' ELSE 'completed' END AS final_state FROM s GROUP BY user_id, event_type""")
def activity_timeline(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 300, "running").when(F.col("value") > 200, "timed_out").otherwise("completed")
    return jn.timeline(_events(spark, sf).withColumn("state", state), item=["user_id", "event_type"], state="state", latency="value")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'result' ELSE 'progress' END AS category, (props->>'$.k')::INT AS k FROM events WHERE event_type <> 'signup'")
def props_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Known event types with their category and the one whitelisted key of the JSON payload."""
    kinds = F.create_map(*[F.lit(x) for pair in (("error", "failure"), ("purchase", "result"), ("view", "progress"), ("click", "progress")) for x in pair])
    props = F.from_json("props", "struct<k: int>")
    return _events(spark, sf).select("event_id", F.try_element_at(kinds, F.col("event_type")).alias("category"), props.k.alias("k")).where("category is not null")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = _events(spark, sf).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, n""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = _events(spark, sf).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "events")
