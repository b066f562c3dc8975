"""Store, state and composed retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.plans.base import query, table


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 5 WHEN 'error' THEN 2 ELSE 1000000 END AS allowed FROM events")
def call_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return store.call_budget(table(spark, sf, "events"), turn=["user_id"], tool="event_type", order=["ts", "event_id"], limits={"view": 3, "click": 5, "error": 2}).select("event_id", "allowed")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN coalesce(max((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'synthesis' ELSE 'analysis' END END AS phase FROM events""")
def model_call_phase(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return store.call_phase(table(spark, sf, "events"), run="user_id", order=["ts", "event_id"], is_call=kind == "view", is_tool=kind == "click").select("event_id", "phase")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), k AS (SELECT * FROM n WHERE n <= 40)
SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) > 5001 AS gap FROM k QUALIFY event_id > 5000""")
def replay_after_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return store.replay(table(spark, sf, "events"), run="user_id", order="event_id", cursor=5000, retained=40).select("event_id", "user_id", "gap")


@query("""SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"user":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", store.sse_frame(F.col("event_id"), F.col("event_type"), F.struct(F.col("user_id").alias("user"))).alias("frame"))


@query("""SELECT user_id, round((epoch_us(min(ts) FILTER (event_type = 'view')) - epoch_us(min(ts))) / 1000.0, 3) AS first_token_ms, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 3) AS total_ms FROM events GROUP BY user_id""")
def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = store.latencies(table(spark, sf, "events"), stream="user_id", ts="ts", is_token=F.col("event_type") == "view")
    return out.select("user_id", F.round("first_token_ms", 3).alias("first_token_ms"), F.round("total_ms", 3).alias("total_ms"))


@query("""WITH e AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN e ON c.conv_id = e.conv_id WHERE m IS NULL OR turn > m""")
def since_last_user(spark: SparkSession, sf: str) -> DataFrame:
    return store.after_last(table(spark, sf, "conversations"), thread="conv_id", order="turn", mark=F.col("role") == "user").select("conv_id", "turn")


@query("SELECT conv_id, role, min(turn) AS seq, arg_max(text, turn) FILTER (text <> '') AS content FROM conversations GROUP BY conv_id, role")
def message_once(spark: SparkSession, sf: str) -> DataFrame:
    return store.message_once(table(spark, sf, "conversations"), key=["conv_id", "role"], order="turn", content="text")


@query("SELECT c_custkey AS key, false AS created FROM customer UNION ALL SELECT DISTINCT o_custkey + 1000000, true FROM orders")
def get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select((F.col("o_custkey") + 1_000_000).alias("key"))
    return store.get_or_create(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), wanted, key=["key"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    children = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return store.cascade_delete(parents, [children], parents.where("c_acctbal < 0"), key="k")[1].select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS segment, c_mktsegment = 'BUILDING' AS swapped FROM customer")
def compare_and_set(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return store.swap_if(people, column="segment", expected=F.lit("BUILDING"), new=F.lit("HOUSING"))


@query("SELECT vec_id FROM embeddings WHERE embedding IS NULL OR label IS DISTINCT FROM 3")
def embedding_candidates(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").withColumn("model", F.col("label").cast("string"))
    return store.needs_embedding(vectors, embedding="embedding", model="model", wanted="3").select("vec_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unknown' END AS problem FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def review_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return store.coverage_check(table(spark, sf, "documents"), table(spark, sf, "labels"), key="doc_id")


LEDGER_LIMIT = 600
_STATE = "list_transform([1, 2, 3], lambda i: CASE WHEN i = k AND ({now}) THEN {value} ELSE {name}[i] END)"
_OUTCOME = f"""CASE WHEN op = 'reserve' THEN CASE WHEN st[k] = 'none' OR es[k] = tokens THEN CASE WHEN st[k] IN ('reserved', 'settled') THEN 'unchanged' WHEN tokens <= {LEDGER_LIMIT} - used THEN 'reserved' ELSE 'over_limit' END ELSE 'conflict' END
 WHEN st[k] = 'none' THEN 'unknown'
 WHEN op = 'settle' THEN CASE WHEN st[k] = 'settled' THEN CASE WHEN us[k] = spent THEN 'unchanged' ELSE 'conflict' END WHEN st[k] = 'released' THEN 'released' WHEN spent > {LEDGER_LIMIT} - used + es[k] THEN 'over_limit' ELSE 'settled' END
 ELSE CASE st[k] WHEN 'settled' THEN 'conflict' WHEN 'reserved' THEN 'released' ELSE 'unchanged' END END"""


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS scope, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 'settle' WHEN 'purchase' THEN 'release' ELSE 'reserve' END AS op,
  (event_id % 3 + 1)::INT AS k, (event_id % 4 * 50 + 50)::BIGINT AS tokens, (event_id % 5 * 60)::BIGINT AS spent FROM events),
s(scope, n, seq, outcome, st, es, us) AS (
  SELECT DISTINCT scope, 0::BIGINT, 0::BIGINT, '', ['none', 'none', 'none'], [0, 0, 0]::BIGINT[], [0, 0, 0]::BIGINT[] FROM e
  UNION ALL
  SELECT scope, n, seq, outcome, {_STATE.format(now="outcome IN ('reserved', 'settled') OR (op = 'release' AND outcome = 'released')", value="outcome", name="st")},
         {_STATE.format(now="outcome = 'reserved'", value="tokens", name="es")}, {_STATE.format(now="outcome = 'settled'", value="spent", name="us")}
  FROM (SELECT *, {_OUTCOME} AS outcome FROM (SELECT s.scope, e.n, e.seq, e.op, e.k, e.tokens, e.spent, s.st, s.es, s.us,
        list_sum(list_transform([1, 2, 3], lambda i: CASE s.st[i] WHEN 'settled' THEN s.us[i] WHEN 'reserved' THEN s.es[i] ELSE 0 END)) AS used FROM s JOIN e ON e.scope = s.scope AND e.n = s.n + 1)))
SELECT scope, seq, outcome FROM s WHERE n > 0""")
def token_ledger_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events as requests for three keys."""
    i, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "click", "settle").when(kind == "purchase", "release").otherwise("reserve")
    requests = table(spark, sf, "events").select(F.col("user_id").alias("scope"), i.alias("seq"), op.alias("op"), (i % 3).cast("string").alias("key"), (i % 4 * 50 + 50).alias("tokens"), (i % 5 * 40).alias("input_tokens"), (i % 5 * 20).alias("output_tokens"))
    return store.ledger(requests, limit=LEDGER_LIMIT)
