"""Queries of profiles, activities, streams, stores and conversations' texts, over rows made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.functions import text as tx
from tessera.operators import activity, composites, profile, store
from tessera.operators import retrieval as rt
from tessera.plans.base import query, table
from tessera.sources import pages, sinks
from tessera.session import shared_folder
from tessera.streaming import frames, run_source

KIND = "CASE event_type WHEN 'view' THEN 'tool.started' WHEN 'click' THEN 'tool.completed' WHEN 'error' THEN 'model.error' WHEN 'purchase' THEN 'subagent.end' ELSE 'internal.note' END"
STATUS = "CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'timed_out' ELSE 'odd' END"


def _kind():
    return F.expr(KIND)


def _runtime(spark: SparkSession, sf: str) -> DataFrame:
    """Events as runtime events; what they hold besides the whitelist must not get through."""
    i = F.col("event_id")
    meta = F.struct(F.lit("search_case_materials").alias("tool_name"), F.floor("value").cast("long").alias("latency_ms"), F.lit("x").alias("secret"), F.when(i % 4 == 0, F.concat(F.lit("  a \n b "), i.cast("string"))).alias("description"),
                    F.struct((i % 7 - 3).alias("input_tokens"), F.lit("9").alias("output_tokens"), F.lit(1.5).alias("total_tokens")).alias("usage"))
    content = F.struct(F.expr(STATUS).alias("status"), F.lit(1).alias("latency_ms"), F.concat(F.lit("q  "), i.cast("string")).alias("query"), F.array(i).alias("truncated"))
    return table(spark, sf, "events").select("event_id", _kind().alias("event_type"), F.to_json(meta).alias("metadata"), F.to_json(content).alias("content"))


@query(f"""WITH e AS (SELECT *, {KIND} AS k, {STATUS} AS s FROM events)
SELECT event_id, CASE k WHEN 'tool.started' THEN 'tool' WHEN 'tool.completed' THEN 'tool' WHEN 'model.error' THEN 'error' ELSE 'subagent' END AS category,
CASE k WHEN 'tool.started' THEN '正在调用工具' WHEN 'tool.completed' THEN '工具调用已完成' WHEN 'model.error' THEN '分析过程发生错误' ELSE CASE s WHEN 'completed' THEN '子任务已完成' WHEN 'timed_out' THEN '子任务执行超时' ELSE '子任务已结束' END END AS label,
CASE WHEN event_id % 4 = 0 THEN 'a b ' || event_id WHEN k = 'tool.started' THEN '检索“q ' || event_id || '”相关的案件材料' END AS description, floor(value)::BIGINT::VARCHAR AS latency_ms, CASE WHEN event_id % 7 >= 3 THEN (event_id % 7 - 3)::VARCHAR END AS input_tokens,
5 + CASE WHEN event_id % 4 = 0 OR k = 'tool.started' THEN 1 ELSE 0 END + CASE WHEN event_id % 7 >= 3 THEN 1 ELSE 0 END - 1 AS keys FROM e WHERE k <> 'internal.note'""")
def runtime_projection(spark: SparkSession, sf: str) -> DataFrame:
    got = activity.projected(_runtime(spark, sf))
    at = lambda k: F.try_element_at("payload", F.lit(k))
    return got.select("event_id", "category", "label", at("description").alias("description"), at("latency_ms").alias("latency_ms"), at("usage.input_tokens").alias("input_tokens"), F.size("payload").alias("keys"))


@query(f"""WITH e AS (SELECT *, {KIND} AS k, {STATUS} AS s FROM events)
SELECT event_id, CASE k WHEN 'tool.started' THEN 'tool_started' WHEN 'tool.completed' THEN 'tool_completed' WHEN 'model.error' THEN 'model_failed' ELSE CASE s WHEN 'completed' THEN 'task_completed' WHEN 'timed_out' THEN 'task_timed_out' ELSE 'task_failed' END END AS type
FROM e WHERE k <> 'internal.note' AND event_id % 6 <> 0 AND event_id % 5 <> 0""")
def persisted_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Stored activities; every sixth has another envelope, every fifth another version."""
    i = F.col("event_id")
    envelope = F.struct(F.when(i % 6 == 0, "other").otherwise(activity.ENVELOPE).alias("kind"), F.when(i % 5 == 0, 2).otherwise(1).alias("schema_version"), F.create_map(F.lit("status"), F.expr(STATUS)).alias("payload"))
    return activity.persisted(table(spark, sf, "events").select("event_id", _kind().alias("event_type"), F.to_json(envelope).alias("extension"))).select("event_id", "type")


_ACT = """a AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, event_type AS e, event_id AS id, value AS v, 'c' || (event_id % 4) AS call, 't' || (event_id % 2) AS task, event_id % 3 AS m FROM events),
b AS (SELECT *, CASE e WHEN 'view' THEN 'tool:' || call WHEN 'click' THEN 'tool:s' || call WHEN 'purchase' THEN 'subagent:' || task WHEN 'error' THEN 'model' END AS base, CASE e WHEN 'click' THEN 'subagent:' || task END AS parent FROM a WHERE e <> 'signup'),
s AS (SELECT *, coalesce(max(CASE WHEN e <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM b),
k AS (SELECT *, CASE WHEN e = 'error' THEN 'model:' || CASE WHEN seen = 0 THEN 'analysis' ELSE 'synthesis' END ELSE base END AS key, CASE WHEN e = 'error' THEN 'i' || idx WHEN e = 'click' THEN 's' || call WHEN e = 'view' THEN call ELSE task END AS ident,
      CASE WHEN m = 0 THEN 'running' WHEN m = 1 THEN 'completed' ELSE 'failed' END AS state FROM s),
c AS (SELECT run, key, ident, arg_max(state, idx) AS state, arg_max(v, idx) AS v FROM k GROUP BY run, key, ident),
f AS (SELECT run, key, CASE WHEN bool_or(state = 'running') THEN 'completed' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'completed' END AS state, max(v) AS duration_ms FROM c GROUP BY run, key),
i AS (SELECT run, key, min(idx) AS o, arg_min(parent, idx) AS parent_key, arg_min(CASE e WHEN 'error' THEN 'model' WHEN 'purchase' THEN 'subagent' ELSE 'tool' END, idx) AS kind FROM k GROUP BY run, key),
p AS (SELECT i.*, q.o AS po FROM i LEFT JOIN i q ON q.run = i.run AND q.key = i.parent_key AND q.parent_key IS NULL)"""


@query(f"WITH {_ACT} SELECT p.run, p.key, kind, parent_key, state, duration_ms, row_number() OVER (PARTITION BY p.run ORDER BY (parent_key IS NOT NULL AND po IS NULL), coalesce(po, o), parent_key IS NOT NULL, o) AS position FROM p JOIN f ON f.run = p.run AND f.key = p.key")
def activity_reducer(spark: SparkSession, sf: str) -> DataFrame:
    """Views are tool calls, clicks tool calls of a subagent's task, purchases the task, errors calls of the main model."""
    from pyspark.sql import Window as W

    e, i = F.col("event_type"), F.col("event_id")
    tool, agent = e.isin("view", "click"), e == "purchase"
    call = F.concat(F.lit("c"), (i % 4).cast("string"))
    ends = F.when(i % 3 == 0, "started").when(i % 3 == 1, "completed").otherwise("failed")
    kind = F.when(tool, "tool").when(agent, "task").otherwise("model")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy(i)).alias("idx"), F.when(e != "signup", F.concat(F.when(tool, "tool").when(agent, "subagent").otherwise("model"), F.lit(".note"))).otherwise("subagent.step").alias("event_type"),
        F.concat(kind, F.lit("_"), ends).alias("type"), F.when(tool, "look").alias("tool_name"), F.when(e == "click", F.concat(F.lit("s"), call)).when(e == "view", call).alias("call_id"), F.when(agent | (e == "click"), F.concat(F.lit("t"), (i % 2).cast("string"))).alias("task_id"),
        F.when(e == "click", "subagent:reader").alias("caller"), F.when(agent, "reader").alias("subagent_type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("status"), F.col("value").alias("latency_ms"), F.lit(None).cast("int").alias("call_index"),
    )
    return activity.reduced_timeline(rows, run="run").select("run", "key", "kind", "parent_key", "state", "duration_ms", "position")


@query("""SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS n, event_id::VARCHAR AS id, event_type AS event, '{"user":' || user_id || '}' AS data FROM events""")
def sse_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events as one stream of frames, cut anywhere, read back."""
    e = table(spark, sf, "events")
    frame = store.sse_frame(F.col("event_id"), F.col("event_type"), F.struct(F.col("user_id").alias("user")))
    cut = F.length(frame) - F.col("event_id").cast("int") % 9
    halves = e.select("user_id", F.posexplode(F.array(F.substring(frame, F.lit(1), cut), F.substring(frame, cut + 1, F.lit(1 << 20)))).alias("half", "chunk"), (F.col("event_id") * 2).alias("at"))
    return frames.parse_streams(halves.select("user_id", (F.col("at") + F.col("half")).alias("seq"), "chunk"), connection="user_id").select("user_id", "n", "id", "event", "data")


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error')::INT AS deltas, CASE WHEN bool_or(event_type = 'error') THEN NULL ELSE string_agg(event_type, '' ORDER BY event_id) END AS text, CASE WHEN bool_or(event_type = 'error') THEN 'provider is gone' END AS failure, bool_or(event_type = 'error') AS infrastructure
FROM (SELECT * FROM events e WHERE event_id <= coalesce((SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error'), 9e18)) GROUP BY user_id""")
def stream_observation(spark: SparkSession, sf: str) -> DataFrame:
    """Events as deltas of a stream that an error ends, else a complete event."""
    e = table(spark, sf, "events")
    error = F.col("event_type") == "error"
    data = F.when(error, F.lit('{"message":"provider is gone","code":"provider_unavailable"}')).otherwise(F.to_json(F.struct(F.col("event_type").alias("delta"))))
    sent = F.concat(F.lit("event: "), F.when(error, "error").otherwise("messages"), F.lit("\ndata: "), data, F.lit("\n\n"))
    ends = e.select("user_id").distinct().select("user_id", F.lit(1 << 60).alias("seq"), F.lit('event: complete\ndata: {"result": {}}\n\n').alias("chunk"))
    got = frames.observe_streams(e.select("user_id", F.col("event_id").alias("seq"), sent.alias("chunk")).unionByName(ends), connection="user_id")
    return got.select("user_id", "deltas", "text", "failure", "infrastructure")


@query("""WITH u AS (SELECT user_id, 'k' || (event_id % 9) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ord, value, event_type, event_id FROM events),
f AS (SELECT *, min(ord) OVER (PARTITION BY user_id, key) AS first FROM u),
n AS (SELECT *, sum(CASE WHEN first = ord AND key <> 'k0' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ord) AS fresh FROM f),
k AS (SELECT * FROM n WHERE fresh + 1 <= 6),
g AS (SELECT user_id, key, arg_max(value, ord) AS value, arg_max(CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN event_type <> 'view' THEN ord END) AS question, min(ord) AS seen FROM k GROUP BY user_id, key),
b AS (SELECT DISTINCT user_id FROM events)
SELECT coalesce(g.user_id, b.user_id) AS user_id, coalesce(g.key, 'k0') AS key, g.value, coalesce(g.question, CASE WHEN coalesce(g.key, 'k0') = 'k0' THEN 'old' END) AS question, row_number() OVER (PARTITION BY coalesce(g.user_id, b.user_id) ORDER BY coalesce(g.key, 'k0') <> 'k0', g.seen) AS ord
FROM g FULL JOIN b ON b.user_id = g.user_id AND g.key = 'k0'""")
def factor_upsert_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Each user has a factor k0; events update or add others, six at most."""
    from pyspark.sql import Window as W

    e = table(spark, sf, "events")
    blank = F.lit(None).cast("string")
    have = e.select("user_id").distinct().select("user_id", F.lit("k0").alias("key"), F.lit(1).alias("ord"), blank.alias("state"), F.lit(None).cast("double").alias("value"), blank.alias("materiality"), F.lit("old").alias("question"))
    question = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("")
    updates = e.select("user_id", F.concat(F.lit("k"), (F.col("event_id") % 9).cast("string")).alias("key"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("ord"), F.lit("asserted").alias("state"), "value", F.lit("high").alias("materiality"), question.alias("question"))
    return profile.upsert_factors(have, updates, case="user_id", cap=6).select("user_id", "key", "value", "question", "ord")


@query("""SELECT event_id, CASE WHEN t = 'boolean' AND v = 'false' AND s = 'asserted' THEN 'denied' WHEN t = 'boolean' AND v = 'true' AND s = 'denied' THEN 'conflicting' ELSE s END AS state, CASE WHEN s <> 'unknown' THEN v END AS value, s <> 'unknown' OR event_id % 2 = 0 AS valid
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE 'boolean' END AS t, CASE WHEN event_id % 5 < 3 THEN 'true' ELSE 'false' END AS v, CASE event_id % 4 WHEN 0 THEN 'asserted' WHEN 1 THEN 'denied' WHEN 2 THEN 'unknown' ELSE 'conflicting' END AS s FROM events)""")
def factor_coercion(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    updates = table(spark, sf, "events").select(i, F.when(i % 3 == 0, "text").otherwise("boolean").alias("type"), F.when(i % 5 < 3, "true").otherwise("false").alias("value"), F.expr("CASE event_id % 4 WHEN 0 THEN 'asserted' WHEN 1 THEN 'denied' WHEN 2 THEN 'unknown' ELSE 'conflicting' END").alias("state"), F.when(i % 2 == 0, "why").otherwise(" ").alias("question"))
    return profile.coerced(updates).select("event_id", "state", "value", "valid")


@query("""WITH c AS (SELECT user_id AS case_id, event_type || (event_id % 3) AS key, min(event_id) AS ord FROM events WHERE event_id % 4 < 2 GROUP BY 1, 2),
ok AS (SELECT case_id, key, ord FROM c WHERE (length(key) + case_id) % 2 = 0 AND right(key, 1) <> '2' AND left(key, 1) <> 's')
SELECT case_id, key, 'ask ' || key AS question, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS rank FROM ok) WHERE rank <= 2""")
def sufficiency_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of some targets; factors of even length are unknown, those of signups of low materiality, reviews of key 2 settled."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"), F.col("event_id").alias("ord"), (F.col("event_id") % 4).cast("int").alias("target"))
    targets = e.select("case_id", "target").distinct().withColumn("kind", F.expr("CASE target WHEN 0 THEN 'estimate' WHEN 1 THEN 'action' ELSE 'explanation' END"))
    keys = e.select("case_id", "key").distinct()
    factors = keys.select("case_id", "key", F.when((F.length("key") + F.col("case_id")) % 2 == 0, "unknown").otherwise("asserted").alias("state"), F.when(F.col("key").startswith("s"), "low").otherwise("high").alias("materiality"), F.concat(F.lit("ask "), "key").alias("question"))
    reviews = keys.select("case_id", "key", F.when(F.col("key").endswith("2"), "resolved").otherwise("unresolved").alias("status"))
    return profile.follow_ups(e, targets, factors, reviews)


@query("""WITH p AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (event_id % 3 = 0))) AS old, list_sort(list_distinct(list(event_type) FILTER (event_id % 3 = 1))) AS new, list_sort(list_distinct(list(event_type) FILTER (event_id % 7 = 2))) AS done FROM events GROUP BY user_id),
q AS (SELECT user_id, coalesce(old, []) AS old, coalesce(new, []) AS new, coalesce(done, []) AS done FROM p)
SELECT user_id, array_to_string(old || list_filter(new, lambda x: NOT list_contains(old, x)), ',') AS claims, array_to_string(list_filter(CASE WHEN user_id % 2 = 0 THEN new ELSE old END, lambda x: NOT list_contains(done, x)), ',') AS missing, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS case_type FROM q""")
def profile_patch(spark: SparkSession, sf: str) -> DataFrame:
    kinds = lambda rule: F.sort_array(F.collect_set(F.when(rule, F.col("event_type"))))
    i, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf, "events").groupBy("user_id").agg(kinds(i % 3 == 0).alias("claims"), kinds(i % 3 == 1).alias("patch_claims"), kinds(i % 7 == 2).alias("patch_resolved_missing_information"))
    rows = rows.withColumns({"missing_information": F.col("claims"), "patch_missing_information": F.when(u % 2 == 0, F.col("patch_claims")), "case_type": F.lit("old"), "patch_case_type": F.when(u % 3 == 0, " new ").otherwise(" ")})
    return profile.apply_patch(rows, lists=["claims"]).select("user_id", F.array_join("claims", ",").alias("claims"), F.array_join("missing_information", ",").alias("missing"), "case_type")


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority AS title FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 ORDER BY o_orderpriority, l_orderkey, l_linenumber LIMIT 500""")
def effective_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 lines of filled orders of customers with even keys, in order of priority: a limited list."""
    sources = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "effective").otherwise("repealed").alias("status"), F.when(F.col("o_custkey") % 2 == 0, "approved").otherwise("pending").alias("review_status"), F.col("o_orderpriority").alias("title"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_quantity").alias("embedding"))
    return store.effective_chunks(lines, sources, limit=500).select(F.col("source_id").alias("l_orderkey"), F.col("chunk_index").alias("l_linenumber"), "title")


@query("SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def owner_scope(spark: SparkSession, sf: str) -> DataFrame:
    people = store.owner_view(table(spark, sf, "customer").withColumn("owner_id", F.col("c_mktsegment")), "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(people, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END AS want FROM events),
s(user_id, n, status, applied, refused, started_at, completed_at) AS (SELECT DISTINCT user_id, 0::BIGINT, 'queued', 0, 0, NULL::TIMESTAMP, NULL::TIMESTAMP FROM e UNION ALL
  SELECT user_id, n, CASE WHEN ok THEN want ELSE status END, applied + ok::INT, refused + (NOT ok)::INT, CASE WHEN ok AND want = 'running' THEN ts ELSE started_at END, CASE WHEN ok AND want IN ('completed', 'failed') THEN ts ELSE completed_at END
  FROM (SELECT s.user_id, e.n, e.want, e.ts, s.status, s.applied, s.refused, s.started_at, s.completed_at, CASE e.want WHEN 'running' THEN s.status = 'queued' WHEN 'completed' THEN s.status = 'running' WHEN 'failed' THEN s.status IN ('queued', 'running') ELSE s.status = 'failed' END AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id AS run_id, arg_max(status, n) AS status, max(applied) AS applied, max(refused) AS refused, arg_max(epoch_us(started_at), n) AS started_us, arg_max(epoch_us(completed_at), n) AS completed_us FROM s GROUP BY user_id""")
def run_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events as requests for a run's status."""
    want = F.expr("CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'queued' END")
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), want.alias("status"), "ts")
    allowed = {"running": ["queued"], "completed": ["running"], "failed": ["queued", "running"], "queued": ["failed"]}
    got = store.timed_transitions(e, allowed=allowed, start="queued")
    return got.select("run_id", "status", "applied", "refused", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"))


@query("""WITH n AS (SELECT event_id, user_id, event_id % 10 = 0 AS refused FROM events WHERE event_id % 2 = 1 OR event_id % 10 = 0), l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 0 GROUP BY user_id)
SELECT event_id, refused, CASE WHEN NOT refused THEN coalesce(last, 0) + row_number() OVER (PARTITION BY n.user_id, refused ORDER BY event_id) END AS seq FROM n LEFT JOIN l ON l.user_id = n.user_id""")
def journal_append(spark: SparkSession, sf: str) -> DataFrame:
    """Odd events are appended to the even ones' journals; every tenth comes from another owner."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    journal = e.where((i % 2 == 0) & (i % 10 != 0)).select(F.col("user_id").alias("thread_id"), i.alias("seq"))
    new = e.where((i % 2 == 1) | (i % 10 == 0)).select(i, F.when(i % 10 == 0, "other").otherwise("me").alias("owner_id"), F.col("user_id").alias("thread_id"), F.col("user_id").alias("run_id"))
    runs = e.select(F.col("user_id").alias("run_id"), F.lit("me").alias("owner_id"), F.col("user_id").alias("thread_id")).distinct()
    return store.appended(journal, new, runs, order="event_id").select("event_id", "refused", "seq")


@query("SELECT user_id AS run_id, min(event_id) AS event_id FROM events WHERE user_id % 5 <> 0 GROUP BY user_id")
def input_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth run has its input already."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id")
    there = e.where("run_id % 5 = 0").select("run_id", F.lit("agent.input").alias("event_type"))
    return store.once_per_run(there, e, event_type="agent.input", order="event_id").select("run_id", "event_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'view' THEN 'set' WHEN 'error' THEN 'clear' ELSE 'consume' END AS op, 'i' || event_id AS x, (event_id % 6)::INT AS want, ts, ts + INTERVAL 3 HOUR AS till FROM events),
s(user_id, n, version, x, till, consumed, refused) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, NULL::VARCHAR, NULL::TIMESTAMP, 0, 0 FROM e UNION ALL
  SELECT user_id, n, version + (sets OR takes OR drops)::INT, CASE WHEN sets THEN nx WHEN takes OR drops THEN NULL ELSE x END, CASE WHEN sets THEN ntill WHEN takes OR drops THEN NULL ELSE till END, consumed + takes::INT, refused + (NOT sets AND NOT takes AND NOT drops)::INT
  FROM (SELECT s.*EXCLUDE (n), e.n, e.x AS nx, e.till AS ntill, e.op = 'set' AS sets, e.op = 'clear' AND s.version > 0 AS drops, e.op = 'consume' AND s.version > 0 AND s.version = e.want AND s.x IS NOT NULL AND coalesce(s.till > e.ts, false) AS takes FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id AS thread_id, max(version) AS version, arg_max(coalesce(x, ''), n) AS interaction, max(consumed) AS consumed, max(refused) AS refused FROM s GROUP BY user_id""")
def interaction_state(spark: SparkSession, sf: str) -> DataFrame:
    """Views set an interaction for three hours, errors clear it, others try to consume it."""
    op = F.expr("CASE event_type WHEN 'view' THEN 'set' WHEN 'error' THEN 'clear' ELSE 'consume' END")
    i = F.col("event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("thread_id"), i.alias("seq"), op.alias("op"), F.concat(F.lit("i"), i.cast("string")).alias("interaction"), (i % 6).alias("version"), F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("expires_at"))
    return store.interactions(e).select("thread_id", "version", F.coalesce("interaction", F.lit("")).alias("interaction"), "consumed", "refused")


@query("""SELECT user_id, event_id, ties FROM (SELECT user_id, event_id, max(ts::DATE) OVER (PARTITION BY user_id) = ts::DATE AS last, count(*) OVER (PARTITION BY user_id, ts::DATE) - 1 AS ties FROM events) WHERE last""")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return store.latest_version(rows, key="user_id", published="day").select("user_id", "event_id", "ties")


@query("""WITH r AS (SELECT user_id AS query_id, event_type AS source, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM r GROUP BY query_id, source""")
def source_ranks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    ranked = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    return store.source_rank(ranked)


@query("""WITH a AS (SELECT user_id AS q, event_id % 20 AS d, 0 AS w, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events UNION ALL SELECT user_id, event_id % 25, 1, row_number() OVER (PARTITION BY user_id ORDER BY event_id) FROM events)
SELECT q AS query_id, d AS doc_id, row_number() OVER (PARTITION BY q ORDER BY min(w * 1000000 + r)) AS place FROM a GROUP BY q, d""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e, i = table(spark, sf, "events"), F.col("event_id")
    ranking = lambda doc, *order: e.select(F.col("user_id").alias("query_id"), doc.alias("doc_id"), F.row_number().over(W.partitionBy("user_id").orderBy(*order)).alias("rank"))
    return store.ordered_union([ranking(i % 20, "value", "event_id"), ranking(i % 25, "event_id")])


@query("""WITH m AS (SELECT conv_id, turn // 2 AS run, turn, role, text FROM conversations WHERE role <> 'system'),
j AS (SELECT conv_id, turn // 2 AS run_id, 'm' || lpad(turn::VARCHAR, 4, '0') AS id, CASE role WHEN 'user' THEN 'message.human' ELSE 'message.ai' END AS t, CASE role WHEN 'user' THEN 0 ELSE 2 END AS p, turn // 2 AS tm FROM conversations WHERE role <> 'system'
      UNION ALL SELECT conv_id, run, md5(conv_id || ':' || run || '-agent-input'), 'agent.input', 1, run FROM m WHERE role = 'user' AND turn % 3 = 0
      UNION ALL SELECT conv_id, turn // 2, 'e' || turn, 'tool.started', 1, turn // 2 FROM conversations WHERE role = 'system')
SELECT conv_id AS thread_id, id AS event_id, t AS event_type, row_number() OVER (PARTITION BY conv_id ORDER BY tm, p, id) AS seq FROM j""")
def unified_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, system turns as events, and the inputs of every third turn, which differ from what was said."""
    c = table(spark, sf, "conversations")
    run = F.floor(F.col("turn") / 2)
    row = [F.col("conv_id").alias("thread_id"), F.concat_ws(":", "conv_id", run.cast("string")).alias("run_id")]
    said = c.where("role <> 'system'").select(*row, F.concat(F.lit("m"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("message_id"), "role", F.col("text").alias("content"), run.alias("created_at"))
    events = c.where("role = 'system'").select(*row, F.concat(F.lit("e"), F.col("turn").cast("string")).alias("event_id"), F.lit("tool.started").alias("event_type"), F.col("text").alias("content"), run.alias("created_at"))
    runs = c.where("role = 'user'").select(*row, F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")).alias("input"), run.alias("created_at"))
    return store.unified_journal(events, said, runs).select("thread_id", "event_id", "event_type", "seq")


@query("""WITH m AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT DISTINCT e.user_id AS thread, 'tool' || (event_id % 3) AS tool FROM events e LEFT JOIN m ON m.user_id = e.user_id WHERE event_type IN ('click', 'purchase') AND event_id % 3 < 2 AND (last IS NULL OR event_id > last)""")
def attempted_tools(spark: SparkSession, sf: str) -> DataFrame:
    role = F.expr("CASE event_type WHEN 'view' THEN 'human' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'tool' ELSE 'ai' END")
    said = table(spark, sf, "events").select(F.col("user_id").alias("thread"), "event_id", role.alias("role"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")).alias("tool"))
    return store.attempted_tools(said, thread="thread", order="event_id", tools=["tool0", "tool1"])


@query("""SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN 'approved' WHEN c_custkey % 3 = 1 THEN 'rejected' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END END AS review_status,
CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01' ELSE '2025-01-01' END WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN '2024-01-01' END AS verified FROM customer""")
def review_workflow(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf, "customer")
    sources = people.select(k.alias("source_id"), F.when(k % 2 == 0, "approved").otherwise("pending").alias("review_status"), F.when(k % 2 == 0, F.lit("2024-01-01").cast("date")).alias("verified_at"))
    decisions = people.select(k.alias("source_id"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END").alias("decision"))
    got = store.reviewed(sources, decisions, at=F.lit("2025-01-01").cast("date"))
    return got.select("source_id", "review_status", F.col("verified_at").cast("string").alias("verified"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events), l AS (SELECT user_id, event_id FROM k WHERE back <= 40 AND event_id > 500),
g AS (SELECT e.user_id FROM (SELECT user_id, count(*) AS n FROM events WHERE event_id > 500 GROUP BY user_id) e LEFT JOIN (SELECT user_id, count(*) AS n FROM l GROUP BY user_id) g ON g.user_id = e.user_id WHERE e.n > coalesce(g.n, 0)),
u AS (SELECT user_id, 0 AS p, 0 AS m, 'gap' AS event FROM g UNION ALL SELECT l.user_id, 1, l.event_id, event_type FROM l JOIN events e ON e.event_id = l.event_id UNION ALL SELECT DISTINCT user_id, 2, 0, 'end' FROM events)
SELECT user_id AS run_id, event, row_number() OVER (PARTITION BY user_id ORDER BY p, m) AS place FROM u""")
def resume_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ms"), F.lit(0).cast("long").alias("n"), F.col("event_type").alias("event"), F.lit("{}").alias("data"))
    return store.resumed(e, last_event_id="500-0", retained=40).select("run_id", "event", "place")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events), l AS (SELECT user_id, event_id FROM k WHERE back <= 40 AND event_id > 500),
g AS (SELECT e.user_id FROM (SELECT user_id, count(*) AS n FROM events WHERE event_id > 500 GROUP BY user_id) e LEFT JOIN (SELECT user_id, count(*) AS n FROM l GROUP BY user_id) g ON g.user_id = e.user_id WHERE e.n > coalesce(g.n, 0))
SELECT l.user_id::VARCHAR AS run_id, l.event_id || '-0' AS id, event_type AS event FROM l JOIN events e ON e.event_id = l.event_id UNION ALL SELECT user_id::VARCHAR, NULL, 'gap' FROM g""")
def resume_from_journal(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream: events are two batches of a journal, and a reader of it comes back with an id."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ms"), F.lit(0).cast("long").alias("n"), F.col("event_type").alias("event"), F.lit("{}").alias("data"))
    folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for number, part in enumerate((e.where("ms % 2 = 0"), e.where("ms % 2 = 1"))):
        run_source.append_batch(part, f"{folder}/journal", number)
    stream = run_source.register(spark).readStream.format("run_events").options(path=f"{folder}/journal", last_event_id="500-0", retained="40").load()
    reader = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    reader.processAllAvailable()
    reader.stop()
    return spark.read.parquet(f"{folder}/out").select("run_id", "id", "event")


@query("""WITH h AS (SELECT conv_id AS c, max(turn) AS most FROM conversations WHERE turn < 2 GROUP BY conv_id) SELECT conv_id, turn, (coalesce(most, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS reference_index FROM conversations LEFT JOIN h ON c = conv_id WHERE turn >= 2""")
def material_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Later turns as new materials of a conversation, numbered on from its first ones."""
    c = table(spark, sf, "conversations")
    have = c.where("turn < 2").select("conv_id", F.col("turn").alias("reference_index"))
    return sinks.add_materials(have, c.where("turn >= 2").select("conv_id", "turn"), case="conv_id", order="turn").select("conv_id", "turn", "reference_index")


@query("SELECT conv_id, count(*) AS materials, sum(length(text))::BIGINT AS chars, count(*) <= 5 AND sum(length(text)) <= 2000 AS within FROM conversations GROUP BY conv_id")
def material_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.capacity(table(spark, sf, "conversations"), case="conv_id", text="text", most=5, most_chars=2000)


@query("""SELECT p.page_id, CASE WHEN page_id % 10 = 0 THEN 'failed' WHEN page_id % 4 = 1 OR first < page_id THEN 'unchanged' ELSE 'pending_review' END AS outcome
FROM (SELECT page_id, min(page_id) OVER (PARTITION BY url, CASE WHEN page_id % 10 = 0 THEN NULL ELSE sha256(html) END) AS first FROM pages) p""")
def case_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as fetched documents: every tenth failed, every fourth after the first is stored already."""
    p, i = table(spark, sf, "pages"), F.col("page_id")
    got = p.select("page_id", F.col("url").alias("source_url"), F.when(i % 10 != 0, F.col("html")).alias("content"), F.when(i % 10 == 0, "timeout").alias("failure"))
    there = p.where("page_id % 4 = 1 and page_id % 10 <> 0").select(F.col("url").alias("source_url"), F.sha2(F.encode("html", "UTF-8"), 256).alias("sha"), F.col("page_id").alias("source_id"))
    return store.synced(got, there.dropDuplicates(["source_url", "sha"]), order="page_id").select("page_id", "outcome")


CITED = "CASE WHEN turn % 3 = 0 THEN '见[La-1:C2]与【Cb:S3】，再见[La-1:C2]。' WHEN turn % 3 = 1 THEN '[Lx:C9] 未知 [Link](u) [M1:C1] [Cb:S3]' ELSE '' END || text"
_MARKS = r"\[(?:L[a-zA-Z0-9-]+:C\d+|C[a-zA-Z0-9-]+:S\d+)\]"


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr(CITED).alias("t"), F.array(F.lit("La-1:C2"), F.lit("Cb:S3")).alias("known"))


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'La-1:C2,Cb:S3' WHEN 1 THEN 'Cb:S3' ELSE '' END AS cited FROM conversations")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with references before it, known and unknown ones, in both kinds of brackets."""
    return _cited(spark, sf).select("conv_id", "turn", F.array_join(F.array_intersect(tx.citations(F.col("t")), F.col("known")), ",").alias("cited"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '见[La-1:C2]与[Cb:S3]，再见[La-1:C2]。' WHEN 1 THEN ' 未知 [Link](u) [M1:C1] [Cb:S3]' ELSE '' END || text AS clean FROM conversations")
def citation_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf).select("conv_id", "turn", tx.strip_citations(F.col("t"), F.col("known")).alias("clean"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '见[1]与【Cb:S3】，再见[1]。' WHEN 1 THEN '[1] 未知 [Link](u) [M1:C1] [2]' ELSE '' END || text AS plain,
CASE turn % 3 WHEN 0 THEN '见`[1]`与【Cb:S3】，再见`[1]`。' WHEN 1 THEN '`[1]` 未知 [Link](u) `[M1:C1]` `[2]`' ELSE '' END || regexp_replace(text, '\\[(\\d+|M\\d+:C\\d+)\\]', '`[\\1]`', 'g') AS markdown, CASE turn % 3 WHEN 0 THEN 'La-1:C2' WHEN 1 THEN 'Cb:S3' ELSE '' END AS sources FROM conversations""")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    return _cited(spark, sf).select("conv_id", "turn", tx.numbered_citations(t).alias("plain"), tx.numbered_citations(t, markdown=True).alias("markdown"), F.array_join(tx.cited_only(t, F.col("known")), ",").alias("sources"))


@query("""SELECT run_id, text FROM (SELECT conv_id || ':' || turn AS run_id, CASE turn % 3 WHEN 0 THEN '见[La-1:C2]与[Cb:S3]，再见[La-1:C2]。' WHEN 1 THEN ' 未知 [Link](u) [M1:C1] [Cb:S3]' ELSE '' END || text AS text FROM conversations) WHERE text <> ''""")
def delta_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a run of deltas of seven characters."""
    from tessera.streaming.delta_filter import fold_deltas

    t = F.col("t")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)), F.lit(7)), lambda i: t.substr(i, F.lit(7)))
    deltas = _cited(spark, sf).where("t <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("run_id"), F.posexplode(parts).alias("seq", "delta"))
    return fold_deltas(deltas.withColumn("seq", F.col("seq").cast("long")), known={"La-1:C2", "Cb:S3"})


@query("SELECT doc_id, '(2019)沪' || (doc_id % 50) || '民终' || (doc_id % 9 + 1) || '号' AS case_number FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 = 0")
def case_number_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in full-width signs, with blanks and leading zeros, before every text but each fourth."""
    i = F.col("doc_id")
    number = F.concat(F.lit("案号 （２０１９） 沪"), (i % 50).cast("string"), F.lit(" 民终第00"), (i % 9 + 1).cast("string"), F.lit("号 "))
    return table(spark, sf, "documents").select("doc_id", tx.case_number(F.concat(F.when(i % 4 > 0, number).otherwise(""), F.col("text"))).alias("case_number"))


_LAW = "'总则前言' || chr(10) || '第一编 总则' || chr(10) || '第' || (doc_id % 3 + 1) || '章' || chr(10) || '第一节　节名' || chr(10) || '第一条 ' || replace(text, chr(10), ' ') || chr(10) || ' 续行' || chr(10) || '第二章 新章' || chr(10) || '不属于条' || chr(10) || '第二条之一　' || lang"


@query("""SELECT doc_id, 1 AS section, '第一条' AS label, '第一编 总则>第' || (doc_id % 3 + 1) || '章>第一节　节名' AS path, sha256(trim(regexp_replace('第一条 ' || replace(text, chr(10), ' '), '[\\s\\x0b\\x1c-\\x1f]+$', '')) || chr(10) || '续行') AS digest FROM documents
UNION ALL SELECT doc_id, 2, '第二条之一', '第一编 总则>第二章 新章', sha256('第二条之一　' || lang) FROM documents""")
def statute_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A statute of three levels around every text; a higher heading ends those below it, and what follows a heading before the
    next article belongs to none."""
    law = F.expr(_LAW.replace("chr(10)", "'\\n'"))
    got = composites.statute_sections(table(spark, sf, "documents").select("doc_id", law.alias("content")))
    return got.select("doc_id", "section", "label", F.array_join("heading_path", ">").alias("path"), F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))


@query("""SELECT doc_id, 1 AS section, '案例信息' AS label, source AS content FROM documents UNION ALL SELECT doc_id, 2, '基本案情', lang || chr(10) || 'x' FROM documents UNION ALL SELECT doc_id, 3, '裁判理由', doc_id::VARCHAR FROM documents""")
def decision_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Two sections with an empty one between them."""
    body = F.concat_ws("\n", "source", F.lit("基本案情"), F.concat(F.lit(" "), "lang"), F.lit(""), F.lit("x"), F.lit("裁判结果"), F.lit("裁判理由"), F.col("doc_id").cast("string"))
    return composites.label_sections(table(spark, sf, "documents").select("doc_id", body.alias("content"))).select("doc_id", "section", "label", "content")


def _stop_gram(texts: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({texts}, '[A-Za-z0-9][A-Za-z0-9_.+-]*'), lambda x: lower(x)))"


_Q = "list_slice(string_split(text, ' '), 1, 3)"


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({_stop_gram("text")}) AS term FROM benchmark), n AS (SELECT query_id, CASE WHEN count(*) <= 2 THEN 1 ELSE 3 END AS floor FROM q GROUP BY query_id),
d AS (SELECT doc_id, source, source || ' ' || text AS w FROM documents),
s AS (SELECT query_id, doc_id, any_value(source) AS source, any_value(length(w)) AS len, sum(CASE WHEN length(term) >= 3 THEN 2 ELSE 1 END) AS score FROM q JOIN d ON contains(lower(w), term) GROUP BY query_id, doc_id),
r AS (SELECT s.query_id, doc_id, source, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, len, doc_id) AS rank, score >= floor AS ok FROM s JOIN n ON n.query_id = s.query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS m FROM r WHERE rank <= 15 AND ok)
SELECT * FROM (SELECT query_id, doc_id, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM k WHERE m <= 2) WHERE rank <= 5""")
def decision_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as decisions with their source as title; two of a source."""
    chunks = table(spark, sf, "documents").select("doc_id", "source", F.col("source").alias("title"), F.col("text").alias("content"))
    return composites.decision_retrieval(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), chunks)


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({_stop_gram("text")}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, any_value(length(text)) AS len, sum(CASE WHEN length(term) >= 3 THEN 2 ELSE 1 END) AS score FROM q JOIN (SELECT doc_id, text, lower(text) AS low FROM documents) ON contains(low, term) GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len, doc_id) AS rank FROM s) WHERE rank <= 8""")
def material_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return composites.material_retrieval(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), chunks)


@query("SELECT doc_id, label IS NULL AS fresh FROM (SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label = 3)")
def embedding_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose vector is not of the wanted model get one; ``fresh`` says which."""
    embedder = embedding.HashEmbedder(16, model="3")
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("embedding_model"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")).join(have, "doc_id", "left")
    got = embedding.backfill(docs, embedder, key="doc_id")
    return got.select("doc_id", (F.size("embedding") == 16).alias("fresh"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
p AS (SELECT page_id, a, list_filter(list_transform(regexp_split_to_array(a, '</?p>|<br>|</?h1>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM a)
SELECT page_id, len(p) AS paragraphs, len(string_split(array_to_string(p, ' '), ' ')) AS words, len(string_split(trim(regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1)), ' ')) AS title_words FROM p""")
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Headings and paragraphs of pages by their containers."""
    named = pages.Containers(detail="<body>", title="<h1>", content="<article>")
    got = pages.page_sections(table(spark, sf, "pages").select("page_id", "html"), containers=named)
    words = lambda c: F.size(F.split(c, " "))
    return got.select("page_id", F.size("paragraphs").alias("paragraphs"), words(F.array_join("paragraphs", " ")).alias("words"), words(F.col("title")).alias("title_words"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT 'chunks' AS kind, count(*) AS records, min('L' || o_custkey || ':C' || n) AS first FROM o UNION ALL SELECT 'sources', count(DISTINCT o_custkey), min('L' || o_custkey) FROM o""")
def committed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sources whose orders are chunks, written as one batch, twice, and read back."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("source_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("chunks"))
    path = f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.write_sources(rows, path)
    kept = sinks.Committed(spark, path)
    chunks = kept.read("chunks").agg(F.lit("chunks").alias("kind"), F.count("*").alias("records"), F.min("reference").alias("first"))
    return chunks.unionByName(kept.read("sources").agg(F.lit("sources").alias("kind"), F.count("*").alias("records"), F.min(F.concat(F.lit("L"), "source_id")).alias("first")))
