"""Runtime events as safe activities, and activities as a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Event types with category, text and activity type; what a payload may hold; names of the activity envelope.
KINDS = {
    "model.started": ("model", "正在分析", "model_started"), "model.completed": ("model", "分析步骤已完成", "model_completed"), "model.error": ("error", "分析过程发生错误", "model_failed"),
    "tool.started": ("tool", "正在调用工具", "tool_started"), "tool.completed": ("tool", "工具调用已完成", "tool_completed"), "tool.error": ("error", "工具调用失败", "tool_failed"),
    "subagent.start": ("subagent", "正在执行子任务", "task_started"), "subagent.step": ("subagent", None, "task_running"), "subagent.end": ("subagent", None, None),
}
ENDS = {"completed": ("子任务已完成", "task_completed"), "failed": ("子任务执行失败", "task_failed"), "timed_out": ("子任务执行超时", "task_timed_out")}
END_OTHERWISE = ("子任务已结束", "task_failed")
KEYS = (
    "call_id", "call_index", "caller", "description", "display_name", "latency_ms", "parent_call_id", "tool_name", "task_id",
    "subagent_type", "message_index", "kind", "status", "truncated", "result_truncated", "error_type",
)
USAGE = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens")
ENVELOPE, VERSION = "runtime.activity", 1


def _choose(key: Column, table: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _scalar(value: Column) -> Column:
    """A JSON scalar as text; null for an object, an array or null."""
    kind = F.schema_of_variant(value)
    return F.when(~kind.rlike("^(?:VOID|OBJECT|ARRAY)"), F.try_variant_get(value, "$", "string"))


def safe_payload(event_type: Column, metadata: Column, content: Column) -> Column:
    """A map of the whitelisted keys of two JSON texts; metadata wins.  Only scalars pass, token counts only as whole numbers
    of 0 or more, a description collapsed and cut to 120 characters; a search that starts describes its query."""
    m, c = F.try_parse_json(metadata), F.try_parse_json(content)
    at = lambda name: F.coalesce(F.try_variant_get(m, f"$.{name}", "variant"), F.try_variant_get(c, f"$.{name}", "variant"))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    described = F.when(F.schema_of_variant(at("description")) == "STRING", tx.preview(text(at("description")), 120)).otherwise(_scalar(at("description")))
    searched = F.when(event_type == "tool.started", tx.search_description(text(F.try_variant_get(m, "$.tool_name", "variant")), text(F.try_variant_get(c, "$.query", "variant"))))
    entries = [F.struct(F.lit("runtime_event").alias("k"), event_type.alias("v"))]
    entries += [F.struct(F.lit(k).alias("k"), (F.coalesce(described, searched) if k == "description" else _scalar(at(k))).alias("v")) for k in KEYS]
    for k in USAGE:
        count = F.try_variant_get(at("usage"), f"$.{k}", "variant")
        whole = F.when(F.schema_of_variant(count) == "BIGINT", F.try_variant_get(count, "$", "bigint"))
        entries.append(F.struct(F.lit(f"usage.{k}").alias("k"), F.when(whole >= 0, whole.cast("string")).alias("v")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def projected(events: DataFrame, *, event_type: str = "event_type", metadata: str = "metadata", content: str = "content") -> DataFrame:
    """Known events with ``category``, ``label`` and ``payload``; unknown types are dropped, and so is all else they held."""
    kind = F.col(event_type)
    payload = safe_payload(kind, F.col(metadata), F.col(content))
    ended = _choose(F.try_variant_get(F.try_parse_json(content), "$.status", "string"), {k: v[0] for k, v in ENDS.items()}, F.lit(END_OTHERWISE[0]))
    label = F.when(kind == "subagent.end", ended).otherwise(_choose(kind, {k: v[1] for k, v in KINDS.items() if v[1]}, F.lit(None).cast("string")))
    kept = [F.col(f"`{c}`") for c in events.columns if c not in (metadata, content)]
    return events.where(kind.isin(*KINDS)).select(*kept, _choose(kind, {k: v[0] for k, v in KINDS.items()}, F.lit(None).cast("string")).alias("category"), label.alias("label"), payload.alias("payload"))


def activity_type(event_type: Column, status: Column) -> Column:
    ended = _choose(status, {k: v[1] for k, v in ENDS.items()}, F.lit(END_OTHERWISE[1]))
    return F.when(event_type == "subagent.end", ended).otherwise(_choose(event_type, {k: v[2] for k, v in KINDS.items() if v[2]}, F.lit(None).cast("string")))


def persisted(events: DataFrame) -> DataFrame:
    """Stored events (seq, event_type, extension: {kind, schema_version, payload} as JSON) as activities with ``type`` and
    ``payload``; other envelopes, versions, event types and malformed ones are dropped."""
    e = F.from_json("extension", "struct<kind: string, schema_version: int, payload: map<string,string>>")
    kept = [F.col(f"`{c}`") for c in events.columns if c != "extension"]
    rows = events.withColumn("_e", e).where((F.col("_e.kind") == ENVELOPE) & (F.col("_e.schema_version") == VERSION) & F.col("_e.payload").isNotNull())
    named = rows.select(*kept, activity_type(F.col("event_type"), F.try_element_at("_e.payload", F.lit("status"))).alias("type"), F.col("_e.payload").alias("payload"))
    return named.where(F.col("type").isNotNull())


def reduced_timeline(activities: DataFrame, *, run: str, running: Column | None = None, failed: Column | None = None) -> DataFrame:
    """One row an item of a run's activities (run, idx, event_type, type, tool_name, call_id, task_id, caller, subagent_type,
    description, status, latency_ms, call_index): key, kind, level, parent_key, technical_name, description, state,
    duration_ms and position.

    Work of a subagent is one item by task, also the tool call that delegates to it; other tool calls are items by call,
    below the subagent that made them; the main model's calls are one item before other work and one after.  Of each
    call its last activity counts.  An item runs while a call does and the run does; otherwise failed goes before
    timed out before completed.  Children follow their parent; those whose parent is unknown come last.
    """
    running, failed = running if running is not None else F.lit(False), failed if failed is not None else F.lit(False)
    kind, live, tool, caller = F.coalesce("event_type", "type"), F.col("type"), F.col("tool_name"), F.coalesce("caller", F.lit("unknown"))
    delegated = F.when(F.startswith(tool, F.lit("delegate_")), F.substring(tool, 10, 1 << 20))
    agent = F.coalesce("subagent_type", delegated)
    task = F.concat(F.lit("subagent:"), F.coalesce("task_id", "call_id", F.concat(F.lit("legacy:"), agent)))
    by_agent = F.when(F.startswith(caller, F.lit("subagent:")), F.substring(caller, 10, 1 << 20))
    is_tool = agent.isNull() & (F.startswith(kind, F.lit("tool.")) | F.startswith(live, F.lit("tool_"))) & (tool != "")
    is_model = agent.isNull() & ~F.coalesce(is_tool, F.lit(False)) & (F.startswith(kind, F.lit("model.")) | F.startswith(live, F.lit("model_"))) & ~caller.rlike("^(?:subagent|middleware):")
    rows = activities.where((kind != "subagent.step") & (live != "task_running")).withColumn("item", F.when(agent.isNotNull(), "subagent").when(is_tool, "tool").when(is_model, "model"))
    rows = rows.withColumn("_agent", agent).withColumn("_of", F.coalesce(agent, by_agent)).withColumn("_task", F.when(agent.isNotNull(), task)).withColumn("_by", by_agent)
    before = W.partitionBy(run).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    named = W.partitionBy(run, "_of").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    seen = F.coalesce(F.max(F.col("item").isin("subagent", "tool")).over(before), F.lit(False))
    rows = rows.withColumn("_seen", seen).withColumn("_last_task", F.last("_task", True).over(named)).where("item is not null")
    phase = F.when((F.col("call_index") == 1) | (F.coalesce("call_index", F.lit(0)) == 0) & ~F.col("_seen"), "analysis").otherwise("synthesis")
    call = F.coalesce("call_id", F.concat_ws(":", caller, tool, F.col("idx").cast("string")))
    key = F.when(F.col("item") == "subagent", F.col("_task")).when(F.col("item") == "tool", F.concat(F.lit("tool:"), call)).otherwise(F.concat(F.lit("model:"), phase))
    parent = F.when((F.col("item") == "tool") & F.col("_by").isNotNull(), F.coalesce(F.concat(F.lit("subagent:"), F.col("task_id")), F.col("_last_task")))
    state = (
        F.when(F.endswith(live, F.lit("failed")) | F.coalesce(F.endswith("event_type", F.lit(".error")), F.lit(False)), "failed")
        .when((live == "task_timed_out") | F.coalesce(F.col("status") == "timed_out", F.lit(False)), "timed_out")
        .when(F.endswith(live, F.lit("completed")) | F.coalesce(F.endswith("event_type", F.lit(".completed")) | (F.col("event_type") == "subagent.end"), F.lit(False)), "completed").otherwise("running")
    )
    identity = F.coalesce("call_id", "task_id", F.concat_ws(":", kind, F.col("idx").cast("string")))
    level = F.when((F.col("item") == "tool") & F.col("_by").isNotNull(), 1).otherwise(0)
    technical = F.when(F.col("item") == "subagent", F.col("_agent")).when(F.col("item") == "tool", tool)
    facts = rows.select(run, "idx", key.alias("key"), "item", level.alias("level"), parent.alias("parent_key"), technical.alias("technical_name"), "description", identity.alias("_id"), state.alias("_state"), "latency_ms")
    first = lambda c: F.min_by(c, "idx").alias(c)
    told = F.when(F.col("description").isNotNull(), F.col("idx"))
    calls = facts.groupBy(run, "key", "_id").agg(F.max_by("_state", "idx").alias("_state"), F.max_by("latency_ms", "idx").alias("latency_ms"))
    has = lambda s: F.bool_or(F.col("_state") == s)
    ended = calls.groupBy(run, "key").agg(has("running").alias("_runs"), has("failed").alias("_failed"), has("timed_out").alias("_late"), F.max("latency_ms").alias("duration_ms"))
    items = facts.groupBy(run, "key").agg(F.min("idx").alias("_order"), *map(first, ("item", "level", "parent_key", "technical_name")), F.max_by("description", told).alias("description")).join(ended, [run, "key"])
    final = F.when(F.col("_runs"), F.when(running, "running").when(failed, "failed").otherwise("completed")).when(F.col("_failed"), "failed").when(F.col("_late"), "timed_out").otherwise("completed")
    parents = items.where("parent_key is null").select(run, F.col("key").alias("parent_key"), F.col("_order").alias("_parent_order"))
    placed = items.join(parents, [run, "parent_key"], "left")
    orphan = F.col("parent_key").isNotNull() & F.col("_parent_order").isNull()
    order = [orphan, F.coalesce("_parent_order", "_order"), F.col("parent_key").isNotNull(), F.col("_order")]
    position = F.row_number().over(W.partitionBy(run).orderBy(*order))
    return placed.select(run, "key", F.col("item").alias("kind"), "level", "parent_key", "technical_name", "description", final.alias("state"), "duration_ms", position.alias("position"))
