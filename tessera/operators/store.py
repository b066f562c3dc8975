"""Store semantics as batch transformations: filters, conditional updates, state folds, streams of frames."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import numbered


def visible_chunks(chunks: DataFrame, sources: DataFrame, *, status: str = "effective") -> DataFrame:
    """Chunks of sources that have the status and are approved."""
    return chunks.join(sources.where((F.col("status") == status) & (F.col("review_status") == "approved")).select("source_id"), "source_id", "left_semi")


def needs_embedding(rows: DataFrame, *, embedding: str, model: str, wanted: str) -> DataFrame:
    """Rows without an embedding, or with one of another model."""
    return rows.where(F.col(embedding).isNull() | ~F.col(model).eqNullSafe(F.lit(wanted)))


def numbered_references(parts: DataFrame, *, source: str, pos: str, prefix: str = "L", mark: str = "C") -> DataFrame:
    """Adds references such as L7:C1, counted from 1."""
    return parts.withColumn("reference", F.concat(F.lit(prefix), F.col(source).cast("string"), F.lit(f":{mark}"), (F.col(pos) + 1).cast("string")))


def hydrated(ids: DataFrame, rows: DataFrame, *, key: str) -> DataFrame:
    """Each wanted id with whether it exists."""
    return ids.select(key).distinct().join(rows.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def coverage_check(candidates: DataFrame, reviews: DataFrame, *, key: str) -> DataFrame:
    """Keys that aren't covered exactly once, with the reason: missing, unknown or repeated."""
    a = candidates.groupBy(key).agg(F.count("*").alias("a"))
    b = reviews.groupBy(key).agg(F.count("*").alias("b"))
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(F.col("b") > 1, "repeated")
    return a.join(b, key, "full").select(key, reason.alias("problem")).where("problem is not null")


def alias_join(records: DataFrame, judgments: DataFrame, *, aliases: str) -> DataFrame:
    """Judgments under a record's own id or any of its aliases, whose ``ridx:`` prefix doesn't count."""
    names = F.array_distinct(F.concat(F.array(F.col("record_id")), F.transform(aliases, lambda x: F.regexp_replace(x, "^ridx:", ""))))
    return judgments.join(records.select("record_id", F.explode(names).alias("query_id")), "query_id")


def transitions(events: DataFrame, *, allowed: dict[str, Sequence[str]], start: str) -> DataFrame:
    """(run_id, status, applied, refused): the requested statuses of a run in order, each applied only from an allowed one.

    ``events`` has (run_id, seq, status); a run's transitions are few, so its fold is one expression.
    """
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    zero = F.struct(F.lit(start).alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(table, e.status), acc.status), F.lit(False))
        return F.struct(F.when(ok, e.status).otherwise(acc.status).alias("status"), (acc.applied + ok.cast("int")).alias("applied"), (acc.refused + (~ok).cast("int")).alias("refused"))

    rows = events.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("e"))
    return rows.select("run_id", F.aggregate("e", zero, step).alias("s")).select("run_id", "s.*")


def message_once(messages: DataFrame, *, key: Sequence[str], order: str, content: str) -> DataFrame:
    """One row per key: the first position, and the last content that isn't empty."""
    last = F.max_by(F.when(F.col(content) != "", F.col(content)), F.when(F.col(content) != "", F.col(order)))
    return messages.groupBy(*key).agg(F.min(order).alias("seq"), last.alias("content"))


def swap_if(df: DataFrame, *, column: str, expected: Column, new: Column) -> DataFrame:
    """Compare and set."""
    return df.withColumn("swapped", F.col(column).eqNullSafe(expected)).withColumn(column, F.when(F.col("swapped"), new).otherwise(F.col(column)))


def get_or_create(rows: DataFrame, wanted: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Existing rows, and a new one for each wanted key that has none."""
    new = wanted.select(*key).distinct().join(rows, list(key), "left_anti")
    return rows.select(*key).withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)))


def cascade_delete(parents: DataFrame, children: Sequence[DataFrame], gone: DataFrame, *, key: str) -> list[DataFrame]:
    return [df.join(gone.select(key), key, "left_anti") for df in (parents, *children)]


def call_budget(calls: DataFrame, *, turn: Sequence[str], tool: str, order: Sequence[str], limits: dict[str, int]) -> DataFrame:
    """Adds ``allowed``: whether a call is within its tool's budget for the turn (tools without one: always)."""
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    placed = numbered(calls, group=[*turn, tool], order=order, name="_nth")
    return placed.withColumn("allowed", F.coalesce(F.col("_nth") <= F.try_element_at(most, F.col(tool)), F.lit(True))).drop("_nth")


def call_phase(events: DataFrame, *, run: str, order: Sequence[str], is_call: Column, is_tool: Column) -> DataFrame:
    """Model calls before any tool ran are analysis, later ones synthesis."""
    at = F.struct(*order)
    first = events.where(is_tool).groupBy(F.col(run).alias("_run")).agg(F.min(at).alias("_first"))
    both = events.join(first, F.col(run) == F.col("_run"), "left")
    return both.withColumn("phase", F.when(is_call, F.when(at > F.col("_first"), "synthesis").otherwise("analysis"))).drop("_run", "_first")


def after_last(df: DataFrame, *, thread: str, order: str, mark: Column) -> DataFrame:
    """Rows after the last marked one of their thread; all rows of a thread without a mark."""
    ends = df.where(mark).groupBy(thread).agg(F.max(order).alias("_end"))
    return df.join(ends, thread, "left").where(F.col("_end").isNull() | (F.col(order) > F.col("_end"))).drop("_end")


def sse_frame(event_id: Column, event: Column, data: Column) -> Column:
    return F.concat(F.lit("id: "), event_id.cast("string"), F.lit("\nevent: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def replay(events: DataFrame, *, run: str, order: str, cursor: int, retained: int) -> DataFrame:
    """Retained events after the cursor (a number), with ``gap`` where earlier ones are already lost."""
    newest = events.withColumn("_n", F.row_number().over(W.partitionBy(run).orderBy(F.desc(order)))).where(F.col("_n") <= retained)
    first = newest.groupBy(run).agg(F.min(order).alias("_first"))
    return newest.where(F.col(order) > cursor).join(first, run).withColumn("gap", F.col("_first") > cursor + 1).drop("_n", "_first")


def latencies(df: DataFrame, *, stream: str, ts: str, is_token: Column) -> DataFrame:
    """Milliseconds from a stream's start to its first token and to its end."""
    ms = lambda c: (F.unix_micros(c.cast("timestamp")) / 1000).cast("double")
    first = F.min(F.when(is_token, F.col(ts)))
    return df.groupBy(stream).agg((ms(first) - ms(F.min(ts))).alias("first_token_ms"), (ms(F.max(ts)) - ms(F.min(ts))).alias("total_ms"))


Entry = tuple[str, int, int, int]  # of a key: status, estimate, used input and output
NO_ENTRY: Entry = ("none", 0, 0, 0)


def ledger_step(entry: Entry, free: int, op: str, key: str | None, tokens: int, used_in: int, used_out: int) -> tuple[str, Entry, int]:
    """The outcome of a request, and its key's entry and the scope's free tokens after it."""
    status, estimate, *used = entry
    if not key or not key.strip() or (op == "reserve" and tokens <= 0) or (op == "settle" and min(used_in, used_out) < 0):
        return "invalid", entry, free
    if op == "reserve":
        if status != "none" and estimate != tokens:
            return "conflict", entry, free
        if status in ("reserved", "settled"):
            return "unchanged", entry, free
        return ("reserved", ("reserved", tokens, 0, 0), free - tokens) if tokens <= free else ("over_limit", entry, free)
    if status == "none":
        return "unknown", entry, free
    if op == "settle":
        if status == "settled":
            return "unchanged" if used == [used_in, used_out] else "conflict", entry, free
        if status == "released":
            return "released", entry, free
        after = free + estimate - used_in - used_out
        return ("settled", ("settled", estimate, used_in, used_out), after) if after >= 0 else ("over_limit", entry, free)
    outcome = {"settled": "conflict", "reserved": "released", "released": "unchanged"}[status]
    return (outcome, ("released", *entry[1:]), free + estimate) if outcome == "released" else (outcome, entry, free)


REQUEST = ["seq", "op", "key", "tokens", "input_tokens", "output_tokens"]


def ledger(events: DataFrame, *, limit: int) -> DataFrame:
    """(scope, seq, outcome): reserve, settle and release requests (scope, seq, op, key, tokens, input_tokens, output_tokens).

    A reservation of a key must fit; again with the same estimate it changes nothing, with another it conflicts; a
    released one is reserved anew if it still fits.  It is settled for what was used, which may be more if that fits;
    again it must be the same.  Settled keys can't be released.  A scope's requests depend on each other, so each
    scope is a fold of its own that keeps one row a key and a running total; scopes run in parallel.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        book: dict[str, Entry] = {}
        free, out = limit, []
        for seq, op, key, *amounts in pdf.sort_values("seq")[REQUEST].itertuples(index=False):
            outcome, book[key], free = ledger_step(book.get(key, NO_ENTRY), free, op, key, *amounts)
            out.append((pdf.scope.iloc[0], seq, outcome))
        return pd.DataFrame(out, columns=["scope", "seq", "outcome"])

    kind = events.schema["scope"].dataType.simpleString()
    return events.groupBy("scope").applyInPandas(fold, f"scope {kind}, seq long, outcome string")


def effective_chunks(chunks: DataFrame, sources: DataFrame, *, status: str = "effective", parent: Sequence[str] = ("title",), bulk: Sequence[str] = ("embedding",), with_bulk: bool = False, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Chunks (source_id, chunk_id, chunk_index, ...) of approved sources of a status, with columns of the source, in order of
    title and place; of some ids only, the first ``limit``.  Bulk columns are read only where asked for."""
    live = sources.where((F.col("status") == status) & (F.col("review_status") == "approved")).select("source_id", *parent)
    slim = chunks if with_bulk else chunks.drop(*bulk)
    joined = slim.join(live, "source_id")
    if ids is not None:
        joined = joined.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    ordered = joined.orderBy("title", "source_id", "chunk_index")
    return ordered.limit(limit) if limit is not None else ordered


def owner_view(rows: DataFrame, owner: str, *, column: str = "owner_id") -> DataFrame:
    """What a user may see: every read goes through it."""
    return rows.where(F.col(column) == owner)


def all_hydrated(ids: DataFrame, rows: DataFrame, *, key: str) -> DataFrame:
    """The rows of all wanted ids; an id that has none is an error when it is read."""
    found = ids.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast(rows.schema[key].dataType))
    return found.withColumn(key, checked).drop("_there")


def timed_transitions(events: DataFrame, *, allowed: dict[str, Sequence[str]], start: str, running: str = "running", final: Sequence[str] = ("completed", "needs_clarification", "failed", "cancelled")) -> DataFrame:
    """(run_id, status, applied, refused, started_at, completed_at): ``transitions`` of events (run_id, seq, status, ts) with the
    times of the last start and the last end that were applied."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.lit(None).cast("timestamp")
    zero = F.struct(F.lit(start).alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("refused"), none.alias("started_at"), none.alias("completed_at"))

    def step(acc: Column, e: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.try_element_at(table, e.status), acc.status), F.lit(False))
        return F.struct(
            F.when(ok, e.status).otherwise(acc.status).alias("status"), (acc.applied + ok.cast("int")).alias("applied"), (acc.refused + (~ok).cast("int")).alias("refused"),
            F.when(ok & (e.status == running), e.ts).otherwise(acc.started_at).alias("started_at"), F.when(ok & e.status.isin(*final), e.ts).otherwise(acc.completed_at).alias("completed_at"),
        )

    rows = events.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "status", F.col("ts").cast("timestamp").alias("ts")))).alias("e"))
    return rows.select("run_id", F.aggregate("e", zero, step).alias("s")).select("run_id", "s.*")


def appended(journal: DataFrame, new: DataFrame, runs: DataFrame, *, order: str) -> DataFrame:
    """New events (owner_id, thread_id, run_id, ...) with ``seq`` on from the largest of their thread, and ``refused`` with no seq
    where the run is not one of that owner's thread.  ``journal`` (thread_id, seq), ``runs`` (run_id, owner_id, thread_id)."""
    mine = runs.select("run_id", "owner_id", "thread_id").distinct().withColumn("_ok", F.lit(True))
    checked = new.join(mine, ["run_id", "owner_id", "thread_id"], "left").withColumn("refused", F.col("_ok").isNull()).drop("_ok")
    last = journal.groupBy("thread_id").agg(F.max("seq").alias("_last"))
    placed = numbered(checked, group=["thread_id", "refused"], order=[order], name="_nth")
    return placed.join(last, "thread_id", "left").withColumn("seq", F.when(~F.col("refused"), F.coalesce("_last", F.lit(0)) + F.col("_nth"))).drop("_last", "_nth")


def once_per_run(journal: DataFrame, new: DataFrame, *, event_type: str, order: str) -> DataFrame:
    """Of new events of a type (run_id, ...) the first of each run that has none yet."""
    there = journal.where(F.col("event_type") == event_type).select("run_id")
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("run_id").orderBy(order))).where("_n = 1").drop("_n")
    return first.join(there, "run_id", "left_anti")


def interactions(events: DataFrame) -> DataFrame:
    """(thread_id, version, interaction, expires_at, consumed, refused) after events (thread_id, seq, op, interaction, version, at,
    expires_at) in order: set replaces what is pending, consume takes it if the version is the expected one and it has not
    expired, clear drops it; each change but the first raises the version from 1."""
    none = F.struct(F.lit(0).alias("version"), F.lit(None).cast("string").alias("interaction"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit(0).alias("consumed"), F.lit(0).alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        there = acc.version > 0
        takes = (e.op == "consume") & there & (acc.version == e.version) & acc.interaction.isNotNull() & F.coalesce(acc.expires_at > e["at"], F.lit(False))
        drops = takes | (e.op == "clear") & there
        sets = e.op == "set"
        return F.struct(
            (acc.version + F.when(sets | drops, 1).otherwise(0)).alias("version"), F.when(sets, e.interaction).when(drops, F.lit(None)).otherwise(acc.interaction).alias("interaction"),
            F.when(sets, e.expires_at).when(drops, F.lit(None)).otherwise(acc.expires_at).alias("expires_at"), (acc.consumed + takes.cast("int")).alias("consumed"), (acc.refused + (~sets & ~drops).cast("int")).alias("refused"),
        )

    stamp = lambda c: F.col(c).cast("timestamp").alias(c)
    rows = events.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "interaction", F.col("version").cast("int").alias("version"), stamp("at"), stamp("expires_at")))).alias("e"))
    return rows.select("thread_id", F.aggregate("e", none, step).alias("s")).select("thread_id", "s.*")


def latest_version(rows: DataFrame, *, key: str, published: str) -> DataFrame:
    """The row of each key that was published last (an unknown date is earliest), and ``ties``: how many others share its date."""
    on = F.coalesce(published, F.lit("0001-01-01").cast("date"))
    best = rows.groupBy(key).agg(F.max(on).alias("_on"))
    return rows.join(best, key).where(on == F.col("_on")).drop("_on").withColumn("ties", F.count("*").over(W.partitionBy(key)) - 1)


def source_rank(ranked: DataFrame, *, source: str = "source") -> DataFrame:
    """(query_id, source, rank): sources in the order of their best rows."""
    best = ranked.groupBy("query_id", source).agg(F.min("rank").alias("_best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_best"))).drop("_best")


def ordered_union(rankings: Sequence[DataFrame]) -> DataFrame:
    """(query_id, doc_id, place): candidates of several rankings, each once, in the order of rankings and ranks."""
    tagged = [r.select("query_id", "doc_id", F.struct(F.lit(i).alias("which"), "rank").alias("_at")) for i, r in enumerate(rankings)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    once = whole.groupBy("query_id", "doc_id").agg(F.min("_at").alias("_at"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("_at"))).drop("_at")


def with_parent(children: DataFrame, parents: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """Children with columns of their parent in place of their own; without one they keep them."""
    new = parents.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).withColumn("_there", F.lit(True))
    out = children.join(new, key, "left")
    return out.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_there", *[f"_{c}" for c in columns])


def unified_journal(events: DataFrame, messages: DataFrame, runs: DataFrame) -> DataFrame:
    """One journal (thread_id, run_id, event_id, event_type, content, created_at, seq) of old events, of messages (thread_id, run_id,
    message_id, role, content, created_at) and, for runs (thread_id, run_id, input, created_at) whose input differs from their
    user's message, of that input.  Each thread is numbered by time; at one time the user's message comes first, the
    answer last."""
    columns = ["thread_id", "run_id", "event_id", "event_type", "content", "created_at"]
    said = messages.withColumn("event_type", F.when(F.col("role") == "user", "message.human").otherwise("message.ai")).withColumnRenamed("message_id", "event_id")
    asked = messages.where("role = 'user'").select("run_id", F.col("content").alias("_said"))
    inputs = runs.join(asked, "run_id").where(F.col("input") != F.col("_said")).select("thread_id", "run_id", F.md5(F.concat(F.col("run_id").cast("string"), F.lit("-agent-input")).cast("binary")).alias("event_id"), F.lit("agent.input").alias("event_type"), F.col("input").alias("content"), "created_at")
    whole = events.select(*columns).unionByName(said.select(*columns)).unionByName(inputs)
    first = F.when(F.col("event_type") == "message.human", 0).when(F.col("event_type") == "message.ai", 2).otherwise(1)
    return whole.withColumn("seq", F.row_number().over(W.partitionBy("thread_id").orderBy("created_at", first, "event_id")))


def attempted_tools(messages: DataFrame, *, thread: str, order: str, tools: Sequence[str]) -> DataFrame:
    """(thread, tool): of ``tools`` those that were called since the thread's last human message; they are not offered again."""
    return after_last(messages, thread=thread, order=order, mark=F.col("role") == "human").where((F.col("role") == "tool") & F.col("tool").isin(*tools)).select(thread, "tool").distinct()


def reviewed(sources: DataFrame, decisions: DataFrame, *, at: Column) -> DataFrame:
    """Sources (source_id, review_status, verified_at) after decisions (source_id, decision): approved or rejected, nothing else;
    a source has a time of verification if and only if it is approved."""
    decided = decisions.where(F.col("decision").isin("approved", "rejected")).select("source_id", "decision")
    out = sources.join(decided, "source_id", "left").withColumn("review_status", F.coalesce("decision", "review_status"))
    since = F.when(F.col("decision") == "approved", F.coalesce("verified_at", at)).otherwise(F.col("verified_at"))
    return out.withColumn("verified_at", F.when(F.col("review_status") == "approved", since)).drop("decision")


def claims_kept(claims: DataFrame, *, ts: str, cutoff: Column) -> DataFrame:
    """Idempotency claims without those made before the cutoff."""
    return claims.where(F.col(ts) >= cutoff)


def resumed(events: DataFrame, *, last_event_id: str | None, retained: int = 512) -> DataFrame:
    """What a reader gets who comes back: events (run_id, ms, n, event, data) after the id ``ms-n``, all retained ones without
    one; then an ``end``.  A run that has already dropped the id's successors is told of a ``gap`` first."""
    import re

    if last_event_id is not None and not re.fullmatch(r"\d{1,20}-\d{1,20}", last_event_id):
        raise ValueError("an event id is digits-digits")
    at = F.struct("ms", "n")
    kept = events.withColumn("_back", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("ms"), F.desc("n")))).where(F.col("_back") <= retained)
    cursor = F.struct(*[F.lit(int(x)).alias(c) for x, c in zip(last_event_id.split("-"), ("ms", "n"))]) if last_event_id else None
    later = kept.where(at > cursor) if cursor is not None else kept
    frame = later.select("run_id", F.lit(1).alias("part"), "ms", "n", F.concat_ws("-", F.col("ms").cast("string"), F.col("n").cast("string")).alias("id"), "event", "data")
    special = lambda runs, part, event: runs.select("run_id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("id"), F.lit(event).alias("event"), F.lit("{}").alias("data"))
    out = frame.unionByName(special(events.select("run_id").distinct(), 2, "end"))
    if cursor is not None:
        dropped = events.groupBy("run_id").agg(F.count_if(at > cursor).alias("all")).join(later.groupBy("run_id").agg(F.count("*").alias("got")), "run_id", "left")
        out = out.unionByName(special(dropped.where(F.col("all") > F.coalesce("got", F.lit(0))), 0, "gap"))
    order = W.partitionBy("run_id").orderBy("part", "ms", "n")
    return out.withColumn("place", F.row_number().over(order)).drop("part", "ms", "n")


def material_chunks(chunks: DataFrame, materials: DataFrame, *, case: str) -> DataFrame:
    """Chunks with title and number of their material, in order of both numbers within a case."""
    named = materials.select(case, "material_id", "reference_index", "title")
    return chunks.join(named, [case, "material_id"]).withColumn("place", F.row_number().over(W.partitionBy(case).orderBy("reference_index", "chunk_index")))


def synced(documents: DataFrame, existing: DataFrame, *, order: str) -> DataFrame:
    """Documents (source_url, content, failure) with ``outcome``: failed where they could not be read, unchanged where url and
    content are stored already or came earlier in the batch, else pending_review; and the id of an unchanged one's source."""
    hashed = documents.withColumn("sha", F.sha2(F.encode("content", "UTF-8"), 256))
    known = existing.select("source_url", "sha", F.col("source_id").alias("known_id"))
    first = F.min(order).over(W.partitionBy("source_url", "sha"))
    both = hashed.join(known, ["source_url", "sha"], "left").withColumn("_first", first)
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("known_id").isNotNull() | (F.col("_first") < F.col(order)), "unchanged").otherwise("pending_review")
    return both.withColumn("outcome", outcome).drop("_first")
