"""Plans over curated datasets: what a benchmark, a sample or a conversation suite holds, and what speaks against it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_identity(payload: object) -> str:
    """SHA-256 of a small plan's canonical JSON: sorted keys, no blanks, letters as they are."""
    return "sha256:" + hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cache_key_parts(payload: dict[str, str], listed: str) -> tuple[str, str]:
    """What stands before and after the items of the list ``listed`` in a payload's compact JSON with sorted keys."""
    head, tail = json.dumps(payload | {listed: ["\0"]}, sort_keys=True, separators=(",", ":")).split('"\\u0000"')
    return head + '"', '"' + tail


def dataset_identity(declared: str | None, *, path: str, size: int, modified: int) -> tuple[str, bool]:
    """The declared hash, or what tells an unverified file from another; and whether it was declared."""
    if not declared:
        return f"unverified:{path}:{size}:{modified}", False
    digest = declared.strip().lower()
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError("a hash has 64 hexadecimal digits")
    return f"sha256:{digest}", True


def messages(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """The messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), text if isinstance(text, Column) else F.lit(text)) for rule, text in rules]))


def unique_or_error(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """The rows; an error when it runs if a key repeats."""
    many = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    if not many.isEmpty():
        raise ValueError(f"{what} are not unique")
    return df


def query_ids(records: DataFrame) -> DataFrame:
    """(dataset_name, query_id) of records: the ridx aliases where a dataset has them, else the record ids."""
    aliases = F.transform(F.filter("source_aliases", lambda a: F.startswith(a, F.lit("ridx:"))), lambda a: F.substring(a, 6, 1 << 20))
    return records.select("dataset_name", F.explode(F.when(F.col("dataset_name") == "cail2022-lcr", aliases).otherwise(F.array("source_record_id"))).alias("query_id"))


def benchmark_plan(queries: DataFrame, judgments: DataFrame, loads: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """One row a dataset: counts, and what its integrity and its readiness lack.

    ``queries`` (dataset_name, query_id), ``judgments`` (dataset_name, query_id, candidate_id, grade), ``loads``
    (dataset_name, queries_rejected, stopped_at_limit, judgments_rejected, candidates_rejected, license_review_status,
    permitted_scopes), ``inventory`` (dataset_name, candidate_id) of those datasets whose candidates were scanned.
    """
    d = "dataset_name"
    asked, judged = queries.select(d, "query_id").distinct(), judgments.select(d, "query_id").distinct()
    sides = asked.withColumn("q", F.lit(1)).join(judged.withColumn("j", F.lit(1)), [d, "query_id"], "full").groupBy(d)
    matched = sides.agg(F.count("q").alias("queries"), F.count_if(F.expr("q = 1 and j = 1")).alias("judged_queries"), F.count_if(F.col("j").isNull()).alias("queries_without_judgments"), F.count_if(F.col("q").isNull()).alias("orphan_judgment_queries"))
    candidates = judgments.select(d, "candidate_id").distinct()
    counts = judgments.groupBy(d).agg(F.count("*").alias("judgments")).join(candidates.groupBy(d).agg(F.count("*").alias("distinct_candidates")), d)
    grades = judgments.groupBy(d, "grade").agg(F.count("*").alias("n")).groupBy(d).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("grade").cast("string"), "n")))).alias("grade_distribution"))
    plan = loads.join(matched, d, "left").join(counts, d, "left").join(grades, d, "left")
    if inventory is not None:
        known = inventory.select(d, "candidate_id").distinct()
        verified = known.groupBy(d).agg(F.count("*").alias("candidate_records"))
        missing = candidates.join(known.select(d).distinct(), d, "left_semi").join(known, [d, "candidate_id"], "left_anti").groupBy(d).agg(F.count("*").alias("missing_judgment_candidates"))
        plan = plan.join(verified, d, "left").join(missing, d, "left")
    else:
        plan = plan.withColumn("candidate_records", F.lit(None).cast("long")).withColumn("missing_judgment_candidates", F.lit(None).cast("long"))
    plan = plan.withColumn("candidate_corpus_verified", F.col("candidate_records").isNotNull()).na.fill(0, ["queries", "judged_queries", "queries_without_judgments", "orphan_judgment_queries", "judgments", "distinct_candidates", "candidate_records", "missing_judgment_candidates"])
    say = lambda text: F.concat(F.col(d), F.lit(f": {text}"))
    verified = F.col("candidate_corpus_verified")
    integrity = messages([
        (F.col("queries_rejected") > 0, say("query records were rejected")), (F.col("stopped_at_limit"), say("query loading stopped at limit")), (F.col("judgments_rejected") > 0, say("relevance records were rejected")),
        (F.col("queries_without_judgments") > 0, say("queries are missing judgments")), (F.col("orphan_judgment_queries") > 0, say("judgments reference unknown queries")),
        (verified & (F.col("candidates_rejected") > 0), say("candidate records were rejected")), (F.col("missing_judgment_candidates") > 0, say("judgments reference missing candidates")),
    ])
    readiness = messages([
        (~verified, say("candidate corpus is not verified")), (~F.array_contains("permitted_scopes", F.lit("research_evaluation")), say("research evaluation scope is not approved")),
        (F.col("license_review_status") != "approved", say("license review is not approved for evaluation")),
    ])
    return plan.withColumn("integrity_errors", integrity).withColumn("readiness_errors", readiness)


def benchmark_totals(plan: DataFrame) -> DataFrame:
    """The plan of all datasets in one row."""
    total = lambda c: F.sum(c).alias(c)
    errors = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("dataset_name", c))), lambda x: x[c])).alias(c)
    out = plan.agg(*map(total, ("queries", "judged_queries", "queries_without_judgments", "orphan_judgment_queries", "judgments", "distinct_candidates")), errors("integrity_errors"), errors("readiness_errors"), F.bool_or("candidate_corpus_verified").alias("candidate_corpus_scanned"))
    ready = F.size("integrity_errors") == 0
    return out.withColumn("integrity_ready", ready).withColumn("evaluation_ready", ready & (F.size("readiness_errors") == 0))


def source_summary(records: DataFrame) -> DataFrame:
    """Per dataset: records, how many with a case number, and how many of each kind."""
    kinds = records.groupBy("dataset_name", "record_kind").agg(F.count("*").alias("n")).groupBy("dataset_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("record_kind", "n")))).alias("record_kinds"))
    return records.groupBy("dataset_name").agg(F.count("*").alias("records_normalized"), F.count_if(F.coalesce(F.col("case_number") != "", F.lit(False))).alias("records_with_case_number")).join(kinds, "dataset_name")


def discovery_errors(plan: DataFrame, *, budget: dict[str, int], declared: bool, license_review_status: str) -> DataFrame:
    """Adds budget_errors and readiness_errors to a plan's row (discovery, evaluation, batches, largest_batch, input_tokens,
    remaining_tokens), and the calls and tokens that it would take: one more call merges the discovery's batches."""
    calls = F.col("batches") + F.when(F.col("discovery") > 0, 1).otherwise(0)
    plan = plan.withColumn("model_calls", calls).withColumn("total_tokens", F.col("input_tokens") + budget["max_output_tokens"])
    over = [
        (F.col("model_calls") > budget["max_model_calls"], "estimated model calls exceed max_model_calls"), (F.col("input_tokens") > budget["max_input_tokens"], "estimated input tokens exceed max_input_tokens"),
        (F.col("largest_batch") > budget["max_batch_input_tokens"], "a batch exceeds max_batch_input_tokens"), (F.col("discovery") + F.col("evaluation") > budget["max_unique_cases"], "selected cases exceed max_unique_cases"),
        (F.col("total_tokens") > F.col("remaining_tokens"), "estimated total tokens exceed cumulative remaining tokens"),
    ]
    lacks = [
        (F.lit(not declared), "dataset SHA-256 has not been declared from an acquisition check"), (F.lit(license_review_status != "approved"), "dataset license review is not approved for model processing"),
        (F.col("discovery") < budget["discovery_cases"], "discovery sample is smaller than the requested size"), (F.col("evaluation") < budget["evaluation_cases"], "evaluation sample is smaller than the requested size"),
    ]
    return plan.withColumn("budget_errors", messages(over)).withColumn("readiness_errors", messages([*over, *lacks]))


def select_scenarios(scenarios: DataFrame, wanted: Sequence[str], *, most: int) -> DataFrame:
    """The scenarios (id, ...) that are asked for, each once and in that order, or all; unknown ids and too many are errors."""
    if not 1 <= most <= 20:
        raise ValueError("most must lie between 1 and 20")
    order = list(dict.fromkeys(wanted))
    known = {r.id for r in scenarios.select("id").collect()} if order else set()
    if unknown := [w for w in order if w not in known]:
        raise ValueError(f"unknown scenarios: {', '.join(unknown)}")
    chosen = scenarios.where(F.col("id").isin(order)).withColumn("_at", F.array_position(F.array(*map(F.lit, order)), F.col("id"))).orderBy("_at").drop("_at") if order else scenarios
    if (n := chosen.count()) > most:
        raise ValueError(f"{n} scenarios are more than {most}")
    return chosen


def suite_plan(scenarios: DataFrame) -> DataFrame:
    """How many scenarios and turns a run would take; ``scenarios`` have an array ``turns``."""
    return scenarios.agg(F.count("*").alias("scenario_count"), F.sum(F.size("turns")).alias("agent_turn_limit"))


def suite_result(scenarios: DataFrame) -> DataFrame:
    """The roll-up of executed scenarios (id, turns, runs, failures, infrastructure_failures): all failures in order of id;
    quality is unknown where the infrastructure failed."""
    flat = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", c))), lambda x: x[c])).alias(c)
    out = scenarios.agg(F.count("*").alias("scenario_count"), F.sum("turns").alias("agent_turns"), F.sum("runs").alias("agent_runs"), flat("failures"), flat("infrastructure_failures"))
    good, whole = F.size("failures") == 0, F.size("infrastructure_failures") == 0
    return out.withColumn("passed", good & whole).withColumn("quality_passed", F.when(whole, good))


def count_check(actual: Column, label: str, least: int, most: int | None) -> list[tuple[Column, Column]]:
    """Rules for a count's range."""
    say = lambda text, n: F.concat(F.lit(f"expected at {text} {n} {label}, got "), actual.cast("string"))
    return [(actual < least, say("least", least))] + ([(actual > most, say("most", most))] if most is not None else [])


def turn_failures(answer: Column, *, required: Sequence[Sequence[str]] = (), forbidden: Sequence[str] = (), most_chars: int | None = None, questions: Column | None = None, most_questions: int | None = None, counts: Sequence[tuple] = ()) -> Column:
    """What an answer fails of its expectations; letters count alike in either case."""
    low = F.lower(answer)
    has = lambda t: F.contains(low, F.lit(t.lower()))
    rules: list[tuple[Column, Column | str]] = []
    for group in required:
        found = F.lit(False)
        for term in group:
            found = found | has(term)
        rules.append((~found, f"answer is missing one of required terms: {list(group)}"))
    rules += [(has(t), f"answer contains forbidden repeated or irrelevant prompt: {t}") for t in forbidden]
    if most_chars is not None:
        rules.append((F.length(answer) > most_chars, F.concat(F.lit("answer has "), F.length(answer).cast("string"), F.lit(f" chars; maximum is {most_chars}"))))
    if questions is not None and most_questions is not None:
        rules.append((questions > most_questions, F.concat(F.lit("answer has "), questions.cast("string"), F.lit(f" follow-up questions; maximum is {most_questions}"))))
    for actual, label, least, most in counts:
        rules += count_check(actual, label, least, most)
    return messages(rules)


def persisted_ids(expected: DataFrame, stored: DataFrame, *, thread: str, key: str) -> DataFrame:
    """Per thread: ids that were sent and aren't stored, ids that are stored and weren't sent, and whether the sets are equal."""
    sides = expected.select(thread, key).distinct().withColumn("_sent", F.lit(True)).join(stored.select(thread, key).distinct().withColumn("_kept", F.lit(True)), [thread, key], "full")
    out = sides.groupBy(thread).agg(F.count_if(F.col("_kept").isNull()).alias("missing"), F.count_if(F.col("_sent").isNull()).alias("unexpected"))
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def persistence_failures(messages_: DataFrame, *, thread: str, order: str, role: str, run: str) -> DataFrame:
    """Per thread: messages, whether roles alternate from the user on, and how many runs don't have exactly two messages."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(thread).orderBy(order))
    odd = F.col(role) != F.when(place % 2 == 1, "user").otherwise("assistant")
    per_thread = messages_.withColumn("_odd", odd).groupBy(thread).agg(F.count("*").alias("messages"), (F.count_if("_odd") == 0).alias("alternating"))
    runs = messages_.groupBy(thread, run).agg(F.count("*").alias("n")).groupBy(thread).agg(F.count("*").alias("runs"), F.count_if(F.col("n") != 2).alias("uneven_runs"))
    return per_thread.join(runs, thread)
