"""Case profiles and factors: patches, updates by key, seeding, the gate for follow-up questions, a turn's effect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.rules import merge_lists

LISTS = ("parties", "claims", "key_facts", "disputed_issues", "evidence_notes")


def clean_list(items: Column) -> Column:
    """Trimmed, non-empty, each once."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.regexp_replace(x, tx.UNICODE_ENDS, "")), lambda x: x != ""))


def apply_patch(rows: DataFrame, *, lists: Sequence[str] = LISTS) -> DataFrame:
    """Columns of a profile after the patch in the columns of the same names with ``patch_``: lists gain what is missing; a
    given list of missing information replaces the old; what is resolved leaves it; a case type replaces the old one."""
    none = F.array().cast("array<string>")
    patch = lambda c: F.col(f"patch_{c}")
    missing = F.coalesce(clean_list(patch("missing_information")), F.col("missing_information"), none)
    resolved = F.coalesce(clean_list(patch("resolved_missing_information")), none)
    out = {c: merge_lists(F.coalesce(F.col(c), none), F.coalesce(clean_list(patch(c)), none), none) for c in lists}
    out["missing_information"] = F.filter(missing, lambda x: ~F.array_contains(resolved, x))
    out["case_type"] = F.coalesce(F.when(F.trim(patch("case_type")) != "", F.trim(patch("case_type"))), F.col("case_type"))
    return rows.withColumns(out)


def retrieval_text(*, case_type: Column, lists: Sequence[Column], factors: Column) -> Column:
    """A profile as words for a search: its texts, and label and value of each factor that is not unknown."""
    told = F.transform(F.filter(factors, lambda f: f["state"] != "unknown"), lambda f: F.when(f["value"].isNull(), f["label"]).otherwise(F.concat(f["label"], F.lit(":"), f["value"])))
    return tx.joined(tx.one(case_type), *lists, told)


def coerced(df: DataFrame) -> DataFrame:
    """Factor updates (type, state, value, question) made consistent, and ``valid``: an unknown factor has no value and needs
    a question; a boolean that is asserted false is denied, one that is denied but true is conflicting."""
    boolean = (F.col("type") == "boolean") & F.col("value").isin("true", "false")
    state = F.when(boolean & (F.col("value") == "false") & (F.col("state") == "asserted"), "denied").when(boolean & (F.col("value") == "true") & (F.col("state") == "denied"), "conflicting").otherwise(F.col("state"))
    unknown = F.col("state") == "unknown"
    return df.withColumns({"valid": ~unknown | F.coalesce(F.trim("question") != "", F.lit(False)), "value": F.when(~unknown, F.col("value")), "state": state})


def upsert_factors(factors: DataFrame, updates: DataFrame, *, case: str, cap: int = 80) -> DataFrame:
    """Factors (case, key, ord, ...) after updates (case, key, ord, state, value, materiality, question, ...) in order.

    A known key takes the last update's columns (of the questions the last that is not empty); a new one is appended.  The
    first update that would pass the cap ends the case's updates.
    """
    known = factors.select(case, "key").distinct().withColumn("_known", F.lit(True))
    have = factors.groupBy(case).agg(F.count("*").alias("_have"))
    first = F.min("ord").over(W.partitionBy(case, "key"))
    fresh = updates.join(known, [case, "key"], "left").withColumn("_new", F.col("_known").isNull() & (F.col("ord") == first))
    nth = F.sum(F.col("_new").cast("int")).over(W.partitionBy(case).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    counted = fresh.join(have, case, "left").withColumn("_over", F.coalesce("_have", F.lit(0)) + nth > cap)
    kept = counted.where(~F.col("_over"))
    last = lambda c: F.max_by(c, "ord").alias(c)
    asked = F.when(F.col("question") != "", F.col("question"))
    folded = kept.groupBy(case, "key").agg(last("state"), last("value"), last("materiality"), F.max_by(asked, F.when(asked.isNotNull(), F.col("ord"))).alias("question"), F.min("ord").alias("seen"))
    old = factors.select(case, "key", F.col("ord").alias("_ord"), *[F.col(c).alias(f"_{c}") for c in ("state", "value", "materiality", "question")])
    both = old.join(folded, [case, "key"], "full")
    changed = F.col("seen").isNotNull()
    place = F.struct(F.col("_ord").isNull().alias("new"), F.coalesce("_ord", "seen").alias("at"))
    out = [F.when(changed, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("state", "value", "materiality")]
    return both.select(case, "key", *out, F.coalesce("question", "_question").alias("question"), F.row_number().over(W.partitionBy(case).orderBy(place)).alias("ord"))


def seeded(factors: DataFrame, definitions: DataFrame, *, case: str) -> DataFrame:
    """Factors with an unknown one for each definition (case, key, label, type, question, materiality) that has none."""
    new = definitions.join(factors.select(case, "key"), [case, "key"], "left_anti").withColumn("state", F.lit("unknown")).withColumn("value", F.lit(None).cast("string"))
    return factors.unionByName(new.select(*factors.columns)) if set(factors.columns) <= set(new.columns) else factors.unionByName(new, allowMissingColumns=True)


def follow_ups(candidates: DataFrame, targets: DataFrame, factors: DataFrame, reviews: DataFrame, *, case: str = "case_id", most: int = 2) -> DataFrame:
    """(case, key, question, rank): the first ``most`` questions that a legal question's turn asks.

    A candidate (case, ord, key, target) counts if its target (case, target, kind) is an estimate, a calculation or an
    action, its review (case, key, status) is unresolved, and its factor is unknown, of high materiality and has a question.
    """
    wanted = targets.where(F.col("kind").isin("estimate", "calculation", "action")).select(case, "target")
    open_ = reviews.where("status = 'unresolved'").select(case, "key").distinct()
    asked = factors.where("state = 'unknown' and materiality = 'high' and question <> ''").select(case, "key", "question")
    fit = candidates.join(wanted, [case, "target"], "left_semi").join(open_, [case, "key"], "left_semi").join(asked, [case, "key"])
    once = fit.groupBy(case, "key", "question").agg(F.min("ord").alias("ord"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy(case).orderBy("ord"))).where(F.col("rank") <= most).select(case, "key", "question", "rank")


def committed_factors(factors: DataFrame, admitted: DataFrame, *, case: str = "case_id") -> DataFrame:
    """Factors that a turn leaves in the profile: known ones, and unknown ones that are asked about."""
    asked = factors.where("state = 'unknown'").join(admitted.select(case, "key"), [case, "key"], "left_semi")
    return factors.where("state <> 'unknown'").unionByName(asked.select(*factors.columns))


def effective_turn(turns: DataFrame) -> DataFrame:
    """A turn (intent, answer_targets, legal_issue) beside the profile's pending_targets (texts): an update of the case while
    targets are pending goes on with them as a legal question."""
    resumed = (F.col("intent") == "case_update") & (F.size("pending_targets") > 0)
    targets = F.when(F.size("answer_targets") > 0, F.col("answer_targets")).when(resumed, F.col("pending_targets")).otherwise(F.col("answer_targets"))
    issue = F.coalesce(F.when(F.col("legal_issue") != "", F.col("legal_issue")), F.when(resumed, F.get("pending_targets", F.lit(0))))
    return turns.withColumns({"effective_targets": targets, "effective_issue": issue, "effective_intent": F.when(resumed, "legal_question").otherwise(F.col("intent"))})
