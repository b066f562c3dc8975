"""Record adapters: JSON payloads of several datasets as one table of records, with the reason of each rejection.

A payload is a VARIANT, so that a number, its digits as text and a boolean are told apart.  An adapter is a row of a
table; what it names is read by one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import cut

_NO_TEXTS = "array<string>"


def field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$['{name}']", "variant")


def kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0), F.lit("VOID"))


def text_of(value: Column) -> Column:
    """A text without white space at its ends; null if it is none or blank."""
    plain = F.regexp_replace(F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string")), tx.UNICODE_ENDS, "")
    return F.when(plain != "", plain)


def identifier_of(value: Column) -> Column:
    """A text or a whole number as text; a boolean is no number."""
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "string")).otherwise(text_of(value))


def _items(value: Column, of) -> Column:
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), of)
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast(_NO_TEXTS))


def texts_of(value: Column) -> Column:
    return _items(value, text_of)


def identifiers_of(value: Column) -> Column:
    return _items(value, identifier_of)


@dataclass(frozen=True)
class Adapter:
    """Where a dataset's payload holds a record's parts; ``labels`` are (field, prefix of its identifiers or None for texts)."""

    dataset: str
    record_kind: str
    record_id: str
    record_id_is_text: bool
    text: str
    record_id_label: str
    alias: tuple[str, str] | None = None  # field, label
    title: str | None = None
    labels: tuple[tuple[str, str | None], ...] = ()


# Three public datasets of cases and questions.
ADAPTERS = {
    a.dataset: a
    for a in (
        Adapter("cail2022-lcr", "case", "path", True, "q", "CAIL2022 path", ("ridx", "CAIL2022 ridx"), None, (("crime", None),)),
        Adapter("lecardv2", "case", "id", False, "fact", "LeCaRDv2 id", None, "title", (("law", None), ("xf", "article:"))),
        Adapter("stard", "consultation", "query_id", False, "问题", "STARD query_id", None, None, (("match_name", None),)),
    )
}


def normalized(payloads: DataFrame, adapter: Adapter, *, version: str, payload: str = "payload", most_chars: int = 30_000) -> DataFrame:
    """The other columns of ``payloads``, and a record's columns with ``reason`` (null if it is admitted)."""
    p = F.col(payload)
    record_id = (text_of if adapter.record_id_is_text else identifier_of)(field(p, adapter.record_id))
    body = text_of(field(p, adapter.text))
    title = text_of(field(p, adapter.title)) if adapter.title else F.lit(None).cast("string")
    alias = identifier_of(field(p, adapter.alias[0])) if adapter.alias else None
    required = lambda value, label: F.when(value.isNull(), f"{label} is required")
    reason = F.coalesce(
        F.when(F.coalesce(kind(p), F.lit("")) != "OBJECT", "research record must be an object"),
        required(record_id, adapter.record_id_label),
        *([required(alias, adapter.alias[1])] if alias is not None else []),
        required(body, "research text"),
        F.when(F.length(body) > most_chars, "research text exceeds max_text_chars"),
    )
    prefixed = lambda ids, prefix: F.transform(ids, lambda x: F.concat(F.lit(prefix), x))
    labels = [texts_of(field(p, f)) if prefix is None else prefixed(identifiers_of(field(p, f)), prefix) for f, prefix in adapter.labels]
    aliases = F.array(F.concat(F.lit(f"{adapter.alias[0]}:"), alias)) if alias is not None else F.array().cast(_NO_TEXTS)
    kept = [F.col(f"`{c}`") for c in payloads.columns if c != payload]
    return payloads.select(
        *kept, F.lit(adapter.dataset).alias("dataset_name"), F.lit(version).alias("dataset_version"), record_id.alias("source_record_id"), aliases.alias("source_aliases"), F.lit(adapter.record_kind).alias("record_kind"),
        body.alias("text"), title.alias("title"), (tx.case_number(title) if adapter.title else F.lit(None).cast("string")).alias("case_number"), F.array_distinct(F.concat(*labels)).alias("labels"),
        tx.identity_hash(body).alias("content_hash"), F.concat(F.lit(f"{adapter.dataset}:"), record_id).alias("reference"), reason.alias("reason"),
    )


def parsed(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Lines (ord, value) that aren't blank, as payloads; a malformed one is null."""
    return lines.where(F.trim(value) != "").select("ord", F.try_parse_json(value).alias("payload"))


def bounded(rows: DataFrame, *, order: str, most: int) -> tuple[DataFrame, bool]:
    """The first ``most`` rows in order, and whether there were more.  The rows are read once and stored."""
    ranked = cut(rows.orderBy(order).limit(most + 1))
    return ranked.orderBy(order).limit(most), ranked.count() > most


def up_to(table: DataFrame, *, order: str, most: int) -> DataFrame:
    """Rows of a table of files that a scan of ``most`` rows in order can see, and no others.  Only the column of the order is
    read to find where it ends; the end is a filter that Parquet skips row groups by."""
    last = table.select(order).where(F.col(order).isNotNull()).orderBy(order).limit(most).agg(F.max(order).alias("last")).first().last
    return table.where(F.lit(False)) if last is None else table.where(F.col(order) <= F.lit(last))


def outcome(months: Column, life: Column, death: Column) -> Column:
    return F.when(death, "death").when(life, "life").when(months <= 0, "non_custodial").when(months <= 12, "up_to_12_months").when(months <= 36, "13_to_36_months").when(months.isNotNull(), "over_36_months")


def _number(value: Column) -> Column:
    """A number; true and false count as 1 and 0."""
    return F.coalesce(F.when(kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, "$", "double")), F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")))


def candidates(payloads: DataFrame, *, nested: bool, target: str, most_chars: int) -> DataFrame:
    """(ord, status, id, facts, outcome_bucket, source_hash): status is candidate, other (another charge) or rejected.

    ``nested`` payloads have {fact, meta: {accusation, term_of_imprisonment}}, others {id, fact, charge, label_months}.
    The charge is looked at first, so a broken record of another charge isn't rejected.
    """
    p = F.col("payload")
    true = lambda v: (kind(v) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False))
    if nested:
        meta = field(p, "meta")
        term = field(meta, "term_of_imprisonment")
        shaped = (kind(p) == "OBJECT") & (kind(meta) == "OBJECT")
        charges = F.transform(texts_of(field(meta, "accusation")), tx.issue)
        bucket = outcome(_number(field(term, "imprisonment")), true(field(term, "life_imprisonment")), true(field(term, "death_penalty")))
    else:
        shaped = kind(p) == "OBJECT"
        charges = F.array(tx.issue(text_of(field(p, "charge"))))
        bucket = outcome(_number(field(p, "label_months")), F.lit(False), F.lit(False))
    facts = text_of(field(p, "fact"))
    wanted = F.coalesce(F.array_contains(charges, F.lit(target)), F.lit(False))
    good = facts.isNotNull() & (F.length(facts) <= most_chars) & bucket.isNotNull()
    status = F.when(~F.coalesce(shaped, F.lit(False)), "rejected").when(~wanted, "other").when(F.coalesce(good, F.lit(False)), "candidate").otherwise("rejected")
    digest = F.sha2(F.encode(facts, "UTF-8"), 256)
    own = None if nested else F.coalesce(identifier_of(field(p, "id")), F.substring(digest, 1, 24))
    out = payloads.select("ord", status.alias("status"), (F.substring(digest, 1, 24) if nested else own).alias("id"), facts.alias("facts"), bucket.alias("outcome_bucket"), digest.alias("source_hash"))
    return out.select("ord", "status", *[F.when(F.col("status") == "candidate", F.col(c)).alias(c) for c in ("id", "facts", "outcome_bucket", "source_hash")])


def pooled(rows: DataFrame, *, most_scanned: int, pool: int) -> DataFrame:
    """What a scan of ``candidates`` in order sees: it ends after ``most_scanned`` rows or with the row that fills the pool.
    Later candidates of a text that an earlier one has are ``duplicate``."""
    scanned, _ = bounded(rows, order="ord", most=most_scanned)
    first = F.min("ord").over(W.partitionBy("source_hash"))
    marked = scanned.withColumn("status", F.when((F.col("status") == "candidate") & (first < F.col("ord")), "duplicate").otherwise(F.col("status")))
    full = marked.where("status = 'candidate'").orderBy("ord").limit(pool).agg(F.when(F.count("*") >= pool, F.max("ord")).alias("stop"))
    return marked.join(F.broadcast(full)).where("stop is null or ord <= stop").withColumn("stopped", F.col("stop").isNotNull()).drop("stop")


def inventory(payloads: DataFrame, *, most_chars: int = 20_000) -> DataFrame:
    """(ord, candidate_id, reason) of candidate texts {id, name, content}; a repeated id is rejected after its first good row."""
    p = F.col("payload")
    name, content = (F.when(kind(field(p, c)) == "STRING", F.try_variant_get(p, f"$.{c}", "string")) for c in ("name", "content"))
    blank = lambda t: F.coalesce(F.regexp_replace(t, tx.UNICODE_ENDS, "") == "", F.lit(True))
    candidate = identifier_of(field(p, "id"))
    reason = F.coalesce(
        F.when(p.isNull(), "malformed"), F.when(kind(p) != "OBJECT", "candidate record must be an object"), F.when(candidate.isNull(), "candidate ID is invalid"), F.when(blank(name), "candidate name is invalid"),
        F.when(blank(content), "candidate content is invalid"), F.when(F.length(content) > most_chars, "candidate content exceeds max_text_chars"),
    )
    checked = payloads.select("ord", candidate.alias("candidate_id"), reason.alias("reason"))
    first = F.min(F.when(F.col("reason").isNull(), F.col("ord"))).over(W.partitionBy("candidate_id"))
    return checked.withColumn("reason", F.coalesce("reason", F.when(first < F.col("ord"), "candidate ID is duplicated")))


def candidate_text(name: Column, content: Column) -> Column:
    return F.concat(name, F.lit("\n"), content)
