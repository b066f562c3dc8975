"""Queries of record adapters, candidate scans and plans, over records made of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import curation, planning
from tessera.operators.positions import concatenated, positioned, zipped
from tessera.plans.base import query, table
from tessera.plans.curation import _PACKED, _packed
from tessera.sources import records

HASH = r"sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g')))"


def _json(struct: Column) -> Column:
    return F.parse_json(F.to_json(struct))


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as payloads: every 11th without a text, every 13th with an id that is no identifier."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    title = F.when(i % 5 == 0, F.concat(F.lit("案号 （２０２０）京"), (i % 40).cast("string"), F.lit("刑初第00"), (i % 7 + 1).cast("string"), F.lit("号")))
    body = F.struct(F.when(i % 13 == 0, "  ").otherwise(i.cast("string")).alias("id"), title.alias("title"), F.when(i % 11 != 0, F.col("text")).alias("fact"), F.array(F.col("lang"), F.lit(" "), F.col("lang")).alias("law"), F.array(i % 3, i % 2).alias("xf"))
    return docs.select("doc_id", _json(body).alias("payload"))


_BODY = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'LeCaRDv2 id is required' WHEN doc_id % 11 = 0 OR {_BODY} = '' THEN 'research text is required' WHEN length({_BODY}) > 2000 THEN 'research text exceeds max_text_chars' END AS reason,
CASE WHEN doc_id % 5 = 0 THEN '(2020)京' || (doc_id % 40) || '刑初' || (doc_id % 7 + 1) || '号' END AS case_number, array_to_string([lang] || ['article:' || (doc_id % 3)] || CASE WHEN doc_id % 3 <> doc_id % 2 THEN ['article:' || (doc_id % 2)] ELSE [] END, ',') AS labels,
CASE WHEN doc_id % 11 <> 0 AND {_BODY} <> '' THEN {HASH} END AS content_hash FROM documents""")
def record_adapter(spark: SparkSession, sf: str) -> DataFrame:
    got = records.normalized(_payloads(spark, sf), records.ADAPTERS["lecardv2"], version="1", most_chars=2000)
    return got.select("doc_id", "reason", "case_number", F.array_join("labels", ",").alias("labels"), "content_hash")


@query(f"""WITH r AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'LeCaRDv2 id is required' WHEN doc_id % 11 = 0 OR {_BODY} = '' THEN 'research text is required' WHEN length({_BODY}) > 2000 THEN 'research text exceeds max_text_chars' END AS reason FROM documents)
SELECT reason, count(*) AS rejected FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    got = records.normalized(_payloads(spark, sf), records.ADAPTERS["lecardv2"], version="1", most_chars=2000)
    return got.where("reason is not null").groupBy("reason").agg(F.count("*").alias("rejected"))


POOL, SCANNED = 60, 150
_SCAN = f"""c AS (SELECT doc_id AS ord, CASE WHEN lang <> 'en' THEN 'other' WHEN {_BODY} = '' OR length({_BODY}) > 1500 THEN 'rejected' ELSE 'candidate' END AS status, sha256({_BODY}) AS h, n_chars % 50 AS months FROM documents ORDER BY doc_id LIMIT {SCANNED}),
d AS (SELECT *, CASE WHEN status = 'candidate' AND min(CASE WHEN status = 'candidate' THEN ord END) OVER (PARTITION BY h) < ord THEN 'duplicate' ELSE status END AS s FROM c),
stop AS (SELECT CASE WHEN count(*) >= {POOL} THEN max(ord) END AS stop FROM (SELECT ord FROM d WHERE s = 'candidate' ORDER BY ord LIMIT {POOL})),
k AS (SELECT ord, s, h, months, stop IS NOT NULL AS stopped FROM d, stop WHERE stop IS NULL OR ord <= stop)"""


@query(f"""WITH {_SCAN} SELECT ord, s AS status, CASE WHEN s IN ('candidate', 'duplicate') THEN CASE WHEN months <= 0 THEN 'non_custodial' WHEN months <= 12 THEN 'up_to_12_months' WHEN months <= 36 THEN '13_to_36_months' ELSE 'over_36_months' END END AS outcome_bucket,
CASE WHEN s IN ('candidate', 'duplicate') THEN h END AS source_hash, stopped FROM k""")
def candidate_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan that ends when the pool is full; the limits are the operator's own."""
    docs = records.up_to(table(spark, sf, "documents"), order="doc_id", most=SCANNED)
    body = F.struct(F.col("text").alias("fact"), F.concat(F.col("lang"), F.lit("罪")).alias("charge"), (F.col("n_chars") % 50).alias("label_months"))
    rows = records.candidates(docs.select(F.col("doc_id").alias("ord"), _json(body).alias("payload")), nested=False, target="en", most_chars=1500)
    return records.pooled(rows, most_scanned=SCANNED, pool=POOL).select("ord", "status", "outcome_bucket", "source_hash", "stopped")


@query(f"""WITH a AS (SELECT row_number() OVER (ORDER BY rep, doc_id) AS ord, doc_id % 900 AS id, source, text FROM (SELECT doc_id, source, text, 0 AS rep FROM documents UNION ALL SELECT doc_id, source, text, 1 FROM documents WHERE doc_id % 7 = 0)),
b AS (SELECT ord, id, CASE WHEN source = (SELECT min(source) FROM documents) THEN 'candidate name is invalid' WHEN {_BODY} = '' THEN 'candidate content is invalid' WHEN length(text) > 3000 THEN 'candidate content exceeds max_text_chars' END AS reason FROM a),
c AS (SELECT *, min(CASE WHEN reason IS NULL THEN ord END) OVER (PARTITION BY id) AS first FROM b)
SELECT coalesce(reason, CASE WHEN first < ord THEN 'candidate ID is duplicated' END, 'admitted') AS outcome, count(*) AS records FROM c GROUP BY 1""")
def candidate_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, and every seventh again; those of one source have no name."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    every = docs.withColumn("rep", F.lit(0)).unionByName(docs.where("doc_id % 7 = 0").withColumn("rep", F.lit(1)))
    least = docs.agg(F.min("source").alias("least"))
    body = F.struct((F.col("doc_id") % 900).alias("id"), F.when(F.col("source") != F.col("least"), F.col("source")).otherwise(" ").alias("name"), F.col("text").alias("content"))
    placed, _ = positioned(every, order=["rep", "doc_id"], name="ord")
    payloads = placed.join(F.broadcast(least)).select("ord", _json(body).alias("payload"))
    return records.inventory(payloads, most_chars=3000).groupBy(F.coalesce("reason", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("records"))


@query("SELECT doc_id, sha256(source || chr(10) || text) AS digest FROM documents")
def candidate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode(records.candidate_text(F.col("source"), F.col("text")), "UTF-8"), 256).alias("digest"))


_PLAN = """q AS (SELECT source AS d, doc_id AS q FROM documents WHERE doc_id % 9 <> 0),
j AS (SELECT d.source AS d, l.doc_id AS q, l.doc_id % 25 AS c, l.quality AS g FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
ds AS (SELECT d, count(*) AS n, d IN (SELECT max(source) FROM documents) AS scanned FROM (SELECT source AS d FROM documents) GROUP BY d),
m AS (SELECT d, count(*) FILTER (EXISTS (SELECT 1 FROM j WHERE j.d = q.d AND j.q = q.q)) AS judged, count(*) AS queries FROM q GROUP BY d),
o AS (SELECT d, count(DISTINCT q) FILTER (q % 9 = 0) AS orphans, count(*) AS judgments, count(DISTINCT c) AS candidates, count(DISTINCT c) FILTER (c >= 20) AS missing FROM j GROUP BY d),
p AS (SELECT ds.d, scanned, coalesce(queries, 0) AS queries, coalesce(judged, 0) AS judged, coalesce(queries - judged, 0) AS without, coalesce(orphans, 0) AS orphans, coalesce(judgments, 0) AS judgments, coalesce(candidates, 0) AS candidates, CASE WHEN scanned THEN coalesce(missing, 0) ELSE 0 END AS missing
      FROM ds LEFT JOIN m ON m.d = ds.d LEFT JOIN o ON o.d = ds.d),
e AS (SELECT *, list_filter([CASE WHEN without > 0 THEN d || ': queries are missing judgments' END, CASE WHEN orphans > 0 THEN d || ': judgments reference unknown queries' END, CASE WHEN missing > 0 THEN d || ': judgments reference missing candidates' END], lambda x: x IS NOT NULL) AS integrity,
      list_filter([CASE WHEN NOT scanned THEN d || ': candidate corpus is not verified' END, CASE WHEN length(d) % 2 = 0 THEN d || ': research evaluation scope is not approved' END, CASE WHEN length(d) % 3 <> 0 THEN d || ': license review is not approved for evaluation' END], lambda x: x IS NOT NULL) AS readiness FROM p)"""


def _benchmark_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset for each source: queries are most documents, judgments their labels; of one the candidates were scanned."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_name"))
    asked = docs.where("doc_id % 9 <> 0").withColumnRenamed("doc_id", "query_id")
    judged = docs.join(table(spark, sf, "labels"), "doc_id").select("dataset_name", F.col("doc_id").alias("query_id"), (F.col("doc_id") % 25).alias("candidate_id"), F.col("quality").alias("grade"))
    size = F.length("dataset_name")
    loads = docs.groupBy("dataset_name").agg(F.lit(0).alias("queries_rejected"), F.lit(False).alias("stopped_at_limit"), F.lit(0).alias("judgments_rejected"), F.lit(0).alias("candidates_rejected"))
    loads = loads.withColumn("license_review_status", F.when(size % 3 == 0, "approved").otherwise("pending")).withColumn("permitted_scopes", F.when(size % 2 == 1, F.array(F.lit("research_evaluation"))).otherwise(F.array().cast("array<string>")))
    known = docs.agg(F.max("dataset_name").alias("dataset_name")).withColumn("candidate_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return planning.benchmark_plan(asked, judged, loads, known)


@query(f"WITH {_PLAN} SELECT d AS dataset_name, queries, judged AS judged_queries, without AS queries_without_judgments, orphans AS orphan_judgment_queries, judgments, candidates AS distinct_candidates, missing AS missing_judgment_candidates, array_to_string(integrity, ';') AS integrity, array_to_string(readiness, ';') AS readiness FROM e")
def benchmark_plan(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["dataset_name", "queries", "judged_queries", "queries_without_judgments", "orphan_judgment_queries", "judgments", "distinct_candidates", "missing_judgment_candidates"]
    return _benchmark_plan(spark, sf).select(*columns, F.array_join("integrity_errors", ";").alias("integrity"), F.array_join("readiness_errors", ";").alias("readiness"))


@query(f"""WITH {_PLAN} SELECT sum(queries)::BIGINT AS queries, sum(judgments)::BIGINT AS judgments, sum(candidates)::BIGINT AS distinct_candidates, sum(len(integrity)) = 0 AS integrity_ready, sum(len(integrity)) + sum(len(readiness)) = 0 AS evaluation_ready, sum(len(integrity) + len(readiness))::INT AS errors FROM e""")
def benchmark_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = planning.benchmark_totals(_benchmark_plan(spark, sf))
    return t.select("queries", "judgments", "distinct_candidates", "integrity_ready", "evaluation_ready", (F.size("integrity_errors") + F.size("readiness_errors")).alias("errors"))


_NORMAL = f"""r AS (SELECT doc_id, source, doc_id % 800 AS sid, CASE WHEN doc_id % 6 = 0 THEN 'n' || (doc_id % 90) END AS cn, CASE WHEN doc_id % 3 = 0 THEN 'consultation' ELSE 'case' END AS kind, {HASH} AS h FROM documents),
d AS (SELECT *, CASE WHEN min(doc_id) OVER (PARTITION BY source, sid) < doc_id THEN 'source_id' WHEN cn IS NOT NULL AND min(doc_id) OVER (PARTITION BY cn) < doc_id THEN 'case_number' WHEN min(doc_id) OVER (PARTITION BY kind, h) < doc_id THEN 'content_hash' END AS dup FROM r)"""


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(i, F.col("source").alias("dataset_name"), (i % 800).alias("sid"), F.when(i % 6 == 0, F.concat(F.lit("n"), (i % 90).cast("string"))).alias("case_number"), F.when(i % 3 == 0, "consultation").otherwise("case").alias("record_kind"), tx.identity_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {_NORMAL} SELECT coalesce(dup, 'unique') AS outcome, count(*) AS records, count(*) FILTER (kind = 'case' AND cn IS NULL) AS cases_without_number, count(*) FILTER (kind = 'consultation') AS consultations FROM d GROUP BY 1")
def normalization_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates by source id, else case number, else content of the same kind."""
    number = F.col("case_number")
    keys = {"source_id": F.concat_ws(":", "dataset_name", "sid"), "case_number": number, "content_hash": F.concat_ws(":", "record_kind", "content_hash")}
    marked = curation.first_occurrence(_normal(spark, sf), keys, F.col("doc_id"))
    case = F.col("record_kind") == "case"
    return marked.groupBy(F.coalesce("duplicate_by", F.lit("unique")).alias("outcome")).agg(F.count("*").alias("records"), F.count_if(case & number.isNull()).alias("cases_without_number"), F.count_if(~case).alias("consultations"))


@query(f"""WITH {_NORMAL}, k AS (SELECT doc_id, unnest([source || ':' || sid] || CASE WHEN doc_id % 4 = 0 THEN [source || ':a' || (doc_id % 300), source || ':a' || (doc_id % 170)] ELSE [] END) AS key FROM r),
m AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key), s AS (SELECT k.doc_id, min(first) AS first FROM k JOIN m ON m.key = k.key GROUP BY k.doc_id),
a AS (SELECT CASE WHEN s.first < r.doc_id THEN 'source_id' WHEN cn IS NOT NULL AND min(r.doc_id) OVER (PARTITION BY cn) < r.doc_id THEN 'case_number' WHEN min(r.doc_id) OVER (PARTITION BY kind, h) < r.doc_id THEN 'content_hash' ELSE 'unique' END AS outcome FROM r JOIN s ON s.doc_id = r.doc_id)
SELECT outcome, count(*) AS records FROM a GROUP BY outcome""")
def normalization_plan_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """As ``normalization_plan``, but a record has aliases, and any source key of an earlier record counts."""
    i = F.col("doc_id")
    alias = lambda n: F.concat("dataset_name", F.lit(":a"), (i % n).cast("string"))
    source = F.concat(F.array(F.concat_ws(":", "dataset_name", "sid")), F.when(i % 4 == 0, F.array(alias(300), alias(170))).otherwise(F.array().cast("array<string>")))
    keys = {"source_id": source, "case_number": F.col("case_number"), "content_hash": F.concat_ws(":", "record_kind", "content_hash")}
    marked = curation.first_occurrence(_normal(spark, sf), keys, i)
    return marked.groupBy(F.coalesce("duplicate_by", F.lit("unique")).alias("outcome")).agg(F.count("*").alias("records"))


@query("""SELECT a.doc_id AS by_id, b.doc_id AS by_size, a.position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) a
JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents) b ON a.position = b.position""")
def positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order of id beside documents in order of size."""
    docs = table(spark, sf, "documents")
    by_size = docs.select("n_chars", F.col("doc_id").alias("by_size"))
    return zipped(docs.select(F.col("doc_id").alias("by_id")), by_size, orders=[["by_id"], ["n_chars", "by_size"]]).select("by_id", "by_size", "position")


@query("""SELECT 0 AS source, item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM benchmark
UNION ALL SELECT 1, doc_id, (SELECT count(*) FROM benchmark) + row_number() OVER (ORDER BY doc_id DESC) - 1 FROM documents""")
def concatenated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Items, then documents from the largest id down, with their places in the whole."""
    items, docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    both = concatenated(items, docs, orders=[["id"], [F.desc("id")]])
    return both.select("source", "id", "position")


@query(f"WITH {_NORMAL} SELECT source AS dataset_name, count(*) AS records_normalized, count(cn) AS records_with_case_number, count(*) FILTER (kind = 'case') AS cases, count(*) FILTER (kind = 'consultation') AS consultations FROM r GROUP BY source")
def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    kinds = lambda k: F.coalesce(F.try_element_at("record_kinds", F.lit(k)), F.lit(0))
    return planning.source_summary(_normal(spark, sf)).select("dataset_name", "records_normalized", "records_with_case_number", kinds("case").alias("cases"), kinds("consultation").alias("consultations"))


@query(f"WITH {_NORMAL} SELECT cn AS identity, string_agg(source || ':' || sid, ',' ORDER BY doc_id) AS members FROM r WHERE cn IS NOT NULL GROUP BY cn HAVING count(DISTINCT source) > 1 AND count(DISTINCT h) > 1 ORDER BY cn LIMIT 20")
def case_number_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 case numbers that several sources have with several contents, and their members in order."""
    return curation.shared_identities(_normal(spark, sf), key="case_number", source="dataset_name", content="content_hash", member=F.concat_ws(":", "dataset_name", "sid"), order="doc_id", k=20).select(F.col("case_number").alias("identity"), F.array_join("members", ",").alias("members"))


BUDGET = {"max_output_tokens": 5000, "max_model_calls": 10, "max_input_tokens": 10**9, "max_batch_input_tokens": 20_000, "max_unique_cases": 150, "discovery_cases": 160, "evaluation_cases": 40}


@query(_PACKED + """, t AS (SELECT count(*) FILTER (o.ordinal <= 160) AS discovery, count(*) FILTER (o.ordinal > 160) AS evaluation, count(DISTINCT batch) AS batches, sum(tokens)::BIGINT AS input_tokens FROM g JOIN o ON o.ordinal = g.ordinal),
l AS (SELECT max(s)::BIGINT AS largest FROM (SELECT sum(tokens) AS s FROM g JOIN o ON o.ordinal = g.ordinal GROUP BY batch))
SELECT discovery, evaluation, batches + 1 AS model_calls, input_tokens + 5000 AS total_tokens, array_to_string(list_filter([CASE WHEN batches + 1 > 10 THEN 'estimated model calls exceed max_model_calls' END, CASE WHEN largest > 20000 THEN 'a batch exceeds max_batch_input_tokens' END,
CASE WHEN discovery + evaluation > 150 THEN 'selected cases exceed max_unique_cases' END, CASE WHEN input_tokens + 5000 > 100000 THEN 'estimated total tokens exceed cumulative remaining tokens' END, 'dataset license review is not approved for model processing'], lambda x: x IS NOT NULL), ';') AS errors FROM t, l""")
def discovery_plan(spark: SparkSession, sf: str) -> DataFrame:
    packed = _packed(spark, sf)
    largest = packed.groupBy("batch").agg(F.sum("tokens").alias("s")).agg(F.max("s").alias("largest_batch"))
    totals = packed.agg(F.count_if(F.col("ordinal") <= 160).alias("discovery"), F.count_if(F.col("ordinal") > 160).alias("evaluation"), F.countDistinct("batch").alias("batches"), F.sum("tokens").cast("long").alias("input_tokens"))
    plan = totals.join(F.broadcast(largest)).withColumn("remaining_tokens", F.lit(100_000))
    out = planning.discovery_errors(plan, budget=BUDGET, declared=True, license_review_status="pending")
    return out.select("discovery", "evaluation", "model_calls", "total_tokens", F.array_join("readiness_errors", ";").alias("errors"))


@query(_PACKED + """ SELECT g.batch, sha256('{"dataset":"d","model":"m","normalization":"n1","prompt":"p1","source_hashes":["' || string_agg(o.sampling_rank, '","' ORDER BY o.ordinal) || '"],"stage":"discovery"}') AS cache_key FROM g JOIN o ON o.ordinal = g.ordinal GROUP BY g.batch""")
def batch_cache_json(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of each batch's payload as compact JSON with sorted keys."""
    head, tail = planning.cache_key_parts({"dataset": "d", "model": "m", "normalization": "n1", "prompt": "p1", "stage": "discovery"}, "source_hashes")
    return curation.identity_of(_packed(spark, sf), ["sampling_rank"], ["ordinal"], ["batch"], head=head, between='","', tail=tail).withColumnRenamed("identity", "cache_key")


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'der')) THEN 'answer is missing one of required terms: [''the'', ''Der'']' END,
CASE WHEN contains(lower(text), 'que') THEN 'answer contains forbidden repeated or irrelevant prompt: que' END, CASE WHEN length(text) > 300 THEN 'answer has ' || length(text) || ' chars; maximum is 300' END,
CASE WHEN turn < 1 THEN 'expected at least 1 legal citations, got ' || turn END, CASE WHEN turn > 3 THEN 'expected at most 3 legal citations, got ' || turn END], lambda x: x IS NOT NULL), ';') AS failures FROM conversations""")
def turn_expectations(spark: SparkSession, sf: str) -> DataFrame:
    failures = planning.turn_failures(F.col("text"), required=[["the", "Der"]], forbidden=["que"], most_chars=300, counts=[(F.col("turn"), "legal citations", 1, 3)])
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(failures, ";").alias("failures"))


@query("""WITH m AS (SELECT conv_id, count(*) AS messages, bool_and(role = CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alternating FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id),
r AS (SELECT conv_id, count(*) AS runs, count(*) FILTER (n <> 2) AS uneven_runs FROM (SELECT conv_id, turn // 2 AS run, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY conv_id)
SELECT m.conv_id, messages, alternating, runs, uneven_runs FROM m JOIN r ON m.conv_id = r.conv_id""")
def persistence_check(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "conversations").withColumn("run", F.floor(F.col("turn") / 2))
    return planning.persistence_failures(said, thread="conv_id", order="turn", role="role", run="run")


@query("""WITH s AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0 OR turn <> 1), x AS (SELECT conv_id, turn + 100 AS turn FROM conversations WHERE conv_id % 7 = 0 AND turn = 0),
b AS (SELECT coalesce(c.conv_id, k.conv_id) AS conv_id, c.turn IS NULL AS unexpected, k.turn IS NULL AS missing FROM (SELECT DISTINCT conv_id, turn FROM conversations) c FULL JOIN (SELECT DISTINCT * FROM (SELECT * FROM s UNION ALL SELECT * FROM x)) k ON c.conv_id = k.conv_id AND c.turn = k.turn)
SELECT conv_id, count(*) FILTER (missing) AS missing, count(*) FILTER (unexpected) AS unexpected, count(*) FILTER (missing OR unexpected) = 0 AS equal FROM b GROUP BY conv_id""")
def persisted_turn_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that were said against turns that are stored: some conversations lack their second, some have one too many."""
    said = table(spark, sf, "conversations").select("conv_id", "turn")
    stored = said.where("conv_id % 5 <> 0 or turn <> 1").unionByName(said.where("conv_id % 7 = 0 and turn = 0").withColumn("turn", F.col("turn") + 100))
    return planning.persisted_ids(said, stored, thread="conv_id", key="turn")


@query("""SELECT count(*) AS scenario_count, sum(turns)::BIGINT AS agent_turns, sum(failed)::INT AS failures, sum(failed) = 0 AND sum(broken) = 0 AS passed, CASE WHEN sum(broken) = 0 THEN sum(failed) = 0 END AS quality_passed
FROM (SELECT conv_id, count(*) AS turns, count(*) FILTER (length(text) > 300) AS failed, count(*) FILTER (role = 'system' AND conv_id % 50 = 0) AS broken FROM conversations GROUP BY conv_id)""")
def suite_result(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    said = lambda rule: F.transform(F.sort_array(F.collect_list(F.when(rule, F.col("turn")))), lambda t: F.concat_ws("/", F.lit("turn"), t))
    scenarios = c.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("turns"), F.lit(1).alias("runs"), said(F.length("text") > 300).alias("failures"), said((F.col("role") == "system") & (F.col("conv_id") % 50 == 0)).alias("infrastructure_failures"))
    return planning.suite_result(scenarios).select("scenario_count", "agent_turns", F.size("failures").alias("failures"), "passed", "quality_passed")
