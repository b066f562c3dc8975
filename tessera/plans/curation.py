"""Dataset curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, curation
from tessera.operators.rules import outcome_bucket
from tessera.plans.base import query, table

HASH = r"sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g')))"


# Every tenth document once more in full-width letters, which identify the same text.
NARROW, WIDE = "abcdefghijklmnopqrstuvwxyz0123456789", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
DOCUMENTS = "(SELECT doc_id, source, text FROM documents UNION ALL SELECT doc_id + 10000000, 'wide', text FROM documents WHERE doc_id % 10 = 0)"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    wide = docs.where("doc_id % 10 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("wide").alias("source"), F.translate("text", NARROW, WIDE).alias("text"))
    return docs.unionByName(wide).withColumn("content_hash", tx.identity_hash(F.col("text")))


@query(f"SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY {HASH}) < doc_id THEN 'content' END AS duplicate_by FROM {DOCUMENTS}")
def dedup_first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return curation.first_occurrence(_records(spark, sf).select("doc_id", "content_hash"), {"content": F.col("content_hash")}, F.col("doc_id")).select("doc_id", "duplicate_by")


@query(f"""WITH d AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY {HASH}) AS first FROM {DOCUMENTS})
SELECT source, count(*) AS scanned, count(*) FILTER (first = doc_id) AS unique_records, count(*) FILTER (first < doc_id) AS duplicates FROM d GROUP BY source""")
def dedup_accounting(spark: SparkSession, sf: str) -> DataFrame:
    marked = curation.first_occurrence(_records(spark, sf).select("doc_id", "source", "content_hash"), {"content": F.col("content_hash")}, F.col("doc_id"))
    return marked.groupBy("source").agg(F.count("*").alias("scanned"), F.count_if(F.col("duplicate_by").isNull()).alias("unique_records"), F.count("duplicate_by").alias("duplicates"))


@query(f"""SELECT * FROM (SELECT {HASH} AS content_hash, count(*) AS members, count(DISTINCT source) AS sources, min(doc_id) AS first_member FROM {DOCUMENTS} GROUP BY {HASH})
WHERE sources >= 2 ORDER BY content_hash LIMIT 50""")
def cross_source_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 groups, a report as the plan that it feeds asks for."""
    return curation.cross_source_groups(_records(spark, sf).select("doc_id", "source", "content_hash"), key="content_hash", source="source", member="doc_id", order="doc_id", k=50)


@query("""WITH p AS (SELECT page_id, url, sha256(html) AS sha FROM pages)
SELECT page_id, CASE WHEN min(page_id) OVER (PARTITION BY url, sha) < page_id THEN 'unchanged' WHEN min(page_id) OVER (PARTITION BY url) < page_id THEN 'new_version' ELSE 'new' END AS outcome FROM p""")
def version_sync_outcome(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha"))
    marked = curation.first_occurrence(pages, {"same": F.concat_ws(" ", "url", "sha"), "url": F.col("url")}, F.col("page_id"))
    return marked.select("page_id", F.when(F.col("duplicate_by") == "same", "unchanged").when(F.col("duplicate_by") == "url", "new_version").otherwise("new").alias("outcome"))


SAMPLE = 200
_SAMPLE = f"""
s AS (SELECT doc_id, lang, length(text) + 200 AS tokens, sha256('42:' || lang || ':' || doc_id) AS sampling_rank FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sampling_rank, doc_id::VARCHAR) AS position FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY position, lang) AS ordinal FROM p ORDER BY position, lang LIMIT {SAMPLE})"""


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.length("text") + 200).alias("tokens"), F.col("doc_id").cast("string").alias("identity"))
    return curation.stratified_round_robin(docs, stratum="lang", identity="identity", seed=42, k=SAMPLE).drop("identity")


@query("WITH " + _SAMPLE + " SELECT doc_id, lang, position, ordinal FROM o")
def stratified_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(spark, sf).select("doc_id", "lang", "position", "ordinal")


@query("WITH " + _SAMPLE + " SELECT CASE WHEN ordinal <= 160 THEN 'discovery' ELSE 'evaluation' END AS stage, count(*) AS cases FROM o GROUP BY 1")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    sample = _sample(spark, sf)
    first, second = curation.split_sizes(F.col("available"), discovery=160, evaluation=40, most=SAMPLE)
    sizes = sample.agg(F.count("*").alias("available")).select(first.alias("first"), second.alias("second"))
    return sample.join(F.broadcast(sizes)).where(F.col("ordinal") <= F.col("first") + F.col("second")).groupBy(F.when(F.col("ordinal") <= F.col("first"), "discovery").otherwise("evaluation").alias("stage")).agg(F.count("*").alias("cases"))


@query("""SELECT CASE WHEN l_quantity <= 0 THEN 'none' WHEN l_quantity <= 12 THEN 'up_to_1y' WHEN l_quantity <= 36 THEN '1y_to_3y' ELSE 'over_3y' END AS bucket, count(*) AS cases FROM lineitem GROUP BY 1""")
def outcome_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(outcome_bucket(F.col("l_quantity")).alias("bucket")).agg(F.count("*").alias("cases"))


_PACKED = "WITH RECURSIVE " + _SAMPLE + """,
g(ordinal, batch, used) AS (SELECT 1, 0, tokens FROM o WHERE ordinal = 1 UNION ALL
  SELECT o.ordinal, CASE WHEN g.used + o.tokens > 20000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.used + o.tokens > 20000 THEN o.tokens ELSE g.used + o.tokens END
  FROM g JOIN o ON o.ordinal = g.ordinal + 1)"""


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return curation.greedy_pack(_sample(spark, sf), ordinal="ordinal", tokens="tokens", budget=20_000)


@query(_PACKED + " SELECT o.doc_id, o.ordinal, o.tokens, g.batch FROM g JOIN o ON o.ordinal = g.ordinal")
def greedy_batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).select("doc_id", "ordinal", "tokens", "batch")


@query(_PACKED + " SELECT g.batch, sha256(string_agg('v1|' || o.doc_id || '|' || o.sampling_rank, chr(10) ORDER BY o.ordinal)) AS identity FROM g JOIN o ON o.ordinal = g.ordinal GROUP BY g.batch")
def batch_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return curation.identity_of(_packed(spark, sf).withColumn("version", F.lit("v1")), ["version", "doc_id", "sampling_rank"], ["ordinal"], ["batch"])


@query("WITH " + _SAMPLE + " SELECT sha256(string_agg(doc_id || '|' || sampling_rank, chr(10) ORDER BY ordinal)) AS identity FROM o")
def plan_identity(spark: SparkSession, sf: str) -> DataFrame:
    return curation.identity_of(_sample(spark, sf), ["doc_id", "sampling_rank"], ["ordinal"])


@query("""WITH o AS (SELECT o_orderpriority AS scope, o_orderstatus AS s, floor(o_totalprice)::BIGINT AS t FROM orders)
SELECT scope, coalesce(sum(t) FILTER (s = 'F'), 0)::BIGINT AS consumed, coalesce(sum(t) FILTER (s = 'O'), 0)::BIGINT AS reserved,
(1000000000000 - coalesce(sum(t) FILTER (s = 'F'), 0) - coalesce(sum(t) FILTER (s = 'O'), 0))::BIGINT AS remaining FROM o GROUP BY scope""")
def token_ledger_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scope"), F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "reserved").otherwise("released").alias("status"), F.floor("o_totalprice").alias("tokens"))
    return curation.ledger_snapshot(orders, scope="scope", status="status", tokens=F.col("tokens"), limit=10**12)


WORD = r"[A-Za-z0-9]+(?:[._+/-][A-Za-z0-9]+)*"


@query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(len(regexp_extract_all(text, '{WORD}')) + length(text) // 8, 1) END AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, len(ss) AS sentences, sha256(array_to_string(ss, chr(10))) AS digest FROM (SELECT doc_id,
list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?；;.])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)""")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    ss = tx.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", ss.alias("ss")).select("doc_id", F.size("ss").alias("sentences"), F.sha2(F.encode(F.array_join("ss", "\n"), "UTF-8"), 256).alias("digest"))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


@query()
def chunk_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks are the lines of a text, all of one section."""
    block = lambda line, i: F.struct(F.concat_ws(":", "doc_id", i).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("heading"), F.lit("text").alias("block_type"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), line.alias("content"))
    blocks = F.filter(F.transform(F.split("text", "\n"), block), lambda b: F.trim(b["content"]) != "")
    return chunking.chunk_hierarchical(table(spark, sf, "documents").select("doc_id", blocks.alias("blocks")))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
