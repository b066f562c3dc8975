"""Queries of harnesses, chunk references, graded relevance and of what composes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import composites, harness, profile, retrieval, store
from tessera.operators import evaluation as ev
from tessera.plans.base import query, table
from tessera.plans.retrieval import ASKED, RETRIEVED, _contained, _lexical_cte

_FAIR = "(SELECT doc_id AS query_id, '中华人民共和国' || source || '法第' || (doc_id % 37 + 1) || '条的规定 “' || left(text, 30) || '”' AS query FROM documents WHERE doc_id % 100 = 0 AND length(text) >= 30 AND NOT regexp_matches(left(text, 30), '[\"“”'']'))"


@query(f"""WITH {RETRIEVED.replace(ASKED, _FAIR)},
g AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY exact_rank IS NULL, exact_rank, old) AS rank FROM both_ QUALIFY rank <= 5),
h AS (SELECT a.query_id, min(g.rank) AS r FROM asked a LEFT JOIN (SELECT g.*, k.label, k.title FROM g JOIN chunks k ON k.doc_id = g.doc_id) g ON g.query_id = a.query_id
  AND g.label = (SELECT label FROM chunks WHERE doc_id = a.query_id) AND g.title = (SELECT title FROM chunks WHERE doc_id = a.query_id) GROUP BY a.query_id)
SELECT count(*) AS cases, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr_at_5, count(*) FILTER (r IS NULL) AS failures, (SELECT count(*) FROM chunks) AS corpus_chunks, (SELECT count(DISTINCT title) FROM chunks) AS corpus_sources FROM h""")
def statute_harness(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document's article is asked for by the law, its number and a phrase of its text."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    article = lambda n: F.concat(F.lit("第"), (n + 1).cast("string"), F.lit("条"))
    title = F.concat(F.lit("中华人民共和国"), "source", F.lit("法"))
    chunks = docs.select(i, article(i % 37).alias("label"), title.alias("title"), F.concat("text", F.lit(" "), article(i * 7 % 37)).alias("content"))
    quote = F.substring("text", 1, 30)
    fair = docs.where((i % 100 == 0) & (F.length("text") >= 30) & ~quote.rlike("[\"“”']"))
    cases = fair.select(i.alias("query_id"), F.concat(title, article(i % 37), F.lit("的规定 “"), quote, F.lit("”")).alias("query"), title.alias("expected_title"), article(i % 37).alias("expected_article"), quote.alias("expected_evidence"))
    ranked = composites.statute_retrieval(cases.select("query_id", "query"), chunks, k=5)
    return harness.evaluated(cases, chunks, ranked, expected={"expected_title": "title", "expected_article": "label"}, source="title")[0]


@query("WITH " + _lexical_cte("r", "text", 5) + """,
e AS (SELECT b.item_id AS query_id, min(d.source) AS expected FROM benchmark b JOIN documents d ON length(substr(b.text, 21, 60)) > 0 AND contains(d.text, substr(b.text, 21, 60)) GROUP BY b.item_id),
s AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY query_id, source),
h AS (SELECT e.query_id, s.rank AS r FROM e LEFT JOIN s ON s.query_id = e.query_id AND s.source = e.expected)
SELECT count(*) AS cases, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr_at_5, count(*) FILTER (r IS NULL) AS failures, (SELECT count(*) FROM documents) AS corpus_chunks, (SELECT count(DISTINCT source) FROM documents) AS corpus_sources FROM h""")
def decision_harness(spark: SparkSession, sf: str) -> DataFrame:
    """Items expect the source of a document that holds their evidence; ranks count distinct sources."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    phrase = F.substring("text", 21, 60)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), phrase.alias("expected_evidence"))
    held = retrieval.phrase_matches(asked.select("query_id", F.col("expected_evidence").alias("phrase")), docs).join(docs.select("doc_id", "source"), "doc_id")
    cases = asked.join(held.groupBy("query_id").agg(F.min("source").alias("expected_source")), "query_id")
    ranked = _contained(spark, sf, k=5)
    return harness.evaluated(cases, docs, ranked, expected={"expected_source": "source"}, source="source", by_source=True)[0]


@query("WITH " + _lexical_cte("r", "text", 10) + """,
j AS (SELECT item_id AS query_id, doc_id, CASE WHEN contains(d.text, substr(b.text, 21, 60)) THEN 2 ELSE 1 END AS grade FROM benchmark b JOIN documents d ON length(substr(b.text, 21, 25)) > 0 AND contains(d.text, substr(b.text, 21, 25))),
q AS (SELECT query_id, doc_id FROM j WHERE grade >= 2),
c AS (SELECT q.query_id, count(*) AS relevant, count(r.doc_id) AS found FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.doc_id = q.doc_id GROUP BY q.query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(avg(found / relevant), 4) AS macro_recall FROM c""")
def graded_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments of two grades, of which only the higher counts."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    held = lambda n, g: retrieval.phrase_matches(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 21, n).alias("phrase")), docs).select("query_id", "doc_id", F.lit(g).alias("grade"))
    judged = held(60, 2).unionByName(held(25, 1)).groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    return ev.hit_and_macro_recall(_contained(spark, sf, k=10), harness.relevant(judged, grade=2), k=10)


@query("""SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS chunk_index, 'L' || p_brand || ':C' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS reference,
'第' || p_partkey || '条' AS label, '第' || p_partkey || '条 ' || p_name AS content FROM part""")
def statute_chunk_references(spark: SparkSession, sf: str) -> DataFrame:
    """A brand is a law, its parts are articles."""
    line = F.concat(F.lit("第"), F.col("p_partkey").cast("string"), F.lit("条 "), "p_name")
    laws = table(spark, sf, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    return composites.statute_chunks(laws).select("doc_id", "chunk_index", "reference", "label", "content")


@query("""SELECT s_suppkey AS doc_id, unnest([1, 2]) AS chunk_index, unnest(['C' || s_suppkey || ':S1', 'C' || s_suppkey || ':S2']) AS reference, unnest(['案例信息', '裁判结果']) AS label, unnest([s_name, 'nation ' || s_nationkey]) AS content FROM supplier""")
def decision_chunk_references(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier is a decision of two sections, the first without a label line."""
    content = F.concat("s_name", F.lit("\n裁判结果\nnation "), F.col("s_nationkey").cast("string"))
    return composites.decision_chunks(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), content.alias("content"))).select("doc_id", "chunk_index", "reference", "label", "content")


@query("""SELECT o_custkey, 'M' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || ':C1' AS reference, o_orderpriority AS content FROM orders""")
def material_chunk_references(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as numbered materials of their customer."""
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return composites.material_chunks(table(spark, sf, "orders").select("o_custkey", number.alias("reference_index"), F.col("o_orderpriority").alias("content"))).select("o_custkey", "reference", "content")


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def ordered_material_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks of orders, which are the materials of a customer."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("material_id"), F.col("o_orderkey").alias("reference_index"), F.col("o_orderpriority").alias("title"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("material_id"), F.col("l_linenumber").alias("chunk_index")).join(orders.select("material_id", "o_custkey"), "material_id")
    got = store.material_chunks(lines, orders.select("o_custkey", "material_id", "reference_index", "title"), case="o_custkey")
    return got.select(F.col("material_id").alias("l_orderkey"), F.col("chunk_index").alias("l_linenumber"), "title", "place")


@query("SELECT event_id, coalesce(c_mktsegment, 'none') AS owner FROM events LEFT JOIN customer ON c_custkey = user_id")
def owner_from_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Events take the segment of the customer of their user's number, and keep their own where there is none."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.lit("none").alias("owner"))
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("owner"))
    return store.with_parent(e, owners, key="user_id", columns=["owner"]).select("event_id", "owner")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 7 DAY FROM events)")
def claims_after_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Claims but those of the first week."""
    e = table(spark, sf, "events")
    first = e.agg(F.min("ts").alias("first")).first().first
    return store.claims_kept(e, ts="ts", cutoff=F.lit(first) + F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("""WITH d AS (SELECT DISTINCT l_returnflag || l_linestatus AS key FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS case_id FROM lineitem),
h AS (SELECT l_suppkey AS case_id, l_returnflag || l_linestatus AS key, 'known' AS state FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT c.case_id, d.key, coalesce(h.state, 'unknown') AS state FROM c CROSS JOIN d LEFT JOIN h ON h.case_id = c.case_id AND h.key = d.key""")
def factor_seeding(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier gets an unknown factor for each line status that its first lines don't have."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("key"), "l_linenumber")
    have = lines.where("l_linenumber = 1").select("case_id", "key").distinct().select("case_id", "key", F.lit("known").alias("state"), F.lit("x").alias("value"))
    wanted = lines.select("case_id").distinct().join(F.broadcast(lines.select("key").distinct()))  # a handful of line states
    return profile.seeded(have, wanted, case="case_id").select("case_id", "key", "state")


@query("SELECT doc_id, sha256(source || ' ' || lang || ' ' || text) AS query FROM documents WHERE text <> ''")
def contextual_queries(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text <> ''")
    return docs.select("doc_id", F.sha2(F.encode(composites.contextual_query(F.col("source"), F.col("lang"), F.col("text")), "UTF-8"), 256).alias("query"))


@query("""SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey, o_orderpriority""")
def accumulated_results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results of searches: of each priority a customer's last one stays."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return composites.accumulated(o, key=["o_custkey", "o_orderpriority"], order=["o_orderkey"])


@query("""WITH a AS (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, [event_type] AS terms FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT user_id AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank, [event_type, 'late'] AS terms FROM events WHERE event_type IN ('click', 'error')),
u AS (SELECT *, 0 AS w FROM a WHERE rank <= 9 UNION ALL SELECT *, 1 FROM b WHERE rank <= 9),
f AS (SELECT query_id, doc_id, coalesce(max(CASE WHEN w = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(max(CASE WHEN w = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score, min(rank) AS best, min(w * 1000 + rank) AS seen, list(terms ORDER BY w) AS t FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, seen, doc_id) AS rank,
CASE WHEN len(t) = 2 THEN 'click,late' ELSE array_to_string(t[1], ',') END AS matched FROM f QUALIFY rank <= 5""")
def fused_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of a user's events with the terms that each matched; fused rows carry both."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "event_type")
    kind = F.col("event_type")
    a = retrieval.top_by(e.where(kind.isin("view", "click")), ["query_id"], [F.col("doc_id")], 9).withColumn("matched_terms", F.array(kind))
    b = retrieval.top_by(e.where(kind.isin("click", "error")), ["query_id"], [F.desc("doc_id")], 9).withColumn("matched_terms", F.array(kind, F.lit("late")))
    return retrieval.fuse([a, b], k=5).select("query_id", "doc_id", "rank", F.array_join("matched_terms", ",").alias("matched"))
