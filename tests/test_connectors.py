"""Corpora as a data source, and table functions called from SQL text."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import table_functions as tf
from tessera.operators import chunking
from tessera.operators import retrieval as rt
from tessera.sources import connector


@pytest.fixture()
def corpus(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("src"))
    rows.repartitionByRange(8, "doc_id").write.parquet(path)
    connector.register(spark)
    yield path, rows, lambda: spark.read.format("corpus").options(path=path, id="doc_id", content="text", source="src").load()


@pytest.mark.parametrize("where", ["true", "id = 77", "id in (5, 3999, 9999)", "id < 10 or id > 3990", "id >= 100 and id < 300", "content is not null and source = 's1'", "content is null", "content like '%99'", "id > 5000"])
def test_rows_are_those_of_the_files(corpus, where):
    _, rows, read = corpus
    plain = rows.toDF("id", "content", "source")
    key = lambda r: (r.id, r.content or "", r.source)
    assert sorted(map(key, read().where(where).collect())) == sorted(map(key, plain.where(where).collect()))


def test_filters_rule_out_partitions(corpus):
    path, _, _ = corpus
    reader = connector.CorpusReader(path, {"id": "doc_id", "content": "text"})
    assert len(reader.partitions()) == 8
    kept = list(reader.pushFilters([connector.GreaterThanOrEqual(("id",), 3990), connector.IsNotNull(("content",))]))
    assert kept == [] and len(reader.partitions()) == 1


def test_splitters_as_table_functions(spark):
    tf.policies["short"] = chunking.Policy("short", "1", 12, 18)
    tf.register(spark)
    texts = [(1, "One sentence here. Another one follows it. And a third. " * 3), (2, " "), (3, None), (4, "中文。" * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").createOrReplaceTempView("split_docs")
    got = spark.sql("SELECT d.doc_id, c.* FROM split_docs d, LATERAL split_text(d.text, 12, 18) c").collect()
    expected = [(i, n, p, chunking.estimate(p)) for i, t in texts if t and t.strip() for n, p in enumerate(chunking.split_to_limit(t, 12, 18))]
    assert sorted(map(tuple, got)) == expected
    named = spark.sql("SELECT d.doc_id, c.* FROM split_docs d, LATERAL split_with(d.text, 'short') c").collect()
    assert sorted(map(tuple, named)) == expected
    with pytest.raises(Exception, match="no splitter"):
        spark.sql("SELECT * FROM split_docs d, LATERAL split_with(d.text, 'long') c").collect()


def test_retrieval_in_sql(spark):
    tf.register(spark)
    docs = spark.createDataFrame([(i, None if i == 5 else f"alpha {'beta ' * (i % 3)}{'拖欠工资' if i % 4 == 0 else ''} x{i}") for i in range(60)], "doc_id long, content string").repartition(4)
    docs.createOrReplaceTempView("match_docs")
    text = "SELECT doc_id, score FROM lexical_matches(TABLE(SELECT doc_id, content FROM match_docs), 'Beta 拖欠 alpha', 7) ORDER BY score DESC, length, doc_id LIMIT 7"
    query = spark.createDataFrame([(1, "Beta 拖欠 alpha")], "query_id long, query string")
    expected = [(r.doc_id, r.score) for r in rt.lexical_rank(query, docs, k=7).orderBy("rank").collect()]
    assert [tuple(r) for r in spark.sql(text).collect()] == expected
    spark.createDataFrame([(q, d, float(d % 5)) for q in (1, 2) for d in range(12)], "query_id long, doc_id long, score double").createOrReplaceTempView("scored")
    got = spark.sql("SELECT * FROM first_of_each(TABLE(scored) PARTITION BY query_id ORDER BY (score DESC, doc_id), 3)").collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 4), (1, 2, 9), (1, 3, 3), (2, 1, 4), (2, 2, 9), (2, 3, 3)]
