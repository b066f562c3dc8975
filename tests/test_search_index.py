"""Rankings from postings against those that read every text."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rt
from tessera.operators import search_index as si
from tests.scans import scanned_rows


def texts(n, seed=2):
    rnd = random.Random(seed)
    vocab = ["covid-19", "covid", "19", "v1.2", "foo_bar", "bar.", "foo", "a-a-a", "a", "x", "Maßstab", "拖欠工资", "工资", "第47条", "İx", "K9", "end.", *(f"w{i}" for i in range(60))]
    return [(i, None if i % 41 == 7 else " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


ASKED = [(1, "covid-19 v1.2"), (2, "foo_bar and foo-bar x x."), (3, "a-a w1 工资"), (4, "19-covid w33 w34"), (5, "no-such-term"), (6, ""), (7, "拖欠工资 end"), (8, "K9 i̇x 5")]


@pytest.fixture(scope="module", params=["long", "string"])
def corpus(spark, request, tmp_path_factory):
    cast = (lambda i: i) if request.param == "long" else (lambda i: f"doc {i:04d} with a name of more than twenty-four signs")
    docs = spark.createDataFrame([(cast(i), t) for i, t in texts(700)], f"doc_id {request.param}, content string").repartition(3)
    queries = spark.createDataFrame(ASKED, "query_id long, query string")
    return queries, docs, si.build(docs, str(tmp_path_factory.mktemp("index")), segments=16)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())


def small_blocks(monkeypatch):
    monkeypatch.setattr(si, "BLOCK_DOCS", 16)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_equal_to_the_scans(corpus, k):
    queries, docs, index = corpus
    assert rows(index.contained(queries, k=k)) == rows(rt.lexical_rank(queries, docs, k=k))
    assert rows(index.bm25(queries, k=k)) == rows(rt.bm25_rank(queries, docs, k=k))


def test_stop_terms(corpus):
    queries, docs, index = corpus
    assert rows(index.contained(queries, k=9, stop_terms=["x", "foo"], cjk_sizes=(2, 3))) == rows(rt.lexical_rank(queries, docs, k=9, stop_terms=["x", "foo"], cjk_sizes=(2, 3)))


def test_only_the_terms_folders_are_read(spark, corpus):
    _, _, index = corpus
    every = spark.read.parquet(f"{index.path}/postings").where("family = 'parts'").count()
    some = index.postings("parts", spark.createDataFrame([("w7",), ("w8",)], "term string"))
    assert {r.term for r in some.collect()} == {"w7", "w8"}
    assert some.count() <= scanned_rows(spark, some) < every / 3


def test_blocks_that_cannot_reach_the_kth_score_are_skipped(spark, tmp_path):
    """One block holds a rare word often; the others hold a common one once."""
    docs = spark.range(20 * si.BLOCK_DOCS).repartitionByRange(8, "id").select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "gold gold gold dust").otherwise(F.concat_ws(" ", F.lit("dust on"), F.col("id"), F.repeat(F.lit(" stone"), (F.col("id") % 9).cast("int")))).alias("content"))
    queries = spark.createDataFrame([("q", "gold dust")], "query_id string, query string")
    index = si.build(docs, str(tmp_path / "i"))
    assert rows(index.bm25(queries, k=10)) == rows(rt.bm25_rank(queries, docs, k=10))
    first, rest = index.scored_blocks
    assert index.about.blocks == 24 and first + rest <= 2


def test_empty_corpus_and_queries(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, content string")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    index = si.build(docs, str(tmp_path / "none"))
    assert index.contained(queries, k=3).count() == 0 and index.bm25(queries, k=3).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, content string")
    index = si.build(docs, str(tmp_path / "blank"))
    assert index.bm25(queries, k=3).count() == 0 and index.contained(queries.limit(0), k=3).count() == 0


def test_a_table_is_indexed_once(spark, tmp_path):
    spark.createDataFrame(texts(50), "doc_id long, content string").write.parquet(str(tmp_path / "t"))
    read = lambda: spark.read.parquet(str(tmp_path / "t"))
    first = si.of_table(read())
    assert si.of_table(read()).path == first.path
    assert si.of_table(read().where("doc_id > 3")).path != first.path
    spark.createDataFrame([(99, "new")], "doc_id long, content string").write.mode("append").parquet(str(tmp_path / "t"))
    assert si.of_table(read()).path != first.path


def test_stated_sets_are_bounded(spark):
    queries = spark.range(1000).select(F.col("id").alias("query_id"), F.repeat(F.lit("word "), 20).alias("query"))
    assert len(rt.stated(queries)) == 1000
    with pytest.raises(ValueError):
        rt.stated(queries, most_bytes=50_000)
