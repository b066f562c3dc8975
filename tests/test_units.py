"""Golden values of text expressions, chunking, rules, readers and the streaming filter."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking, curation, journal, retrieval, rules
from tessera.sources import readers
from tessera.streaming import delta_filter, journal_sink


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def test_terms(spark):
    assert one(spark, "OpenAI contract OPENAI", tx.query_terms) == ["openai", "contract"]
    assert one(spark, "拖欠工资", tx.query_terms) == ["拖欠", "欠工", "工资", "拖欠工", "欠工资", "拖欠工资"]
    assert one(spark, "a b", lambda c: tx.query_terms(c, stop_terms=["B"])) == ["a"]
    assert one(spark, "", tx.query_terms) == []


def test_lexical_scores_and_ties(spark):
    q = spark.createDataFrame([(1, "OpenAI contract")], "query_id long, query string")
    d = spark.createDataFrame([(1, "OPENAI contract terms"), (2, "contract x"), (3, "contract"), (4, "none"), (5, None)], "doc_id long, content string")
    assert [(r.doc_id, r.score) for r in retrieval.lexical_rank(q, d, k=5).orderBy("rank").collect()] == [(1, 4.0), (3, 2.0), (2, 2.0)]
    assert retrieval.lexical_rank(q.limit(0), d, k=5).collect() == []


def test_exact_title_without_the_states_name(spark):
    q = spark.createDataFrame([(1, "劳动合同法第四十七条"), (2, "第四十七条")], "query_id long, query string")
    c = spark.createDataFrame([(1, "第四十七条", "中华人民共和国公司法", "x"), (2, "第四十七条", "中华人民共和国劳动合同法", "x"), (3, "第四十七条", None, "x")], "doc_id long, label string, title string, content string")
    got = retrieval.exact_rank(q, c, k=5, pattern="第[四十七]+条").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, 2, 8.0), (1, 1, 5.0), (1, 3, 5.0), (2, 1, 5.0), (2, 2, 5.0), (2, 3, 5.0)]


def brute_bm25(asked, docs):
    cut = lambda t: [p for p in re.split(r"[_.+-]+", t) if p]
    tokens = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.+-]*", t)]
    parts = {i: [p for t in tokens(text) for p in cut(t)] for i, text in docs}
    mean, out = sum(map(len, parts.values())) / len(parts), {}
    for q, text in asked:
        for phrase in map(cut, dict.fromkeys(tokens(text))):
            tf = {i: sum(ps[j : j + len(phrase)] == phrase for j in range(len(ps))) for i, ps in parts.items()}
            df = sum(n > 0 for n in tf.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, n in tf.items():
                if n:
                    out[q, i] = out.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(parts[i]) / mean))
    return out


def test_bm25_phrases(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["covid-19", "covid", "19", "v1.2", "foo_bar", "bar", "foo", "a-a-a", "a", "x"]) for _ in range(rnd.randint(1, 12)))) for i in range(80)]
    asked = [(1, "covid-19"), (2, "foo_bar and foo-bar x x."), (3, "a-a v1.2 bar_foo"), (4, "19-covid"), (5, "no-such-term"), (6, "covid 19")]
    got = retrieval.bm25_rank(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, content string"), k=100).collect()
    expected = brute_bm25(asked, docs)
    assert {q for q, _ in expected} == {1, 2, 3, 4, 6}
    assert {(r.query_id, r.doc_id): r.score for r in got} == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}


def test_fusion_and_cap(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    fused = retrieval.fuse([a, b], k=3).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [11, 10, 12]
    assert fused[0].score == 1 / 62 + 1 / 62
    ranked = spark.createDataFrame([(1, "s", i) for i in range(1, 5)] + [(1, "t", 5)], "query_id long, source string, rank int")
    assert [(r.source, r.rank) for r in retrieval.cap_per_source(ranked, cap=2, k=3).orderBy("rank").collect()] == [("s", 1), ("s", 2), ("t", 3)]


def test_vector_rank_skips_broken_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, None])], "doc_id long, embedding array<double>")
    assert [(r.doc_id, r.score) for r in retrieval.vector_rank(q, d, k=5).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707107)]


def test_token_estimate_agrees_with_the_chunker(spark):
    rnd = random.Random(1)
    texts = ["", "a", "中文字", "A-b.c d", *("".join(rnd.choice("ab1. 中，\n-_/") for _ in range(rnd.randint(1, 60))) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.token_estimate(F.col("t")).alias("n")).collect()
    assert all(r.n == chunking.estimate(r.t) for r in got)


def test_chunks_stay_within_budget():
    rnd = random.Random(2)
    for _ in range(50):
        text = "".join(rnd.choice(["word ", "中文", "x.", "! ", "\n", "12-3 "]) for _ in range(rnd.randint(0, 200)))
        parts = chunking.split_to_limit(text, 20, 30)
        assert all(chunking.estimate(p) <= 30 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    with pytest.raises(ValueError):
        chunking.split_to_limit("x", 5, 4)


def test_hierarchical_merge():
    base = {"parent_id": None, "block_type": "text", "page_start": None, "page_end": None}
    blocks = [base | {"id": "1", "heading": "a", "content": "one"}, base | {"id": "2", "heading": "b", "content": "two"}, base | {"id": "3", "heading": "b", "content": "three"}, base | {"id": "4", "heading": "b", "block_type": "table", "content": "t"}]
    assert [[b["id"] for b in g] for g in chunking.merge_blocks(blocks, chunking.Policy())] == [["1"], ["2", "3"], ["4"]]


def test_case_numbers(spark):
    assert one(spark, "（２０２０） 京0101刑初第001号", tx.case_number) == "(2020)京0101刑初1号"
    assert one(spark, None, tx.case_number) is None


def test_delta_filter_is_independent_of_cuts():
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(["[L1:C2]", "【C9:S1】", "[Link](u)", "[", "【L", "x", "]", "[M1:C1]"]) for _ in range(8))
        whole, held = delta_filter.feed("", text, {"L1:C2"})
        out, rest = "", ""
        while text:
            n = rnd.randint(1, 9)
            now, rest = delta_filter.feed(rest, text[:n], {"L1:C2"})
            out, text = out + now, text[n:]
        assert out + rest == whole + held


def test_delta_filter_lets_go_of_what_is_too_long_for_a_marker():
    assert delta_filter.feed("", "[L" + "y" * 100, set()) == ("", "[L" + "y" * 100)
    assert delta_filter.feed("", "[L" + "y" * 170, set()) == ("[L" + "y" * 170, "")


def test_compensation(spark):
    people = spark.createDataFrame([(3, 2, 1000.0, None), (20, 0, 10000.0, 2000.0), (20, 6, 6000.0, 2000.0)], "y int, m int, w double, a double")
    got = rules.compensation(people, years="y", months="m", wage="w", average="a").collect()
    assert [(float(r.compensation_months), float(r.n1), r.cap_applied) for r in got] == [(3.5, 3500.0, None), (12.0, 72000.0, True), (21.0, 126000.0, False)]


def test_split_and_pack(spark):
    assert curation.split_counts(10, 12, 6, 18) == (7, 3)
    assert curation.split_counts(100, 12, 6, 18) == (12, 6)
    sample = spark.createDataFrame(list(enumerate([5, 6, 4, 9, 1], 1)), "o int, t long")
    assert [r.batch for r in curation.greedy_pack(sample, ordinal="o", tokens="t", budget=10).orderBy("o").collect()] == [0, 1, 1, 2, 2]


def test_keyset_pages(spark):
    rows = spark.range(1, 8).withColumnRenamed("id", "seq")
    page = journal.keyset_page(rows, before=7, limit=3).orderBy("seq").collect()
    assert [(r.seq, r.next_cursor) for r in page] == [(4, 4), (5, 4), (6, 4)]
    assert {r.next_cursor for r in journal.keyset_page(rows, before=3, limit=3).collect()} == {None}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{bad\n{"id": 2}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long")
    assert sorted((r.record.id if r.record else 0, r.reason) for r in rows.collect()) == [(0, "malformed"), (1, None), (2, None)]
    assert [(r.reason, r.rejected) for r in readers.rejections(rows).collect()] == [("malformed", 1)]
    (tmp_path / "a.json").write_text('[{"id": 3}, {"id": 4}]')
    assert [r.record.id for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "id: long").collect()] == [3, 4]
    (tmp_path / "q.trec").write_text("1 0 a 3\n1 0 b 9\nx y\n1 0 a 3\n")
    trec = readers.read_trec(spark, str(tmp_path / "q.trec"))
    assert sorted((r.query_id or "", r.grade or 0, r.reason or "") for r in trec.collect()) == [("", 0, "malformed"), ("1", 0, "invalid_grade"), ("1", 3, ""), ("1", 3, "")]
    assert [(r.doc_id, r.grade, r.repeats) for r in readers.settled_judgments(trec.where("reason is null")).collect()] == [("a", 3, 1)]
    (tmp_path / "q.json").write_text('{"1": {"a": 2, "b": "0"}}')
    assert sorted((r.doc_id, r.grade) for r in readers.read_nested_qrels(spark, str(tmp_path / "q.json")).collect()) == [("a", 2), ("b", 0)]
    (tmp_path / "laws").mkdir()
    (tmp_path / "laws" / "x.md").write_text("---\ntitle: \"T\"\nstatus: ok\n---\n# H\n\n**A** b\n---\n> c\n")
    (tmp_path / "laws" / "_skip.md").write_text("no")
    row = readers.read_markdown_tree(spark, str(tmp_path / "laws")).select("meta", readers.normalized_markdown(F.col("body")).alias("b")).collect()
    assert [(r.meta["title"], r.b) for r in row] == [("T", "H\nA b\nc")]
    urls = spark.createDataFrame([("https://a.gov.cn/x",), ("http://gov.cn/",), ("https://evilgov.cn/",), ("nonsense",)], "u string")
    assert [r.ok for r in urls.select(readers.official_url(F.col("u"), ["gov.cn"]).alias("ok")).collect()] == [True, False, False, False]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x[L1", False), ("a", 2, ":C2]y[L", True)], "run_id string, seq long, delta string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, seq long, delta string, last boolean").parquet(str(tmp_path / "in"))
    q = delta_filter.filter_stream(stream, {"L1:C2"}).writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert "".join(r.text for r in spark.sql("SELECT text FROM shown ORDER BY seq").collect()) == "x[L1:C2]y[L"
    journal_sink.write_journal(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
