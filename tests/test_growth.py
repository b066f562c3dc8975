"""Steps whose time, memory or shuffled rows must not outgrow their input."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.functions import text as tx


def test_questions_take_each_run_once(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ?？!。\n") for _ in range(40)) for _ in range(200)] + ["", "?", "x?", "tail without a mark"]
    plain = [len([q for q in (m.strip(" ") for m in re.findall("[^\n。！？?!]*[？?]", t)) if len(q) > 1]) for t in texts]
    df = spark.createDataFrame(list(enumerate([*texts, "word " * 100_000])), "i long, t string")
    begin = time.monotonic()
    got = [r.n for r in df.select("i", F.size(tx.questions(F.col("t"))).alias("n")).orderBy("i").collect()]
    assert got == [*plain, 0]
    assert time.monotonic() - begin < 30  # one pass over half a megabyte; from each character it takes minutes


def test_rankings_hold_little_at_once(spark):
    """Thousands of queries against rows of a batch: what a task holds depends on the queries, not on rows times queries."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.operators import retrieval as rt

    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(2000)]
    asked = [(q, rng.sample(words, 8)) for q in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").coalesce(1)
    queries = spark.createDataFrame([(q, " ".join(ws)) for q, ws in asked], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in rt.lexical_rank(queries, docs, k=3).where("query_id < 40").collect()}
    for q, ws in asked[:40]:
        best = sorted((-sum(2 * (w in t) for w in ws), len(t), d) for d, t in enumerate(texts))[:3]
        assert [got.get((q, i + 1)) for i in range(3)] == [(d, -s) if s else None for s, _, d in best]
    uses: dict[str, list[int]] = {}
    for q, ws in asked:
        for w in ws:
            uses.setdefault(w, []).append(q)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2000)), "content": pa.array(texts)})
    tracemalloc.start()
    rows = list(rt._rank_texts(iter([batch]), rt._Terms(uses, 3000), pa.array(range(3000)), 3))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows[0].num_rows == 9000 and held < 60e6  # all pairs that share a word take 2,000 x 3,000 x 0.45 x 32 bytes
    x = np.random.default_rng(1).normal(size=(3000, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").coalesce(1)
    near = rt.vector_rank(vectors.withColumnRenamed("doc_id", "query_id"), vectors, k=2).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    assert len(near) == 6000 and all(abs(r.score - np.sort(score[r.query_id])[-r["rank"]]) < 2e-6 for r in near)


def test_rankings_of_documents_shuffle_best_rows_only(spark, tmp_path):
    """The items' rankings write no postings: what is shuffled depends on the items, not on the words of the texts."""
    from tessera.plans import catalogue

    words = [f"w{i}x" for i in range(300)]
    rng = random.Random(7)
    spark.createDataFrame([(i, " ".join(rng.choices(words, k=200))) for i in range(3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return status.executorList(False).apply(0).totalShuffleWrite()

    for name in ("bm25_topk", "rrf_fusion"):
        before = written()
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 25
        assert written() - before < 3000 * 200 * 4  # four bytes a word; the table itself is dealt out by a shuffle


def test_parts_in_python_are_those_of_spark(spark):
    from tessera.operators import retrieval as rt

    texts = ["A+B_c  covid-19 x.y. _z KK 拖欠工资a试 用期", "", "--", "Ünï 第1条ab", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r.p for r in df.select("i", tx.index_parts(F.col("t")).alias("p")).orderBy("i").collect()]
    assert [p or [] for p in got] == [rt._parts(t) for t in texts]


def test_deltas_are_folded_run_after_run(spark):
    """One pass over sorted deltas: no table of its own for each run, which costs a millisecond of Python."""
    from tessera.streaming import delta_filter

    rows = [(r, s, d) for r in ("a", "b", None) for s, d in enumerate(["x[L1", ":C2] y", None, "[L9:C9]", " tail [L"])] + [("c", 0, None)]
    random.Random(1).shuffle(rows)
    df = delta_filter.fold_deltas(spark.createDataFrame(rows, "run_id string, seq long, delta string"), {"L1:C2"})
    assert {r.run_id: r.text for r in df.collect()} == {"a": "x[L1:C2] y tail [L", "b": "x[L1:C2] y tail [L", None: "x[L1:C2] y tail [L", "c": ""}
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


def test_exact_rankings_and_evidence_join_no_texts(spark):
    """Queries that share a label don't make rows of every pair, and evidence is looked for in one pass."""
    from tessera.operators import harness
    from tessera.operators import retrieval as rt

    n = 200
    docs = spark.createDataFrame([(i, "第1条", "中华人民共和国甲法", f"text {i} 第2条") for i in range(n)], "doc_id long, label string, title string, content string")
    queries = spark.createDataFrame([(i, f"甲法第1条 第2条 “text {i} ”") for i in range(n)], "query_id long, query string")
    df = rt.exact_rank(queries, docs, k=3, pattern="第[0-9]+条")
    assert "Join" not in df._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in df.collect())
    order = lambda q: sorted(((-12.0 if d == q else -10.0), d) for d in range(n))[:3]
    assert got == sorted((q, d, -s, i + 1) for q in range(n) for i, (s, d) in enumerate(order(q)))
    cases = spark.createDataFrame([(1, "text 7", "甲"), (2, "", "甲"), (3, "text 7", "乙"), (4, "none", "甲"), (5, "", "丙"), (6, None, "甲")], "query_id long, expected_evidence string, title string")
    texts = spark.createDataFrame([(1, "a text 7", "甲"), (2, "b", "乙")], "doc_id long, content string, title string")
    left = harness.missing_evidence(cases, texts, expected={"title": "title"})
    assert sorted(r.query_id for r in left.collect()) == [3, 4, 5, 6]
    assert "Contains" not in left._jdf.queryExecution().toString()


def test_chunks_are_cut_a_few_rows_at_a_time():
    import pyarrow as pa

    from tessera.operators import chunking as ch

    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(1000)), "content": pa.array(["word " * 2000, None] * 500)})
    out = ch._cut_batches(iter([batch]), ch.Policy())
    first = next(out)
    assert max(first.column("i").to_pylist()) < ch.ROWS < 1000
    rows = [r for b in [first, *out] for r in b.to_pylist()]
    assert [r["content"] for r in rows if r["i"] == 998] == ch.split_to_limit("word " * 2000, 500, 800) and all(r["i"] % 2 == 0 for r in rows)


def test_ledger_asks_the_state_once_a_key_and_batch():
    from pyspark.sql import Row

    from tessera.streaming.ledger_stream import LedgerProcessor

    class Book(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, v):
            self.held = v

    p = LedgerProcessor(600)
    p.scope, p.book = Value(), Book()
    rows = [Row(seq=i, op=("reserve", "settle", "release")[i // 3 % 3], key=str(i % 3), tokens=50, input_tokens=10, output_tokens=10) for i in range(300)]
    whole = [r.outcome for r in p.handleInputRows((1,), iter(rows), None)]
    assert p.book.calls <= 6
    q = LedgerProcessor(600)
    q.scope, q.book = Value(), Book()
    assert whole == [r.outcome for part in (rows[:100], rows[100:101], rows[101:]) for r in q.handleInputRows((1,), iter(part), None)]
