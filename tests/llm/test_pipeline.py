"""The pipeline's stages against brute force, each on its own input."""

import collections

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_operators import SCHEMA, brute_components, brute_cut, brute_quality, corpus, frame


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages_in_order(spark, tmp_path):
    rows = corpus(9, 80)
    docs = frame(spark, rows)
    columns = docs.columns
    good = stage("quality rules")(spark, docs, None)
    assert good.columns == columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert all(not brute_quality(t)[-1] for t in kept.values())
    failed = {i for i, t, *_ in rows if brute_quality(t)[-1]}
    assert not failed & set(kept) and len(kept) > 40
    rows = [r for r in rows if r[0] in kept]

    docs = frame(spark, rows)
    near = stage("n-gram Jaccard join")(spark, docs, None)
    assert sorted(near.columns) == sorted(columns)
    expected = {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in near.collect()} == expected
    rows = [r for r in rows if r[0] in expected]

    docs = frame(spark, rows)
    cut = stage("substring dedup")(spark, docs, None)
    assert cut.columns == columns
    texts = {i: t for i, (_, _, t) in brute_cut(rows).items() if t}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    rows = [(i, texts[i], lang, source) for i, _, lang, source in rows if i in texts]

    docs = frame(spark, rows)
    mixed = stage("mixing sources")(spark, docs, None)
    assert mixed.columns == columns
    from tessera.llm.mixing import mix_sources

    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in copies.items() if n})

    seats = stage("packing")(spark, mixed, None).collect()
    assert collections.Counter(r.doc_id for r in seats if r.start == 0) == collections.Counter({i: n for i, n in copies.items() if n})
    assert max(r.offset + r.length for r in seats) <= 2048


def test_run_reads_documents(spark, tmp_path):
    frame(spark, corpus(3, 40)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 10 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)


def test_odd_rows(spark):
    rows = [(None, "the plain words of a text that is long enough to be kept by every rule of this table, twice over and more", "en", "a")] * 2
    rows += [(1, rows[0][1], None, None), (1, rows[0][1], None, None)]
    docs = spark.createDataFrame([(i, t, l, s, None) for i, t, l, s in rows], SCHEMA)
    good = stage("quality rules")(spark, docs, None)
    assert good.count() == 4
    near = stage("n-gram Jaccard join")(spark, good, None)
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 0, 1]
    for _, f in cp.STAGES:
        f(spark, docs.limit(0), None).collect()


TEXT = "the plain words of a text that is long enough to be kept by every rule of this table and {} more than once by one"


def test_near_duplicates_decide_by_row(spark):
    a, b, c = (" ".join(TEXT.format(w) for w in ws) for ws in (("read", "seen"), ("heard", "told"), ("far other words such as these that stand here", "and there")))
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, c, "en", "s"), (2, c, "en", "s"), (3, c, "fr", "s"), (1, "one of its own text that no other row has at all", "en", "s"), (None, a, "en", "s"), (7, "", "en", "s"), (7, "", "en", "s")]
    docs = spark.createDataFrame([(i, t, l, s, len(t)) for i, t, l, s in rows], SCHEMA)
    for order in (1, 2):
        near = stage("n-gram Jaccard join")(spark, docs.repartition(order), None)
        assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([(1, a), (2, c), (1, rows[5][1]), (None, a), (7, ""), (7, "")], key=repr)


def test_columns_of_any_name(spark):
    docs = frame(spark, corpus(2, 20)).withColumn("a.b", F.lit(1)).withColumn("x`y", F.lit("z")).withColumn("linkable", F.lit(2)).withColumn("mark", F.lit(3)).withColumn("cid", F.lit(4))
    for name, f in cp.STAGES[:-1]:
        assert sorted(f(spark, docs, None).columns) == sorted(docs.columns), name
        f(spark, docs, None).collect()
