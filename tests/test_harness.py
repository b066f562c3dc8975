"""Harnesses fail before they rank; grades have bounds."""

import pytest

from tessera.operators import harness


def test_evidence_comes_first(spark):
    chunks = spark.createDataFrame([(1, "law a", "art 1", "the rent is due"), (2, "law b", "art 1", "the heir pays"), (3, "law b", "art 2", "nothing")], "doc_id long, title string, label string, content string")
    cases = spark.createDataFrame([("q1", "rent", "law a", "art 1", "rent is"), ("q2", "heir", "law b", "art 1", "heir")], "query_id string, query string, t string, a string, expected_evidence string")
    expected = {"t": "title", "a": "label"}
    ranked = harness.lexical_of(cases, chunks)
    summary, results = harness.evaluated(cases, chunks, ranked, expected=expected, source="title")
    got = summary.first()
    assert (got.cases, got.recall_at_1, got.mrr_at_5, got.failures, got.corpus_chunks, got.corpus_sources) == (2, 1.0, 1.0, 0, 3, 2)
    assert {r.query_id: (r.relevant_rank, r.retrieved) for r in results.collect()} == {"q1": (1, ["law a"]), "q2": (1, ["law b"])}
    unfair = cases.unionByName(spark.createDataFrame([("q3", "x", "law b", "art 2", "heir"), ("q4", "x", "law c", "art 1", "y")], cases.schema))
    assert {r.query_id for r in harness.missing_evidence(unfair, chunks, expected=expected).collect()} == {"q3", "q4"}
    with pytest.raises(ValueError, match="evidence"):
        harness.evaluated(unfair, chunks, ranked, expected=expected, source="title")


def test_sources_are_ranked_once(spark):
    chunks = spark.createDataFrame([(i, "s1" if i < 4 else "s2", "word") for i in range(1, 6)], "doc_id long, source string, content string")
    cases = spark.createDataFrame([(1, "word", "s2", "word")], "query_id long, query string, e string, expected_evidence string")
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id long, doc_id long, rank int")
    of = lambda by: harness.evaluated(cases, chunks, ranked, expected={"e": "source"}, source="source", by_source=by)[1].first()
    assert (of(False).relevant_rank, of(True).relevant_rank, of(True).retrieved) == (4, 2, ["s1", "s2"])


def test_grades(spark):
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 2, 2), (2, 3, 3)], "query_id long, doc_id long, grade int")
    assert sorted(tuple(r) for r in harness.relevant(judged, grade=2).collect()) == [(1, 2), (2, 3)]
    with pytest.raises(ValueError):
        harness.relevant(judged, grade=4)
