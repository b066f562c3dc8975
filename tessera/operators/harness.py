"""Retrieval harnesses: cases whose evidence is checked against the corpus before anything is ranked.

A case (query_id, query, expected_evidence and what names its chunk) is only fair if the corpus holds the chunk that it
expects, and that chunk its evidence; else the harness fails with the cases' ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import retrieval as rt
from tessera.operators.store import source_rank
from tessera.session import cut


def _expected(expected: dict[str, str]) -> Column:
    """Whether a chunk's columns are those that a case expects of it ({case column: chunk column})."""
    tests = [F.col(f"c.{case}") == F.col(f"k.{chunk}") for case, chunk in expected.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def missing_evidence(cases: DataFrame, chunks: DataFrame, *, expected: dict[str, str], evidence: str = "expected_evidence") -> DataFrame:
    """Cases without a chunk that is expected and holds their evidence."""
    asked = cases.select("query_id", F.col(evidence).alias("phrase"), *expected)
    hits = rt.phrase_matches(asked.select("query_id", "phrase"), chunks).select("query_id", "doc_id").distinct()
    named = asked.join(hits, "query_id").alias("c").join(chunks.select("doc_id", *expected.values()).alias("k"), (F.col("c.doc_id") == F.col("k.doc_id")) & _expected(expected))
    texts = chunks.where("content is not null").select(*expected.values()).distinct()  # an empty phrase is in every text
    empty = asked.where("phrase = ''").alias("c").join(texts.alias("k"), _expected(expected))
    held = named.select("c.query_id").unionByName(empty.select("c.query_id")).distinct()
    return cases.join(held, "query_id", "left_anti")


def evaluated(cases: DataFrame, chunks: DataFrame, ranked: DataFrame, *, expected: dict[str, str], source: str, by_source: bool = False, ks: Sequence[int] = (1, 3, 5), k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary, results) of a ranking (query_id, doc_id, rank) of ``chunks`` (doc_id, content, ``source``, ...).

    A case's rank is that of its first expected chunk; with ``by_source`` that of its source among the distinct sources of
    the ranking.  ``results`` has a row a case: relevant_rank (null if it was missed) and what was retrieved.  Cases without
    evidence are an error, and nothing is evaluated.
    """
    missed = [r.query_id for r in missing_evidence(cases, chunks, expected=expected).select("query_id").limit(10).collect()]
    if missed:
        raise ValueError(f"the corpus lacks the evidence of cases {missed}")
    top = ranked.where(F.col("rank") <= k).join(chunks.select("doc_id", source, *[c for c in expected.values() if c != source]), "doc_id")
    if by_source:
        top = source_rank(top, source=source)
    hit = cases.alias("c").join(top.alias("k"), "query_id").where(_expected(expected)).groupBy("query_id").agg(F.min("k.rank").alias("relevant_rank"))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(source).cast("string").alias("s")))), lambda x: x["s"])
    retrieved = top.groupBy("query_id").agg(shown.alias("retrieved"))  # k rows a case
    results = cut(cases.select("query_id").join(hit, "query_id", "left").join(retrieved, "query_id", "left"))
    found = F.col("relevant_rank")
    summary = results.agg(
        F.count("*").alias("cases"), *[F.round(F.avg(F.when(found <= n, 1.0).otherwise(0.0)), 4).alias(f"recall_at_{n}") for n in ks],
        F.round(F.avg(F.coalesce(1.0 / found, F.lit(0.0))), 4).alias(f"mrr_at_{k}"), F.count_if(found.isNull()).alias("failures"),
    )
    size = chunks.agg(F.count("*").alias("corpus_chunks"), F.countDistinct(source).alias("corpus_sources"))
    return summary.join(F.broadcast(size)), results  # one row each


def relevant(judgments: DataFrame, *, grade: int) -> DataFrame:
    """(query_id, doc_id) judged with ``grade`` or more."""
    if not 0 <= grade <= 3:
        raise ValueError("a grade is 0 to 3")
    return judgments.where(F.col("grade") >= grade).select("query_id", "doc_id").distinct()


def lexical_of(cases: DataFrame, chunks: DataFrame, *, k: int = 5, **terms) -> DataFrame:
    """A harness's plain retriever."""
    return rt.lexical_rank(cases.select("query_id", "query"), chunks, k=k, **terms)
