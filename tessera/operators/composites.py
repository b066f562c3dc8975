"""Sectioning and the composed retrieval pipelines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import retrieval as rt
from tessera.operators.chunking import Policy, split_blocks
from tessera.session import cut

NUMERAL = "[0-9零〇一二三四五六七八九十百千万亿两]+"
ARTICLE = f"第{NUMERAL}条(?:之{NUMERAL})?"
# Colloquial terms and the statutes' words for them.
SYNONYMS = {"每天": "每日", "上限": "不超过", "工资": "劳动报酬", "拖欠工资": "未及时足额支付劳动报酬"}
STOP_TERMS = ["一下", "什么", "应该", "怎么", "怎样", "情况", "怎么办", "这个"]


LEVELS = "编章节"
_MARK = re.compile(rf"^(?:(?P<article>{ARTICLE})|第{NUMERAL}(?P<unit>[{LEVELS}])(?:[ \t\u3000]+.*)?$)", re.M)
_SECTIONS = "array<struct<label: string, heading_path: array<string>, content: string>>"
# The section labels of decisions, and the first section's.
DECISION_LABELS = ("案例信息", "关键词", "裁判要点", "裁判要旨", "相关法条", "基本案情", "裁判结果", "裁判理由", "典型意义", "关联索引")
DECISION_STOP_TERMS = ["一下", "可以", "是否", "能否", "什么", "应该", "怎么", "怎样", "情况", "怎么办", "这个", "案件"]
MATERIAL_STOP_TERMS = ["一下", "什么", "应该", "怎么", "怎样", "情况", "怎么办", "我的", "这个"]
INTENT = f"{ARTICLE}.{{0,8}}(?:规定|内容|全文|是什么|怎么说)"
STATUTE, DECISION, MATERIAL = Policy("statute", "1", 500, 800), Policy("decision", "1", 500, 800), Policy("material", "1", 450, 700)


def _lines(text: str) -> str:
    return "\n".join(filter(None, map(str.strip, (text or "").splitlines())))


def articles(text: str) -> list[tuple]:
    """(label, heading path, content) of each article: it runs to the next article or heading.  A heading ends those
    below its level.  A text without articles is one section without a label."""
    text, out, path = _lines(text), [], {}
    marks = list(_MARK.finditer(text))
    for mark, end in zip(marks, [*(m.start() for m in marks[1:]), len(text)]):
        if mark["article"]:
            out.append((mark["article"], [path[u] for u in LEVELS if u in path], text[mark.start() : end].strip()))
        else:
            path = {u: h for u, h in path.items() if LEVELS.index(u) < LEVELS.index(mark["unit"])} | {mark["unit"]: mark[0]}
    return out or [(None, [], text)]


def labelled(text: str, labels: Sequence[str], default: str) -> list[tuple]:
    """(label, empty path, content) of the parts between lines that are exactly a label; empty parts are left out."""
    lines = _lines(text).split("\n")
    at = [i for i, line in enumerate(lines) if line in labels]
    parts = [(default, lines[: at[0] if at else len(lines)]), *((lines[i], lines[i + 1 : j]) for i, j in zip(at, [*at[1:], len(lines)]))]
    return [(label, [], "\n".join(body)) for label, body in parts if any(body)] or [(default, [], _lines(text))]


def _sectioned(docs: DataFrame, cut_text: Callable[[str], list[tuple]]) -> DataFrame:
    @F.pandas_udf(_SECTIONS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(cut_text)

    kept = [F.col(f"`{c}`") for c in docs.columns if c != "content"]
    return docs.select(*kept, F.posexplode(cut("content")).alias("section", "s")).select(*kept, (F.col("section") + 1).alias("section"), "s.*")


def statute_sections(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (with ``content``), and section (from 1), label, heading_path and content of each article."""
    return _sectioned(docs, articles)


def label_sections(docs: DataFrame, labels: Sequence[str] = DECISION_LABELS, default: str = DECISION_LABELS[0]) -> DataFrame:
    """The same for texts cut at lines that are exactly one of ``labels``."""
    return _sectioned(docs, lambda t: labelled(t, labels, default))


def numbered_chunks(sections: DataFrame, policy: Policy, *, prefix: str, mark: str, source: str = "doc_id") -> DataFrame:
    """Sections as chunks, with chunk_index (from 1 in each source) and a reference such as L7:C1."""
    chunks = split_blocks(sections, policy=policy)
    number = F.row_number().over(W.partitionBy(source).orderBy("section", "chunk_in_block"))
    reference = F.concat(F.lit(prefix), F.col(source).cast("string"), F.lit(f":{mark}"), F.col("chunk_index").cast("string"))
    return chunks.withColumn("chunk_index", number).withColumn("reference", reference)


def statute_chunks(docs: DataFrame) -> DataFrame:
    return numbered_chunks(statute_sections(docs), STATUTE, prefix="L", mark="C")


def decision_chunks(docs: DataFrame) -> DataFrame:
    return numbered_chunks(label_sections(docs), DECISION, prefix="C", mark="S")


def material_chunks(materials: DataFrame, *, number: str = "reference_index") -> DataFrame:
    """Chunks of a case's materials, with references M1:C1 by the material's number in its case."""
    chunks = split_blocks(materials, policy=MATERIAL).withColumn("chunk_index", F.col("chunk_in_block") + 1)
    return chunks.withColumn("reference", F.concat(F.lit("M"), F.col(number).cast("string"), F.lit(":C"), F.col("chunk_index").cast("string")))


def expanded(query: Column) -> Column:
    """The query and the statutes' words for the terms that it holds."""
    return F.concat_ws(" ", query, *[F.when(F.contains(query, F.lit(k)), F.lit(v)) for k, v in SYNONYMS.items()])


def _vectors(queries: DataFrame, chunks: DataFrame, k: int) -> list[DataFrame]:
    """The vector ranking where both sides have embeddings; a query without one, as when its embedding failed, has only
    the other rankings.  With ``embedding_model`` on both sides a chunk takes part under the query's model only."""
    if "embedding" not in queries.columns or "embedding" not in chunks.columns:
        return []
    label = "embedding_model" if "embedding_model" in queries.columns and "embedding_model" in chunks.columns else None
    return [rt.vector_rank(queries, chunks, k=k, label=label)]


def statute_retrieval(queries: DataFrame, chunks: DataFrame, *, k: int = 6) -> DataFrame:
    """Exact terms of the query as asked, lexical on the expanded one over title, headings, label and content, vectors where
    a query has one; fused.  If the query asks for an article, that article of the law it names comes first.

    ``queries`` (query_id, query[, embedding]); ``chunks`` (doc_id, label, title, content[, heading_path, embedding]).
    """
    headings = F.col("heading_path") if "heading_path" in chunks.columns else F.array().cast("array<string>")
    whole = chunks.withColumn("content", tx.joined(tx.one(F.col("title")), headings, tx.one(F.col("label")), tx.one(F.col("content"))))
    exact = cut(rt.exact_rank(queries, chunks, k=3 * k, pattern=ARTICLE))
    lexical = rt.lexical_rank(queries.select("query_id", expanded(F.col("query")).alias("query")), whole, k=3 * k, stop_terms=STOP_TERMS)
    fused = rt.fuse([exact, lexical, *_vectors(queries, whole, 3 * k)], k=k)
    asked = queries.where(F.col("query").rlike(INTENT)).select("query_id", "query")
    direct = exact.withColumnRenamed("rank", "exact_rank").join(asked, "query_id").join(chunks.select("doc_id", "label", "title"), "doc_id")
    named = F.array_contains(F.regexp_extract_all("query", F.lit(ARTICLE), F.lit(0)), F.col("label")) & rt.names_title(F.col("query"), F.col("title"))
    return rt.promote(fused, direct.where(named).select("query_id", "doc_id", "exact_rank"), k=k).select("query_id", "doc_id", "rank")


def decision_retrieval(queries: DataFrame, chunks: DataFrame, *, k: int = 5, vector_floor: float = 0.55, stop_terms: Sequence[str] = DECISION_STOP_TERMS) -> DataFrame:
    """Lexical above a floor that depends on the number of terms, over number, title, keywords, section and content; vectors
    above theirs; fused, two chunks a source.  Columns but ``source`` and ``content`` may be missing."""
    parts = [tx.one(F.col(c)) if c != "keywords" else F.col(c) for c in ("case_number", "title", "keywords", "section_label", "content") if c in chunks.columns]
    whole = chunks.withColumn("content", tx.joined(*parts))
    lexical = rt.lexical_rank(queries, whole, k=3 * k, stop_terms=stop_terms)
    floors = queries.select("query_id", F.when(F.size(tx.query_terms(F.col("query"), stop_terms=stop_terms)) <= 2, 1.0).otherwise(3.0).alias("floor"))
    rankings = [lexical.join(floors, "query_id").where("score >= floor").drop("floor")]
    rankings += [r.where(F.col("score") >= vector_floor) for r in _vectors(queries, whole, 3 * k)]
    fused = rt.fuse(rankings, k=3 * k).join(chunks.select("doc_id", "source"), "doc_id")
    return rt.cap_per_source(fused.select("query_id", "doc_id", "source", "rank"), cap=2, k=k)


def material_retrieval(queries: DataFrame, chunks: DataFrame, *, k: int = 8) -> DataFrame:
    """Lexical and, where a query has vector hits, vectors, each k deep, fused."""
    rankings = [rt.lexical_rank(queries, chunks, k=k, stop_terms=MATERIAL_STOP_TERMS), *_vectors(queries, chunks, k)]
    return rt.fuse(rankings, k=k).select("query_id", "doc_id", "rank")


def contextual_query(title: Column, profile: Column, query: Column) -> Column:
    """What authorities are searched with; an embedding is made of the query alone."""
    return tx.joined(tx.one(title), tx.one(profile), tx.one(query))


def accumulated(results: DataFrame, *, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Results of several searches by key, each with its last row's columns."""
    last = F.max_by(F.struct(*[F.col(c) for c in results.columns if c not in key]), F.struct(*order))
    return results.groupBy(*key).agg(last.alias("r")).select(*key, "r.*")
