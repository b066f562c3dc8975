"""Batch retrieval: lexical, exact, vector and BM25 rankings for many queries at once, fusion and caps."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import cut

QUERY_BLOCK = 1000
STATED_BYTES = 64 << 20
ROWS = 512  # rows of a batch that are decoded at once
AUTOMATON_CHARS = 4_000_000  # characters of the terms of one automaton


def stated(queries: DataFrame, most_bytes: int = STATED_BYTES) -> list[Row]:
    """The rows of a stated set of queries, which go to every task once; a set of more than ``most_bytes`` is an error."""
    rows, held = [], 0
    for r in queries.toLocalIterator():
        held += sum(len(x) * (1 if isinstance(x, str) else 8) if hasattr(x, "__len__") else 8 for x in r)
        if held > most_bytes:
            raise ValueError(f"a stated set of queries has at most {most_bytes} bytes; search in several sets")
        rows.append(r)
    return rows


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as Spark does."""
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy()


def top_by(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark plans it as a group limit before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class _Best:
    """The k best of each of n queries among the rows of a task, which no other task can change.

    Rows are columns in the order of rank, each ascending.  What k kept rows of its query go before need not be added:
    ``may_enter`` tells by the first two columns.
    """

    def __init__(self, k: int, n: int):
        self.k, self.n, self.parts, self.size, self.limit = k, n, [], 0, 200_000
        self.first, self.second = np.full(n, np.inf), None

    def may_enter(self, first: np.ndarray, second: object, queries: slice | np.ndarray = slice(None)) -> np.ndarray:
        if self.second is None:
            return np.ones(first.shape, bool)
        last = self.first[queries]
        return ~((first > last) | (first == last) & (second > self.second[queries]))

    def add(self, query: np.ndarray, *columns: np.ndarray) -> None:
        if not len(query):
            return
        self.parts.append((query, *columns))
        self.size += len(query)
        if self.size > self.limit:
            self.limit = 2 * max(100_000, len(self.rows()[0]))
        elif len(self.parts) > 4096:
            self.parts = [tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))]

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return ()
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.lexsort(columns[::-1])
        query = columns[0][order]
        new = np.ones(len(query), bool)
        new[1:] = query[1:] != query[:-1]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        keep = order[place < self.k]
        self.parts, self.size = [tuple(c[keep] for c in columns)], len(keep)
        last = order[place == self.k - 1]
        self.first, self.second = np.full(self.n, np.inf), np.zeros(self.n, columns[2].dtype)
        self.first[columns[0][last]], self.second[columns[0][last]] = columns[1][last], columns[2][last]
        return self.parts[0]


class _Terms:
    """The terms of n stated queries, and the queries of each group of terms that the same queries have.

    Groups that a quarter of the queries have are rows of a table, the others lists of queries.
    """

    def __init__(self, uses: dict[str, list[int]], n: int):
        self.n, self.names = n, list(uses)
        groups: dict[bytes, int] = {}
        self.group = np.array([groups.setdefault(np.array(q, np.int32).tobytes(), len(groups)) for q in uses.values()], int)
        self.queries = [np.frombuffer(b, np.int32) for b in groups]
        self.sizes = np.array([len(q) for q in self.queries], int)
        large = np.flatnonzero(self.sizes * 4 > n)
        self.row = np.full(len(self.queries), -1)
        self.row[large] = np.arange(len(large))
        self.table = np.array([np.bincount(self.queries[g], minlength=n) for g in large], np.float32)

    @cached_property
    def automata(self) -> list:
        import ahocorasick

        out, held = [], AUTOMATON_CHARS
        for i, t in enumerate(self.names):
            if t:
                if held >= AUTOMATON_CHARS:
                    out.append(ahocorasick.Automaton())
                    held = 0
                out[-1].add_word(t, i)
                held += len(t)
        for a in out:
            a.make_automaton()
        return out

    def found(self, text: str) -> set[int]:
        return set().union(*(map(itemgetter(1), a.iter(text)) for a in self.automata))

    def scores(self, found: set[int], weights: np.ndarray) -> np.ndarray:
        """Sums of the weights of the terms found, for each query."""
        at = np.fromiter(found, int, len(found))
        weight = np.bincount(self.group[at], weights[at], len(self.queries))
        hit = np.flatnonzero(weight)
        few = hit[self.row[hit] < 0]
        out = np.bincount(np.concatenate([self.queries[g] for g in few]), np.repeat(weight[few], self.sizes[few]), self.n) if len(few) else np.zeros(self.n)
        for g in hit[self.row[hit] >= 0]:
            out += weight[g] * self.table[self.row[g]]
        return out


def _rank_texts(batches: Iterator[pa.RecordBatch], terms: _Terms, ids: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    """One pass over the texts of a task for all queries."""
    best, weights = _Best(k, terms.n), np.array([2.0 if len(t) >= 3 else 1.0 for t in terms.names])
    for batch in _slices(batches):
        doc = _ids(batch.column("doc_id"))
        for row, text in enumerate(batch.column("content").to_pylist()):
            if text and (found := terms.found(text.lower())):
                s = terms.scores(found, weights)
                hit = np.flatnonzero((s > 0) & best.may_enter(-s, len(text)))
                best.add(hit, -s[hit], np.full(len(hit), len(text)), np.full(len(hit), doc[row]))
    if got := best.rows():
        q, score, length, at = got
        yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "doc_id": pa.array(at), "score": pa.array(-score), "length": pa.array(length)})


def lexical_rank(queries: DataFrame, docs: DataFrame, *, k: int, stop_terms: Sequence[str] = (), cjk_sizes: Sequence[int] = (2, 3, 4)) -> DataFrame:
    """(query_id, doc_id, score, rank): weights of the query's terms that a document contains as substrings.

    ``queries`` (query_id, query) is a stated set that goes to every task and is compared with all ``docs`` (doc_id,
    content); documents are read once and never shuffled, and a task holds its k best rows of each query.  Ties: shorter
    content, then smaller doc_id.
    """
    terms = queries.select("query_id", tx.query_terms(F.col("query"), stop_terms=stop_terms, cjk_sizes=cjk_sizes).alias("terms"))
    rows = sorted(stated(terms), key=lambda r: r.query_id)
    ids = pa.array([r.query_id for r in rows])
    uses: dict[str, list[int]] = {}
    for j, r in enumerate(rows):
        for t in r.terms or ():
            uses.setdefault(t, []).append(j)
    known = _Terms(uses, len(rows))
    found = docs.select("doc_id", "content").mapInArrow(lambda b: _rank_texts(b, known, ids, k), f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(docs, 'doc_id')}, score double, length long")
    return top_by(found, ["query_id"], [F.desc("score"), F.col("length"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, 0 where a norm is 0."""
    fold = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = fold(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(fold(F.transform(a, lambda x: x * x))) * F.sqrt(fold(F.transform(b, lambda x: x * x)))
    return F.when(norms == 0, 0.0).otherwise(dot / norms)


def _rank_vectors(batches: Iterator[pa.RecordBatch], ids: pa.Array, queries: np.ndarray, labels: np.ndarray | None, k: int, positive: bool) -> Iterator[pa.RecordBatch]:
    norms, best = np.sqrt((queries**2).sum(axis=1)), _Best(k, len(queries))
    for batch in _slices(batches):
        doc, length = _ids(batch.column("doc_id")), batch.column("length").to_numpy()
        x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(doc), -1)
        mine = np.sqrt((x**2).sum(axis=1))
        for lo in range(0, len(queries), QUERY_BLOCK):
            q = slice(lo, lo + QUERY_BLOCK)
            under = np.outer(mine, norms[q])
            score = np.round(np.divide(x @ queries[q].T, under, out=np.zeros_like(under), where=under > 0), 6)
            ok = best.may_enter(-score, length[:, None], q)
            if positive:
                ok &= score > 0
            if labels is not None:
                ok &= batch.column("label").to_numpy(zero_copy_only=False)[:, None] == labels[q][None, :]
            r, c = np.nonzero(ok)
            best.add(c + lo, -score[r, c], length[r], doc[r])
    if got := best.rows():
        c, score, _, doc = got
        yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(c)), "doc_id": pa.array(doc), "score": pa.array(-score), "length": pa.array(got[2])})


def vector_rank(queries: DataFrame, docs: DataFrame, *, k: int, positive: bool = True, label: str | None = None, strict: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine to 6 places; ``queries`` (query_id, embedding) are compared in blocks.

    Only vectors of the queries' length that are whole take part, or, if ``strict``, others are an error; scores of 0 or
    less are dropped if ``positive``.  With ``label`` a query meets documents of its own label only.  Ties: shorter
    ``content`` where documents have one, then smaller doc_id.
    """
    rows = sorted(stated(queries.where("embedding is not null")), key=lambda r: r.query_id)
    kinds = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(docs, 'doc_id')}"
    if not rows:
        return docs.sparkSession.createDataFrame([], f"{kinds}, score double, rank int")
    x = np.array([r.embedding for r in rows], np.float64)
    labels = np.array([r[label] for r in rows]) if label else None
    fits = (F.size("embedding") == x.shape[1]) & ~F.exists("embedding", lambda v: v.isNull())
    whole = docs.where(F.col("embedding").isNotNull() & (F.when(fits, True).otherwise(F.raise_error(F.lit("vectors differ in length"))) if strict else fits))
    length = F.length("content").cast("long") if "content" in docs.columns else F.lit(0).cast("long")
    ids = pa.array([r.query_id for r in rows])
    columns = [F.col("doc_id"), F.col("embedding"), length.alias("length"), *([F.col(label).alias("label")] if label else [])]
    found = whole.select(*columns).mapInArrow(lambda b: _rank_vectors(b, ids, x, labels, k, positive), f"{kinds}, score double, length long")
    return top_by(found, ["query_id"], [F.desc("score"), F.col("length"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def fuse(rankings: Sequence[DataFrame], *, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion.  Terms are added in the order of ``rankings``; ties: best rank, then first seen.  Where all
    rankings have ``matched_terms``, their union in that order goes along."""
    with_terms = all("matched_terms" in r.columns for r in rankings)
    tagged = [r.select("query_id", "doc_id", "rank", F.lit(i).alias("which"), *(["matched_terms"] if with_terms else [])) for i, r in enumerate(rankings)]
    terms = [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("which", "matched_terms"))), lambda x: x["matched_terms"]))).alias("matched_terms")] if with_terms else []
    one = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "doc_id").agg(
        *[F.max(F.when(F.col("which") == i, 1.0 / (constant + F.col("rank")))).alias(f"s{i}") for i in range(len(rankings))],
        F.min("rank").alias("best_rank"),
        F.min(F.struct("which", "rank")).alias("seen"),
        *terms,
    )
    score = reduce(lambda a, b: a + b, [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(rankings))])
    fused = one.withColumn("score", score)
    return top_by(fused, ["query_id"], [F.desc("score"), F.col("best_rank"), F.col("seen"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "best_rank", "rank", *(["matched_terms"] if with_terms else []))


def cap_per_source(ranked: DataFrame, *, cap: int, k: int) -> DataFrame:
    """At most ``cap`` rows of a source while walking a ranking (query_id, source, rank), then the first k."""
    capped = top_by(ranked, ["query_id", "source"], [F.col("rank")], cap, "in_source")
    return top_by(capped.withColumnRenamed("rank", "old_rank"), ["query_id"], [F.col("old_rank")], k).drop("in_source", "old_rank")


def two_phase(queries: DataFrame, docs: DataFrame, first: Sequence[DataFrame], *, k: int) -> DataFrame:
    """Ranks fully only the (query_id, doc_id) candidates that light first rankings found, each once."""
    pairs = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id") for r in first]).distinct()
    both = pairs.join(docs.select("doc_id", F.col("embedding").cast("array<double>").alias("d")), "doc_id").join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id")
    scored = both.select("query_id", "doc_id", F.round(cosine(F.col("q"), F.col("d")), 6).alias("score")).where("score > 0")
    return top_by(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _phrase_hits(batches: Iterator[pa.RecordBatch], phrases: list[str]) -> Iterator[pa.RecordBatch]:
    """(phrase, doc_id) where a text holds a phrase."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    for batch in _slices(batches):
        found = [(i, d) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) if t for i in {i for _, i in automaton.iter(t)}]
        yield pa.RecordBatch.from_pydict({"phrase": pa.array([phrases[i] for i, _ in found], pa.string()), "doc_id": pa.array([d for _, d in found], batch.column("doc_id").type)})


def phrase_matches(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, phrase, doc_id) where a document holds a query's phrase; a stated set of phrases goes to every task, the
    documents are read once and stay where they are."""
    known = sorted(r.phrase for r in stated(phrases.where("phrase <> ''").select("phrase").distinct()))
    if not known:
        return docs.sparkSession.createDataFrame([], f"query_id {_kind(phrases, 'query_id')}, phrase string, doc_id {_kind(docs, 'doc_id')}")
    hits = docs.select("doc_id", "content").mapInArrow(lambda b: _phrase_hits(b, known), f"phrase string, doc_id {_kind(docs, 'doc_id')}")
    return hits.join(phrases.select("query_id", "phrase").distinct(), "phrase").select("query_id", "phrase", "doc_id")


def promote(ranked: DataFrame, direct: DataFrame, *, k: int) -> DataFrame:
    """Direct hits (query_id, doc_id, exact_rank) first, ranked or not, then the rest in order; the first k."""
    both = ranked.withColumnRenamed("rank", "old_rank").join(direct, ["query_id", "doc_id"], "full")
    return top_by(both, ["query_id"], [F.col("exact_rank").isNull(), F.col("exact_rank"), F.col("old_rank")], k).drop("exact_rank", "old_rank")


# What counts as a quoted phrase, and the colloquial terms whose statutory words are looked for as they stand.
QUOTED = "[\"“”']([^\"“”']{2,80})[\"“”']"
EXACT_EXPANSIONS = {"拖欠工资": "未及时足额支付劳动报酬"}
STATE = "中华人民共和国"


def names_title(query: Column, title: Column) -> Column:
    """Whether a query names a law, with or without the state's name before it."""
    short = F.regexp_replace(title, f"^{STATE}", "")
    return F.coalesce(F.contains(query, title) | (short != title) & F.contains(query, short), F.lit(False))


def exact_terms(query: Column, pattern: str) -> Column:
    """References, quoted phrases and statutory words of a query."""
    references, quoted = (F.array_distinct(F.regexp_extract_all(query, F.lit(p), F.lit(i))) for p, i in ((pattern, 0), (QUOTED, 1)))
    return F.concat(references, quoted, F.array_compact(F.array(*[F.when(F.contains(query, F.lit(k)), F.lit(v)) for k, v in EXACT_EXPANSIONS.items()])))


def _rank_exact(batches: Iterator[pa.RecordBatch], terms: _Terms, asked: list[str], ids: pa.Array, k: int) -> Iterator[pa.RecordBatch]:
    best, weights, place = _Best(k, terms.n), np.full(len(terms.names), 2.0), {t: i for i, t in enumerate(terms.names)}
    known: dict[str, np.ndarray] = {}

    def named(title: str | None, queries: np.ndarray) -> np.ndarray:
        """``names_title`` of these queries; for the first titles of a task, of all queries once."""
        if title is None:
            return np.zeros(len(queries), bool)
        short = title.removeprefix(STATE)
        holds = lambda q: title in q or short != title and short in q
        if title not in known and len(known) < 256:
            known[title] = np.fromiter(map(holds, asked), bool, len(asked))
        return known[title][queries] if title in known else np.fromiter((holds(asked[q]) for q in queries), bool, len(queries))

    for batch in _slices(batches):
        doc = _ids(batch.column("doc_id"))
        for row, (label, title, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "title", "content")), strict=True)):
            found, own = terms.found(text) if text else set(), place.get(label)
            if own is not None:
                found.add(own)
            if not found:
                continue
            if own is not None:
                weights[own] = 5.0
            s = terms.scores(found, weights)
            if own is not None:
                weights[own] = 2.0
            hit = np.flatnonzero((s > 0) & best.may_enter(-s - 3, doc[row]))
            score = -s[hit] - 3 * named(title, hit)
            enters = best.may_enter(score, doc[row], hit)
            hit, score = hit[enters], score[enters]
            best.add(hit, score, np.full(len(hit), doc[row]))
    if got := best.rows():
        q, score, at = got
        yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q)), "doc_id": pa.array(at), "score": pa.array(-score)})


def exact_rank(queries: DataFrame, chunks: DataFrame, *, k: int, pattern: str) -> DataFrame:
    """(query_id, doc_id, score, rank): for each exact term of the query 5 if it is a chunk's label, else 2 if the chunk's
    content holds it, and 3 more if the query names the chunk's title.  ``chunks`` (doc_id, label, title, content), each
    with an id of its own; they are read once, and a task holds its k best rows of each query.  A term can stand among the
    references and the quoted phrases, and then counts twice."""
    rows = sorted(stated(queries.select("query_id", "query", exact_terms(F.col("query"), pattern).alias("terms")).where("query_id is not null and size(terms) > 0")), key=lambda r: r.query_id)
    ids, asked = pa.array([r.query_id for r in rows]), [r.query for r in rows]
    kinds = f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(chunks, 'doc_id')}, score double"
    if not rows:
        return chunks.sparkSession.createDataFrame([], f"{kinds}, rank int")
    uses: dict[str, list[int]] = {}
    for j, r in enumerate(rows):
        for t in r.terms:
            uses.setdefault(t, []).append(j)
    known = _Terms(uses, len(rows))
    found = chunks.where("doc_id is not null").select("doc_id", "label", "title", "content").mapInArrow(lambda b: _rank_exact(b, known, asked, ids, k), kinds)
    return top_by(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "rank")


class Bm25Statistics:
    """What a stated set of queries needs of a corpus: vocabulary, phrases and their inverse document frequencies."""

    def __init__(self, wanted: list, k1: float, b: float):
        self.k1, self.b = k1, b
        self.phrases = sorted({tuple(r.p) for r in wanted})
        at = {p: i for i, p in enumerate(self.phrases)}
        self.words = sorted({w for p in self.phrases for w in p})
        place = {w: i for i, w in enumerate(self.words)}
        self.numbers = [np.array([place[w] for w in p]) for p in self.phrases]
        self.single = np.full(len(self.words), -1)
        self.longer = []
        for i, n in enumerate(self.numbers):
            if len(n) == 1:
                self.single[n[0]] = i
            else:
                self.longer.append(i)
        self.query_ids = sorted({r.query_id for r in wanted})
        row = {q: j for j, q in enumerate(self.query_ids)}
        uses: dict[int, dict[int, int]] = {}
        for r in wanted:
            mine = uses.setdefault(at[tuple(r.p)], {})
            mine[row[r.query_id]] = mine.get(row[r.query_id], 0) + 1
        self.queries = [np.array(list(uses[i])) for i in range(len(self.phrases))]
        self.times = [np.array(list(uses[i].values()), float) for i in range(len(self.phrases))]

    def frequencies(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases a document has, and how often."""
        known, n = np.unique(words, return_counts=True)
        mine = self.single[known]
        found, counts = list(mine[mine >= 0]), list(n[mine >= 0])
        have = set(known.tolist())
        for i in self.longer:
            if have.issuperset(self.numbers[i].tolist()):
                starts = set(places[words == self.numbers[i][0]].tolist())
                for j, w in enumerate(self.numbers[i][1:], 1):
                    starts &= set((places[words == w] - j).tolist())
                if starts:
                    found.append(i)
                    counts.append(len(starts))
        return np.array(found, int), np.array(counts, float)


_PART, _RUN = re.compile("[A-Za-z0-9]+"), re.compile(tx.CJK_RUN)


def _parts(text: str | None) -> list[str]:
    """The same parts as ``functions.text.index_parts``."""
    if not text:
        return []
    parts = " ".join(_PART.findall(text)).lower().split()
    if not text.isascii():
        parts += [run[i : i + n] for run in _RUN.findall(text) for n in (2, 3) for i in range(len(run) - n + 1)]
    return parts


def _frequencies(batches: Iterator[pa.RecordBatch], stats: Bm25Statistics) -> Iterator[tuple]:
    """(doc_id, parts, phrases, how often) of each document, from its text or from its parts."""
    place = {w: i for i, w in enumerate(stats.words)}
    for batch in _slices(batches):
        doc = _ids(batch.column("doc_id"))
        each = batch.column("parts").to_pylist() if "parts" in batch.schema.names else map(_parts, batch.column("content").to_pylist())
        for d, parts in zip(doc, each, strict=True):
            at = np.fromiter((place.get(p, -1) for p in parts or ()), int, len(parts or ()))
            known = np.flatnonzero(at >= 0)
            yield d, len(at), *stats.frequencies(at[known], known)


def _document_frequencies(batches: Iterator[pa.RecordBatch], stats: Bm25Statistics) -> Iterator[pa.RecordBatch]:
    """The documents that have each phrase; after the phrases stand the number of documents and that of their parts."""
    total = np.zeros(len(stats.phrases) + 2, np.int64)
    for _, size, found, _ in _frequencies(batches, stats):
        total[found] += 1
        total[-2:] += 1, size
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"phrase": pa.array(at), "df": pa.array(total[at])})


def _rank_bm25(batches: Iterator[pa.RecordBatch], stats: Bm25Statistics, idf: np.ndarray, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(k, len(stats.query_ids))
    for doc, size, found, tf in _frequencies(batches, stats):
        if not len(found):
            continue
        gain = idf[found] * tf * (stats.k1 + 1) / (tf + stats.k1 * (1 - stats.b + stats.b * size / mean))
        s = np.bincount(np.concatenate([stats.queries[f] for f in found]), np.concatenate([stats.times[f] * g for f, g in zip(found, gain)]), len(stats.query_ids))
        score, name = -np.round(s, 10), np.array([str(doc)])
        hit = np.flatnonzero((s > 0) & best.may_enter(score, name))
        best.add(hit, score[hit], np.repeat(name, len(hit)), np.full(len(hit), doc))
    if got := best.rows():
        q, score, _, at = got
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.array(stats.query_ids)[q]), "doc_id": pa.array(at), "score": pa.array(-score)})


def indexed(docs: DataFrame) -> DataFrame:
    """(doc_id, parts) of documents (doc_id, content): what a full-text index holds of them."""
    return docs.select("doc_id", tx.index_parts(F.col("content")).alias("parts"))


def bm25_rank(queries: DataFrame, docs: DataFrame, *, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25; ``docs`` are (doc_id, content) or what ``indexed`` made of them.

    Each distinct query term counts once, so ``a`` and ``a.`` both score.  A Latin term of several index parts
    (``covid-19``) is a phrase: its parts side by side, with a document frequency of its own.  Inverse document
    frequencies are floored at 1e-6; scores are rounded to 10 places; ties by doc_id as text.

    One pass over the texts counts, one scores; a task keeps sums by phrase and its k best rows of each query, so nothing
    of a text is written or shuffled.
    """
    wanted = queries.select("query_id", F.explode(tx.query_terms(F.col("query"), cjk_sizes=(2, 3))).alias("raw"))
    wanted = wanted.select("query_id", F.array_remove(F.split("raw", r"[_.+-]+"), "").alias("p")).where(F.size("p") > 0)
    stats = Bm25Statistics(stated(wanted), k1, b)
    texts = docs.select("doc_id", "parts" if "parts" in docs.columns else "content")
    df = np.zeros(len(stats.phrases) + 2)
    for r in texts.mapInArrow(lambda x: _document_frequencies(x, stats), "phrase long, df long").groupBy("phrase").agg(F.sum("df").alias("df")).collect():
        df[r.phrase] = r.df
    *df, n, parts = df
    idf = np.maximum(np.log((n - np.array(df) + 0.5) / (np.array(df) + 0.5)), 1e-6)
    mean = parts / n if parts else 1.0
    found = texts.mapInArrow(lambda x: _rank_bm25(x, stats, idf, mean, k), f"query_id {_kind(queries, 'query_id')}, doc_id {_kind(docs, 'doc_id')}, score double")
    return top_by(found, ["query_id"], [F.desc("score"), F.col("doc_id").cast("string")], k)


def build_index(docs: DataFrame, path: str, *, identity: str, most_documents: int = 60_000, most_chars: int = 20_000, most_total: int = 64 << 20) -> bool:
    """Writes the index parts of documents (doc_id, content) under ``path`` with the corpus's identity and statistics;
    False if an index of that identity is there already.  Another identity, repeated ids, blank or too long texts
    and too large a corpus are errors, and nothing is written."""
    spark = docs.sparkSession
    if not identity.strip():
        raise ValueError("an identity is required")
    if _exists(spark, f"{path}/about"):
        if spark.read.json(f"{path}/about").first().identity != identity:
            raise ValueError("the index there has another identity")
        return False
    length = F.length("content")
    about = docs.agg(F.count("*").alias("documents"), F.sum(length).alias("chars"), F.count_if(F.coalesce(F.trim("content") == "", F.lit(True)) | (length > most_chars)).alias("bad")).first()
    if not about.documents or about.documents > most_documents or about.bad or about.chars > most_total:
        raise ValueError("the corpus is empty, too large, or holds blank or too long texts")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        raise ValueError("ids must be unique")
    indexed(docs).write.parquet(f"{path}/parts")
    spark.createDataFrame([(identity, about.documents, about.chars)], "identity string, documents long, chars long").coalesce(1).write.json(f"{path}/about")
    return True


def read_index(spark: SparkSession, path: str, *, identity: str) -> DataFrame:
    if spark.read.json(f"{path}/about").first().identity != identity:
        raise ValueError("the index there has another identity")
    return spark.read.parquet(f"{path}/parts")


def _exists(spark: SparkSession, path: str) -> bool:
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()).exists(java)


def guarded(df: DataFrame, *, limit: int) -> DataFrame:
    """The rows, or an error if there are more than ``limit``."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return df
