"""Inverted index: postings by term and block of documents, written once, and rankings that read the queries' terms only.

A block is up to ``BLOCK_DOCS`` documents that one task read together.  A row of postings holds what one term has in one
block, so a term of very many documents is many rows, and each row says how many documents it has, how often at most and how
short they are at least: a bound of the gain that any of them can have.  Rows lie in ``segments`` folders by a hash of their term, sorted by term; a search reads the
folders and columns that it needs.  Two families are written:

- ``parts``: full-text parts with frequencies and places, for BM25;
- ``words``: maximal runs of the signs of a query term, and CJK grams, for containment.  A term stands in a text as a
  substring if and only if it stands in one of its words, so the dictionary of distinct words is searched in place of the
  texts, and nothing is lost.

BM25 takes sums of greatest gains as bounds of blocks.  The most promising block of each query is scored first; the k-th
score found there rules out every block whose bound lies below it, and only the others' postings are read and shuffled.

Null texts are documents without terms.  Ids may be of any type that has an order; each row is a document, so repeated ids
are ranked each by itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.retrieval import stated, top_by
from tessera.session import cut, shared_folder

BLOCK_DOCS = 512
BLOCK_TERMS = 2_000_000  # words and parts of a block, for very long texts
K1, B = 1.2, 0.75
RUN = r"[a-z0-9_.+-]+"  # what a lowered query term is made of


def _number(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)) if kind is None else pa.array(values, kind))


def _sizes(starts: np.ndarray, end: int) -> pa.Array:
    return pa.array(np.diff(np.append(starts, end)).astype(np.int32))


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


_ROW = "term string, block long, n int, most int, least int, docs array<int>, counts array<int>, lens array<int>, places array<array<int>>"
_COLUMNS = ["family", *(c.split()[0] for c in _ROW.split(", ")), "ids"]


def _posted_block(rows: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    """A row for the block's documents and one for each term of a family."""
    ints, nested = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
    words, parts, ids, chars = (rows.column(c).combine_chunks() for c in ("words", "parts", "doc_id", "chars"))
    sizes = np.diff(parts.offsets.to_numpy())
    n = len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(["documents"]), pa.nulls(1, pa.string()), pa.array([number]), pa.array([n], pa.int32()), *[pa.nulls(1, pa.int32())] * 2, pa.nulls(1, ints), _lists(chars.to_numpy(), np.array([0])), _lists(sizes, np.array([0])), pa.nulls(1, nested), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)],
        _COLUMNS,
    )
    of_row = lambda lists: np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    terms, code = _number(words.flatten())
    order = np.lexsort((row := of_row(words), code))
    code, row = code[order], row[order]
    at = _first_of_each(code)
    count = len(at)
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(["words"] * count), terms.take(pa.array(code[at])), pa.array([number] * count), _sizes(at, len(row)), *[pa.nulls(count, pa.int32())] * 2, _lists(row, at), pa.nulls(count, ints), pa.nulls(count, ints), pa.nulls(count, nested), pa.nulls(count, pa.list_(ids.type))], _COLUMNS)
    terms, code = _number(parts.flatten())
    row = of_row(parts)
    place = np.arange(len(row)) - np.repeat(parts.offsets.to_numpy()[:-1] - parts.offsets.to_numpy()[0], sizes)
    order = np.lexsort((place, row, code))
    code, row, place = code[order], row[order], place[order]
    pair = _first_of_each(code, row)
    at = _first_of_each(code[pair])
    count = len(at)
    if count:
        counts = np.diff(np.append(pair, len(row)))
        bounds = [pa.array(f.reduceat(v, at).astype(np.int32)) for f, v in ((np.maximum, counts), (np.minimum, sizes[row[pair]]))]
        places = pa.ListArray.from_arrays(pa.array(np.append(at, len(pair)).astype(np.int32)), _lists(place, pair))
        yield pa.RecordBatch.from_arrays([pa.array(["parts"] * count), terms.take(pa.array(code[pair][at])), pa.array([number] * count), _sizes(at, len(pair)), *bounds, _lists(row[pair], at), _lists(counts, at), _lists(sizes[row[pair]], at), places, pa.nulls(count, pa.list_(ids.type))], _COLUMNS)


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    import pyarrow.compute as pc

    waiting: list[pa.Table] = []
    docs, terms = 0, 0
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        held = np.cumsum(np.asarray(pc.add(pc.list_value_length(whole.column("words")), pc.list_value_length(whole.column("parts")))))
        at = 0
        while at < whole.num_rows:
            base = int(held[at - 1]) if at else 0
            fits = int(np.searchsorted(held, base + BLOCK_TERMS - terms, "right")) - at
            take = max(min(BLOCK_DOCS - docs, fits, whole.num_rows - at), 0 if docs else 1)
            if take:
                waiting.append(pa.Table.from_batches([whole.slice(at, take)]))
                docs, terms, at = docs + take, terms + int(held[at + take - 1]) - base, at + take
            if docs >= BLOCK_DOCS or terms >= BLOCK_TERMS or not take:
                yield from _posted_block(pa.concat_tables(waiting), number)
                waiting, docs, terms, number = [], 0, 0, number + 1
    if waiting:
        yield from _posted_block(pa.concat_tables(waiting), number)


def _java_path(spark: SparkSession, path: str):
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()), java


def build(docs: DataFrame, path: str, *, segments: int | None = None, k1: float = K1, b: float = B) -> SearchIndex:
    """Writes the index of documents (doc_id, content) under ``path``.  Texts are read once, postings are shuffled and written
    once; ``about`` is written last, and an index without it is none.  ``segments`` is a folder for each 4 MB of the input's
    files, 4096 at most, if not given."""
    spark = docs.sparkSession
    segments = segments or 1 + min(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >> 22, 4095)
    least = spark.sparkContext.defaultParallelism
    docs = docs if docs.rdd.getNumPartitions() >= least else docs.repartition(least)  # one small file would be one task
    kind = docs.schema["doc_id"].dataType.simpleString()
    low, none = F.lower("content"), F.array().cast("array<string>")
    words = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(RUN), F.lit(0)), tx.cjk_grams(low, (2, 3, 4))))
    rows = docs.select("doc_id", F.coalesce(words, none).alias("words"), F.coalesce(tx.index_parts(F.col("content")), none).alias("parts"), F.coalesce(F.length("content"), F.lit(0)).alias("chars"))
    made = rows.mapInArrow(_posted, f"family string, {_ROW}, ids array<{kind}>")
    placed = made.withColumn("segment", F.coalesce(F.pmod(F.xxhash64("term"), F.lit(segments)).cast("int"), F.lit(0)))
    placed.hint("rebalance", "family", "segment").sortWithinPartitions("family", "segment", "term", "block").write.mode("overwrite").partitionBy("family", "segment").parquet(f"{path}/postings")
    index = SearchIndex(spark, path, kind)
    index._family("words").groupBy("term").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/dictionary")
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = index.documents.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("documents"), F.coalesce(F.sum(total), F.lit(0)).alias("parts")).first()
    mean = float(sums.parts) / sums.documents if sums.parts else 1.0
    about = [(sums.documents, sums.blocks, mean, k1, b, segments, kind)]
    spark.createDataFrame(about, "documents long, blocks long, mean double, k1 double, b double, segments int, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    return index


def _gain(tf: Column, size: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def of_table(docs: DataFrame) -> SearchIndex:
    """The index of documents that are read from files as they are: built where there is none of these very files and
    columns in the shared folder, else taken as it is."""
    spark = docs.sparkSession
    seen = []
    for name in sorted(docs.inputFiles()):
        fs, java = _java_path(spark, name)
        status = fs.getFileStatus(java)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    plan = docs._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    name = hashlib.sha256("\n".join([*seen, plan]).encode()).hexdigest()[:32]
    path = f"{shared_folder(spark)}/search-index-{name}"
    fs, java = _java_path(spark, f"{path}/about/_SUCCESS")
    if fs.exists(java):
        return SearchIndex(spark, path)
    made = f"{path}-{uuid.uuid4().hex}"
    build(docs, made)
    if fs.rename(_java_path(spark, made)[1], _java_path(spark, path)[1]) and fs.exists(java):
        return SearchIndex(spark, path)
    return SearchIndex(spark, made if not fs.exists(java) else path)  # another run was first


@dataclass
class _Asked:
    """A stated set of queries: ids, their terms as numbers, and what a term weighs in each query."""

    query_ids: pa.Array
    terms: list[str]
    uses: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], kind: pa.DataType) -> _Asked:
        """From (query_id, term, weight); equal pairs add up."""
        ids = sorted({q for q, _, _ in rows})
        place = {q: i for i, q in enumerate(ids)}
        terms = sorted({t for _, t, _ in rows})
        number = {t: i for i, t in enumerate(terms)}
        sums: list[dict[int, float]] = [{} for _ in ids]
        for q, t, w in rows:
            mine = sums[place[q]]
            mine[number[t]] = mine.get(number[t], 0.0) + w
        return cls(pa.array(ids, kind), terms, [(np.array(list(s), int), np.array(list(s.values()), float)) for s in sums])


def _best_of_block(asked: _Asked, gains: np.ndarray, ids: pa.Array, lengths: np.ndarray, k: int, *, as_text: bool, places: int | None) -> pa.Table:
    """The k best documents of a block for each query; ``gains`` is a table of terms by documents."""
    names = np.array([str(x) for x in ids.to_pylist()] if as_text else ids.to_pylist())
    order_of_ids = np.empty(len(names), np.int64)
    order_of_ids[np.argsort(names, kind="stable")] = np.arange(len(names))
    first = np.zeros(len(names)) if as_text else lengths
    q, at, scores = [], [], []
    for i, (numbers, weights) in enumerate(asked.uses):
        score = weights @ gains[numbers]
        hit = np.flatnonzero(score > 0)
        if places is not None:
            score = np.round(score, places)
        best = hit[np.lexsort((order_of_ids[hit], first[hit], -score[hit]))[:k]]
        q.append(np.full(len(best), i))
        at.append(best)
        scores.append(score[best])
    q, at, scores = (np.concatenate(x) if x else np.zeros(0, int) for x in (q, at, scores))
    return pa.table({"query_id": asked.query_ids.take(pa.array(q, pa.int64())), "doc_id": ids.take(pa.array(at, pa.int64())), "score": pa.array(scores.astype(float)), "length": pa.array(lengths[at].astype(np.int64))})


def _spread(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The row of each posting, and its document."""
    docs = rows.column("docs").combine_chunks()
    return np.repeat(np.arange(len(docs)), np.diff(docs.offsets.to_numpy())), docs.flatten().to_numpy()


def _contained_block(rows: pa.Table, block: pa.Table, asked: _Asked, k: int) -> pa.Table:
    ids = block.column("ids")[0].values if block.num_rows else pa.array([], asked.query_ids.type)
    if not rows.num_rows or not block.num_rows:
        return _best_of_block(asked, np.zeros((len(asked.terms), 0)), ids, np.zeros(0), k, as_text=False, places=None)
    present = np.zeros((len(asked.terms), len(ids)), np.float32)
    row, doc = _spread(rows)
    terms = rows.column("terms").combine_chunks()
    of = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))  # the row of each term
    size = np.bincount(row, minlength=len(rows))
    each = size[of]  # documents of each (row, term)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(size) - size)[of], each)
    present[np.repeat(terms.flatten().to_numpy(), each), doc[at]] = 1
    return _best_of_block(asked, present, ids, block.column("chars")[0].values.to_numpy(), k, as_text=False, places=None)


def _scored_block(rows: pa.Table, block: pa.Table, asked: _Asked, idf: np.ndarray, k: int, mean: float, k1: float, b: float) -> pa.Table:
    ids = block.column("ids")[0].values if block.num_rows else pa.array([], asked.query_ids.type)
    gains = np.zeros((len(asked.terms), len(ids)))
    if rows.num_rows and block.num_rows:
        number = {t: i for i, t in enumerate(asked.terms)}
        term = np.array([number[t] for t in rows.column("term").to_pylist()])
        row, doc = _spread(rows)
        tf, size = (rows.column(c).combine_chunks().flatten().to_numpy().astype(float) for c in ("counts", "lens"))
        gains[term[row], doc] = idf[term[row]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))
    return _best_of_block(asked, gains, ids, np.zeros(len(ids)), k, as_text=True, places=10)


def _phrases_of_block(rows: pa.Table, phrases: list[tuple[str, ...]]) -> pa.Table:
    """Postings of phrases from those of their parts: a phrase stands where its parts stand side by side."""
    held: dict[str, dict[int, tuple[int, set[int]]]] = {}
    for term, docs, lens, places in zip(*(rows.column(c).to_pylist() for c in ("term", "docs", "lens", "places")), strict=True):
        held[term] = {d: (n, set(p)) for d, n, p in zip(docs, lens, places, strict=True)}
    out = []
    for phrase in phrases:
        mine = [held.get(w, {}) for w in phrase]
        found = []
        for d in sorted(set(mine[0]).intersection(*mine[1:])):
            starts = set.intersection(*[{p - j for p in m[d][1]} for j, m in enumerate(mine)])
            if starts:
                found.append((d, len(starts), mine[0][d][0]))
        if found:
            docs, counts, lens = zip(*found)
            out.append(("\x1f".join(phrase), list(docs), list(counts), list(lens)))
    ints = pa.list_(pa.int32())
    block = rows.column("block")[0].as_py() if rows.num_rows else 0
    return pa.table({"term": pa.array([r[0] for r in out], pa.string()), "block": pa.array([block] * len(out), pa.int64()), "n": pa.array([len(r[1]) for r in out], pa.int32()), "docs": pa.array([r[1] for r in out], ints), "counts": pa.array([r[2] for r in out], ints), "lens": pa.array([r[3] for r in out], ints)})


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str
    known_kind: str | None = None  # of document ids, while there is no ``about`` yet

    @property
    def kind(self) -> str:
        return self.known_kind or self.about.kind

    def _family(self, family: str) -> DataFrame:
        rows = self.spark.read.schema(f"{_ROW}, ids array<{self.kind}>, family string, segment int").parquet(f"{self.path}/postings")
        return rows.where(F.col("family") == family)

    @cached_property
    def about(self):
        return self.spark.read.json(f"{self.path}/about").first()

    @property
    def documents(self) -> DataFrame:
        """A row a block: ids, characters and parts of its documents."""
        return self._family("documents").select("block", "ids", F.col("counts").alias("chars"), "lens")

    def postings(self, family: str, terms: DataFrame) -> DataFrame:
        """Postings of the distinct ``terms`` (term, ...), with their other columns; only the terms' folders are read."""
        segment = F.pmod(F.xxhash64("term"), F.lit(int(self.about.segments))).cast("int")
        needed = [r.s for r in terms.select(segment.alias("s")).distinct().collect()]  # at most ``segments`` numbers
        rows = self._family(family).where(F.col("segment").isin(needed))
        return rows.drop("family", "segment", "ids").join(terms, "term")

    def contained(self, queries: DataFrame, *, k: int, **terms) -> DataFrame:
        """(query_id, doc_id, score, rank) as ``lexical_rank`` of the texts gives it, from postings of words."""
        pairs = queries.select("query_id", F.explode(tx.query_terms(F.col("query"), **terms)).alias("term")).select("query_id", "term", tx.term_weight(F.col("term")).alias("w"))
        rows = [tuple(r) for r in stated(pairs)]
        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": self.kind}
        if not rows:
            return self._nothing(kinds)
        asked = _Asked.of(rows, pa.array([rows[0][0]]).type)
        words = self.spark.read.schema("term string").parquet(f"{self.path}/dictionary").mapInArrow(partial(_holding, terms=asked.terms), "term string, terms array<int>")
        matched = cut(words)
        found = self.postings("words", matched).select("block", "docs", "terms")
        best = self._by_block(found, self.documents).applyInArrow(lambda rows, block: _contained_block(rows, block, asked, k), self._schema(kinds))
        return top_by(best, ["query_id"], [F.desc("score"), F.col("length"), F.col("doc_id")], k).select("query_id", "doc_id", "score", "rank")

    def bm25(self, queries: DataFrame, *, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank) as ``bm25_rank`` of the texts gives it; blocks that can't reach a query's k-th
        score are not scored."""
        wanted = queries.select("query_id", F.explode(tx.query_terms(F.col("query"), cjk_sizes=(2, 3))).alias("raw"))
        wanted = wanted.select("query_id", F.array_join(F.array_remove(F.split("raw", r"[_.+-]+"), ""), "\x1f").alias("term"), F.lit(1.0).alias("w")).where("term <> ''")
        rows = [tuple(r) for r in stated(wanted)]
        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": self.kind}
        if not rows:
            return self._nothing(kinds)
        asked, about = _Asked.of(rows, pa.array([rows[0][0]]).type), self.about
        postings = self._of_terms(asked.terms)
        best = _gain(F.col("most"), F.col("least"), about.mean, about.k1, about.b)
        light = cut(postings.select("term", "block", "n", best.alias("best")))
        df = {r.term: r.df for r in light.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # one row for a stated term
        held = np.array([df.get(t, 0) for t in asked.terms], float)
        idf = np.maximum(np.log((about.documents - held + 0.5) / (held + 0.5)), 1e-6)
        weights = [(i, asked.terms[t], float(w * idf[t])) for i, (numbers, times) in enumerate(asked.uses) for t, w in zip(numbers.tolist(), times.tolist(), strict=True)]
        weighed = light.join(F.broadcast(self.spark.createDataFrame(weights, "q int, term string, w double")), "term")  # of the size of the stated set
        bounds = cut(weighed.groupBy("q", "block").agg((F.sum(F.col("w") * F.col("best")) + 1e-9).alias("bound")))
        mean, k1, b = about.mean, about.k1, about.b

        def of_blocks(blocks: DataFrame) -> DataFrame:
            rows = postings.select("term", "block", "docs", "counts", "lens").join(blocks, "block", "left_semi")
            return self._by_block(rows, self.documents.join(blocks, "block", "left_semi")).applyInArrow(lambda rows, block: _scored_block(rows, block, asked, idf, k, mean, k1, b), self._schema(kinds))

        first = cut(top_by(bounds, ["q"], [F.desc("bound"), F.col("block")], 1).select("block").distinct())
        found = cut(of_blocks(first))
        numbered = self.spark.createDataFrame([(q, i) for i, q in enumerate(asked.query_ids.to_pylist())], f"query_id {kinds['query_id']}, q int")
        kth = top_by(found, ["query_id"], [F.desc("score")], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        least = numbered.join(kth, "query_id").select("q", "least")
        open_ = bounds.join(F.broadcast(least), "q", "left").where("least is null or bound >= least").select("block").distinct()
        rest = cut(open_.join(first, "block", "left_anti"))
        self.scored_blocks = (first.count(), rest.count())
        out = found.unionByName(of_blocks(rest))
        return top_by(out, ["query_id"], [F.desc("score"), F.col("doc_id").cast("string")], k).select("query_id", "doc_id", "score", "rank")

    def _by_block(self, *tables: DataFrame):
        """The tables by block, side by side.  Their number of partitions is set, as what is few bytes is much work here."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        a, b = (df.repartition(n, "block").groupBy("block") for df in tables)
        return a.cogroup(b)

    def _of_terms(self, terms: list[str]) -> DataFrame:
        """Postings of parts and of phrases (parts joined by a unit separator)."""
        named = lambda some: self.spark.createDataFrame([(t,) for t in sorted(some)], "term string")
        single = self.postings("parts", named(t for t in terms if "\x1f" not in t)).drop("places")
        phrases = [tuple(t.split("\x1f")) for t in terms if "\x1f" in t]
        if not phrases:
            return single
        of_parts = self.postings("parts", named({w for p in phrases for w in p})).select("term", "block", "docs", "lens", "places")
        made = cut(of_parts.groupBy("block").applyInArrow(lambda rows: _phrases_of_block(rows, phrases), "term string, block long, n int, docs array<int>, counts array<int>, lens array<int>"))
        return single.unionByName(made.withColumns({"most": F.array_max("counts"), "least": F.array_min("lens")}))

    def _schema(self, kinds: dict[str, str]) -> str:
        return f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, length long"

    def _nothing(self, kinds: dict[str, str]) -> DataFrame:
        return self.spark.createDataFrame([], f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int")


def _holding(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(term, terms): words that hold any of ``terms`` as a substring, and the numbers of these."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    automaton.make_automaton()
    for batch in batches:
        words, numbers = [], []
        for word in batch.column("term").to_pylist():
            if found := {i for _, i in automaton.iter(word)}:
                words.append(word)
                numbers.append(sorted(found))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.list_(pa.int32()))], ["term", "terms"])
