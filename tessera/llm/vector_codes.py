"""Vector code compression: product codes by Lloyd's iteration in integers, with Hamerly's bounds.

A component x becomes floor(``scale`` * x), a vector is cut into ``parts`` equal consecutive parts, and each part position
has a codebook that starts as that part of the vectors of the ``entries`` smallest ids.  A round assigns each part to its
nearest entry (ties to the lower index) and replaces an entry by the floor of its parts' mean; unused entries stay.

Each part keeps its entry, an upper bound of the distance to it and a lower bound of the distance to the second nearest.
When entries move, the bounds move with them.  A part whose upper bound lies strictly below its lower bound, or below half
the distance from its entry to the nearest other, has its entry alone as the nearest and is left as it is.  Else the
upper bound is made exact and tried again; only then are all entries measured, in integers.  Bounds carry a margin far
above what doubles round, so they decide what is measured and never the result.

A round is one pass over a stored table: every task writes its rows' new bounds, and as rows of their own the sums of its
parts by entry.  Spark adds those up; the driver holds codebooks, which have a fixed size.

Vectors that are null, hold null or non-finite components, or are empty or of a length that ``parts`` does not divide are
dropped, and so are those of another length than the kept vector of the smallest id.  So that squared distances fit a
long, a component beyond 2**30 / sqrt(length) after scaling (2**27 of 64) counts as non-finite.  Null ids come after all others, equal ids are
ordered by their vectors, and rows that repeat an id are vectors of their own.  With fewer vectors than entries a codebook
has as many as there are.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.tables import broadcast_if_small, drop_stored, stored

MARGIN = 1e-6  # distances are below 2**31, whose doubles are 2**-22 apart at most
MOST = 1 << 30  # of a scaled vector's length, so that squared distances are below 2**62
ROWS = 4096


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts (rows, dims) to the entries (entries, dims), in integers."""
    out = np.zeros((len(x), len(book)), np.int64)
    for d in range(x.shape[1]):
        gap = x[:, d, None] - book[None, :, d]
        out += gap * gap
    return out


@dataclass
class Bounds:
    """One part position: entry, upper bound, lower bound of the second nearest."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def moved(self, old: np.ndarray, new: np.ndarray) -> None:
        """After the entries moved: an upper bound grows by its entry's way, a lower one shrinks by the longest other."""
        way = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float))
        longest = np.array([np.delete(way, i).max(initial=0.0) for i in range(len(way))])
        self.upper = self.upper + way[self.entry] + MARGIN
        self.lower = self.lower - longest[self.entry] - MARGIN

    def assign(self, x: np.ndarray, book: np.ndarray) -> int:
        """Gives each part its nearest entry; the number of parts that had to be measured against all."""
        between = distances(book, book).astype(float)
        np.fill_diagonal(between, np.inf)
        half = np.sqrt(between.min(axis=1)) / 2 - MARGIN
        bound = np.maximum(half[self.entry], self.lower)
        open_ = np.flatnonzero(~(self.upper < bound))
        gap = x[open_] - book[self.entry[open_]]
        self.upper[open_] = np.sqrt((gap * gap).sum(axis=1).astype(float)) + MARGIN
        open_ = open_[~(self.upper[open_] < bound[open_])]
        if len(open_):
            d = distances(x[open_], book)
            near = d.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(open_))
            self.upper[open_] = np.sqrt(d[rows, near].astype(float)) + MARGIN
            d[rows, near] = np.iinfo(np.int64).max
            self.lower[open_] = np.sqrt(d.min(axis=1).astype(float)) - MARGIN if len(book) > 1 else np.inf
            self.entry[open_] = near
        return len(open_)


def _values(col: pa.Array, width: int, kind: type) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), x.shape[1]).cast(pa.list_(kind))


_BOUNDS = "entry array<int>, upper array<double>, lower array<double>"
_SUMS = "part int, code int, n long, total array<decimal(38,0)>, scans long"
_NAMES = ["id", "label", "v", "entry", "upper", "lower", "part", "code", "n", "total", "scans"]


def _round(batches: Iterator[pa.RecordBatch], parts: int, old: np.ndarray | None, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the bounds against the codebooks ``new``, then the sums of the rows by part and entry."""
    count, dims = new.shape[1], new.shape[2]
    n, total, scans = np.zeros((parts, count), np.int64), np.zeros((parts, count, dims), object), np.zeros(parts, np.int64)
    kinds = None
    for whole in batches:
        kinds = (whole.schema.field("id").type, whole.schema.field("label").type)
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = _values(batch.column("v"), parts * dims, np.int64).reshape(-1, parts, dims)
            if old is None:
                state = [Bounds(np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf)) for _ in range(parts)]
            else:
                entry, upper, lower = (_values(batch.column(c), parts, k) for c, k in (("entry", np.int64), ("upper", float), ("lower", float)))
                state = [Bounds(entry[:, m], upper[:, m], lower[:, m]) for m in range(parts)]
            for m, bounds in enumerate(state):
                if old is not None:
                    bounds.moved(old[m], new[m])
                scans[m] += bounds.assign(x[:, m], new[m])
                n[m] += np.bincount(bounds.entry, minlength=count)
                for e in np.unique(bounds.entry):
                    total[m, e] += x[bounds.entry == e, m].sum(axis=0).astype(object)
            rows = [_lists(np.stack([getattr(b, f) for b in state], axis=1), k) for f, k in (("entry", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()))]
            nothing = [pa.nulls(len(x), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), *rows, *nothing], _NAMES)
    if kinds:
        m, e = np.nonzero(n)
        sums = pa.array([[int(t) for t in total[i, j]] for i, j in zip(m, e, strict=True)], pa.list_(pa.decimal128(38, 0)))
        first = np.concatenate([[True], m[1:] != m[:-1]])
        nothing = [pa.nulls(len(m), k) for k in (*kinds, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(m.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[m, e]), sums, pa.array(np.where(first, scans[m], 0))], _NAMES)


def _means(state: DataFrame, book: np.ndarray) -> tuple[np.ndarray, int]:
    """The codebooks of the next round, and how many parts were measured against all entries in this one."""
    dims = book.shape[2]
    sums = [F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(dims)]
    new, scans = book.copy(), 0
    for r in state.where("part is not null").groupBy("part", "code").agg(F.sum("n").alias("n"), F.sum("scans").alias("scans"), *sums).collect():  # parts * entries rows
        new[r.part, r.code] = [int(r[f"t{d}"]) // r.n for d in range(dims)]
        scans += r.scans
    return new, scans


def _coded(batches: Iterator[pa.RecordBatch], parts: int, book: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = _values(batch.column("v"), parts * book.shape[2], np.int64).reshape(-1, parts, book.shape[2])
            entry = _values(batch.column("entry"), parts, np.int64)
            gap = x - book[np.arange(parts)[None, :], entry]
            error = (gap * gap).sum(axis=(1, 2))
            code = [row.tobytes().hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], ["id", "label", "code", "error"])


@dataclass
class Codes:
    """``rows`` (id, label, code, error), the final ``codebooks`` (parts, entries, dims) and, of each assignment, how many
    parts were ``measured`` against all entries.  ``drop`` removes the stored table that ``rows`` reads."""

    rows: DataFrame
    codebooks: np.ndarray
    measured: list[int]
    kept: DataFrame | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def drop(self) -> None:
        if self.kept is not None:
            drop_stored(self.kept)


def scaled(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(id, label, v): the vectors that can be coded, as integers."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where(f"v is not null and size(v) > 0 and size(v) % {parts} = 0 and not exists(v, x -> x is null or isnan(x) or abs(x) * {scale} > {MOST} / sqrt(size(v)))")
    return good.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(scale).cast("double"))).cast("array<int>").alias("v"))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of all vectors; two hex digits a part."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has one byte a part")
    rows = scaled(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, scale=scale)
    first = rows.select("id", "v").orderBy(F.col("id").isNull(), "id", "v").limit(1).collect()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    if not first:
        schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return Codes(vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64), [])
    width = len(first[0].v)
    rows = rows.where(F.size("v") == width)
    start = rows.select("id", "v").orderBy(F.col("id").isNull(), "id", "v").limit(entries).collect()
    book = np.array([r.v for r in start], np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, {_BOUNDS}, {_SUMS}"
    old, state, measured = None, None, []
    for i in range(rounds + 1):
        source = rows if state is None else state.where("part is null").select("id", "label", "v", "entry", "upper", "lower")
        made = stored(source.mapInArrow(partial(_round, parts=parts, old=old, new=book), schema), "codes")
        if state is not None:
            drop_stored(state)
        state = made
        new, scans = _means(state, book)
        measured.append(scans)
        if i < rounds:
            old, book = book, new
    coded = state.where("part is null").select("id", "label", "v", "entry").mapInArrow(partial(_coded, parts=parts, book=book), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return Codes(coded, book, measured, state)


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", **how) -> DataFrame:
    """One row per kept vector: id, code, error, label_error (errors of equal labels, nulls together), codebooks_sha256."""
    codes = compress(vectors, id_col=id_col, label_col=label_col, **how)
    rows = stored(codes.rows, "coded")
    codes.drop()
    sums = stored(rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = rows.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("same")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for the query over ``embeddings``: every part against every entry in every round."""
    near = lambda i: f"""a{i} AS MATERIALIZED (
  SELECT r, m, part, arg_min(e, struct_pack(d, e)) AS e, min(d) AS d
  FROM (SELECT p.r, p.m, p.part, b.e, list_sum(list_transform(list_zip(p.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{i} b ON p.m = b.m)
  GROUP BY r, m, part)"""  # noqa: E731
    steps = []
    for i in range(rounds):
        steps += [near(i), f"""s{i} AS (SELECT m, e, k, sum(part[k])::BIGINT AS s, count(*)::BIGINT AS c FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM p) + 1)) AS k) GROUP BY m, e, k),
n{i} AS (SELECT m, e, list(CASE WHEN s % c < 0 THEN s // c - 1 ELSE s // c END ORDER BY k) AS entry FROM s{i} GROUP BY m, e),
b{i + 1} AS MATERIALIZED (SELECT b.m, b.e, coalesce(n.entry, b.entry) AS entry FROM b{i} b LEFT JOIN n{i} n ON n.m = b.m AND n.e = b.e)"""]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, m, list_slice(q, (m * len(q) // {parts} + 1)::BIGINT, ((m + 1) * len(q) // {parts})::BIGINT) AS part FROM v, (SELECT unnest(range(0, {parts})) AS m)),
b0 AS MATERIALIZED (SELECT m, r - 1 AS e, part AS entry FROM p WHERE r <= {entries}),
{", ".join(steps)}, {near(rounds)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY m) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY m, e)) AS codebooks_sha256 FROM b{rounds})
SELECT v.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, h.codebooks_sha256
FROM v JOIN c ON c.r = v.r, h"""
