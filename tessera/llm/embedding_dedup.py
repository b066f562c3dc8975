"""Embedding near-duplicates: an exact metric range join.

Cosine c between unit vectors is the chord distance sqrt(2 - 2c), a metric, so "cosine at least t" is a range join of
radius r = sqrt(2 - 2t).

1. Equal vectors of a label are one class with a multiplicity, so copies make no pairs.
2. Pivots of a label are chosen far apart (farthest first) on a sample of its classes.  A class belongs to the cell of
   its nearest pivot if it lies within the cell radius R, else to the rest cell.
3. By the triangle inequality a class has no partner in another pivot's cell if it is farther than R + r from that
   pivot, or more than 2r farther from it than from its own (the bound by the plane between the two is tighter);
   a class of a cell has none in the rest cell if it lies within R - r of its pivot.  Otherwise it is replicated.
4. Cells join independently: members against members and replicas.  Each member meets every partner in its own
   cell exactly once, so its links are counted there alone.  Large cells are dealt in blocks of ``block`` members by
   ``block`` candidates, so a task holds one pair of blocks at a time.
5. A block pair returns link counts and only a spanning forest of the links it found, which grows while the pair is
   compared, so links that join nothing are never held; forests are merged to components.

How many pivots, and R, are what costs least by the replicas and pairs that the sample measures, so the number of
cells grows with a label that falls into clusters; where all vectors of a label are about equally far from each
other no partition can prune, and it stays one cell of many blocks.

Vectors that are null, empty, zero or hold null or non-finite components, vectors of a null label and vectors of a
null id link with nothing; only vectors of equal length are compared.  Rows that repeat an id are separate vectors
for counting (each is another vector to the others) and one node for components.  Ids keep their type; the smallest
is meant in its order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.graph import connected_components
from tessera.llm.tables import broadcast_if_small, drop_stored, stored

REPLICA = 100  # what it costs to move a class once, in comparisons of two vectors
SALT_ROWS = 50_000  # classes of a label that one task places


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.clip(x @ y.T, -1, 1), 0))


def place(x: np.ndarray, pivots: np.ndarray, cell_radius: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's own cell, and a table of the cells it must be present in; the last cell is the rest."""
    n, p = len(x), len(pivots)
    present = np.zeros((n, p + 1), bool)
    if not p:
        present[:, 0] = True
        return np.zeros(n, int), present
    d = _distances(x, pivots)
    near = d.argmin(axis=1)
    own = d[np.arange(n), near]
    home = np.where(own <= cell_radius, near, p)
    slack = 1e-9
    plane = (d**2 - own[:, None] ** 2) / np.maximum(2 * _distances(pivots, pivots)[near], 1e-12)
    present[:, :p] = (d <= cell_radius + radius + slack) & (d - own[:, None] <= 2 * radius + slack) & (plane <= radius + slack)
    present[:, p] = own > cell_radius - radius - slack
    present[np.arange(n), home] = True
    return home, present


def choose(x: np.ndarray, total: int, radius: float) -> tuple[np.ndarray, float]:
    """Pivots and cell radius of the least cost for ``total`` classes.  One half of a sample of unit vectors gives the
    pivots, the other measures what they cost (a pivot itself is always alone in its cell)."""
    x, rest = x[: len(x) // 2], x[len(x) // 2 :]
    most = min(len(x), 2 * math.isqrt(total))
    order, nearest = ([0], _distances(x, x[:1])[:, 0]) if most else ([], np.zeros(1))
    while len(order) < most and nearest.max() > 1e-9:
        order.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(x, x[order[-1:]])[:, 0])
    best, found = total * REPLICA + float(total) ** 2, (x[:0], 2.0)
    count = 1
    while count <= len(order):
        for cell_radius in (radius, 1.5 * radius, 2 * radius, 3 * radius, 2.0):
            home, present = place(rest, x[order[:count]], cell_radius, radius)
            pairs = (np.bincount(home, minlength=count + 1) * present.sum(axis=0)).sum() / len(rest) ** 2
            cost = total * (REPLICA * present.sum() / len(rest) + count) + pairs * float(total) ** 2
            if cost < best:
                best, found = cost, (x[order[:count]], cell_radius)
        count = count + 1 if count < 4 else count * 5 // 4
    return found


def _choose_group(t: pa.Table, radius: float) -> pa.Table:
    pivots, cell_radius = choose(_unit(_matrix(t.column("v"))), t.column("classes")[0].as_py(), radius)
    return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "salts": t.column("salts")[:1], "pivots": pa.array([pivots.ravel()], pa.list_(pa.float64())), "cell_radius": pa.array([cell_radius])})


_PLACED = ["label", "dim", "cid", "n", "v", "cell", "native"]


def _place_group(t: pa.Table, chosen: pa.Table, radius: float) -> pa.Table:
    """A row for the cell of each class and for every cell that it is replicated to."""
    if not t.num_rows:
        return pa.Table.from_batches([], pa.schema([*(t.schema.field(c) for c in _PLACED[:5]), ("cell", pa.int32()), ("native", pa.bool_())]))
    dim = t.column("dim")[0].as_py()
    pivots = np.array(chosen.column("pivots")[0].as_py(), float).reshape(-1, dim)
    home, present = place(_unit(_matrix(t.column("v"))), pivots, chosen.column("cell_radius")[0].as_py(), radius)
    row, cell = np.nonzero(present)
    rows = t.select(_PLACED[:5]).take(pa.array(row))
    return rows.append_column("cell", pa.array(cell.astype(np.int32))).append_column("native", pa.array(home[row] == cell))


class _Forest:
    """Which links join what earlier links had not joined; parts are labels in an array, so that a row that links with
    thousands of one part costs a few operations on arrays."""

    def __init__(self, size: int):
        self.part = np.arange(size)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, node: int, others: np.ndarray) -> None:
        """Links of one node."""
        open_ = others[self.part[others] != self.part[node]]
        if not len(open_):
            return
        parts, first = np.unique(self.part[open_], return_index=True)
        self.a.append(np.full(len(first), node))
        self.b.append(open_[first])
        self.part[np.isin(self.part, parts)] = self.part[node]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.a, self.b))


def _join_blocks(t: pa.Table, threshold: float, step: int = 512) -> pa.Table:
    """Link counts of a block's members, and a spanning forest of the links; ``step`` members are compared at a time."""
    mine = t.column("member").to_numpy(zero_copy_only=False)
    ids, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
    x = _matrix(t.column("v"))
    norm = np.sqrt((x * x).sum(axis=1))
    left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
    known, number = np.unique(ids, return_inverse=True)  # a class can be a member and a candidate
    forest, counts = _Forest(len(known)), np.zeros(len(left), np.int64)
    for lo in range(0, len(left), step):
        a = left[lo : lo + step]
        cosine = (x[a] @ x[right].T) / np.outer(norm[a], norm[right])
        linked = (cosine >= threshold) & (ids[a][:, None] != ids[right][None, :])
        counts[lo : lo + step] = linked @ n[right]
        for i in np.flatnonzero(linked.any(axis=1)):
            forest.add(number[a[i]], number[right[linked[i]]])
    a, b = (known[z] for z in forest.links())
    other = pa.array(np.concatenate([np.zeros(len(left), np.int64), b]), mask=np.arange(len(left) + len(a)) < len(left))
    return pa.table({"cid": pa.array(np.concatenate([ids[left], a]), pa.int64()), "n_links": pa.array(np.concatenate([counts, np.zeros(len(a), np.int64)])), "other": other})


def placed_classes(classes: DataFrame, *, radius: float, sample: int) -> DataFrame:
    """Rows of classes (label, dim, cid, n, v) with ``cell`` and ``native``, one for each cell a class is present in."""
    key = ["label", "dim"]
    sizes = classes.groupBy(*key).agg(F.count("*").alias("classes")).withColumn("salts", F.ceil(F.col("classes") / SALT_ROWS).cast("int"))
    sizes = stored(sizes, "label-sizes")
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("cid"), "cid"))
    drawn = stored(classes.select(*key, "cid").withColumn("place", first).where(F.col("place") <= sample).select("cid"), "drawn")
    few = classes.join(broadcast_if_small(drawn), "cid").join(broadcast_if_small(sizes), key).select(*key, "cid", "v", "classes", "salts")
    chosen = few.groupBy(*key).applyInArrow(lambda t: _choose_group(t, radius), "label string, dim int, salts int, pivots array<double>, cell_radius double")
    chosen = stored(chosen, "pivots")
    spread = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = classes.join(broadcast_if_small(sizes).select(*key, "salts"), key).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int"))
    schema = T.StructType([*(classes.schema[c] for c in _PLACED[:5]), T.StructField("cell", T.IntegerType()), T.StructField("native", T.BooleanType())])
    grouped = salted.groupBy(*key, "salt").cogroup(spread.groupBy(*key, "salt"))
    return grouped.applyInArrow(lambda t, c: _place_group(t, c, radius), schema)


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, sample: int = 512, block: int = 16_000) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    ``sample`` classes of a label choose its pivots; they decide what the join costs, not what it finds.
    """
    radius = math.sqrt(2 - 2 * threshold)
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    positive_zero = F.transform(vector, lambda x: x + F.lit(0).cast("float" if single else "double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), positive_zero.alias("v"))
    good = F.expr("id is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    for seed in range(1, 9):  # two hashes name a class; should two classes ever share both, others are taken
        hashes = [F.xxhash64(F.lit(seed), "label", "v").alias("h1"), F.xxhash64(F.lit(-seed), "v", "label").alias("h2")]
        classes = rows.where("good").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        classes = stored(classes.select("label", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cid"), "n", "v", "rep", *hashes), "classes")
        if classes.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        drop_stored(classes)
    slim = stored(rows.select("id", "good", *hashes), "rows")
    placed = stored(placed_classes(classes.drop("rep", "h1", "h2"), radius=radius, sample=sample), "placed")

    key = ["label", "dim", "cell"]
    sizes = stored(placed.groupBy(*key).agg(F.ceil(F.count_if("native") / block).cast("int").alias("na"), F.ceil(F.count("*") / block).cast("int").alias("nb")), "cells")
    sized = placed.join(broadcast_if_small(sizes), key)
    spot = F.xxhash64("cid")
    first, second = F.pmod(spot, F.col("na")).cast("int"), F.pmod(spot, F.col("nb")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = sized.where("native").select(*key, first.alias("ia"), every("nb").alias("ib"), F.lit(True).alias("member"), "cid", "n", "v")
    others = sized.where("na > 0").select(*key, every("na").alias("ia"), second.alias("ib"), F.lit(False).alias("member"), "cid", "n", "v")
    pairs = members.unionByName(others)
    joined = stored(pairs.groupBy(*key, "ia", "ib").applyInArrow(lambda t: _join_blocks(t, threshold), "cid long, n_links long, other long"), "joined")
    drop_stored(placed, sizes)

    counts = joined.where("other is null").groupBy("cid").agg(F.sum("n_links").alias("outside"))
    merged = connected_components(joined.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    names = classes.select("cid", "rep")
    least = merged.join(names.withColumnRenamed("cid", "node"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    least = stored(least, "least")
    component = merged.join(broadcast_if_small(least), "component").select(F.col("node").alias("cid"), "least")
    named = classes.select("cid", "rep", "n", "h1", "h2").join(counts, "cid", "left").join(component, "cid", "left")
    named = stored(named.select("h1", "h2", F.coalesce("least", "rep").alias("component"), (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("links")), "named")
    drop_stored(joined, merged, least, classes)
    linked = slim.where("good").join(broadcast_if_small(named), ["h1", "h2"]).select("id", "links", "component")
    alone = slim.where("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


def oracle() -> str:
    """DuckDB SQL for the query over ``embeddings``: every pair, then components by recursion."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
SELECT e.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT node, min(seen) AS m FROM r GROUP BY node) c ON c.node = e.vec_id"""
