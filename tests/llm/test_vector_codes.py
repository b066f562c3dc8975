"""Vector codes against Lloyd's iteration without bounds, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes as vc


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (id, vector, label) as the contract has them: {index: (code, error)}, label errors and the digest."""
    kept = [(i, [math.floor(scale * x) for x in v], label, n) for n, (i, v, label) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, rows[r[3]][1]))
    width = len(kept[0][1]) // parts
    cut = {r[3]: [tuple(r[1][m * width : (m + 1) * width]) for m in range(parts)] for r in kept}
    books = [[cut[r[3]][m] for r in kept[:entries]] for m in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda m, p: min(range(len(books[m])), key=lambda e: (dist(p, books[m][e]), e))
    for _ in range(rounds):
        for m in range(parts):
            of = {}
            for p in cut.values():
                of.setdefault(near(m, p[m]), []).append(p[m])
            books[m] = [tuple(sum(c) // len(of[e]) for c in zip(*of[e])) if e in of else books[m][e] for e in range(len(books[m]))]
    out = {n: ("".join(f"{near(m, p[m]):02x}" for m in range(parts)), sum(dist(p[m], books[m][near(m, p[m])]) for m in range(parts))) for n, p in cut.items()}
    labels = {}
    for r in kept:
        labels[r[2]] = labels.get(r[2], 0) + out[r[3]][1]
    return out, labels, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("x") for c in ("id", "v", "part", "code", "n", "same", "error")}).repartition(3)
    got = vc.vector_codes(df, **how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    out, labels, digest = plain(rows, **how)
    expected = sorted(((rows[n][0], code, error, labels[rows[n][2]], digest) for n, (code, error) in out.items()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expected


def vectors(n, seed, dims=16, grid=None):
    """Clustered vectors; on a ``grid`` many distances are equal."""
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(20)]
    out = []
    for i in range(n):
        v = [float(np.float32(x + rnd.gauss(0, 0.08))) for x in rnd.choice(centres)]
        out.append((i * 3 + 1, [round(x * grid) / grid for x in v] if grid else v, rnd.choice([1, 1, 1, 2, None])))
    return out


@pytest.mark.parametrize("grid", [None, 2, 4])
def test_equals_plain_iteration(spark, grid):
    rows = vectors(400, 3, grid=grid)
    rows += [(5000, None, 1), (5001, [None] + [0.5] * 15, 1), (5002, [math.nan] * 16, 2), (5003, [math.inf] + [0.0] * 15, None), (5004, [], 1)]
    rows += [rows[0], rows[0], (None, [0.25] * 16, 1), (None, [0.5] * 16, None)]
    compare(spark, rows, rounds=4)


def test_few_vectors(spark):
    compare(spark, [(2, [0.5] * 8, 1), (1, [-0.1] * 8, None), (3, [0.5] * 8, 1)])
    compare(spark, [(9, [1.5, -2.25] * 4, 1)], rounds=2)


def test_large_components_and_sums(spark):
    compare(spark, [(i, [30000.0 * (-1) ** i] * 4 + [i * 100.0] * 4, i % 2) for i in range(40)], entries=3, rounds=3)


def test_unused_entries_stay(spark):
    """Equal starting entries: the higher index of two is never nearest."""
    rows = [(i, [0.1 * (i // 2)] * 8, 1) for i in range(8)] + [(100 + i, [0.35] * 8, 2) for i in range(5)]
    compare(spark, rows, entries=8, rounds=3)


def test_defined_results(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vc.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [0.5] * 7, 1), (4, [1e30] * 8, 1), (5, [-0.5] * 8, 1)]
    got = vc.vector_codes(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.vec_id for r in got) == [1, 5]
    named = vc.vector_codes(spark.createDataFrame([("a", [0.5] * 8, "x"), ("b", [0.1] * 8, None)], "vec_id string, embedding array<double>, label string"))
    assert {r.vec_id: r.code for r in named.collect()} == {"a": "00" * 8, "b": "01" * 8}


def test_bounds_spare_most_scans(spark):
    """Of clustered parts few are measured against all entries once entries have settled."""
    df = spark.createDataFrame(vectors(3000, 8), "vec_id long, embedding array<float>, label int")
    codes = vc.compress(df, rounds=10)
    assert codes.rows.count() == 3000 and codes.measured[0] <= 3000 * 8
    assert codes.measured[-1] < 0.35 * 3000 * 8
    codes.drop()
