"""The metric range join: exact whatever the cells, cells that prune where vectors fall into clusters, and general ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_links

from tessera.llm import embedding_dedup as ed

RADIUS = math.sqrt(2 - 2 * 0.93)


def clustered(seed, clusters=60, size=20, dim=24, noise=0.05):
    rnd = np.random.RandomState(seed)
    centres = rnd.randn(clusters, dim)
    x = np.repeat(centres, size, axis=0) + noise * np.linalg.norm(centres, axis=1).mean() / math.sqrt(dim) * rnd.randn(clusters * size, dim)
    return x.astype(np.float32)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(4))
def test_every_link_meets_in_the_cell_of_either(seed):
    rnd = np.random.RandomState(seed)
    x = unit(np.concatenate([clustered(seed, 12, 15, 6, 0.3), rnd.randn(100, 6)]).astype(float))
    linked = x @ x.T >= 0.93
    for count in (0, 1, 2, 7, 30):
        for cell_radius in (RADIUS, 1.5 * RADIUS, 2 * RADIUS, 2.0):
            home, present = ed.place(x, x[rnd.choice(len(x), count, replace=False)], cell_radius, RADIUS)
            assert present[np.arange(len(x)), home].all()
            for i, j in zip(*np.nonzero(linked)):
                assert present[j, home[i]]


def test_cells_prune_clusters_and_grow_with_them():
    counts = []
    for clusters in (20, 80):
        x = unit(clustered(1, clusters, 40).astype(float))
        sample = x[np.random.RandomState(0).permutation(len(x))[:512]]
        pivots, cell_radius = ed.choose(sample, len(x), RADIUS)
        home, present = ed.place(x, pivots, cell_radius, RADIUS)
        pairs = (np.bincount(home, minlength=len(pivots) + 1) * present.sum(axis=0)).sum()
        assert pairs < 0.15 * len(x) ** 2 and present.sum() < 2.5 * len(x)
        counts.append(len(pivots))
    assert counts[1] > 2 * counts[0]


def test_far_vectors_stay_one_cell():
    x = unit(np.random.RandomState(3).randn(400, 64))
    pivots, _ = ed.choose(x, 400, RADIUS)
    assert len(pivots) == 0


@pytest.mark.parametrize("block", [30, 16_000])
def test_clustered_query_against_brute_force(spark, block):
    x = clustered(2, 20, 15, 8, 0.25)
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)] + [(1000 + i, [float(v) for v in x[7]], 1) for i in range(30)]
    rows += [(7, rows[9][1], 1), (2000, [-0.0] + rows[3][1][1:], 0), (2001, [0.0] + rows[3][1][1:], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ed.embedding_dedup(df, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)


def test_text_ids_and_double_vectors(spark):
    x = clustered(5, 6, 8, 8, 0.2).astype(float)
    rows = [(f"v{i:03}", [float(v) for v in e], 0) for i, e in enumerate(x)] + [(None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int").withColumn("links", F.lit(1)).withColumn("component", F.lit("x"))
    got = ed.embedding_dedup(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == brute_links(rows[:-1])
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_a_dense_group_holds_no_links(spark):
    """Thousands of near-equal vectors in one block: every pair links, a spanning forest comes back."""
    import resource
    import time

    import pyarrow as pa

    from tessera.llm.embedding_dedup import _join_blocks

    n = 4000
    rnd = np.random.RandomState(1)
    x = rnd.normal(size=16) + rnd.normal(size=(n, 16)) * 0.02
    flat, ids = np.concatenate([x, x]).ravel(), np.tile(np.arange(n), 2)
    t = pa.table({"member": pa.array(np.arange(2 * n) < n), "cid": pa.array(ids), "n": pa.array(np.ones(2 * n, np.int64)), "v": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 16).astype(np.int32)), pa.array(flat))})
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = _join_blocks(t, 0.93)
    assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert out.num_rows == 2 * n - 1 and set(out.column("n_links").to_numpy()[:n]) == {n - 1}
