"""Readings of a mixture: how often, in which blocks and at which places."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix_sources, readings


def documents(spark):
    rows = [(i, "w " * (i % 9 + 1), "big" if i % 10 else "small") for i in range(600)] + [(1000, None, None), (1001, "", "small"), (None, "a b c", "small"), (5, "w w", "big"), (5, "w w", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("row", "name", "span", "block", "place", "epoch")})


@pytest.mark.parametrize("factor", [1.0, 3.4])
def test_readings_are_the_copies_in_order_of_their_turns(spark, factor):
    docs = documents(spark)
    mixed = mix_sources(docs, carry=True, budget_factor=factor, most_repeats=50.0).collect()
    got = readings(docs, budget_factor=factor, most_repeats=50.0).collect()
    copies, blocks, spans = collections.Counter(), {}, {}
    for r in mixed:
        copies[r.name] += r.copies
        blocks[r.name], spans[r.name] = r.blocks, r.span
    assert len(got) == sum(copies.values())
    seen = collections.Counter()
    for r in got:
        text = r.row.text or ""
        name = str(r.row.doc_id) if r.row.doc_id is not None else "null:" + hashlib.md5(text.encode()).hexdigest()
        turn = hashlib.md5(f"1:{r.epoch}:{name}".encode()).hexdigest()
        assert r.block == int(turn[:8], 16) % blocks[name]
        assert r.place == pytest.approx((r.epoch + (r.block + int(turn[8:16], 16) / 2**32) / blocks[name]) / max(spans[name], 1e-9))
        seen[name] += 1
    assert seen == +copies


def test_sources_are_mixed_at_every_point_and_copies_lie_apart(spark):
    got = sorted(readings(documents(spark), budget_factor=3.0, most_repeats=50.0).collect(), key=lambda r: r.place)
    weight = collections.Counter()
    for r in got:
        weight[r.row.source] += len((r.row.text or "").split())
    total = sum(weight.values())
    half = collections.Counter()
    for r in got[: len(got) // 2]:
        half[r.row.source] += len((r.row.text or "").split())
    for source in ("big", "small"):
        assert half[source] / sum(half.values()) == pytest.approx(weight[source] / total, abs=0.08)
    places = collections.defaultdict(list)
    for i, r in enumerate(got):
        if r.row.doc_id not in (None, 5):
            places[r.row.doc_id].append(i)
    gaps = [b - a for p in places.values() for a, b in zip(p, p[1:])]
    assert gaps and sum(g > 10 for g in gaps) > 0.9 * len(gaps)
