"""The ledger as keyed state: whatever the micro-batches are, outcomes are those of the fold over all requests."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.streaming import ledger_stream as ls

SCHEMA = "scope string, seq long, op string, key string, tokens long, input_tokens long, output_tokens long"


def requests(n=240, seed=4):
    rnd = random.Random(seed)
    ops = ["reserve", "reserve", "settle", "release"]
    return [(rnd.choice("abc"), i, rnd.choice(ops), rnd.choice(["k1", "k2", "k3", " ", None]), rnd.choice([0, 100, 100, 250]), rnd.choice([-1, 40, 40, 200]), rnd.choice([0, 40])) for i in range(n)]


def run(spark, rows, folder, cuts, *, limit=450, initial=None, name="ledger"):
    """Rows as a file for each micro-batch; the outcomes of all."""
    source = f"{folder}/in"
    lo = 0
    for i, hi in enumerate([*cuts, len(rows)]):
        if rows[lo:hi]:
            spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.parquet(f"{source}/{name}-{i:03d}")
        lo = hi
    stream = ls.rocksdb(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = ls.ledger_stream(stream, limit=limit, initial=initial).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.scope, r.seq, r.outcome) for r in spark.read.parquet(f"{folder}/out").collect())


def folded(spark, rows, limit=450):
    return sorted((r.scope, r.seq, r.outcome) for r in store.ledger(spark.createDataFrame(rows, SCHEMA), limit=limit).collect())


@pytest.mark.parametrize("cuts", [[], [60, 61, 200]])
def test_outcomes_do_not_depend_on_the_cuts(spark, tmp_path, cuts):
    rows = requests()
    got = run(spark, rows, tmp_path, cuts)
    assert got == folded(spark, rows)
    assert {o for *_, o in got} >= {"reserved", "settled", "released", "over_limit", "conflict", "unchanged", "unknown", "invalid"}


def test_restart_keeps_the_book_and_the_limit(spark, tmp_path):
    rows = requests(120)
    run(spark, rows[:70], tmp_path, [30], name="first")
    assert run(spark, rows[70:], tmp_path, [], name="second") == folded(spark, rows)
    with pytest.raises(Exception, match="was opened with a limit of 450"):
        run(spark, [("a", 999, "reserve", "k9", 1, 0, 0)], tmp_path, [], limit=700, name="third")
    assert run(spark, [("a", 999, "reserve", "k9", 10**6, 0, 0)], tmp_path, [], name="fourth")[-1:] != []


def test_initial_state_goes_on_from_an_earlier_ledger(spark, tmp_path):
    rows = requests(160, seed=9)
    early, late = rows[:90], rows[90:]
    before = spark.createDataFrame(early, SCHEMA)
    initial = ls.entries(before, store.ledger(before, limit=450), limit=450)
    got = run(spark, late, tmp_path, [20], initial=initial)
    assert got == [r for r in folded(spark, rows) if r[1] >= 90]


def test_limits_are_positive(spark):
    with pytest.raises(ValueError):
        ls.ledger_stream(spark.createDataFrame([], SCHEMA), limit=0)
