"""Positions, zips, early stops, records of several keys."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import curation, positions
from tessera.sources import records
from tests.scans import scanned_rows


def test_positions_follow_partitions_and_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7)
    placed, n = positions.positioned(df)
    assert n == 1000 and sorted(r.position for r in placed.collect()) == list(range(1000))
    ordered, _ = positions.positioned(df, order=["v"])
    assert all(r.v == r.position for r in ordered.collect())
    assert positions.positioned(df.limit(0))[0].count() == 0


def test_file_positions(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
    df = spark.read.parquet(*[f"{tmp_path}/part{i}" for i in (2, 0, 1)])
    assert all(r.id == r.position for r in positions.file_positions(df).collect())


def test_zip_is_strict(spark):
    a, b = spark.range(50).repartition(3), spark.range(100, 150).withColumnRenamed("id", "other").repartition(4)
    got = positions.zipped(a, b, orders=[["id"], ["other"]]).collect()
    assert sorted((r.id, r.other) for r in got) == [(i, i + 100) for i in range(50)]
    with pytest.raises(ValueError):
        positions.zipped(a, b.where("other < 149"))


def test_concatenation(spark):
    got = positions.concatenated(spark.range(5), spark.range(3), orders=[[F.desc("id")], ["id"]]).orderBy("position").collect()
    assert [(r.source, r.id) for r in got] == [(0, 4), (0, 3), (0, 2), (0, 1), (0, 0), (1, 0), (1, 1), (1, 2)]


def test_a_scan_that_stops_reads_no_further_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).select(F.col("id").alias("ord"), F.repeat(F.lit("x"), 50).alias("payload")).repartitionByRange(20, "ord").write.parquet(path)
    some = records.up_to(spark.read.parquet(path), order="ord", most=150)
    assert some.count() == 150
    assert scanned_rows(spark, some) <= 2_000
    assert records.up_to(spark.read.parquet(path).limit(0), order="ord", most=5).count() == 0


def test_any_key_of_an_earlier_record_counts(spark):
    rows = [(1, ["a", "b"], "x"), (2, ["c", "b"], "y"), (3, ["c"], "z"), (4, ["d", None], "x"), (5, None, "q"), (6, [], "q"), (7, ["d", "d"], "r")]
    df = spark.createDataFrame(rows, "i long, keys array<string>, h string")
    got = {r.i: r.duplicate_by for r in curation.first_occurrence(df, {"source": F.col("keys"), "hash": F.col("h")}, F.col("i")).collect()}
    assert got == {1: None, 2: "source", 3: "source", 4: "hash", 5: None, 6: "hash", 7: "source"}
