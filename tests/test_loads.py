"""Bounded loads: accounting equals a second scan, and a load beyond a limit leaves nothing."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import loads, readers, records, sinks

ADAPTER = records.ADAPTERS["cail2022-lcr"]


@pytest.fixture()
def file(tmp_path):
    rows = [{"path": f"p{i}", "ridx": i, "q": "text " * (i % 5 + 1)} for i in range(200)]
    rows += [{"path": 3, "ridx": 1, "q": "x"}, {"path": "p", "q": "x"}, {"path": "p", "ridx": 1, "q": " "}, {"path": "p", "ridx": 1, "q": "y" * 60}]
    lines = [json.dumps(r) for r in rows] + ["{bad", "[1]", "", "   "]
    path = tmp_path / "data.jsonl"
    path.write_text("\n".join(lines))
    return path


def load(spark, file, target, **how):
    limits = loads.Limits(**({"record_chars": 50} | how.pop("limits", {})))
    return loads.load(spark, str(file), str(target), ADAPTER, version="1", limits=limits, **how)


def test_accounting_equals_a_second_scan(spark, file, tmp_path):
    got = load(spark, file, tmp_path / "t", sha256=hashlib.sha256(file.read_bytes()).hexdigest())
    lines = spark.read.text(str(file)).where(F.trim("value") != "").select(F.try_parse_json("value").alias("payload"))
    again = records.normalized(lines, ADAPTER, version="1", most_chars=50)
    counts = {r.reason: r["count"] for r in again.groupBy("reason").count().collect()}
    assert got.admitted == counts.pop(None) == 200 and got.rejected == counts and got.scanned == 206
    stored = sinks.Committed(spark, str(tmp_path / "t"))
    assert stored.names() == [got.batch] and stored.read("records").count() == 200
    assert got.chars == stored.read("records").agg(F.sum(F.length("text"))).first()[0]
    assert load(spark, file, tmp_path / "t").batch == got.batch and len(stored.names()) == 1


@pytest.mark.parametrize("how", [{"limits": {"records": 205}}, {"limits": {"total_chars": 100}}, {"limits": {"bytes": 1000}}, {"sha256": "0" * 64}])
def test_beyond_a_limit_nothing_is_left(spark, file, tmp_path, how):
    with pytest.raises(loads.LoadError):
        load(spark, file, tmp_path / "t", **how)
    target = tmp_path / "t"
    assert sinks.Committed(spark, str(target)).names() == []
    assert not target.exists() or [p for p in target.rglob("*.parquet")] == []


def test_judgments_of_any_shape(spark, tmp_path):
    shapes = {
        "array": json.dumps([{"query_id": 1, "match_id": [7, 8]}, {"query_id": 2, "match_id": []}]),
        "lines": "\n".join(json.dumps(r) for r in ({"query_id": 1, "match_id": [7, 8]}, {"query_id": 2, "match_id": []})),
        "nested": json.dumps({"1": {"7": 1, "8": "1"}}),
        "trec": "\n1 0 7 1\n1 0 8 1\n",
    }
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
        assert sorted(tuple(r) for r in readers.read_qrels(spark, str(tmp_path / name)).collect()) == [("1", "7", 1, None), ("1", "8", 1, None)], name
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError):
        readers.read_qrels(spark, str(tmp_path / "none"))


def test_a_missing_file(spark, tmp_path):
    with pytest.raises(loads.LoadError):
        load(spark, tmp_path / "none", tmp_path / "t")
