"""Runs as a stream source: resume, gap, heartbeat, restart, and runs that go on without readers."""

import time

import pytest

from tessera.operators import store
from tessera.streaming import run_source as rs

SCHEMA = "run_id string, ms long, n long, event string, data string"


def batch(spark, path, number, rows):
    rs.append_batch(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(path), number)


def reader(spark, journal, folder, **options):
    stream = rs.register(spark).readStream.format("run_events").options(path=str(journal), **options).load()
    return stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")


def drain(query):
    query.processAllAvailable()
    query.stop()


def got(spark, folder):
    return sorted(((r.run_id, r.id, r.event) for r in spark.read.schema("run_id string, id string, event string").parquet(f"{folder}/out").collect()), key=repr)


def test_resume_gap_and_restart(spark, tmp_path):
    journal = tmp_path / "journal"
    batch(spark, journal, 0, [("a", 5, i, "step", "{}") for i in range(4)] + [("b", 7, 0, "step", "{}")])
    drain(reader(spark, journal, tmp_path / "r", last_event_id="5-1").start())
    assert got(spark, tmp_path / "r") == [("a", "5-2", "step"), ("a", "5-3", "step"), ("b", "7-0", "step")]
    batch(spark, journal, 1, [("a", 6, 0, "late", "{}"), ("c", 1, 0, "old", "{}"), ("c", 9, 0, "new", "{}")])
    drain(reader(spark, journal, tmp_path / "r", last_event_id="5-1").start())  # goes on from its checkpoint
    assert got(spark, tmp_path / "r")[2:] == [("a", "6-0", "late"), ("b", "7-0", "step"), ("c", "9-0", "new")]
    drain(reader(spark, journal, tmp_path / "gap", last_event_id="5-0", retained="2", run="a").start())
    assert got(spark, tmp_path / "gap") == [("a", "5-3", "step"), ("a", "6-0", "late"), ("a", None, "gap")]


def test_equal_to_the_batch_form(spark, tmp_path):
    journal = tmp_path / "journal"
    rows = [(run, 10 + i // 3, i % 3, "step", str(i)) for run in ("x", "y", "z") for i in range({"x": 30, "y": 4, "z": 12}[run])]
    batch(spark, journal, 0, rows[::2])
    batch(spark, journal, 1, rows[1::2])
    drain(reader(spark, journal, tmp_path / "r", last_event_id="11-1", retained="6").start())
    expected = store.resumed(spark.createDataFrame(rows, SCHEMA), last_event_id="11-1", retained=6).where("event <> 'end'")
    assert got(spark, tmp_path / "r") == sorted(((r.run_id, r.id, r.event) for r in expected.collect()), key=repr)


def test_an_unfinished_batch_is_invisible(spark, tmp_path):
    journal = tmp_path / "journal"
    batch(spark, journal, 0, [("a", 1, 0, "seen", "{}")])
    batch(spark, journal, 1, [("a", 2, 0, "unfinished", "{}")])
    (journal / "ids" / "batch=1" / "_SUCCESS").unlink()
    drain(reader(spark, journal, tmp_path / "r").start())
    assert got(spark, tmp_path / "r") == [("a", "1-0", "seen")]


def test_heartbeat(spark, tmp_path):
    journal = tmp_path / "journal"
    batch(spark, journal, 0, [("a", 1, 0, "seen", "{}")])
    query = reader(spark, journal, tmp_path / "r", heartbeat="0.5").start()
    until = time.monotonic() + 60
    while time.monotonic() < until and not any(e == "heartbeat" for *_, e in got(spark, tmp_path / "r") if (tmp_path / "r" / "out" / "_spark_metadata").exists()):
        time.sleep(0.3)
    query.stop()
    assert {e for *_, e in got(spark, tmp_path / "r")} == {"seen", "heartbeat"}


def test_a_run_goes_on_without_readers(spark, tmp_path):
    source, journal = tmp_path / "in", tmp_path / "journal"
    spark.createDataFrame([("a", 1, 0, "first", "{}")], SCHEMA).coalesce(1).write.parquet(f"{source}/0")
    run = lambda: rs.write_runs(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(source)), str(journal), f"{tmp_path}/run").awaitTermination()
    run()
    drain(reader(spark, journal, tmp_path / "r").start())
    spark.createDataFrame([("a", 2, 0, "second", "{}")], SCHEMA).coalesce(1).write.parquet(f"{source}/1")
    run()  # nobody reads
    drain(reader(spark, journal, tmp_path / "r").start())
    assert got(spark, tmp_path / "r") == [("a", "1-0", "first"), ("a", "2-0", "second")]


def test_ids_are_checked():
    with pytest.raises(ValueError):
        rs.RunReader({"path": "x", "last_event_id": "5"})
