"""Runs as a stream source whose offsets are event ids.

A run writes its events (run_id, ms, n, event, data) to a journal in batches (``write_runs``), and goes on whether or not
anyone reads.  A reader is a streaming query of its own: ``format("run_events")`` with the
journal's ``path``, maybe one ``run``, the ``last_event_id`` (digits-digits) that it has seen, how many events of a run are
``retained``, and ``heartbeat`` seconds.  Its checkpoint holds the last id of each run, so it goes on where it stopped.

Where events after a reader's id are no longer retained it gets a ``gap`` first.  A reader that hears nothing for ``heartbeat``
seconds gets one row of that name.  A batch counts once its writer has written what ids it holds; that small table is what the
driver reads.  A reader's share of a micro-batch, the events of a few runs since its last one, is held by one task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

Id = tuple[int, int]
NEVER: Id = (-1, -1)


def event_id(text: str) -> Id:
    if not re.fullmatch(r"\d{1,20}-\d{1,20}", text):
        raise ValueError("an event id is digits-digits")
    ms, _, n = text.partition("-")
    return int(ms), int(n)


def _text(i: Id) -> str:
    return f"{i[0]}-{i[1]}" if i >= (0, 0) else ""


def _id(text: str) -> Id:
    return event_id(text) if text else NEVER


@dataclass
class RunRange(InputPartition):
    """Events of some runs, each after one id and up to another, and the batches that may hold them."""

    runs: dict[str, tuple[Id, Id]]
    batches: list[str]
    heartbeat: bool = False


def append_batch(events: DataFrame, path: str, number: int) -> None:
    """Writes events (run_id, ms, n, event, data) as a batch of the journal, and then which ids of which runs it holds, by which
    it is complete; under the same number it replaces itself."""
    events.select(F.col("run_id").cast("string").alias("run_id"), "ms", "n", "event", "data").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    held = events.sparkSession.read.parquet(f"{path}/events/batch={number}").groupBy("run_id").agg(F.min(F.struct("ms", "n")).alias("lo"), F.max(F.struct("ms", "n")).alias("hi"))
    held.select("run_id", "lo.ms", "lo.n", F.col("hi.ms").alias("hi_ms"), F.col("hi.n").alias("hi_n")).write.mode("overwrite").parquet(f"{path}/ids/batch={number}")


def write_runs(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of events as batches of a journal; takes all there is and ends."""
    return events.writeStream.foreachBatch(lambda batch, number: append_batch(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Journal:
    """The runs and ids of a journal's complete batches, each read once: a row a run and batch."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.ids: dict[str, dict[str, tuple[Id, Id]]] = {}  # by batch: each run's smallest and largest id

    def listed(self, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.path for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", recursive=True, allow_not_found=True)))

    def rows(self, path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        with self.files.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(columns=columns)

    def refresh(self) -> None:
        found = self.listed("ids")
        for done in (f.rpartition("/")[0] for f in found if f.endswith("/_SUCCESS")):
            name = done.rpartition("/")[2]
            if name not in self.ids:
                parts = [b for f in found if f.startswith(done + "/") and f.endswith(".parquet") for b in self.rows(f, ["run_id", "ms", "n", "hi_ms", "hi_n"])]
                self.ids[name] = {run: ((ms, n), (hi_ms, hi_n)) for b in parts for run, ms, n, hi_ms, hi_n in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    def latest(self) -> dict[str, Id]:
        out: dict[str, Id] = {}
        for runs in self.ids.values():
            for run, (_, hi) in runs.items():
                out[run] = max(hi, out.get(run, NEVER))
        return out


class RunReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], options.get("run")
        self.first = options.get("last_event_id", "")
        _id(self.first)
        self.retained, self.heartbeat, self.parallel = int(options.get("retained", 512)), float(options.get("heartbeat", 0)), int(options.get("partitions", 8))
        self.journal: Journal | None = None
        self.seen: tuple[dict, float, int] = ({}, time.monotonic(), 0)  # last ids, since when, beats

    def initialOffset(self) -> dict:
        return {"ids": {}, "beat": 0}

    def latestOffset(self) -> dict:
        self.journal = self.journal or Journal(self.path)
        self.journal.refresh()
        ids = {run: _text(i) for run, i in sorted(self.journal.latest().items()) if self.run in (None, run)}
        known, since, beat = self.seen
        now = time.monotonic()
        if ids != known:
            self.seen = (ids, now, beat)
        elif self.heartbeat and now - since >= self.heartbeat:
            self.seen = (ids, now, beat + 1)
        return {"ids": ids, "beat": self.seen[2]}

    def partitions(self, start: dict, end: dict) -> list[RunRange]:
        self.journal = self.journal or Journal(self.path)
        self.journal.refresh()
        wanted = {run: (_id(start["ids"].get(run, self.first)), _id(i)) for run, i in end["ids"].items()}
        wanted = {run: r for run, r in wanted.items() if r[0] < r[1]}
        out = []
        for part in range(self.parallel):
            runs = dict(list(wanted.items())[part :: self.parallel])
            if runs:
                batches = [b for b, held in self.journal.ids.items() if any(run in held and held[run][1] > after and held[run][0] <= until for run, (after, until) in runs.items())]
                out.append(RunRange(runs, batches))
        if not out and end.get("beat", 0) > start.get("beat", 0):
            return [RunRange({}, [], True)]
        return out

    def read(self, partition: RunRange) -> Iterator[tuple]:
        if partition.heartbeat:
            yield None, None, "heartbeat", "{}"
            return
        journal, events = Journal(self.path), {run: [] for run in partition.runs}
        wanted = pa.array(list(partition.runs), pa.string())
        for path in (f for b in partition.batches for f in journal.listed(f"events/{b}") if f.endswith(".parquet")):
            for batch in journal.rows(path, ["run_id", "ms", "n", "event", "data"]):
                rows = batch.filter(pc.is_in(batch.column(0), value_set=wanted))
                for run, ms, n, event, data in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    after, until = partition.runs[run]
                    if after < (ms, n) <= until:
                        events[run].append(((ms, n), event, data))
        for run, found in sorted(events.items()):
            found.sort()
            if len(found) > self.retained and partition.runs[run][0] != NEVER:
                yield run, None, "gap", "{}"
            for i, event, data in found[-self.retained :]:
                yield run, _text(i), event, data

    def commit(self, end: dict) -> None:
        pass


class RunEvents(DataSource):
    """(run_id, id, event, data) of runs; see the module."""

    @classmethod
    def name(cls) -> str:
        return "run_events"

    def schema(self) -> str:
        return "run_id string, id string, event string, data string"

    def streamReader(self, schema) -> RunReader:
        return RunReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RunEvents)
    return spark
