"""Bounded load of a dataset's files: verified before, counted while it is written, committed after.

One pass reads, normalises and writes the records; the counts by which a load is accepted are taken from that very pass
(``Observation``), so nothing is scanned again.  A load that breaks a limit leaves nothing behind.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources.records import Adapter, normalized
from tessera.sources.sinks import Committed


class LoadError(ValueError):
    """A file that isn't the one declared, or a load beyond its limits."""


@dataclass(frozen=True)
class Limits:
    bytes: int = 64 << 20
    records: int = 100_000
    record_chars: int = 30_000
    total_chars: int = 256 << 20


@dataclass(frozen=True)
class Load:
    """A committed load: its batch, and how many records were scanned, admitted and rejected by reason, with their characters."""

    batch: str
    scanned: int
    admitted: int
    chars: int
    rejected: dict[str, int] = field(default_factory=dict)


def verify(spark: SparkSession, path: str, *, sha256: str | None, limits: Limits) -> None:
    """The file's size, before it is opened, and its hash."""
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = java.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(java):
        raise LoadError(f"{path} is missing")
    if (size := files.getFileStatus(java).getLen()) > limits.bytes:
        raise LoadError(f"{path} has {size} bytes; the limit is {limits.bytes}")
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
        if found is None or found.h != sha256.lower():
            raise LoadError(f"{path} is not the declared file")


def reasons(adapter: Adapter) -> list[str]:
    """Every reason for which ``normalized`` rejects a record of the dataset."""
    labels = [adapter.record_id_label, *([adapter.alias[1]] if adapter.alias else []), "research text"]
    return ["research record must be an object", *(f"{label} is required" for label in labels), "research text exceeds max_text_chars"]


def accounting(records: DataFrame, known: list[str]) -> list[Column]:
    """Counts over records (text, reason) that one pass can take."""
    admitted = F.col("reason").isNull()
    return [F.count(F.lit(1)).alias("scanned"), F.count_if(admitted).alias("admitted"), F.coalesce(F.sum(F.when(admitted, F.length("text"))), F.lit(0)).alias("chars"), *[F.count_if(F.col("reason") == r).alias(f"r{i}") for i, r in enumerate(known)]]


def load(spark: SparkSession, path: str, target: str, adapter: Adapter, *, version: str, sha256: str | None = None, limits: Limits = Limits()) -> Load:
    """Loads a JSON-lines file of an adapter's dataset into the table ``records`` of ``Committed`` below ``target``.

    Blank lines don't count.  Rejected records are counted and left out.  Too large a file, another hash, too many records
    or characters are errors, after which no batch is there; the same file again is the same batch.
    """
    verify(spark, path, sha256=sha256, limits=limits)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("payload"))
    known = reasons(adapter)
    seen = Observation()
    rows = normalized(lines, adapter, version=version, most_chars=limits.record_chars)
    rows = rows.observe(seen, *accounting(rows, known))
    counted: dict[str, int] = {}

    def check() -> None:
        counted.update(seen.get)
        if counted["scanned"] > limits.records:
            raise LoadError(f"{path} has {counted['scanned']} records; the limit is {limits.records}")
        if counted["chars"] > limits.total_chars:
            raise LoadError(f"{path} has {counted['chars']} characters; the limit is {limits.total_chars}")

    batch = Committed(spark, target).write(check=check, records=rows.where("reason is null").drop("reason"))
    return Load(batch, counted["scanned"], counted["admitted"], counted["chars"], {r: n for i, r in enumerate(known) if (n := counted[f"r{i}"])})
