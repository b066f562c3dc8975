"""Sinks: sources with their numbered chunks, materials of a case, reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.store import numbered_references


def numbered_chunks(sources: DataFrame, *, source: str, chunks: str, prefix: str, mark: str) -> DataFrame:
    """(source, chunk_index, content, reference) of sources that hold their chunks as an array of texts."""
    rows = sources.select(source, F.posexplode(chunks).alias("_pos", "content"))
    return numbered_references(rows, source=source, pos="_pos", prefix=prefix, mark=mark).select(source, (F.col("_pos") + 1).alias("chunk_index"), "content", "reference")


def _content_name(*tables: DataFrame) -> str:
    """A hash of what the tables hold: their columns, and the digests of all rows added up, so that order doesn't count and
    rows that repeat do."""
    parts = []
    for df in tables:
        row = F.sha2(F.encode(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), "UTF-8"), 256)
        lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
        parts.append(f"{df.schema.simpleString()}:{list(df.agg(F.count('*').alias('n'), *lanes).first())}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class Committed:
    """Batches of several tables below ``path``.  A batch is staged, moved to a folder named by a hash of its content, and then
    named by a manifest; readers see the tables of manifests only, so a batch is there in whole or not at all, and one that is
    written again is there once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._java(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _java(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        """Batches that are committed."""
        folder = self._java(f"{self.path}/commits")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if "." not in f.getPath().getName()) if self._fs.exists(folder) else []

    def write(self, *, check: Callable[[], None] | None = None, **tables: DataFrame) -> str:
        """The batch's name.  ``check`` is called once the tables are staged; if it raises, or a table can't be written, nothing
        is left."""
        stage = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{stage}/{name}")
            if check:
                check()
        except BaseException:
            self._fs.delete(self._java(stage), True)
            raise
        written = {name: self.spark.read.schema(df.schema).parquet(f"{stage}/{name}") for name, df in tables.items()}
        batch = _content_name(*written.values())
        manifest, target = self._java(f"{self.path}/commits/{batch}"), self._java(f"{self.path}/batches/{batch}")
        if self._fs.exists(manifest):
            self._fs.delete(self._java(stage), True)
            return batch
        self._fs.mkdirs(target.getParent())
        self._fs.mkdirs(manifest.getParent())
        if self._fs.exists(target):  # moved by a writer that never committed; it holds the same
            self._fs.delete(self._java(stage), True)
        elif not self._fs.rename(self._java(stage), target) and not self._fs.exists(target):
            raise OSError(f"{target} could not be written")
        draft = self._java(f"{self.path}/commits/.{batch}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({name: df.schema.jsonValue() for name, df in tables.items()}).encode()))
        out.close()
        if not self._fs.rename(draft, manifest) and not self._fs.exists(manifest):
            raise OSError(f"{manifest} could not be written")
        return batch

    def read(self, name: str, batches: Sequence[str] | None = None) -> DataFrame:
        """A table's rows of all committed batches, or of some."""
        chosen = self.names() if batches is None else list(batches)
        if not chosen:
            raise FileNotFoundError(f"{self.path} has no committed batch")
        first = f"{self.path}/commits/{chosen[0]}"
        held = json.loads("\n".join(r.value for r in self.spark.read.text(first).collect()))
        return self.spark.read.schema(StructType.fromJson(held[name])).parquet(*[f"{self.path}/batches/{b}/{name}" for b in chosen])


def write_sources(sources: DataFrame, path: str, *, source: str = "source_id", chunks: str = "chunks", prefix: str = "L", mark: str = "C") -> str:
    """Adds the sources' rows and their chunks, each with its reference, to the tables ``sources`` and ``chunks`` of
    ``Committed`` below ``path``; the name of the batch."""
    numbered = numbered_chunks(sources, source=source, chunks=chunks, prefix=prefix, mark=mark)
    return Committed(sources.sparkSession, path).write(sources=sources.drop(chunks), chunks=numbered)


def add_materials(materials: DataFrame, new: DataFrame, *, case: str, order: str) -> DataFrame:
    """New materials of cases with ``reference_index``: on from the largest that the case has."""
    have = materials.groupBy(case).agg(F.max("reference_index").alias("_have"))
    nth = F.row_number().over(W.partitionBy(case).orderBy(order))
    return new.join(have, case, "left").withColumn("reference_index", (F.coalesce("_have", F.lit(0)) + nth).cast("int")).drop("_have")


def touched(parents: DataFrame, changed: DataFrame, *, key: str, at: Column, column: str = "updated_at") -> DataFrame:
    """Parents with ``column`` set where a child changed."""
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    return parents.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), at).otherwise(F.col(column))).drop("_hit")


def capacity(materials: DataFrame, *, case: str, text: str, most: int, most_chars: int) -> DataFrame:
    """Per case: materials, characters, and whether both are within their limits."""
    out = materials.groupBy(case).agg(F.count("*").alias("materials"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    return out.withColumn("within", (F.col("materials") <= most) & (F.col("chars") <= most_chars))


def write_report(report: DataFrame, path: str, *, failed: Column | None = None) -> int:
    """Writes a report of few rows as one JSON file; 2 if it failed, else 0."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return 2 if failed is not None and not report.where(failed).isEmpty() else 0
