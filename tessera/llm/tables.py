"""Table access, lineage cuts and row ranking shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); only where none is set, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = java.get() if java.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that outlives lost executors.

    Spark removes the shuffle files of the write when it ends.  The table stays until ``drop_stored`` or, at the end of
    an application, ``drop_all``.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _path(spark: SparkSession, path: str):
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()), java


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that no later plan reads."""
    for df in tables:
        fs, path = _path(df.sparkSession, df._stored_at)
        fs.delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Removes every table that this application stored; results that still read them can't be read any more."""
    fs, path = _path(spark, _folder(spark))
    fs.delete(path, True)


def broadcast_if_small(df: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """A table of ``stored``, marked for broadcast if its files are small; else Spark joins it by a shuffle."""
    fs, path = _path(df.sparkSession, df._stored_at)
    return F.broadcast(df) if fs.getContentSummary(path).getLength() <= most_bytes else df


def with_rank(df: DataFrame, group: list[str], order: Column, spread: Column, buckets: int, name: str = "rank") -> DataFrame:
    """Ranks from 0 within ``group``, by (bucket of ``spread``, ``order``).

    No task holds a whole group: rows are ranked within ``buckets`` buckets of a group, and the small table of
    bucket sizes gives each bucket its first rank.
    """
    from pyspark.sql import Window as W

    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    firsts = sizes.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_first"))
    inner = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(order)) - 1
    ranked = keyed.withColumn("_inner", inner)
    return ranked.join(firsts, [*group, "_bucket"]).withColumn(name, F.col("_first") + F.col("_inner")).drop("_bucket", "_inner", "_first")
