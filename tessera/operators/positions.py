"""Positions across partitions: rows are counted by partition and each partition starts where the ones before it end.

Nothing passes through one task: what is gathered is one count a partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

_ROW_BITS = 33  # of monotonically_increasing_id: the partition's number stands above, the row's below


def _starts(counts: list[tuple], spark, kind: str) -> DataFrame:
    """(key, first) from (key, rows) in order."""
    out, total = [], 0
    for key, n in counts:
        out.append((key, total))
        total += n
    return spark.createDataFrame(out, f"_key {kind}, _first long")


def positioned(df: DataFrame, *, order: Sequence[str | Column] = (), name: str = "position") -> tuple[DataFrame, int]:
    """The rows with their position from 0, and how many there are: in the order of ``order`` (a range shuffle), else as
    partitions and their rows follow each other.  The rows are stored once, so their order is settled."""
    rows = cut((df.orderBy(*order) if order else df).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS).cast("int")
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = _starts(counts, df.sparkSession, "int")
    placed = rows.join(F.broadcast(starts), part == F.col("_key"))  # a row a partition
    at = F.col("_first") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.withColumn(name, at).drop("_id", "_key", "_first"), sum(n for _, n in counts)


def file_positions(df: DataFrame, *, name: str = "position") -> DataFrame:
    """Rows of Parquet files with their position from 0, by file name and place in the file; nothing is moved or stored."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = sorted((r._file, r.n) for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect())
    starts = _starts(counts, df.sparkSession, "string")
    return rows.join(F.broadcast(starts), F.col("_file") == F.col("_key")).withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_row", "_key", "_first")


def zipped(*tables: DataFrame, orders: Sequence[Sequence[str]] | None = None, name: str = "position") -> DataFrame:
    """Rows of equal position side by side; tables of different lengths are an error."""
    placed = [positioned(df, order=order, name=name) for df, order in zip(tables, orders or [()] * len(tables), strict=True)]
    lengths = [n for _, n in placed]
    if len(set(lengths)) > 1:
        raise ValueError(f"tables of {lengths} rows can't be zipped")
    return reduce(lambda a, b: a.join(b, name), [df for df, _ in placed])


def concatenated(*tables: DataFrame, orders: Sequence[Sequence[str]] | None = None, name: str = "position") -> DataFrame:
    """The rows of the tables one after another, with ``source`` (the table's number) and their position in the whole."""
    out, total = [], 0
    for i, (df, order) in enumerate(zip(tables, orders or [()] * len(tables), strict=True)):
        placed, n = positioned(df, order=order, name=name)
        out.append(placed.withColumn("source", F.lit(i)).withColumn(name, F.col(name) + total))
        total += n
    return reduce(DataFrame.unionByName, out)
