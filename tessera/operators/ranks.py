"""Row numbers within groups of any size: the order is cut into pieces, and no task sorts more than a group's piece.

The cuts are quantiles of the first column of the order over all rows, so a group that holds a third of the rows is cut as
finely as the whole.  Rows of one value stay together, which keeps the order exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = 32


def _number(df: DataFrame, column: str):
    """A column of the order as a double: numbers, dates and times."""
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    return (F.unix_micros(value.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else value).cast("double")


def numbered(df: DataFrame, *, group: Sequence[str], order: Sequence[str], name: str = "seq", pieces: int = PIECES) -> DataFrame:
    """Adds the row's number from 1 within its group in ascending order; the first column of the order is a number or a time."""
    value = _number(df, order[0])
    cuts = sorted(set(df.select(value.alias("v")).approxQuantile("v", [i / pieces for i in range(1, pieces)], 0.01)))
    piece = F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)) if cuts else F.lit(0))
    cut = df.withColumn("_piece", piece)
    sizes = cut.groupBy(*group, "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], F.col("_piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("_start"))
    inner = cut.withColumn("_inner", F.row_number().over(W.partitionBy(*group, "_piece").orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"_{i}")) for i, g in enumerate(group)]
    on = F.col("_piece") == F.col("_p")
    for s in same:
        on = on & s
    return inner.join(starts, on).withColumn(name, (F.col("_start") + F.col("_inner")).cast("int")).drop("_piece", "_inner", "_start", "_p", *[f"_{i}" for i in range(len(group))])
