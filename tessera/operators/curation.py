"""Dataset curation: deduplication accounting, stratified sampling, packing, ledgers and plan identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_occurrence(df: DataFrame, keys: dict[str, Column], order: Column) -> DataFrame:
    """Adds ``duplicate_by``: the first of ``keys`` (in their order of priority) that an earlier row shares, else null.

    A key may be an array, of which any item that an earlier row has counts; ``order`` must be unique then.  A key's earliest
    row is an aggregate that combines before its shuffle; the join back of a key of very many rows is split by adaptive
    execution.
    """
    out = df.withColumn("_ord", order)
    tests = []
    for name, key in keys.items():
        out = out.withColumn(f"_{name}", key)
        if isinstance(out.schema[f"_{name}"].dataType, T.ArrayType):
            each = out.select("_ord", F.explode(F.array_distinct(f"_{name}")).alias("_item")).where("_item is not null")
            least = each.groupBy("_item").agg(F.min("_ord").alias("_least"))
            mine = each.join(least, "_item").groupBy("_ord").agg(F.min("_least").alias(f"_first_{name}"))
            out = out.join(mine, "_ord", "left")
        else:
            least = out.where(F.col(f"_{name}").isNotNull()).groupBy(f"_{name}").agg(F.min("_ord").alias(f"_first_{name}"))
            out = out.join(least, f"_{name}", "left")
        tests.append(F.when(F.col(f"_first_{name}") < F.col("_ord"), F.lit(name)))
    return out.withColumn("duplicate_by", F.coalesce(*tests)).drop("_ord", *[f"_{n}" for n in keys], *[f"_first_{n}" for n in keys])


def cross_source_groups(df: DataFrame, *, key: str, source: str, member: str, order: str, k: int, least_sources: int = 2) -> DataFrame:
    """Keys that several sources share, with their number of members and sources and the first member; the first k keys.

    (Only counts and the first member are kept, so a key that most rows share stays small.)
    """
    per_source = df.groupBy(key, source).agg(F.count("*").alias("n"), F.min_by(member, order).alias("m"), F.min(order).alias("o"))
    groups = per_source.groupBy(key).agg(F.sum("n").alias("members"), F.count("*").alias("sources"), F.min_by("m", "o").alias("first_member"))
    return groups.where(F.col("sources") >= least_sources).orderBy(key).limit(k)


def shared_identities(df: DataFrame, *, key: str, source: str, member: Column, order: str, k: int, content: str | None = None) -> DataFrame:
    """The first k keys that several sources have (and, with ``content``, with several contents), and their members in order.

    Which keys these are comes from counts; only their rows are gathered, for a report of k lines.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    many = [F.min(c) < F.max(c) for c in (source, *([content] if content else []))]  # two at least
    keys = rows.groupBy(key).agg(*[m.alias(f"_m{i}") for i, m in enumerate(many)])
    first = keys.where(" and ".join(f"_m{i}" for i in range(len(many)))).orderBy(key).limit(k).select(key)
    found = rows.withColumn("_member", member).join(F.broadcast(first), key)
    return found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "_member"))), lambda x: x["_member"]).alias("members"))


def sampling_rank(seed: int, stratum: Column, identity: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), stratum, identity), 256)


def stratified_round_robin(df: DataFrame, *, stratum: str, identity: str, seed: int, k: int) -> DataFrame:
    """The first k rows in rounds over the strata, each stratum in order of its sampling rank; adds position and ordinal (from 1).

    Only k rows of a stratum can be among the first k, and Spark limits each stratum to k before its window's shuffle.
    """
    ranked = df.withColumn("sampling_rank", sampling_rank(seed, F.col(stratum), F.col(identity)))
    placed = ranked.withColumn("position", F.row_number().over(W.partitionBy(stratum).orderBy("sampling_rank", identity))).where(F.col("position") <= k)
    return placed.orderBy("position", stratum).limit(k).withColumn("ordinal", F.row_number().over(W.orderBy("position", stratum)))


def split_sizes(available: Column, *, discovery: int, evaluation: int, most: int) -> tuple[Column, Column]:
    """How many of a sample go to either part: all that is asked for, else in proportion, halves to even."""
    chosen = F.least(available, F.lit(discovery + evaluation), F.lit(most)).cast("int")
    share = F.bround(chosen * F.lit(discovery / max(discovery + evaluation, 1))).cast("int")
    first = F.least(chosen, F.lit(discovery), F.greatest(share, F.lit(1)))
    return first, F.least(F.lit(evaluation), chosen - first)


def split_counts(available: int, discovery: int, evaluation: int, most: int) -> tuple[int, int]:
    """``split_sizes`` of a number that the driver knows."""
    chosen = min(available, discovery + evaluation, most)
    first = min(chosen, discovery, max(1, round(chosen * discovery / max(discovery + evaluation, 1))))
    return first, min(evaluation, chosen - first)


def _in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """All rows in one partition, in order; its tasks stream it."""
    return df.repartition(1).sortWithinPartitions(*order)


def greedy_pack(sample: DataFrame, *, ordinal: str, tokens: str, budget: int) -> DataFrame:
    """Adds ``batch`` (from 0): rows in order, a new batch where the budget would be passed.

    Each batch starts its sum anew, so it isn't a prefix sum: the rows (of a bounded sample) are streamed in order.
    """
    import pyarrow as pa

    def number(batches):
        batch, used = -1, 0
        for rows in batches:
            out = []
            for n in rows.column(tokens).to_pylist():
                if batch < 0 or used + n > budget:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield rows.append_column("batch", pa.array(out, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sample.schema.fields)
    return _in_order(sample, [ordinal]).mapInArrow(number, f"{schema}, batch int")


def identity_of(df: DataFrame, parts: Sequence[str], order: Sequence[str], group: Sequence[str] = (), *, head: str = "", between: str = "\n", tail: str = "", separator: str = "|") -> DataFrame:
    """SHA-256 of the rows' parts, joined in order between ``head`` and ``tail``; of a plan, or of each of its groups."""
    import hashlib

    import pyarrow as pa

    line = F.concat_ws(separator, *[F.col(p).cast("string") for p in parts])
    rows = df.select(*group, *[c for c in order if c not in group], line.alias("_line"))
    rows = rows.repartition(*group).sortWithinPartitions(*group, *order) if group else _in_order(rows, order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def digest(batches):
        now, sums, types = None, None, {}
        for batch in batches:
            types = {g: batch.schema.field(g).type for g in group}
            keys = list(zip(*[batch.column(g).to_pylist() for g in group])) if group else [()] * batch.num_rows
            done = []
            for key, text in zip(keys, batch.column("_line").to_pylist()):
                if sums is not None and key == now:
                    sums.update(between.encode())
                else:
                    done += [(now, sums)] if sums is not None else []
                    now, sums = key, hashlib.sha256(head.encode())
                sums.update(text.encode())
            yield from _digests(done, types)
        yield from _digests([(now, sums)] if sums is not None else [], types)

    def _digests(done, types):
        for _, s in done:
            s.update(tail.encode())
        cols = {g: pa.array([k[i] for k, _ in done], types[g]) for i, g in enumerate(group)} | {"identity": pa.array([s.hexdigest() for _, s in done], pa.string())}
        if done:
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(digest, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "identity string"]))


def ledger_snapshot(df: DataFrame, *, scope: str, status: str, tokens: Column, limit: int) -> DataFrame:
    """Consumed (settled), reserved and remaining tokens of each scope; released reservations count nowhere."""
    total = lambda s: F.coalesce(F.sum(F.when(F.col(status) == s, tokens)), F.lit(0)).cast("long")
    return df.groupBy(scope).agg(total("settled").alias("consumed"), total("reserved").alias("reserved")).withColumn("remaining", F.lit(limit).cast("long") - F.col("consumed") - F.col("reserved"))
