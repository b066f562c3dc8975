"""Exact Jaccard self-join of documents on word shingles: a grouped prefix join.

Documents with equal shingle sets (equal size and two 64-bit sums of hashes) are one class and are compared once.  For a
threshold t, two sets of at least t of each other's size share one of their first ``n - ceil(t n) + 1`` shingles in any
order that all sets agree on.

1. In the order of hashes, the prefix lengthened by l shingles must share min(l, l') of them with some other
   class.  Most classes fail this at once; only the rest go on.  (An eighth of a set serves as l.)
2. For the rest, shingles are ordered from rare to frequent.  Shingles of one class alone lead nowhere but use up
   the prefix; sets whose prefix they fill are done.
3. Classes with the same prefix and size are collapsed into one group.  Groups are paired with the most central group of
   each prefix shingle's list, under the size and position filters; pairs of groups are then expanded, the centre
   of one against the members of the other, and verified.  So are the members of each group against their centre.
4. Verified links are contracted to components, and groups are split by them: members with the same prefix, size and
   component are one group.  All pairs of groups of different components that share a prefix shingle and pass the
   filters are then expanded to all their members and verified too, so no link is lost.

Frequent shingles are counted by aggregates that spill and, in step 1, resolved within each batch first.  No pair is
made within one class of copies or within what is already one component.

Defined results: null or empty text has 0 shingles and links with nothing; fewer than k words are one shingle,
the whole sequence; a null id gives a null component; rows that repeat an id get the component of their own text.
Ids keep their type; the smallest is meant in its order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.graph import connected_components
from tessera.llm.hashing import chunks, list_column, mix, signed
from tessera.llm.tables import broadcast_if_small, drop_stored, stored

_U = np.uint64
SPARE = 8  # one in so many shingles lengthens the first prefix


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingles in ascending order of hash."""
    for c in chunks(batch.column("text"), lower=True):
        shingle, whole = c.windows(k)
        words = np.diff(c.first)
        for size in range(1, k):
            if (short := np.flatnonzero(words == size)).size:
                first = c.first[short]
                shingle[first] = c.windows(size)[0][first]
                whole[first] = True
        for lo, hi in zip(c.first[:-1], c.first[1:], strict=True):
            yield np.unique(shingle[lo:hi][whole[lo:hi]])


def _sums(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return s.sum(dtype=_U), mix(s).sum(dtype=_U)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, heads = [], [], [], []
        for s in _sets(batch, k):
            m = len(s)
            n.append(m)
            a, b = _sums(s)
            one.append(a)
            two.append(b)
            heads.append(s[: m - -(-percent * m // 100) + -(-m // SPARE)])
        at = np.cumsum([0, *map(len, heads)])
        values = np.concatenate([*heads, np.zeros(0, _U)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(signed(np.array(one, _U))), pa.array(signed(np.array(two, _U))), list_column(signed(values), at)], ["id", "mark", "n", "sig", "sig2", "head"])


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted arrays."""
    n = len(keys[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _count(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(sig, return_counts=True)
    return at, n.astype(np.int64)


def _meet_here(token: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, class) pairs, and which tokens several classes have."""
    order = np.lexsort((sig, token))
    token, sig = token[order], sig[order]
    new = _new(token, sig)
    token, sig = token[new], sig[new]
    run = np.flatnonzero(_new(token))
    size = np.diff(np.append(run, len(token)))
    return token, sig, np.repeat(size > 1, size)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, token, met): a class's tokens, of those that several classes of the batch have the first; and as met rows how
    many tokens of a class some other class of the batch has."""
    names = ["sig", "token", "met"]
    for batch in batches:
        n = np.asarray(pc.list_value_length(batch.column("head")), np.int64)
        token, sig, both = _meet_here(batch.column("head").flatten().to_numpy(), np.repeat(batch.column("sig").to_numpy(), n))
        go = ~both | _new(token)
        order = np.lexsort((token[go], sig[go]))  # rows of a class together compress best
        yield pa.RecordBatch.from_arrays([pa.array(sig[go][order]), pa.array(token[go][order]), pa.array(np.zeros(len(order), bool))], names)
        at, n = _count(sig[both])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(np.ones(len(at), bool))], names)


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, n, set) of the rows whose text is that of the class they were found for."""
    for batch in batches:
        n, one, two = (batch.column(c).to_numpy() for c in ("n", "sig", "sig2"))
        sets, mine = [], []
        for i, s in enumerate(_sets(batch, k)):
            if (len(s), *_sums(s)) == (n[i], one[i : i + 1].view(_U)[0], two[i : i + 1].view(_U)[0]):
                sets.append(s)
                mine.append(i)
        sizes = [len(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(mine, pa.int64())), pa.array(sizes, pa.int64()), list_column(signed(np.concatenate([*sets, np.zeros(0, _U)])), np.cumsum([0, *sizes]))], ["id", "n", "set"])


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links of Jaccard
    similarity ``percent``/100 or more over k-word shingles; A-Z count as a-z).

    With ``mark``, a small column of the input, each row also has it, and ``component``, a number of its component that
    is its own even where ids repeat (null for rows that can't link).
    """
    if k < 1 or not 0 < percent <= 100:
        raise ValueError("k must be positive and percent in (0, 100]")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (mark if mark is not None else F.lit(None).cast("long")).alias("mark"))
    kind, mark_kind = (marked.schema[c].dataType.simpleString() for c in ("id", "mark"))
    rows = stored(marked.mapInArrow(partial(_signatures, k=k, percent=percent), f"id {kind}, mark {mark_kind}, n long, sig long, sig2 long, head array<long>"), "signatures")
    key = ["n", "sig", "sig2"]
    some = F.col("id").isNotNull() & (F.col("n") > 0)
    classes = stored(rows.where(some).groupBy(*key).agg(F.min("id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    # The key is an expression over the shuffled rows, so that they don't carry it.
    meet = F.when(F.col("met"), F.xxhash64("sig")).otherwise(F.col("token"))
    heads = rows.where(some).select("sig", "head").mapInArrow(_heads, "sig long, token long, met boolean").repartition(F.col("met"), meet)
    same = W.partitionBy("met", "meet")
    counted = heads.select("*", meet.alias("meet")).select("sig", "token", "met", F.min("sig").over(same).alias("lo"), F.max("sig").over(same).alias("hi"))
    met = counted.where("met or lo < hi").groupBy("sig").agg(F.sum(F.when(F.col("met"), F.col("token")).otherwise(1)).alias("met"))
    left = stored(classes.join(met, "sig").where(f"met >= greatest(1, (n * {percent}) div {100 * SPARE})").select(F.col("rep").alias("id"), "cid", *key), "candidates")
    # always by a shuffle, so that the plan is the same at every size
    found = texts.join(left.hint("shuffle_hash"), "id").select(F.col("cid").alias("id"), *key, "text")
    sets = stored(found.mapInArrow(partial(_full_sets, k=k), "id long, n long, set array<long>"), "sets")
    if not sets.groupBy("id").count().where("count > 1").isEmpty():  # whole rows that repeat, or ids of several texts
        once = stored(sets.dropDuplicates(["id"]), "sets")
        drop_stored(sets)
        sets = once
    slim = stored(rows.drop("head"), "signatures")
    drop_stored(rows)
    rows = slim

    tokens = sets.select("id", "n", F.explode("set").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    frequent = stored(frequent, "frequent")
    known = tokens.join(frequent, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    alone = F.col("n") - F.size("list")
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefixes = known.withColumn("alone", alone).withColumn("take", take.cast("int")).where("take > 0").select("id", "n", "alone", F.expr("transform(slice(list, 1, take), x -> x.token)").alias("prefix"))
    prefixes = stored(prefixes.withColumn("group", F.struct(F.xxhash64("n", "prefix").alias("a"), F.xxhash64(F.lit(1), "prefix", "n").alias("b"))), "prefixes")
    drop_stored(frequent)

    # A pair's overlap must reach `need`; from a common first shingle on, it can't exceed `reach` of either.
    need = F.expr(f"ceil({percent} * (a_n + b_n) / {100 + percent}D - 1e-9)")
    fits = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (F.least("a_reach", "b_reach") >= need)

    def entries(p: DataFrame) -> DataFrame:
        """A row for each prefix shingle of a group; ``alone`` is the least of its members."""
        return p.withColumn("e", F.explode(F.expr("transform(prefix, (t, i) -> struct(t as token, n - alone - i as reach))"))).select(*[c for c in p.columns if c != "prefix"], "e.*")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("token", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "token"])

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(f"{s}_id"), F.col("n").alias(f"{s}_n"), F.col("set").alias(f"{s}_set")) for s in "ab")
        both = pairs.join(b, "b_id").join(a, "a_id").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
        return both.where(f"100 * common >= {percent} * (a_n + b_n - common)").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    groups = stored(prefixes.groupBy("group").agg(F.min_by(F.struct("id", "n", "alone", "prefix"), F.struct("alone", "id")).alias("centre")), "groups")
    members = prefixes.select("group", "id")
    own = members.join(groups.select("group", F.col("centre.id").alias("a_id")), "group").where("id <> a_id").select("a_id", F.col("id").alias("b_id"))
    listed = stored(entries(groups.select("group", "centre.*")), "entries")
    pivots = stored(listed.groupBy("token").agg(F.min_by(F.struct("id", "n", "reach"), F.struct("alone", "id")).alias("p"), F.count("*").alias("many")).where("many > 1").select("token", "p.*"), "pivots")
    paired = side(listed.select("token", "group", "n", "reach"), "b").join(side(pivots, "a"), "token").where(fits).select("a_id", "b_group").distinct()
    stars = stored(paired, "pairs").join(members.select(F.col("group").alias("b_group"), F.col("id").alias("b_id")), "b_group").where("a_id <> b_id").select("a_id", "b_id")
    links = stored(verified(own.unionByName(stars).distinct()), "links")
    merged = connected_components(links)
    drop_stored(listed, pivots, groups)

    split = prefixes.join(merged.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = stored(split.withColumn("group", F.struct("group", "component")), "split")
    parts = entries(split.groupBy("group", "component", "n").agg(F.min("alone").alias("alone"), F.any_value("prefix").alias("prefix")))
    parts = stored(parts, "parts")
    open_lists = stored(parts.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("n").alias("least_n")).where("c1 < c2").select("token", "least_n"), "open")
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))
    alive = stored(parts.join(open_lists, "token").where(F.col("reach") >= F.ceil((F.col("n") + smallest) * percent / F.lit(100.0 + percent) - 1e-9)).select("token", "group", "component", "n", "reach"), "alive")
    rest = side(alive, "a").join(side(alive, "b"), "token").where(fits & (F.col("a_component") < F.col("b_component"))).select("a_group", "b_group").distinct()
    expand = lambda s: split.select(F.col("group").alias(f"{s}_group"), F.col("id").alias(f"{s}_id"))
    pairs = stored(rest, "pairs").join(expand("b"), "b_group").join(expand("a"), "a_group").select("a_id", "b_id")
    more = stored(verified(pairs), "links")
    if not more.isEmpty():
        drop_stored(merged)
        merged = connected_components(links.unionByName(more))
    drop_stored(split, parts, open_lists, alive, sets, prefixes, links, more, left)
    least = merged.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    least = stored(least, "least")
    of_class = classes.join(merged.join(broadcast_if_small(least), "component").select(F.col("node").alias("cid"), "component", "least"), "cid", "left")
    of_class = stored(of_class.select(*key, F.coalesce("component", "cid").alias("component"), F.coalesce("least", "rep").alias("least")), "components")
    drop_stored(classes, merged, least)
    named = rows.where(some).join(broadcast_if_small(of_class), key).select("id", "mark", "n", "component", "least")
    alone = rows.where(~some).select("id", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("least"))
    extra = ["mark", "component"] if mark is not None else []
    return named.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), *extra)
