"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

1. Words of every text are summed by source; the shares p of all words are the untempered mix.
2. A source's weight is p ** a, normalised.  a = 1 keeps the natural mix, a = 0 makes all sources equal.  The
   largest a in [0, 1] whose entropy reaches ``entropy_share`` of the greatest possible is found by bisection,
   then raised by bisection, where needed, until no source would be read more than ``most_repeats`` times.
3. A source's budget is its weight of ``budget`` words.  It is realised in epochs: every epoch is a permutation of
   the source's documents in blocks, dealt by a hash of seed, epoch and id.  Whole epochs count for all documents;
   of the last, whole blocks are taken while the budget lasts, then documents of the next block in hash order
   until the budget is met.

Sources may hold most rows: sums are aggregated before they are shuffled, a source of n rows has sqrt(n) blocks, so
that neither a block nor the list of blocks grows as the source does, and the bisection runs as Spark aggregates.

A null source is a source of its own.  A null or empty text has no words; it costs nothing and is kept once for
each whole epoch and once more if its block or turn comes.  Rows without an id are dealt by their text; repeats of an
id are rows like others.
All expressions are built-in and run in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import quoted, stored

LEVELS, WAYS = 6, 64  # bisection steps are taken six at a time: one job measures all 63 points they may visit


def word_count(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def _measure(shares: DataFrame, powers: list[float], budget_factor: float) -> list[tuple[float, float]]:
    """At each exponent: entropy as a share of the greatest possible, and most repeats of a source."""
    at = shares.select("p", F.posexplode(F.array(*map(F.lit, powers))).alias("i", "a")).withColumn("q", F.pow("p", "a"))
    rows = at.groupBy("i").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("ql"), F.max(F.col("q") / F.col("p")).alias("r"), F.count("*").alias("n")).collect()
    return [((math.log(x.z) - x.ql / x.z) / math.log(x.n) if x.n > 1 else 1.0, budget_factor * x.r / x.z) for x in sorted(rows)]


def find_exponent(shares: DataFrame, *, entropy_share: float, most_repeats: float, budget_factor: float) -> float:
    """Bisection over the exponent; ``shares`` has a row (p) for each source that has words."""

    def bisect(holds, lo: float, hi: float) -> float:
        """The last point found where ``holds``, which is so at lo and not at hi."""
        for _ in range(LEVELS):
            points = [lo + (hi - lo) * i / WAYS for i in range(1, WAYS)]
            yes = [holds(m) for m in _measure(shares, points, budget_factor)]
            k = yes.index(False) if False in yes else WAYS - 1
            lo, hi = ([lo, *points][k], [*points, hi][k])
        return lo

    natural = _measure(shares, [1.0], budget_factor)[0]
    power = 1.0 if natural[0] >= entropy_share else bisect(lambda m: m[0] >= entropy_share, 0.0, 1.0)
    if _measure(shares, [power], budget_factor)[0][1] <= most_repeats or natural[1] > most_repeats:
        return power if natural[1] <= most_repeats else 1.0
    return bisect(lambda m: m[1] <= most_repeats, 1.0, power)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy_share: float = 0.98, most_repeats: float = 2.0, budget_factor: float = 1.0, seed: int = 1, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, source, n_words, weight (of its source), copies (times to read it), last_block (its
    block in the last epoch).  With ``carry`` the input row comes along as a struct ``row``, and what ``readings`` needs.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    rows = docs.select(F.col(id_col).alias("id"), name.alias("name"), F.col(source_col).alias("source"), word_count(text_col).alias("n_words"), *([F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")] if carry else []))
    if not carry:
        rows = stored(rows, "rows")
    sums = stored(rows.groupBy("source").agg(F.sum("n_words").alias("words"), F.count("*").alias("docs")), "sources")
    total = sums.agg(F.sum("words")).first()[0] or 0
    if total == 0:
        return rows.select(F.col("id").alias(id_col), "source", "n_words", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("last_block"), *(["row", "name", F.lit(1.0).alias("span"), F.lit(1).cast("long").alias("blocks")] if carry else []))
    shares = sums.where("words > 0").select((F.col("words") / F.lit(total)).alias("p"))
    power = find_exponent(shares, entropy_share=entropy_share, most_repeats=most_repeats, budget_factor=budget_factor)
    z = shares.agg(F.sum(F.pow("p", F.lit(power)))).first()[0]
    share = F.col("words") / F.lit(total)
    plan = sums.withColumn("weight", F.when(F.col("words") > 0, F.pow(share, F.lit(power)) / F.lit(z)).otherwise(0.0))
    plan = plan.withColumn("budget", F.floor(F.round(F.col("weight") * F.lit(float(total) * budget_factor), 3)))
    plan = plan.withColumn("epochs", F.when(F.col("words") > 0, F.expr("budget div words")).otherwise(1))
    plan = plan.withColumn("rest", F.when(F.col("words") > 0, F.col("budget") - F.col("epochs") * F.col("words")).otherwise(0))
    plan = plan.withColumn("blocks", F.ceil(F.sqrt("docs")))
    plan = plan.withColumn("span", F.col("epochs") + F.when(F.col("words") > 0, F.col("rest") / F.col("words")).otherwise(0.0))
    plan = stored(plan.select("source", "words", "weight", "epochs", "rest", "blocks", "span"), "plan")

    dealt = rows.join(plan, rows.source.eqNullSafe(plan.source)).drop(plan.source)
    dealt = dealt.withColumn("turn", _turn(seed, F.col("epochs"))).withColumn("block", _block())
    sizes = dealt.groupBy("source", "block").agg(F.sum("n_words").alias("block_words"))
    before = F.coalesce(F.sum("block_words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("source", "block", before.alias("start")), "blocks")
    placed = dealt.join(starts.select(F.col("source").alias("s"), F.col("block").alias("b"), "start"), dealt.source.eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    inside = F.coalesce(F.sum("n_words").over(W.partitionBy("source", "block").orderBy("turn", "n_words").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    more = (F.col("start") + inside < F.col("rest")).cast("long")
    return placed.select(F.col("id").alias(id_col), "source", "n_words", "weight", (F.col("epochs") + more).cast("long").alias("copies"), F.col("block").cast("long").alias("last_block"), *(["row", "name", "span", "blocks"] if carry else []))


def readings(docs: DataFrame, *, seed: int = 1, **how) -> DataFrame:
    """(row, epoch, block, place): a row for each time that a row of ``docs`` is read.

    An epoch of a source deals its documents to blocks anew; blocks follow each other, and within one the turns.  ``place``,
    from 0 to 1, is how far a source has got with its budget, so in its order the sources are mixed by their weights at
    every point, and the readings of one document lie an epoch apart.
    """
    mixed = mix_sources(docs, carry=True, seed=seed, **how).where("copies > 0")
    each = mixed.select("row", "name", "span", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    each = each.withColumn("turn", _turn(seed, F.col("epoch"))).withColumn("block", _block())
    inside = F.conv(F.substring("turn", 9, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    at = (F.col("epoch") + (F.col("block") + inside) / F.col("blocks")) / F.greatest("span", F.lit(1e-9))
    return each.select("row", "epoch", "block", at.alias("place"))


def _turn(seed: int, epoch: Column) -> Column:
    """What deals a document (``name``) in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("name")).cast("binary"))


def _block() -> Column:
    return F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"), F.col("blocks"))


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``."""
    entropy = "(ln(z) - ql / z) / ln(n)"
    level = """SELECT k + 1, CASE WHEN {ok} THEN mid ELSE lo END, CASE WHEN {ok} THEN hi ELSE mid END FROM (
      SELECT k, lo, hi, mid, list_sum(qs) AS z, list_sum(list_transform(qs, lambda q: q * ln(q))) AS ql, len(qs) AS n,
             list_max(list_transform(list_zip(qs, ps), lambda t: t[1] / t[2])) AS r
      FROM (SELECT k, lo, hi, mid, ps, list_transform(ps, lambda p: pow(p, mid)) AS qs FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid FROM {name} WHERE k < 36), l))"""
    return f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, source, md5(coalesce(text, '')) AS sum_, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n_words FROM documents),
sums AS (SELECT source, sum(n_words)::BIGINT AS words, count(*) AS docs FROM rows_ GROUP BY source),
tot AS (SELECT sum(words)::DOUBLE AS t FROM sums),
l AS (SELECT list(words / t ORDER BY source) AS ps FROM sums, tot WHERE words > 0),
h(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL {level.format(ok=entropy + " >= 0.98", name="h")}),
nat AS (SELECT (ln(1) - list_sum(list_transform(ps, lambda q: q * ln(q)))) / ln(len(ps)) AS e FROM l),
pw AS (SELECT CASE WHEN e >= 0.98 THEN 1.0 ELSE (SELECT lo FROM h WHERE k = 36) END AS a FROM nat),
rep AS (SELECT list_max(list_transform(ps, lambda p: pow(p, a) / p)) / list_sum(list_transform(ps, lambda p: pow(p, a))) AS r FROM l, pw),
g(k, lo, hi) AS (SELECT 0, 1.0::DOUBLE, a::DOUBLE FROM pw UNION ALL {level.format(ok="r / z <= 2.0", name="g")}),
po AS (SELECT CASE WHEN r <= 2.0 THEN a ELSE (SELECT lo FROM g WHERE k = 36) END AS a FROM rep, pw),
plan AS (SELECT source, words, weight, floor(round(weight * t, 3))::BIGINT AS budget, ceil(sqrt(docs))::BIGINT AS blocks
         FROM (SELECT *, CASE WHEN words > 0 THEN pow(words / t, a) / (SELECT list_sum(list_transform(ps, lambda p: pow(p, a))) FROM l) ELSE 0 END AS weight FROM sums, tot, po)),
full_ AS (SELECT *, CASE WHEN words > 0 THEN budget // words ELSE 1 END AS epochs, CASE WHEN words > 0 THEN budget % words ELSE 0 END AS rest FROM plan),
dealt AS (SELECT r.*, p.weight, p.epochs, p.rest, p.blocks, md5('1:' || p.epochs || ':' || coalesce(r.doc_id::VARCHAR, 'null:' || r.sum_)) AS turn
          FROM rows_ r JOIN full_ p ON r.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, (('0x' || substr(turn, 1, 8))::BIGINT) % blocks AS block FROM dealt)
SELECT doc_id, source, n_words, round(weight, 9) AS weight, block AS last_block,
       epochs + CASE WHEN coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY block, turn, n_words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS copies
FROM b"""
