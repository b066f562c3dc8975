"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Base features are counts; a rule bounds the ratio of two features and
may apply from a number of words on.  All expressions are built-in and run in the JVM.

Null or empty text has no words and fails the base rule.  Rows are judged one by one, so ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import quoted

WORD_GAP = r"[\x20\x09-\x0D]+"

# Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by from or an "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "el los y del las se por con no una su para es al lo como más o"
).split()


class Rule(NamedTuple):
    """Fails where numerator / denominator lies outside [least, most], for texts of ``from_words`` words or more."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None
    from_words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.5),
    Rule("capitals", "n_capitals", "n_letters", None, 0.5),
    Rule("letters", "n_letters", "n_chars", 0.4, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.6),
    Rule("stop_words", "n_stop_words", "n_words", 0.005, None, 100),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: str, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _with_repeats(df: DataFrame, width: int = 8) -> DataFrame:
    """Adds n_repeat_words: words inside windows that occur twice or more in their text.

    Windows are 64-bit hashes in an array; only where two are equal are they sorted with their places.  Every
    array is referenced more than once by the next projection, which keeps Spark from inlining it into lambdas.
    """
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", F.expr(f"if(size(_h) >= {width}, transform(sequence(0, size(_h) - {width}), i -> xxhash64(slice(_h, i + 1, {width}))), array())"))
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_g)) < size(_g), sort_array(transform(_g, (g, i) -> struct(g, i))), array())"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (e, i) -> (i > 0 and get(_s, i - 1).g = e.g) or coalesce(get(_s, i + 1).g = e.g, false)), e -> e.i))"))
    return df.withColumn("n_repeat_words", F.expr(f"cast(aggregate(zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> least({width}, coalesce(b - a, {width}))), 0, (x, y) -> x + y) as long)"))


def quality_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``id_col``, the carried columns (as a struct ``carried``) and every feature the rules may name."""
    carried = [F.struct(*[F.col(quoted(c)) for c in carry]).alias("carried")] if carry else []
    df = docs.select(F.col(id_col).alias("id"), *carried, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", WORD_GAP), ""))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    stops = sorted({*stop_words, *(w.capitalize() for w in stop_words)})
    df = df.select(
        "id", *(["carried"] if carry else []), "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length("_text").cast("long").alias("n_chars"),
        _removed("_text", r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        _removed("_text", r"[^\p{Lu}]+").alias("n_capitals"),
        _removed("_text", r"[^\p{L}]+").alias("n_letters"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
    )
    return _with_repeats(df).drop("_words", "_h", "_g", "_s", "_p")


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of features fails, as one array expression."""

    def fails(r: Rule) -> Column:
        top, under = F.col(r.numerator), F.col(r.denominator)
        out = F.lit(False)
        if r.least is not None:
            out = out | (top < under * F.lit(r.least))
        if r.most is not None:
            out = out | (top > under * F.lit(r.most))
        return out & (F.col("n_words") >= r.from_words)

    return F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30, carry: tuple[str, ...] = (), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, the base features, base_failed, kept, failed_rules and, where asked for, ``carried``."""
    df = quality_features(docs, id_col=id_col, text_col=text_col, carry=carry, stop_words=stop_words)
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    df = df.withColumn("failed_rules", compiled(rules))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return df.select(F.col("id").alias(id_col), *BASE, "base_failed", kept.alias("kept"), "failed_rules", *(["carried"] if carry else []))


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``, from the same table of rules."""
    stops = ", ".join("'" + w + "'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    parts = []
    for r in RULES:
        tests = ([f"{r.numerator} < {r.denominator} * {r.least!r}::DOUBLE"] if r.least is not None else []) + ([f"{r.numerator} > {r.denominator} * {r.most!r}::DOUBLE"] if r.most is not None else [])
        parts.append(f"(({' OR '.join(tests)}) AND n_words >= {r.from_words})")
    gone = lambda kept: f"length(regexp_replace(t, '[^{kept}]+', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) AS n_chars,
             {gone("#*$%&|<>")} AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclamations,
             {gone(chr(92) + "p{Lu}")} AS n_capitals, {gone(chr(92) + "p{L}")} AS n_letters,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop_words, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(parts)}) AS kept
FROM b"""
