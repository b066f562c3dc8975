"""Language identification by rank-order profiles.

A profile is the ``top`` most frequent character n-grams (n = 1 to 3) in order of rank.  Texts are lower-cased, runs
of non-letters become one blank, and a text begins and ends with one.  A document's distance to a language is the sum
over its own profile of how far each n-gram is out of place, ``top`` for one that the language's profile lacks; the
nearest language is predicted, the first in order of name on a tie.

Every language of the labelled rows is learned, from at most ``per_language`` of its texts: those with the smallest
hashes of id (documented bound; ``None`` takes all).  N-grams are counted by the executors; only each profile's ``top``
rows reach the driver.  Null or letterless text is ``und`` with score 0; the score is otherwise 1 - nearest / farthest
possible distance.  Without any labelled text everything is ``und``.  Ids may be null or repeat; each row is judged by
itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, stored

TOP = 400
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams; empty if the text has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return np.zeros(0, np.uint64)
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of non-letters, the first
    code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
    two = code[:-1] << np.uint64(21) | code[1:]
    three = two[:-1] << np.uint64(21) | code[2:]
    return np.concatenate([code[code != 32], two, three])


def ranked(codes: np.ndarray, top: int, counts: np.ndarray | None = None) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    if counts is None:
        codes, counts = np.unique(codes, return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    codes: np.ndarray
    places: np.ndarray  # (codes, languages): rank, or top where the profile lacks the code
    top: int

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(grams(text), self.top)
        if not len(mine) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        there = self.codes[at] == mine
        place = np.where(there[:, None], self.places[at], self.top)
        off = np.where(place == self.top, self.top, np.abs(place - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.languages[best], float(1 - off[best] / (self.top * len(mine)))


def profiles_of(lists: dict[str, np.ndarray], top: int) -> Profiles:
    """Profiles from each language's n-grams in order of rank."""
    names = tuple(sorted(n for n, mine in lists.items() if len(mine)))
    codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *[lists[n] for n in names]]))
    places = np.full((len(codes), len(names)), top)
    for j, name in enumerate(names):
        places[np.searchsorted(codes, lists[name]), j] = np.arange(len(lists[name]))
    return Profiles(names, codes, places, top)


def learn(texts: dict[str, list[str]], top: int = TOP) -> Profiles:
    return profiles_of({name: ranked(np.concatenate([np.zeros(0, np.uint64), *map(grams, mine)]), top) for name, mine in texts.items()}, top)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a batch's texts."""
    for batch in batches:
        mine: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            mine.setdefault(lang, []).append(grams(text.as_py()))
        for lang, parts in mine.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", allowed: Column | None = None, per_language: int | None = 1000, top: int = TOP) -> Profiles:
    """Profiles of all languages of the rows for which ``allowed``, an expression over ``id``, holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    if allowed is not None:
        rows = rows.where(allowed)
    if per_language is not None:
        rows = rows.withColumn("draw", F.xxhash64("id", "lang"))
        first = lambda *order: F.row_number().over(W.partitionBy("lang").orderBy(*order))
        # The limits are pushed below the shuffle: no partition sends more than per_language rows of a language.
        last = rows.select("lang", "draw").withColumn("place", first("draw")).where(F.col("place") <= per_language).groupBy("lang").agg(F.max("draw").alias("last"))
        few = rows.join(broadcast_if_small(stored(last, "last-draws")), "lang").where("draw <= last")
        rows = few.withColumn("place", first("draw", F.xxhash64("text"))).where(F.col("place") <= per_language)  # rows that repeat an id draw alike
    counted = rows.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= top)
    got = best.select("lang", "code", "rank").toArrow()
    lang, code, rank = got.column("lang").to_numpy(zero_copy_only=False), got.column("code").to_numpy(), got.column("rank").to_numpy()
    order = np.lexsort((rank, lang.astype(str)))
    lang, code = lang[order].astype(str), code[order].astype(np.uint64)
    names, at = np.unique(lang, return_index=True)
    return profiles_of({str(n): c for n, c in zip(names, np.split(code, at[1:]), strict=True)} if len(names) else {}, top)


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [profiles.predict(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["id", "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    said = texts.mapInArrow(partial(_predict, profiles=profiles), f"id {texts.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return said.withColumnRenamed("id", id_col)
