"""Splitters and rankings as table functions, so that SQL text can call them.

``register`` gives a session:

- ``split_text(text, target, most)``: the chunks of a text under a token budget, for LATERAL;
- ``split_with(text, splitter)``: the same by the name of a policy that ``policies`` holds;
- ``lexical_matches(TABLE(...), query, k)`` over rows (doc_id, content): the k best of each task by the weights of the query's
  terms, of which ORDER BY score DESC, length, doc_id LIMIT k makes the ranking;
- ``first_of_each(TABLE(...) PARTITION BY ... ORDER BY ..., k)``: the first k rows (query_id, doc_id, score) of each partition,
  with their rank.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tessera.functions.text import CJK_RUN, LATIN_TOKEN
from tessera.operators.chunking import Policy, estimate, split_to_limit

policies: dict[str, Policy] = {}


def _chunks(text: str | None, target: int, most: int) -> Iterator[tuple[int, str, int]]:
    for i, part in enumerate(split_to_limit(text, target, most) if text and text.strip() else []):
        yield i, part, estimate(part)


class SplitText:
    def eval(self, text: str, target: int, most: int) -> Iterator[tuple[int, str, int]]:
        yield from _chunks(text, target, most)


def terms_of(query: str) -> list[str]:
    """Distinct Latin tokens, then CJK grams of two to four, as ``query_terms`` has them."""
    latin = [t.lower() for t in re.findall(LATIN_TOKEN, query)]
    grams = [run[i : i + n] for run in re.findall(CJK_RUN, query) for n in (2, 3, 4) for i in range(len(run) - n + 1)]
    return list(dict.fromkeys([*latin, *grams]))


class LexicalMatches:
    def __init__(self) -> None:
        self.query, self.terms, self.best, self.k = None, [], [], 0

    def eval(self, row: Row, query: str, k: int) -> Iterator[tuple]:
        if query != self.query:
            self.query, self.terms, self.k = query, [(t, 2 if len(t) >= 3 else 1) for t in terms_of(query or "")], k
        text = (row.content or "").lower()
        if score := sum(w for t, w in self.terms if t in text):
            item = (score, -len(row.content), _Falling(row.doc_id))
            if len(self.best) < k:
                heapq.heappush(self.best, item)
            else:
                heapq.heappushpop(self.best, item)
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        for score, length, doc in self.best:
            yield doc.value, float(score), -length


class _Falling:
    """Of equal documents the smaller id is better."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Falling) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Falling) and self.value == other.value


class FirstOfEach:
    def __init__(self) -> None:
        self.n = 0

    def eval(self, row: Row, k: int) -> Iterator[tuple]:
        self.n += 1
        if self.n <= k:
            yield row.query_id, row.doc_id, row.score, self.n


def register(spark: SparkSession) -> SparkSession:
    known = dict(policies)  # as they are now; workers don't see later ones

    class SplitWith:
        def eval(self, text: str, splitter: str) -> Iterator[tuple[int, str, int]]:
            if splitter not in known:
                raise ValueError(f"there is no splitter {splitter!r}")
            yield from _chunks(text, known[splitter].target, known[splitter].most)

    chunk = "chunk_index int, content string, tokens int"
    spark.udtf.register("split_text", udtf(SplitText, returnType=chunk))
    spark.udtf.register("split_with", udtf(SplitWith, returnType=chunk))
    spark.udtf.register("lexical_matches", udtf(LexicalMatches, returnType="doc_id long, score double, length long"))
    spark.udtf.register("first_of_each", udtf(FirstOfEach, returnType="query_id long, doc_id long, score double, rank int"))
    return spark
