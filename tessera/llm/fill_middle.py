"""Fill-in-middle transformation by a table-driven byte automaton.

A text is cut into units, white space with the word after it, or white space at the end.  One automaton over bytes is the
product of three small ones: where in a unit it is, how many continuation bytes a code point still has, and how much of
a sentinel it has read.  Its two tables give the next state and what a transition counts: a unit that begins, a code
point, a sentinel that is complete.

The state depends on the last few bytes only, so a text is scanned in lanes of ``LANE`` bytes side by side, each from a
few bytes before it.  The first pass keeps the counts of each lane, no positions; with the number of units known, a second
pass over the two lanes that hold a text's cuts finds their places.

A null text is empty, an empty text has no units and is plain, and so is one that holds a sentinel.  The draw depends on
the seed and the id alone (a null id draws as an empty one), so rows that repeat an id are cut alike where their texts
are.  Rows are transformed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import text_column

LANE = 512  # bytes; the counts of a lane fit the fields below
CHUNK_BYTES = 1 << 21
UNIT, POINT, SENTINEL = 1, 1 << 10, 1 << 20  # one of each in a transition's count
FIELD = (1 << 10) - 1
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
PLAIN, SPM, PSM = "plain", "spm", "psm"

_START, _SPACE, _WORD = range(3)
_WHITE = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")


def _pending(pending: int, byte: int) -> tuple[int, bool]:
    """Continuation bytes to come after ``byte``, and whether it begins a code point."""
    if 0x80 <= byte < 0xC0:
        return max(pending - 1, 0), pending == 0
    return (0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3), True


@lru_cache(16)
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, int]:
    """Next states and counts by state * 256 + byte, and how many bytes decide a state.  State 0 is a text's beginning."""
    words = [s.encode() for s in sentinels]
    if not all(words):
        raise ValueError("a sentinel must not be empty")
    begun = {w[:i] for w in words for i in range(len(w) + 1)}

    def read(progress: bytes, byte: int) -> bytes:
        now = progress + bytes([byte])
        while now not in begun:
            now = now[1:]
        return now

    states, following, counts = {(_START, 0, b""): 0}, [], []
    queue = list(states)
    for where, pending, progress in queue:
        for byte in range(256):
            white = byte in _WHITE
            left, point = _pending(pending, byte)
            now = read(progress, byte)
            counts.append(UNIT * (where == _START or white and where == _WORD) + POINT * point + SENTINEL * any(now.endswith(w) for w in words))
            state = (_SPACE if white else _WORD, left, now)
            if state not in states:
                states[state] = len(states)
                queue.append(state)
            following.append(states[state])
    return np.array(following, np.int32) * 256, np.array(counts, np.int32), max(4, *map(len, words))


class Scan:
    """The lanes of consecutive texts and what the automaton counts in each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, sentinels: tuple[str, ...] = SENTINELS):
        self.raw, self.at = raw, at
        self.next, self.counts, self.reach = automaton(sentinels)
        lanes = -(-np.diff(at) // LANE)
        self.row = np.repeat(np.arange(len(lanes)), lanes)
        self.first = np.concatenate([[0], np.cumsum(lanes)])  # lanes before each row
        self.begin = at[self.row] + (np.arange(len(self.row)) - self.first[self.row]) * LANE
        self.length = np.minimum(LANE, at[self.row + 1] - self.begin)
        counted = np.zeros(len(self.row), np.int32)
        for lane, step in self._steps(np.arange(len(self.row))):
            counted[lane] += self.counts[step]
        before = lambda unit: np.concatenate([[0], np.cumsum(counted // unit & FIELD)])
        self.units, self.points, marks = before(UNIT), before(POINT), before(SENTINEL)
        self.n = self._of_rows(self.units)
        self.marked = self._of_rows(marks) > 0

    def _of_rows(self, before: np.ndarray) -> np.ndarray:
        return before[self.first[1:]] - before[self.first[:-1]]

    def _steps(self, lanes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each byte of the lanes: those that have it, and the numbers of their transitions."""
        order = lanes[np.argsort(-self.length[lanes], kind="stable")]
        begin, length = self.begin[order], self.length[order]
        state = np.zeros(len(order), np.int32)
        inner = np.flatnonzero(begin > self.at[self.row[order]])
        for back in range(self.reach, 0, -1):  # a lane is at least ``reach`` bytes from its text's beginning
            state[inner] = self.next[state[inner] + self.raw[begin[inner] - back]]
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t, "left"))
            step = state[:live] + self.raw[begin[:live] + t]
            yield order[:live], step
            state[:live] = self.next[step]

    def cuts(self, rows: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the byte where its unit of that number begins (or its text ends) and the code points before it."""
        place, points = self.at[rows + 1].copy(), self._of_rows(self.points)[rows]
        inner = np.flatnonzero(unit < self.n[rows])
        number = self.units[self.first[rows[inner]]] + unit[inner]
        lane = np.searchsorted(self.units, number, "right") - 1
        rank = number - self.units[lane]  # units of the lane before the one looked for
        wanted, which = np.unique(lane, return_inverse=True)
        by_lane = np.argsort(which, kind="stable")
        slot = np.full(len(self.row), -1)
        slot[wanted] = np.arange(len(wanted))
        ends = np.searchsorted(which[by_lane], np.arange(len(wanted) + 1))
        seen, at_byte = np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int64)
        for live, step in self._steps(wanted):
            mine, count = slot[live], self.counts[step]
            for i in mine[(count & FIELD) > 0]:
                for q in by_lane[ends[i] : ends[i + 1]]:
                    if seen[i] & FIELD == rank[q]:
                        place[inner[q]] = self.begin[wanted[i]] + at_byte[i]
                        points[inner[q]] = self.points[wanted[i]] - self.points[self.first[rows[inner[q]]]] + (seen[i] // POINT & FIELD)
            seen[mine] += count
            at_byte[mine] += 1
        return place, points


def _pieces(col: pa.Array, chunk_bytes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of runs of whole rows of about ``chunk_bytes``."""
    data, at = text_column(col)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk_bytes, "right")) - 1)
        yield lo, data[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
        lo = hi


def _transformed(batches: Iterator[pa.RecordBatch], sentinels: tuple[str, str, str], percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    head, tail, fill = (s.encode() for s in sentinels)
    for batch in batches:
        draws = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
        for lo, raw, at in _pieces(batch.column("text"), CHUNK_BYTES):
            scan = Scan(raw, at, sentinels)
            h1, h2, h3, h4 = (h[lo : lo + len(at) - 1] for h in draws)
            cut = ~scan.marked & (scan.n > 0) & (h3 % 100 < percent)
            spm = h4 % 100 < spm_percent
            a, b = np.minimum(h1 % (scan.n + 1), h2 % (scan.n + 1)), np.maximum(h1 % (scan.n + 1), h2 % (scan.n + 1))
            rows = np.flatnonzero(cut)
            (p, p_points), (m, m_points) = scan.cuts(rows, a[rows]), scan.cuts(rows, b[rows])
            buf, out = raw.tobytes(), [None] * len(cut)
            for r in np.flatnonzero(~cut):
                out[r] = buf[at[r] : at[r + 1]]
            for r, i, j in zip(rows, p, m, strict=True):
                prefix, middle, suffix = buf[at[r] : i], buf[i:j], buf[j : at[r + 1]]
                out[r] = b"".join((tail, suffix, head, prefix, fill, middle) if spm[r] else (head, prefix, tail, suffix, fill, middle))
            form = np.where(cut, np.where(spm, SPM, PSM), PLAIN)
            chars = [np.zeros(len(cut), np.int64) for _ in range(2)]
            chars[0][rows], chars[1][rows] = p_points, m_points - p_points
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, len(cut)), pa.array(scan.n), pa.array(form), *(pa.array(c, mask=~cut) for c in chars), pa.array(out, pa.binary()).view(pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form, prefix_chars, middle_chars (null if plain) and ``output``.

    ``percent`` of the texts are cut at two drawn units; of these ``spm_percent`` get the suffix first.
    """
    if len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    draw = lambda i: F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = rows.select("id", "text", *[draw(i) for i in range(4)])
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(partial(_transformed, sentinels=tuple(sentinels), percent=percent, spm_percent=spm_percent), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form."""
    head, tail, fill = sentinels
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substr(c, F.instr(c, mark) + F.lit(len(mark)))
    psm = F.substr(output, F.lit(len(head) + 1))
    psm_rest = after(psm, tail)
    spm = F.substr(output, F.lit(len(tail) + 1))
    spm_rest = after(spm, head)
    return F.when(form == PSM, F.concat(before(psm, tail), after(psm_rest, fill), before(psm_rest, fill))).when(form == SPM, F.concat(before(spm_rest, fill), after(spm_rest, fill), before(spm, head))).otherwise(output)


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             CAST('0x' || substr(k, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(k, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(k, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(k, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS prefix,
             coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS middle, coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
