"""Substring deduplication by Rabin-Karp window hashes.

Every window of ``window`` words gets a 64-bit hash.  A word is removed when a window that covers it also
begins in a document with a smaller id.  Counting every window of a corpus in one shuffle would move more
bytes than the corpus has, so windows are first thinned without loss: equal windows have the same smallest
hash among their ``anchor``-word parts, and only about one position in four is such a smallest one.

1. Anchors of each document are counted by a Spark window aggregate; those of two documents or more are shared.
2. Documents with shared anchors hash all their windows; of those over shared anchors another aggregate finds the
   smallest id.  Windows are equal by 96 bits (64 and a check of 32 by a second polynomial over the words' hashes).
3. Covered words go; neighbouring windows merge into maximal removal intervals.

Frequent anchors and windows are resolved within each chunk of rows (about a megabyte of text) first, and only one row
a chunk goes on to the aggregates, which spill; so a passage that a third of all documents share costs a task a few
bytes for each megabyte of the corpus and is never held in memory.  The plan is lazy throughout and the exchange of the
texts is planned once for both joins.

Null or empty text: no words, nothing removed.  Null id: kept whole and no source of removals.  Rows that
repeat an id count as one document and are each cut by their own text.  Ids keep their type and its order.
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
from pyspark.sql import types as T

from tessera.llm.hashing import chunks, list_column, mix, signed
from tessera.llm.tables import broadcast_if_small, stored

WINDOW, ANCHOR = 13, 6
_U = np.uint64


def _order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of a batch's ids, equal for equal ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    known = ids.unique()
    return pc.index_in(ids, known.take(pc.sort_indices(known))).to_numpy(zero_copy_only=False).astype(np.int64)


def _smallest_parts(parts: np.ndarray, width: int) -> np.ndarray:
    low = parts.copy()
    for j in range(1, width):
        if len(parts) > j:
            np.minimum(low[:-j], parts[j:], out=low[:-j])
    return low


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _rows(batch: pa.RecordBatch, row: np.ndarray, value: np.ndarray, known: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Rows in document order, which compresses best; ``tag`` is 2 k + known."""
    order = np.lexsort((*more, row))
    row = row[order]
    tag = 2 * batch.column("k").to_numpy()[row].astype(np.int64) + known[order]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(tag), pa.array(signed(value[order])), *(pa.array(m[order]) for m in more)], ["id", "tag", "value", "place"][: 3 + len(more)])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(id, tag, value): a document's anchors; known if two documents of a chunk have it, and one more row to be counted."""
    for batch in batches:
        doc = _order(batch.column("id"))
        for c in chunks(batch.column("text")):
            parts, _ = c.windows(anchor)
            _, whole = c.windows(window)
            low, row = _smallest_parts(parts, window - anchor + 1)[whole], (c.row_of_word() + c.lo)[whole]
            for _ in range(2):  # first what repeats side by side, then all
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                low, row = low[new], row[new]
                order = np.lexsort((row, low))
                low, row = low[order], row[order]
            at = _runs(low)
            size = np.diff(np.append(at, len(low)))
            many = np.minimum.reduceat(doc[row], at) < np.maximum.reduceat(doc[row], at) if len(at) else np.zeros(0, bool)
            known = np.repeat(many, size)
            first = at[many]
            yield _rows(batch, np.append(row, row[first]), np.append(low, low[first]), np.append(known, np.zeros(len(first), bool)))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null rows have none."""
    n = np.asarray(pc.fill_null(pc.list_value_length(col), 0), np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), n)


def _windows(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(id, tag, value, place): windows over shared anchors; known if a smaller id of the chunk has it too.  ``place`` holds
    the check (0 if known) and, in its lower 32 bits, where the window starts."""
    for batch in batches:
        doc = _order(batch.column("id"))
        marks, mark_row = _lists(batch.column("marks"))
        marks = mix(marks.view(_U) ^ mix(mark_row.astype(_U)))
        for c in chunks(batch.column("text")):
            parts, _ = c.windows(anchor)
            whole_hash, whole = c.windows(window)
            row = c.row_of_word() + c.lo
            mine = marks[np.searchsorted(mark_row, c.lo) : np.searchsorted(mark_row, c.lo + c.rows)]
            at = np.flatnonzero(whole)
            low = _smallest_parts(parts, window - anchor + 1)[at]
            at = at[np.isin(mix(low ^ mix(row[at].astype(_U))), mine)]
            value, check = whole_hash[at], c.checks(window, at)
            order = np.lexsort((doc[row[at]], check, value))
            at, value, check = at[order], value[order], check[order]
            runs = _runs(mix(value) ^ check.view(np.uint32))
            least = np.repeat(doc[row[at[runs]]], np.diff(np.append(runs, len(at))))
            known = doc[row[at]] > least
            place = np.where(known, 0, check).astype(np.int64) << 32 | (at - c.first[row[at] - c.lo])
            yield _rows(batch, row[at], value, known, place)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, start_row = _lists(batch.column("starts"))
        for c in chunks(batch.column("text")):
            lo, hi = np.searchsorted(start_row, (c.lo, c.lo + c.rows))
            begin = c.first[start_row[lo:hi] - c.lo] + starts[lo:hi]
            n = len(c.start)
            depth = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + window, minlength=n + 1)[: n + 1]
            gone = np.cumsum(depth)[:n] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[c.first[1:]] - total[c.first[:-1]]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            row = c.row_of_word()
            firsts = c.first[:-1][np.diff(c.first) > 0]
            edge[firsts] = gone[firsts]
            opens = np.flatnonzero(edge)
            shut = gone.copy()
            shut[:-1] &= ~gone[1:]
            lasts = c.first[1:][np.diff(c.first) > 0] - 1
            shut[lasts] = gone[lasts]
            closes = np.flatnonzero(shut) + 1
            spans_at = np.searchsorted(opens, c.first)
            base = c.first[row[opens]] if len(opens) else opens
            part = batch.slice(c.lo, c.rows)
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"),
                "n_words": pa.array(np.diff(c.first).astype(np.int64)),
                "n_removed": pa.array(removed.astype(np.int64)),
                "kept": kept_texts(c, ~gone),
                "removed_from": list_column((opens - base).astype(np.int32), spans_at, pa.int32()),
                "removed_to": list_column((closes - base).astype(np.int32), spans_at, pa.int32()),
            } | ({"row": part.column("row")} if "row" in batch.schema.names else {}))


def kept_texts(c, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    word = np.flatnonzero(keep)
    row = c.row_of_word()[word]
    lead = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    raw = c.raw.copy()
    begin = c.start[word] - ~lead
    raw[begin[~lead]] = 0x20
    depth = np.zeros(len(raw) + 1, np.int8)
    depth[begin] += 1
    np.subtract.at(depth, c.end[word], 1)
    inside = np.cumsum(depth, dtype=np.int8)[:-1] > 0
    at = np.concatenate([[0], np.cumsum(inside)])[c.bytes_at]
    return pa.Array.from_buffers(pa.string(), c.rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw[inside])])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, row: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (kept words joined by one space), and the maximal
    removed word intervals as removed_from and removed_to; ``row`` is carried along where given."""
    if not 0 < anchor <= window:
        raise ValueError("anchor must lie between 1 and window")
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([row.alias("row")] if row is not None else []))
    kind = every.schema["id"].dataType.simpleString()
    # ids of several texts: there a number of the text, else 0, tells rows of one id apart
    several = every.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a < b")
    several = stored(several.select("id", "a"), "ids-of-several-texts")
    number = F.when(F.col("a").isNotNull() | F.col("id").isNull(), F.pmod(F.xxhash64("text").bitwiseXOR(F.coalesce("a", F.lit(0))), F.lit(1 << 31)).cast("int"))
    # a key that is never null, so that both joins share one exchange of the texts
    texts = every.join(broadcast_if_small(several), "id", "left").withColumn("doc", F.struct("id", F.coalesce(number, F.lit(0)).alias("k"))).drop("id", "a")
    known, k = F.col("tag") % 2 == 1, F.shiftright("tag", 1).cast("int")
    meet = F.when(known, F.xxhash64("id", "tag")).otherwise(F.col("value"))

    anchors = texts.where("doc.id is not null").select("doc.id", "doc.k", "text").mapInArrow(partial(_anchors, window=window, anchor=anchor), f"id {kind}, tag long, value long")
    # the keys are expressions over the shuffled rows, so that the rows don't carry them
    row_of, same = F.struct("id", "tag"), W.partitionBy("known", "meet")
    counted = anchors.repartition(known, meet).select("*", known.alias("known"), meet.alias("meet")).select("id", "tag", "value", "known", F.min(row_of).over(same).alias("lo"), F.max(row_of).over(same).alias("hi"))
    marks = counted.where("known or lo < hi").groupBy(F.struct("id", k.alias("k")).alias("doc")).agg(F.collect_set("value").alias("marks"))
    windows = texts.join(marks.hint("shuffle_hash"), "doc").select("doc.id", "doc.k", "text", "marks").mapInArrow(partial(_windows, window=window, anchor=anchor), f"id {kind}, tag long, value long, place long")
    same, check = W.partitionBy("known", "meet", "check"), F.shiftright("place", 32)
    counted = windows.repartition(known, meet, check).select("id", "tag", "place", known.alias("known"), meet.alias("meet"), check.alias("check")).withColumn("least", F.min("id").over(same))
    starts = counted.where("known or least < id").groupBy(F.struct("id", k.alias("k")).alias("doc")).agg(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")).alias("starts"))

    out = T.StructType.fromDDL(f"id {kind}, n_words long, n_removed long, kept string, removed_from array<int>, removed_to array<int>")
    if row is not None:
        out = out.add("row", every.schema["row"].dataType)
    cut = texts.join(starts.hint("shuffle_hash"), "doc", "left").select("doc.id", "text", *(["row"] if row is not None else []), "starts")
    return cut.mapInArrow(partial(_cut, window=window), out).withColumnRenamed("id", id_col)
