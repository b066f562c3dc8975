"""Packing token sequences: cutting stock by column generation.

1. Documents are tokenised once and cut at multiples of the capacity; only the last piece of each is shorter.
2. Pieces fall into length classes of ``step`` tokens, rounded up.  The histogram of classes (at most
   capacity/step rows, whatever the corpus) goes to the driver.
3. Column generation: a linear program chooses how often to use each pattern of classes; a knapsack by dynamic
   programming finds the pattern that its prices favour most, until none gains.
4. Patterns are rounded down; what is left over, at most about one piece for each pattern and class, is packed by
   first fit decreasing.
5. Pieces are ranked within their class and take the places that patterns give to those ranks.

Where the tokenizer's file says that it drops white space and splits no piece across it, words are encoded once and
remembered by each Python worker, up to ``MEMORY`` words; whole texts are encoded with any other file.

A null or empty text is the end mark alone.  Ids may be null or repeat; each row is packed.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.hashing import text_column
from tessera.llm.tables import stored, with_rank

MEMORY = 1_000_000
# The parts of a tokenizer's description that make encoding word by word the same as encoding whole texts.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_BYTE = np.arange(256)
_LETTER = (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 65) & (_BYTE <= 90)
_TAIL = np.isin(_BYTE, [ord(c) for c in ".,!?;:"])
_LEAD = 0xC3  # of the letters U+00C0 to U+00FF; all but the two signs among them
_LATIN = (_BYTE >= 0x80) & (_BYTE <= 0xBF) & ~np.isin(_BYTE, [0x97, 0xB7])


def _is_wordwise(description: dict) -> bool:
    model = description["model"]
    return (
        all(description.get(k) == v for k, v in WORDWISE.items())
        and (model["type"], model.get("end_of_word_suffix"), model.get("dropout"), model.get("unk_token")) == ("BPE", "</w>", None, None)
        and all(t["special"] and not t["normalized"] and t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in description["added_tokens"])
    )


class TextTokenizer:
    """Token ids of whole texts, for any tokenizer file."""

    def __init__(self, model):
        self._model = model

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for e in self._model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
            yield np.array(e.ids, np.uint32)


class WordTokenizer:
    """Token ids of texts, word by word; words are runs without ASCII white space.

    A word of plain letters and a tail of plain marks is one piece, or two, of which each ends in a token that closes
    a piece; so all such new words are encoded in one go, without the tokenizer's own search for pieces.  All other
    words go through the whole tokenizer.
    """

    def __init__(self, model, description: dict):
        from tokenizers import Tokenizer

        self._model = model
        bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, description["pre_tokenizer"]["pretokenizers"][1]]}
        self._plain = Tokenizer.from_str(json.dumps(description | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
        vocabulary = description["model"]["vocab"]
        self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._new: list[bytes] = []
        new = self._new

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                at = self[word] = len(self)
                new.append(word)
                return at

        self._places = Places()
        self._size = self._used = 0
        self._first = np.zeros(1 << 16, np.int64)
        self._count = np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)

    def _encode_plain(self, raw: np.ndarray, tail_at: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of plain words: lines of ``raw`` with ``pieces`` pieces each, whose tails begin at ``tail_at``."""
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        after = np.flatnonzero(raw[:-1] == _LEAD) + 1
        low[after[low[after] <= 0x9E]] += 32
        text = np.insert(low, tail_at, 32).tobytes().decode()
        ids = np.array(self._plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._closes[ids]) + 1
        last = ends[np.cumsum(pieces) - 1]
        return np.diff(last, prepend=0), ids

    def _encode_new(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of all new words, in order."""
        raw = np.frombuffer(b"\n".join([*self._new, b""]), np.uint8)
        stop = np.flatnonzero(raw == 10)
        start = np.append(0, stop[:-1] + 1)
        lead = raw == _LEAD
        letter, tail = _LETTER[raw] | lead, _TAIL[raw]
        letter[1:] |= lead[:-1] & _LATIN[raw[1:]]
        lead[:-1] &= ~letter[1:] | (raw[1:] < 0x80)  # a lead byte that no letter follows
        odd = ~(letter | tail | (raw == 10)) | lead
        odd[1:] |= tail[:-1] & letter[1:]
        plain = (np.add.reduceat(odd.astype(np.int32), start) == 0) & letter[start]
        before = np.append(False, letter[:-1]) & tail
        size = stop + 1 - start
        mine = np.repeat(plain, size)
        parts = 1 + np.add.reduceat(before.astype(np.int32), start)[plain]
        counts, ids = np.zeros(len(start), np.int64), np.zeros(0, np.uint32)
        if plain.any():
            counts[plain], ids = self._encode_plain(raw[mine], np.flatnonzero(before[mine]), parts)
        if plain.all():
            return counts, ids
        rest = [w.decode() for w, p in zip(self._new, plain.tolist(), strict=True) if not p]
        got = [np.array(e.ids, np.uint32) for e in self._model.encode_batch_fast(rest, add_special_tokens=False)]
        counts[~plain] = [len(g) for g in got]
        out, whole = np.zeros(int(counts.sum()), np.uint32), np.repeat(plain, counts)
        out[whole], out[~whole] = ids, np.concatenate(got)
        return counts, out

    def _learn(self) -> None:
        counts, flat = self._encode_new()
        while self._size + len(counts) > len(self._first):
            self._first, self._count = np.append(self._first, np.zeros_like(self._first)), np.append(self._count, np.zeros_like(self._count))
        while self._used + len(flat) > len(self._ids):
            self._ids = np.append(self._ids, np.zeros_like(self._ids))
        at = slice(self._size, self._size + len(counts))
        self._count[at] = counts
        self._first[at] = self._used + np.cumsum(counts) - counts
        self._ids[self._used : self._used + len(flat)] = flat
        self._size, self._used = self._size + len(counts), self._used + len(flat)
        self._new.clear()

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if self._size > MEMORY:
            self._forget()
        find = self._places.__getitem__
        found = []
        for text in texts:
            words = text.split()
            found.append(np.fromiter(map(find, words), np.int64, len(words)))
        if self._new:
            self._learn()
        for at in found:
            n = self._count[at]
            ends = np.cumsum(n)
            yield self._ids[np.repeat(self._first[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def load_tokenizer(path: str) -> TextTokenizer | WordTokenizer:
    """Word by word where the file's description shows that to be the same, else whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        description = json.load(f)
    model = Tokenizer.from_file(path)
    return WordTokenizer(model, description) if _is_wordwise(description) else TextTokenizer(model)


_tokenizers: dict[str, TextTokenizer | WordTokenizer] = {}


def _tokenizer(path: str) -> TextTokenizer | WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = load_tokenizer(path)
    return _tokenizers[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool, group: int = 512) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    tail = np.array([end_id], np.uint32)
    for whole in batches:
        for lo in range(0, whole.num_rows, group):
            batch = whole.slice(lo, group)
            data, at = text_column(batch.column("text"))
            view = memoryview(data)
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, tokens in enumerate(tokenizer.encode([bytes(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])):
                tokens = np.concatenate([tokens, tail]).astype("<u4")
                for s in range(0, len(tokens), capacity):
                    piece = tokens[s : s + capacity]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(tokens))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            cols = {"id": batch.column("id").take(pa.array(row, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
            yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))


class Pattern(NamedTuple):
    """``copies`` sequences, each with ``counts[i]`` pieces of class ``classes[i]``."""

    copies: int
    classes: tuple[int, ...]
    counts: tuple[int, ...]


def _knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits, by dynamic programming.

    The best value of one piece for each amount of room is combined with itself, so that each round doubles the
    number of pieces: best[c] = max over j of best[j] + best[c - j].
    """
    one = np.zeros(room + 1)
    one[sizes] = prices
    at = np.full(room + 1, -1)
    at[sizes] = np.arange(len(sizes))
    best = np.maximum.accumulate(one)
    rise = np.concatenate([[False], best[1:] > best[:-1]])
    alone = np.maximum.accumulate(np.where(rise, np.arange(room + 1), 0))  # the room that the best single piece uses
    cuts = []
    while True:
        padded = np.concatenate([np.full(room, -np.inf), best])
        # row c of the view is best[c], best[c - 1], ...: what is left beside j
        rest = np.lib.stride_tricks.as_strided(padded[room:], (room + 1, room + 1), (padded.strides[0], -padded.strides[0]))
        both = rest + best
        cut = both.argmax(axis=1)
        new = both[np.arange(room + 1), cut]
        if not (new > best + 1e-12).any():
            break
        cuts.append(cut)
        best = new
    column = np.zeros(len(sizes))
    todo = [(room, len(cuts))]
    while todo:
        c, level = todo.pop()
        if level:
            j = int(cuts[level - 1][c])
            todo += [(j, level - 1), (c - j, level - 1)]
        elif alone[c]:
            column[at[alone[c]]] += 1
    return float(best[room]), column


def _first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Fractional first fit decreasing: each pattern is used until a class runs out, so its columns are triangular."""
    m = len(sizes)
    left, basis = demand.copy(), np.zeros((m, m))
    while (left > 0).any():
        free, column = room, np.zeros(m)
        for k in np.flatnonzero(left > 0)[::-1]:
            column[k] = free // sizes[k]
            free -= int(column[k] * sizes[k])
        has = column > 0
        copies = (left[has] / column[has]).min()
        gone = has & (left <= copies * column * (1 + 1e-12))
        left = np.where(gone, 0, left - copies * column)
        first, *rest = np.flatnonzero(gone)
        basis[:, first] = column
        for k in rest:
            basis[k, k] = room // sizes[k]
    return basis


def plan_patterns(histogram: dict[int, int], room: int, gap: float = 2e-4, most_steps: int = 20_000) -> list[Pattern]:
    """Patterns that hold every piece of ``histogram`` (class size to count) in sequences of ``room``.

    Column generation stops when the bound of the linear program is within ``gap``; ``most_steps`` only ends a
    solve that stalls, any basis reached is a full packing.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n), int)
    if not len(sizes):
        return []
    if sizes[0] < 1 or sizes[-1] > room:
        raise ValueError("classes must lie between 1 and the room of a sequence")
    demand = np.array([histogram[int(k)] for k in sizes], float)
    m = len(sizes)
    basis = _first_basis(sizes, demand, room)
    inverse = np.linalg.inv(basis)
    used = np.maximum(inverse @ demand, 0)
    bound = sizes @ demand / room
    for step in range(most_steps):
        prices = inverse.sum(axis=0)
        value, column = _knapsack(np.maximum(prices, 0), sizes, room)
        bound = max(bound, prices @ demand / value)
        if value <= 1 + 1e-9 or bound >= used.sum() * (1 - gap):
            break
        way = inverse @ column
        ok = way > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = used[ok] / way[ok]
        out = int(np.argmin(ratio))
        used = np.maximum(used - ratio[out] * way, 0)
        used[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        if step % 500 == 499:
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ demand, 0)
    left = demand.astype(np.int64)
    out: list[Pattern] = []
    for j in np.argsort(-used):
        column = basis[:, j].astype(np.int64)
        has = column > 0
        copies = int(min(np.floor(used[j] + 1e-6), (left[has] // column[has]).min()))
        if copies > 0:
            left -= copies * column
            out.append(Pattern(copies, tuple(sizes[has].tolist()), tuple(column[has].tolist())))
    while left.any():
        free, column = room, np.zeros(m, np.int64)
        for k in range(m - 1, -1, -1):
            if left[k] and sizes[k] <= free:
                column[k] = min(left[k], free // sizes[k])
                free -= int(column[k] * sizes[k])
        has = column > 0
        copies = int((left[has] // column[has]).min())
        left -= copies * column
        out.append(Pattern(copies, tuple(sizes[has].tolist()), tuple(column[has].tolist())))
    return out


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By class: first rank, first sequence, pieces in each copy and first slot of every pattern that uses it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        slot = 0
        for k, n in sorted(zip(p.classes, p.counts, strict=True), reverse=True):
            rows.setdefault(k, []).append((taken.get(k, 0), sequence, n, slot))
            taken[k] = taken.get(k, 0) + n * p.copies
            slot += n
        sequence += p.copies
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def _seat(batches: Iterator[pa.RecordBatch], places: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
        sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for k in np.unique(cls):
            mine = np.flatnonzero(cls == k)
            first, base, n, slot_at = places[int(k)]
            seg = np.searchsorted(first, rank[mine], "right") - 1
            past = rank[mine] - first[seg]
            sequence[mine] = base[seg] + past // n[seg]
            slot[mine] = slot_at[seg] + past % n[seg]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])


def pack(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, step: int = 4, bucket_rows: int = 100_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``with_ids``, the ids."""
    if capacity % step:
        raise ValueError("step must divide capacity")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = stored(texts.mapInArrow(partial(_pieces, path=tokenizer_path, capacity=capacity, end_id=end_id, with_ids=with_ids), schema), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_patterns(histogram, capacity // step))
    buckets = max(16, sum(histogram.values()) // bucket_rows)
    key = F.struct("id", "start", "ids_crc32")
    ranked = with_rank(pieces, ["class"], key, key, buckets)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    seated = ranked.mapInArrow(partial(_seat, places=places), f"{out}, sequence_id long, slot long")
    before = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    return seated.withColumn("offset", F.coalesce(before, F.lit(0))).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
