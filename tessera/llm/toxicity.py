"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled ids (those of the ``per_label`` smallest hashes of each label) is split into three
parts: one finds the lexicon, one fits the trees, one calibrates.  Words are counted and features are computed by the
executors; the driver gets the lexicon (``most`` rows) and the features of the sample, never a text.

The lexicon holds hashes of words, and of words' first four to six bytes, that toxic rows of the first part
have far more often than others.  Words are runs of letters and digits in which look-alike digits and signs count
as the letters they stand for.  Features of a text, all over its whole length: lexicon densities (words, stems,
weighted, greatest weight), second-person proximity, capitals, punctuation and obfuscation rates, and lengths.

Null or empty text scores as a text without words.  Without rows of both labels every score is the share of label 1
(0 if there are no labels).  Null labels are ignored; of an id's labels the largest counts, of its texts the first in
order.  Scored ids may be null or repeat: each row is scored by itself, so neighbouring rows and their order mean nothing.
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

from tessera.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from tessera.llm.hashing import Chunk, chunks, hash_words, signed
from tessera.llm.tables import drop_stored, stored

_U = np.uint64
# Signs that stand for letters, and second-person words.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta tes vos usted ustedes ti vosotros sie".split()
STEMS = (4, 5, 6)

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SIGN = np.isin(_BYTE, [ord(c) for c in "@$"])
_LETTER = _UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_MARK = np.isin(_BYTE, [ord(c) for c in "!?"])
_INNER = np.isin(_BYTE, [ord(c) for c in "*@$.-_+"])
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _a, _b in LOOK_ALIKE.items():
    _PLAIN[ord(_a)] = ord(_b)
_WORD = np.zeros(256, bool)
_WORD[97:123] = True
_WORD[48:58] = True
_WORD[128:] = True


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return hash_words(_PLAIN[raw], np.array([0]), np.array([len(raw)]))[0]


_YOU = np.sort(np.array([_word_hash(w) for w in SECOND_PERSON], _U))


def _words(col: pa.Array) -> Iterator[tuple[Chunk, list[np.ndarray]]]:
    """Chunks of the disguise-free text with, for each word, the hashes of the whole and of its stems (0 if shorter)."""
    for c in chunks(col, word_bytes=_WORD, table=_PLAIN):
        buf, keys = _PLAIN[c.raw], [c.hash]
        for k in STEMS:
            long = c.end - c.start > k
            h = np.zeros(len(c.hash), _U)
            h[long] = hash_words(buf, c.start[long], c.start[long] + k) ^ _U(k) if long.any() else 0
            keys.append(h)
        yield c, keys


@dataclass(frozen=True)
class Lexicon:
    hashes: np.ndarray
    weights: np.ndarray

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.where(self.hashes[at] == keys, self.weights[at], 0.0)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each row's sum, from that row's values alone (a running sum would round by what stands before)."""
    out, filled = np.zeros(len(first) - 1), np.diff(first) > 0
    if filled.any():
        out[filled] = np.add.reduceat(values.astype(np.float64), first[:-1][filled])
    return out


def _near(flag: np.ndarray, first: np.ndarray, reach: int = 5) -> np.ndarray:
    """Whether a flagged word stands at most ``reach`` words away within the same row."""
    total, at, sizes = np.concatenate([[0], np.cumsum(flag)]), np.arange(len(flag)), np.diff(first)
    return total[np.minimum(at + reach + 1, np.repeat(first[1:], sizes))] > total[np.maximum(at - reach, np.repeat(first[:-1], sizes))]


def features(col: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of features for each text."""
    out = []
    for c, keys in _words(col):
        weights = [lexicon(k) for k in keys]
        weight = np.maximum.reduce(weights)
        hit = weight > 0
        you = np.isin(c.hash, _YOU)
        near_you = _near(you, c.first)
        n = np.maximum(np.diff(c.first), 1)
        letters = np.maximum(_sums(_LETTER[c.raw], c.bytes_at), 1)
        chars = np.maximum(np.diff(c.bytes_at), 1)
        disguise = np.zeros(len(c.raw), bool)
        if len(c.raw) > 2:
            disguise[1:-1] = (_DIGIT | _SIGN | _INNER)[c.raw[1:-1]] & _LETTER[c.raw[:-2]] & _LETTER[c.raw[2:]]
            inside = c.bytes_at[:-1][np.diff(c.bytes_at) > 0]
            disguise[inside] = disguise[inside - 1] = False  # the first byte of a row and the last of the one before
        top = np.zeros(c.rows)
        if len(weight):
            filled = np.diff(c.first) > 0
            top[filled] = np.maximum.reduceat(weight, c.first[:-1][filled])
        hits, whole = _sums(hit, c.first), _sums(weights[0] > 0, c.first)
        out.append(np.stack([
            hits / n, whole / n, _sums(np.maximum.reduce(weights[1:]) > 0, c.first) / n, np.minimum(hits, 20), _sums(weight, c.first) / n, top,
            _sums(hit & near_you, c.first) / n, _sums(you, c.first) / n,
            _sums(_UPPER[c.raw], c.bytes_at) / letters, _sums(_MARK[c.raw], c.bytes_at) / chars, _sums(disguise, c.bytes_at) / n,
            np.log1p(np.diff(c.first)), letters / chars,
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 13))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, bad, n): how many of a batch's texts hold a word or stem, and how many of them are toxic."""
    for batch in batches:
        toxic = batch.column("y").to_numpy().astype(float)
        seen, label = [np.zeros(0, _U)], [np.zeros(0)]
        for c, keys in _words(batch.column("text")):
            row = c.row_of_word()
            for k in keys:
                order = np.lexsort((k, row))
                r, h = row[order], k[order]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                new &= h != 0
                seen.append(h[new])
                label.append(toxic[c.lo + r[new]])
        hashes, at, n = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
        bad = np.bincount(at, np.concatenate(label), len(hashes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(bad), pa.array(n.astype(np.int64))], ["hash", "bad", "n"])


def _sketched(batches: Iterator[pa.RecordBatch], width: int = 5) -> Iterator[pa.RecordBatch]:
    """(sketch, y, text): the smallest hash of a text's windows, which near-copies mostly share."""
    for batch in batches:
        sketch = np.zeros(batch.num_rows, _U)
        for c in chunks(batch.column("text"), word_bytes=_WORD, table=_PLAIN):
            sizes = np.diff(c.first)
            hashes, whole = c.windows(width)
            hashes = np.where(whole | (np.repeat(sizes, sizes) < width), hashes, ~_U(0))
            if len(hashes):
                sketch[c.lo + np.flatnonzero(sizes)] = np.minimum.reduceat(hashes, c.first[:-1][sizes > 0])
        yield pa.RecordBatch.from_arrays([pa.array(signed(sketch)), batch.column("y"), batch.column("text")], ["sketch", "y", "text"])


def learn_lexicon(sample: DataFrame, *, least_rows: int = 4, least_log_odds: float = 2.0, most: int = 4096) -> Lexicon:
    """From rows (text, y): what toxic rows hold far more often than others, the ``most`` strongest of it.  Near-copies of one
    label count once, so that the words of one much-copied text don't pass for toxic ones."""
    sample = sample.select("text", "y").mapInArrow(_sketched, "sketch long, y int, text string").groupBy("sketch", "y").agg(F.min("text").alias("text"))
    sizes = sample.agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).first()
    counts = sample.select("text", "y").mapInArrow(_seen, "hash long, bad long, n long").groupBy("hash").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / F.lit(sizes.bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / F.lit(sizes.good + 1.0))
    picked = counts.where(F.col("bad") >= least_rows).withColumn("odds", odds).where(F.col("odds") >= least_log_odds)
    got = picked.orderBy(F.desc("odds"), "hash").limit(most).toArrow()
    hashes, weights = got.column("hash").to_numpy().view(_U), got.column("odds").to_numpy()
    order = np.argsort(hashes)
    return Lexicon(hashes[order], weights[order])


def _featured(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"), lexicon)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["key", "part", "y", "x"])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    calibration: Isotonic | None
    share: float

    def score(self, col: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(col), self.share)
        return np.clip(self.calibration(self.trees.margin(features(col, self.lexicon))), 0, 1)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed: Column | None = None, per_label: int = 4000) -> ToxicityModel:
    """Learns from labelled rows for which ``allowed``, an expression over ``id``, holds."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).where("id is not null and y is not null")
    if allowed is not None:
        known = known.where(allowed)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    place = F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    chosen = known.withColumn("place", place).where(F.col("place") <= per_label).select("id", "y")  # at most 2 * per_label rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    part = F.when(F.pmod(F.xxhash64("id", F.lit("part")), F.lit(5)) < 2, 0).when(F.pmod(F.xxhash64("id", F.lit("part")), F.lit(5)) < 4, 1).otherwise(2)
    drawn = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = stored(drawn.select(F.col("id").cast("string").alias("key"), "text", "y", part.alias("part")), "toxicity-sample")
    sizes = {(r.part, r.y) for r in sample.select("part", "y").distinct().collect()}
    nothing = Lexicon(np.zeros(0, _U), np.zeros(0))
    if len(sizes) < 6:
        drop_stored(sample)
        return ToxicityModel(nothing, None, None, share)
    lexicon = learn_lexicon(sample.where("part = 0"))
    kept = sample.where("part > 0").mapInArrow(partial(_featured, lexicon=lexicon), "key string, part int, y int, x array<double>").toArrow().sort_by("key")
    x, y, part = np.array(kept.column("x").to_pylist()), kept.column("y").to_numpy().astype(float), kept.column("part").to_numpy()
    drop_stored(sample)
    mean = y.mean()
    weight = np.where(y == 1, share / mean, (1 - share) / (1 - mean))
    trees = fit_trees(x[part == 1], y[part == 1], weight[part == 1])
    calibration = fit_isotonic(trees.margin(x[part == 2]), y[part == 2], weight[part == 2])
    return ToxicityModel(lexicon, trees, calibration, share)


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(batch.column("text")))], ["id", "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(partial(_score, model=model), f"id {texts.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
