"""Toxicity features against a plain version, and scores that do not depend on the rows around."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_operators import LONG, frame

from tessera.llm import boosting, toxicity

ALIKE = toxicity.LOOK_ALIKE


def plain(text):
    return "".join(ALIKE.get(c, chr(ord(c) + 32) if "A" <= c <= "Z" else c) for c in text)


def brute(text, lexicon):
    """Features of an ASCII text; ``lexicon`` maps words and (size, stem) to weights."""
    words = re.findall(r"[a-z0-9]+", plain(text))
    whole = [lexicon.get(w, 0.0) for w in words]
    stem = [max([lexicon.get((k, w[:k]), 0.0) for k in toxicity.STEMS if len(w) > k], default=0.0) for w in words]
    weight = [max(a, b) for a, b in zip(whole, stem)]
    you = [w in {plain(s) for s in toxicity.SECOND_PERSON} for w in words]
    n, chars, letters = max(len(words), 1), max(len(text), 1), max(sum(c.isalpha() for c in text), 1)
    hits = sum(w > 0 for w in weight)
    near = sum(w > 0 and any(you[max(0, i - 5) : i + 6]) for i, w in enumerate(weight))
    disguised = sum(text[i] in "0123456789@$*.-_+" and text[i - 1].isalpha() and text[i + 1].isalpha() for i in range(1, len(text) - 1))
    return [hits / n, sum(w > 0 for w in whole) / n, sum(w > 0 for w in stem) / n, min(hits, 20), sum(weight) / n, max(weight, default=0.0), near / n, sum(you) / n,
            sum("A" <= c <= "Z" for c in text) / letters, sum(c in "!?" for c in text) / chars, disguised / n, np.log1p(len(words)), letters / chars]


def lexicon_of(words):
    hashes, weights = [], []
    for key, weight in words.items():
        raw = np.frombuffer((key if isinstance(key, str) else key[1]).encode(), np.uint8)
        h = toxicity.hash_words(raw, np.array([0]), np.array([len(raw)]))[0]
        hashes.append(h if isinstance(key, str) else h ^ np.uint64(key[0]))
        weights.append(weight)
    order = np.argsort(hashes)
    return toxicity.Lexicon(np.array(hashes, np.uint64)[order], np.array(weights)[order])


def texts_of(n):
    rnd = random.Random(n)
    words = ["idiot", "IDIOT!", "1d10t", "idiotic", "you", "Your", "plain", "w.o", "a", "b@d", "?!", "x-y"]
    return [" ".join(rnd.choice(words) for _ in range(n)) for _ in range(20)]


def test_features_against_a_plain_version():
    words = {"idiot": 3.0, (4, "idio"): 2.5, "bad": 4.0}
    texts = [t for n in range(13) for t in texts_of(n)] + ["", " ", "you are an idiot", "idiot " + "w " * 5 + "you", "idiot " + "w " * 4 + "you"]
    expected = np.array([brute(t, words) for t in texts])
    lexicon = lexicon_of(words)
    assert np.allclose(toxicity.features(pa.array(texts), lexicon), expected)
    for i, t in enumerate(texts):  # each alone
        assert np.allclose(toxicity.features(pa.array([t]), lexicon)[0], expected[i]), t
    order = np.random.RandomState(0).permutation(len(texts))
    assert np.allclose(toxicity.features(pa.array([texts[i] for i in order]), lexicon), expected[order])
    assert toxicity.features(pa.array([], pa.string()), lexicon).shape == (0, 13)


def model():
    rnd = np.random.RandomState(1)
    x = rnd.rand(200, 13)
    y = (x[:, 0] + x[:, 6] > 0.9).astype(float)
    return toxicity.ToxicityModel(lexicon_of({"idiot": 3.0}), boosting.fit_trees(x, y, np.ones(200)), boosting.Isotonic(np.array([-2.0, 2.0]), np.array([0.0, 1.0])), 0.5)


def test_scores_do_not_depend_on_order_or_neighbours(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(t for n in (0, 1, 4, 11, 12) for t in texts_of(n))] + [(900, LONG + " you", "en", "s"), (901, "idiot", "en", "s"), (902, None, "en", "s")]
    scores = []
    for order in (rows, rows[::-1]):
        for parts in (1, 7):
            got = toxicity.score_toxicity(frame(spark, order).repartition(parts), model()).collect()
            scores.append({r.doc_id: r.score for r in got})
    assert all(s == scores[0] for s in scores) and len(scores[0]) == len(rows)
    assert toxicity.score_toxicity(frame(spark, []), model()).collect() == []


@pytest.mark.parametrize("text", ["you are an idiot", "idiot", ""])
def test_one_short_row(spark, text):
    assert len(toxicity.score_toxicity(frame(spark, [(1, text, "en", "s")]), model()).collect()) == 1


def test_training_with_repeated_ids_and_lone_labels(spark):
    docs = frame(spark, [(i % 50, f"word{i} idiot{i % 2}", "en", "s") for i in range(400)])
    marks = spark.createDataFrame([(i % 50, i % 2) for i in range(400)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    fitted = toxicity.train(docs, marks)
    assert len(toxicity.score_toxicity(docs, fitted).collect()) == 400
    lone = toxicity.train(docs, marks.where("toxic = 1"))
    assert lone.trees is None and lone.share == 1.0
