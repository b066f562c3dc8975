"""The grouped prefix join: groups of equal prefixes, boilerplate without links, ids of several texts and other types."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, brute_components, frame

from tessera.llm.ngram_join import ngram_jaccard_join


def families(seed, families_=6, size=12, words=60):
    """Near-copies that differ at their ends only, so that many share a prefix and size."""
    rnd = random.Random(seed)
    rows = []
    for f in range(families_):
        base = [f"f{f}w{i}" if rnd.random() < 0.5 else f"c{rnd.randrange(40)}" for i in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 5, 9])):
                text[rnd.randrange(words)] = f"c{rnd.randrange(40)}"
            rows.append((len(rows), " ".join(text), "en", "s"))
    return rows


def boilerplate(seed, n=80):
    """A long common passage and some words of their own: most don't link, some do."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    return [(i, " ".join(passage[rnd.randrange(3) :] + [f"u{rnd.randrange(30)}x{j % 7}" for j in range(rnd.randint(1, 16))]), "en", "s") for i in range(n)]


@pytest.mark.parametrize(("make", "seed"), [(families, 1), (families, 2), (boilerplate, 3), (boilerplate, 4)])
@pytest.mark.parametrize(("k", "percent"), [(4, 85), (3, 60)])
def test_against_brute_force(spark, make, seed, k, percent):
    rows = make(seed)
    got = ngram_jaccard_join(frame(spark, rows).repartition(5), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)


def test_ids_of_several_texts(spark):
    texts = [t for _, t, *_ in families(5, 4, 6)]
    rows = [(i % 5, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (3, "", "en", "s"), (4, None, "en", "s")]
    rows += rows[:4]
    nodes = [(i, t, "en", "s") for i, t in enumerate(t for _, t, *_ in rows)]
    groups = brute_components(nodes, 4, 85)
    least = {}
    for i, (doc, t, *_) in enumerate(rows):
        if doc is not None and WORDS.findall(t or ""):
            root = groups[i][1]
            least[root] = min(doc, least.get(root, doc))
    expected = [(doc, groups[i][0], None if doc is None else least.get(groups[i][1], doc) if WORDS.findall(t or "") else doc) for i, (doc, t, *_) in enumerate(rows)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows), k=4, percent=85).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_ids_keep_their_type(spark):
    rows = families(6, 3, 8)
    docs = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(docs, k=4, percent=85).collect()}
    assert got == {f"d{i:04}": f"d{c:04}" for i, (_, c) in brute_components(rows, 4, 85).items()}
