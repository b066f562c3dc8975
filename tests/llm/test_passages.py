"""Substring dedup: a passage in every document, ids of several texts, ids of other types."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, WORDS, brute_cut, frame

from tessera.llm import hashing
from tessera.llm.substring_dedup import substring_dedup


def shared_passages(seed, n):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(13, 60))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = list(passages[0])  # in every document
        for _ in range(rnd.randint(0, 4)):
            words += [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] + rnd.choice(passages)
        rows.append((i, " ".join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_a_passage_in_every_document(spark, monkeypatch, parts):
    rows = shared_passages(3, 150)
    got = substring_dedup(frame(spark, rows).repartition(parts, F.rand(1))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_cut(rows)


def brute_rows(rows, w=13):
    """Rows of any ids: what each row loses to smaller ids, whichever of their texts holds it."""
    first = {}
    for i, t in rows:
        words = WORDS.findall(t or "")
        for k in range(len(words) - w + 1):
            if i is not None:
                first[tuple(words[k : k + w])] = min(i, first.get(tuple(words[k : k + w]), i))
    out = []
    for i, t in rows:
        words = WORDS.findall(t or "")
        gone = {j for k in range(len(words) - w + 1) if i is not None and first[tuple(words[k : k + w])] < i for j in range(k, k + w)}
        out.append((i, " ".join(x for j, x in enumerate(words) if j not in gone)))
    return out


def test_ids_of_several_texts(spark):
    texts = [t for _, t, *_ in shared_passages(5, 60)] + ODD
    rows = [(None if i % 17 == 16 else i % 7, t) for i, t in enumerate(texts)]
    rows += rows[:9]  # and whole rows again
    got = substring_dedup(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.kept) for r in got), key=key) == sorted(brute_rows(rows), key=key)


@pytest.mark.parametrize("cast", ["string", "decimal(20,2)", "int"])
def test_ids_keep_their_type_and_order(spark, cast):
    rows = shared_passages(7, 40)
    docs = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast(cast))
    df = substring_dedup(docs)
    assert df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    key = str if cast == "string" else int
    expected = dict(brute_rows([(key(i), t) for i, t, *_ in rows]))
    assert {key(r.doc_id): r.kept for r in df.collect()} == expected


def test_checks_tell_windows_apart():
    import pyarrow as pa

    [c] = hashing.chunks(pa.array(["a b c d a b c d", "b c d a"]))
    got = c.checks(4, hashing.np.flatnonzero(c.windows(4)[1]))
    assert got[0] == got[4] and got[1] == got[5] and len(set(got.tolist())) == 4
