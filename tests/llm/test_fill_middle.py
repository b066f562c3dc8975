"""Fill-in-middle against the definition by regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle as fm
from tessera.llm.queries import fill_in_middle_digests

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_definition(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out, chars = "plain", text, (None, None)
    elif h4 % 100 < 80:
        form, out, chars = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (len(prefix), len(middle))
    else:
        form, out, chars = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (len(prefix), len(middle))
    return n, form, *chars, out, text


def texts():
    rnd = random.Random(5)
    pieces = ["a", "the", " ", "\n\t", "  ", "é", "語彙", "🙂🙂", "\x1c", "<", "<P", "P>", "<S", "<M ", " ", "x" * 700, "é" * 400, " " * 600]
    out = [None, "", " ", "a", " a", "a ", " a b ", "<P>", "x<S>y", "<<M>", "<M", "é<P>é", "a\x1cb", "語 彙\n", "<\x20P>"]
    out += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    for shift in range(-6, 7):  # sentinels, wide characters and unit starts about the edge of a lane
        out += ["y" * (fm.LANE + shift) + "<S>z w", " é" * 200 + "y" * (112 + shift) + "語 彙<" + "q r" * 300]
    return out + ["".join(f"w{i} é\n" for i in range(60_000))]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts())] + [(7, "again and again"), (7, "again and again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "h1", "n", "form", "output", "key")})
    return rows, df, fm.fill_in_middle(df)


def test_equals_the_definition(result):
    rows, _, made = result
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
    expected = sorted(((i, *by_definition(i, t)[:5]) for i, t in rows), key=repr)
    assert got == expected
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_texts_come_back(result):
    rows, _, made = result
    back = made.select("doc_id", fm.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_digests(result):
    rows, df, _ = result
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_in_middle_digests(df).collect()), key=repr)
    assert got == sorted(((i, sha(by_definition(i, t)[4]), sha(t or "")) for i, t in rows), key=repr)


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fm.fill_in_middle(empty).count() == 0
    named = spark.createDataFrame([(f"doc-{i}", "one two three four") for i in range(40)], "doc_id string, text string")
    got = fm.fill_in_middle(named).collect()
    assert {(r.doc_id, r.output) for r in got} == {(f"doc-{i}", by_definition(f"doc-{i}", "one two three four")[4]) for i in range(40)}


def test_other_sentinels(spark):
    marks = ("[[pre]]", "\x02", "é|")
    df = spark.createDataFrame([(1, "a b [[pre]] c"), (2, "plain é | text"), (3, "é|"), (4, "one two three")], "doc_id long, text string")
    made = fm.fill_in_middle(df, percent=100, sentinels=marks)
    assert {r.doc_id: r.form == "plain" for r in made.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert {(r.doc_id, r.t) for r in made.select("doc_id", fm.restored(F.col("output"), F.col("form"), marks).alias("t")).collect()} == {(r.doc_id, r.text) for r in df.collect()}
    with pytest.raises(ValueError):
        fm.fill_in_middle(df, sentinels=("<P>", "<P>", "<M>"))


def test_state_depends_on_the_last_bytes_only():
    following, _, reach = fm.automaton()
    rnd = np.random.RandomState(1)
    states = np.unique(following)
    for _ in range(300):
        tail = rnd.choice(np.frombuffer("a <PSM>é語🙂\n".encode(), np.uint8), reach)
        ends = set()
        for state in states:
            for byte in tail:
                state = following[state + byte]
            ends.add(int(state))
        assert len(ends) == 1
