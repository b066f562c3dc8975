"""Licence scan: file headers, full texts, notices in longer lines, and the first filter against none."""

import collections
import random
import re

import pytest
from test_operators import ODD, frame

from tessera.llm import license_scan as ls


def brute(text, threshold=0.8):
    """All matches of a text by comparing every unit with every template."""
    out = collections.Counter()
    table = [(n, i, set(ls.bigrams(t)), " ".join(ls.words_of(t))) for n, ts in ls.TEMPLATES.items() for i, t in enumerate(ts)]
    lines = (text or "").split("\n")
    units = [("line", i, u) for i, u in enumerate(lines)]
    for i, u in enumerate(lines):
        parts = re.sub(r"([.!?;])[ \t]+", "\\1\x01", u).split("\x01")
        units += [("sentence", i, s) for s in parts if len(parts) > 1]
    paragraphs = re.split(r"\n[ \t\r]*\n", text or "")
    units += [("paragraph", i, u) for i, u in enumerate(paragraphs) if "\n" in u.strip("\n\r\t ")]
    units += [("text", 0, text)] if len(paragraphs) > 1 else []
    for kind, i, u in units:
        mine = set(ls.bigrams(u))
        for name, variant, b, words in table:
            if mine and 2 * len(mine & b) / (len(mine) + len(b)) >= threshold:
                out[kind, i, name, variant, round(2 * len(mine & b) / (len(mine) + len(b)), 9)] += 1
            elif kind == "line" and len(mine) > len(b) * (2 - threshold) / threshold + 1e-9 and f" {words} " in f" {' '.join(ls.words_of(u))} ":
                out["phrase", i, name, variant, 1.0] += 1
    return out


def texts():
    rnd = random.Random(2)
    known = [t for ts in ls.TEMPLATES.values() for t in ts]
    out = [*ODD, "Copyright 2021 Acme Inc. All rights reserved.", "This project is released under the MIT License, see the LICENSE file for details."]
    for t in known:
        words = t.split()
        for _ in range(rnd.randint(0, max(1, len(words) // 8))):
            words[rnd.randrange(len(words))] = rnd.choice(["foo", "bar", "license", "software"])
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        out += [t, " ".join(words), "Intro.\n\n" + "\n".join(lines) + "\n\nEnd.", "\n\n".join(lines), f"Some words before it and more of them: {t} And some words after it, too."]
    return out


def test_against_brute_force(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts())]
    got = collections.defaultdict(collections.Counter)
    for r in ls.license_scan(frame(spark, rows)).collect():
        got[r.doc_id][r.unit_kind, r.unit, r.license_id, r.variant, round(r.dice, 9)] += 1
    for i, t, *_ in rows:
        assert got[i] == brute(t), t


@pytest.mark.parametrize("name", ["GPL-3.0", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "BSD-3-Clause", "Zlib", "MIT"])
def test_headers_and_full_texts_are_found(name):
    full = max(ls.TEMPLATES[name], key=len)
    wrapped = "\n".join(" * " + " ".join(full.split()[i : i + 12]) for i in range(0, len(full.split()), 12))
    assert {k[2] for k in brute(f"/*\n{wrapped}\n */\n\nint main;")} & {name, name.replace("GPL", "LGPL"), name.replace("LGPL", "GPL")}


def test_key_words_lose_nothing():
    for ts in ls.TEMPLATES.values():
        for t in ts:
            b = ls.bigrams(t)
            keys = ls.key_words(b, 0.8)
            without = [p for p in b if not keys & set(p.split())]
            assert all(2 * len(without) / (a + len(b)) < 0.8 for a in range(len(without), 2 * len(b)))
