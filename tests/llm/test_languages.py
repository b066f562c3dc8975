"""Language identification: every language is learned, and the whole query against a plain rank-order version."""

import collections
import zlib

from pyspark.sql import functions as F
from test_operators import LONG, corpus, frame

from tessera.llm import language_id


def brute_grams(text):
    chars, gap = [" "], True
    for c in (text or "").lower():
        if c.isalpha():
            chars.append(c)
            gap = False
        elif not gap:
            chars.append(" ")
            gap = True
    chars.append(" ")
    joined = "".join(chars)
    if not joined.strip():
        return collections.Counter()
    grams = [joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)]
    return collections.Counter(g for g in grams if g != " ")


def brute_ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))][:top]


def brute_predict(text, profiles, top):
    mine = brute_ranked(brute_grams(text), top)
    if not mine:
        return "und", 0.0
    off = {lang: sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(mine)) for lang, p in profiles.items()}
    best = min(sorted(off), key=off.get)
    return best, 1 - off[best] / (top * len(mine))


def test_query_against_brute_force(spark):
    texts = [(i, t, "xx" if i % 3 else "yy", "s") for i, (_, t, _, _) in enumerate(corpus(7, 60))]
    rows = texts + [(500, None, "xx", "s"), (501, "12 !", "yy", "s"), (502, LONG, None, "s"), (None, "zz zz", "yy", "s"), (None, "zz zz", "yy", "s")]
    docs = frame(spark, rows)
    got = language_id.identify(docs, language_id.train(docs, allowed=F.crc32(F.col("id").cast("string")) % 3 != 1, top=60)).collect()
    learned = collections.defaultdict(collections.Counter)
    for i, text, lang, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and lang and text is not None:
            learned[lang] += brute_grams(text)
    profiles = {lang: brute_ranked(c, 60) for lang, c in learned.items()}
    expected = collections.Counter((i, *(lambda p: (p[0], round(p[1], 12)))(brute_predict(t, profiles, 60))) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got) == expected


def test_six_hundred_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i // 26 % 26] + letters[i % 26] + letters[i // 676 + 3] + letters[(i * 7) % 26]
    rows = [(10 * i + j, f"{word(i)} {word(i)} {word(i)}", f"l{i:03}", "s") for i in range(600) for j in range(2)]
    rows += [(100_000 + i, f"{word(5)} {word(5)} {word(5)}", "l005", "s") for i in range(3000)]  # a hot language takes nothing from the others
    docs = frame(spark, rows)
    profiles = language_id.train(docs, per_language=2)
    assert len(profiles.languages) == 600
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, profiles).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) > 0.99 * len(rows)
    assert {lang for i, lang in got.items()} == {lang for _, _, lang, _ in rows}


def test_sample_is_bounded_whatever_the_ids(spark):
    docs = frame(spark, [(None, chr(0x4E00 + i), "xx", "s") for i in range(50)] + [(7, chr(0x5E00 + i), "yy", "s") for i in range(50)])
    profiles = language_id.train(docs, per_language=3)
    assert profiles.languages == ("xx", "yy")
    assert sum(0x4E00 <= int(c) < 0x6000 for c in profiles.codes) == 6
    everyone = language_id.train(docs, per_language=None)
    assert everyone.languages == ("xx", "yy")


def test_empty_tables(spark):
    docs = frame(spark, [(1, "abc", "xx", "s")])
    profiles = language_id.train(docs)
    assert language_id.identify(docs.limit(0), profiles).collect() == []
    assert language_id.train(docs.limit(0)).languages == ()
