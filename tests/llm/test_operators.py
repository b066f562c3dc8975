"""Each operator against brute force, and its defined results for odd input."""

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import boosting, hashing, html_extract, language_id, license_scan, mixing, packing, quality_rules, toxicity
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.graph import connected_components
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.queries import ORACLES, QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "one two three", " x y \x1cz", "ß ÀÉ İi " * 3, "same words here again and again " * 40]


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], SCHEMA)
    clash = ["id", "row", "n", "n_words", "sig", "token", "component", "block", "at", "label", "score", "length", "carried"]
    return df.withColumns({c: F.lit("x") for c in clash})


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", *("".join(chr(97 + int(d)) for d in str(i + 100)) + "en" for i in range(300))]
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 120))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 7 == 3:
            words = rows[-1][1].split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, (" " if i % 2 else "\n").join(words), "en", "hot" if i % 3 else f"s{i % 5}"))
    return rows + [(n + i, t, None if i % 2 else "fr", None if i == 1 else "odd") for i, t in enumerate(ODD)]


LONG = " ".join(f"v{i % 977} u{i * i % 1013}" for i in range(40_000))


def brute_cut(rows, w=13):
    first, words = {}, {}
    for i, t, *_ in rows:
        words[i] = WORDS.findall(t or "")
        for k in range(len(words[i]) - w + 1):
            g = tuple(words[i][k : k + w])
            first[g] = min(i, first.get(g, i))
    out = {}
    for i, ws in words.items():
        gone = {j for k in range(len(ws) - w + 1) if first[tuple(ws[k : k + w])] < i for j in range(k, k + w)}
        out[i] = (len(ws), len(gone), " ".join(x for j, x in enumerate(ws) if j not in gone))
    return out


def test_substring_dedup(spark):
    rows = corpus() + [(200, LONG, "en", "hot"), (201, LONG, "en", "hot")]
    got = substring_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_cut(rows)
    for r in got:
        assert sum(b - a for a, b in zip(r.removed_from, r.removed_to)) == r.n_removed
        assert all(b < c for b, c in zip(r.removed_to, r.removed_from[1:]))


def test_substring_dedup_odd_ids(spark):
    long = " ".join(map(str, range(30)))
    got = substring_dedup(frame(spark, [(None, long, "en", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (6, long, "en", "a")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 5, 0), (False, 5, 0), (False, 6, 30), (True, 0, 0)]
    assert substring_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", range(1, 14))
def test_short_text_alone_in_a_chunk(n):
    words = [f"w{i}" for i in range(n - 1)] + ["you"]
    alone = pa.array([" ".join(words)])
    for k in (2, 4, 6, 13):
        [chunk] = hashing.chunks(alone)
        got, whole = chunk.windows(k)
        [longer] = hashing.chunks(pa.array([" ".join(words), " ".join(f"x{i}" for i in range(40))]))
        expected, expected_whole = longer.windows(k)
        assert whole.tolist() == expected_whole[:n].tolist() == [i + k <= n for i in range(n)]
        assert got[whole].tolist() == expected[:n][whole].tolist()
    lexicon = toxicity.Lexicon(next(hashing.chunks(pa.array(["w0"]), word_bytes=toxicity._WORD, table=toxicity._PLAIN)).hash, np.ones(1))
    x = toxicity.features(alone, lexicon)
    assert x.shape == (1, 13) and x[0, 6] == ((1 / n) if 2 <= n <= 6 else 0)
    rows = toxicity.features(pa.array(["w0 a", "you b", " ".join(words)]), lexicon)
    assert rows[:2, 6].tolist() == [0, 0] and rows[2].tolist() == x[0].tolist()  # not across rows


def test_one_short_document_alone(spark):
    model = toxicity.ToxicityModel(toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)), boosting.fit_trees(np.eye(13), np.arange(13) % 2.0, np.ones(13)), boosting.fit_isotonic(np.array([0.0, 1]), np.array([0.0, 1]), np.ones(2)), 0.5)
    for n in (1, 2, 3, 5, 11, 13):
        docs = frame(spark, [(1, " ".join(f"w{i}" for i in range(n)), "en", "a")]).coalesce(1)
        assert [r.n_words for r in substring_dedup(docs).collect()] == [n]
        assert [r.n_shingles for r in ngram_jaccard_join(docs, k=4, percent=85).collect()] == [max(1, n - 3)]
        assert len(toxicity.score_toxicity(docs, model).collect()) == 1


def brute_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, k, percent):
    rows = corpus(k, 50) + [(90, "One TWO three", "en", "a"), (91, LONG, "en", "a"), (92, LONG + " tail", "en", "a")]
    got = ngram_jaccard_join(frame(spark, rows), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, percent)


def test_ngram_join_near_copies_chain(spark):
    """A chain of near-copies, each close to its neighbours only, is one component."""
    rnd = random.Random(5)
    words, rows = [f"t{i}" for i in range(100)], []
    for i in range(40):
        words = list(words)
        words[rnd.randrange(100)] = f"new{i}"
        rows.append((i, " ".join(words), "en", "a"))
    got = ngram_jaccard_join(frame(spark, rows), k=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_ngram_join_odd_ids(spark):
    got = ngram_jaccard_join(frame(spark, [(None, "a b c d e f", "en", "a"), (3, "a b c d e f", "en", "a"), (3, "a b c d e f", "en", "a"), (2, "A B c d e f", "en", "a")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (3, 2), (3, 2)]
    assert ngram_jaccard_join(frame(spark, [])).collect() == []


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(None, 4), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_quality(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), failed


def test_quality_rules(spark):
    rows = corpus(4) + [(300, "the word # and | more " * 30, "en", "a"), (301, "x\nx\n \nx\ny " * 9, "en", "a"), (302, LONG, "en", "a"), (303, "OF THE!! AND!! " * 20, "en", "a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text), i
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert "symbols" in got[300].failed_rules
    assert quality_rules.quality_rules(frame(spark, [])).collect() == []


def test_quality_runs_without_user_functions(spark):
    plan = quality_rules.quality_rules(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_links(rows, t=0.93):
    good = {}
    for i, (vid, e, label) in enumerate(rows):
        if label is not None and vid is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[i] = np.array(e, float)
    links, parent = collections.Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in good:
        for j in good:
            a, b = good[i], good[j]
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= t:
                links[i] += 1
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((vid, links[i], root(vid), vid == root(vid)) for i, (vid, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [7, 4000])
def test_embedding_dedup(spark, block):
    rnd = np.random.RandomState(2)
    rows = []
    for i in range(120):
        v = rnd.randn(8)
        if i % 3:
            v = np.array(rows[-1][1]) * rnd.uniform(0.5, 2) + rnd.randn(8) * rnd.choice([0, 0.05, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], i // 60))
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [math.nan] * 8, 1), (204, rows[5][1], None), (205, [1.0, 2.0], 1), (206, [], 1), (207, [math.inf] * 8, 1), (208, rows[5][1], 0), (209, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("cell", F.lit(1))
    got = embedding_dedup(df, block=block).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(6) + [(400, LONG, "en", "a"), (401, "<|endoftext|> it's a.b. İ", "en", "a"), (None, "no id", "en", "a"), (402, "again", "en", "a"), (402, "again", "en", "a")]
    got = packing.pack(frame(spark, rows), tokenizer_path=tokenizer_path(), with_ids=True).collect()
    model = Tokenizer.from_file(tokenizer_path())
    expected = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            expected[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    seats = collections.defaultdict(list)
    for r in got:
        seats[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for pieces in seats.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(seats) == list(range(len(seats)))
    assert packing.pack(frame(spark, []), tokenizer_path=tokenizer_path()).collect() == []


def test_patterns_hold_all_and_waste_little():
    rnd = np.random.RandomState(1)
    sizes = np.minimum(256, rnd.geometric(0.01, 20_000))
    demand = collections.Counter(sizes.tolist())
    plan, held = packing.plan_patterns(demand, 256), collections.Counter()
    for p in plan:
        assert sum(a * b for a, b in zip(p.classes, p.counts)) <= 256
        for a, b in zip(p.classes, p.counts):
            held[a] += b * p.copies
    assert held == demand
    assert sum(p.copies for p in plan) <= sizes.sum() / 256 * 1.01 + 1
    assert packing.plan_patterns({}, 256) == []
    assert packing.plan_patterns({256: 3}, 256) == [packing.Pattern(3, (256,), (1,))]


def test_knapsack_is_exact():
    rnd = np.random.RandomState(4)
    for _ in range(20):
        sizes = np.sort(rnd.choice(np.arange(1, 30), 6, replace=False))
        prices = rnd.rand(6)
        best = np.zeros(61)
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [prices[i] + best[c - s] for i, s in enumerate(sizes) if s <= c])
        value, column = packing._knapsack(prices, sizes, 60)
        assert value == pytest.approx(best[60]) and column @ prices == pytest.approx(value) and column @ sizes <= 60


def test_html_cases(spark):
    pages = [
        "<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>One<b>two</b>\n three<br>four<p>five <div class='comments'>no</div></article><footer>f</footer>",
        None, "", "plain &lt;text", "<p>a<p>b<ul><li>c<li>d</ul><script>if (a<b) '</p>'</script><!-- no --><form>f</form>",
        "<main><p>in</p></main><p>out</p>", "<article><p>x<aside>y</aside>z</p></article><div class=sidebar>s</div>", "<p>unclosed <b>bold <i>it",
        "<div class='article-body'><p>text</p></div><div id='cookie-notice'>c</div><div role=navigation>n</div>",
        "<p>" + "long word " * 20_000,
        "<body class='has-comments sidebar'><article class='post header'>kept</article><article class='comment'>gone</article></body>",
    ]
    expected = ["T & x Onetwo three four five", "", "", "plain <text", "a b c d", "in", "x z", "unclosed bold it", "text", ("long word " * 20_000).strip(), "kept"]
    df = spark.createDataFrame([(i % 7, f"http://h{i}.x/" if i != 3 else None, p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit(1))
    got = html_extract.extract_main_text(df).collect()
    assert collections.Counter((r.text, r.n_chars) for r in got) == collections.Counter((t, len(t)) for t in expected)
    assert html_extract.extract_main_text(df.limit(0)).collect() == []


def extracted(page):
    return " ".join(words for _, words in html_extract.main_blocks(html_extract.parse(page)[0]))


def test_html_loses_no_page_at_the_parse_step():
    article = "<article><p>The story itself, of some length.</p></article>"
    story = "The story itself, of some length."
    for page in (
        f"<html><head><title>T <b> x</title><meta charset=utf8><body>{article}</html>", f"<head><link rel=x>{article}", f"<head><title>T</title>text<p>x</p>{article}",
        f"<svg viewBox='0 0 1 1'/>{article}", f"<iframe src=x />{article}", f"<svg><path d=x>{article}<svg></svg>", f"<button>{article}<button>b</button>",
        *[f"<div class='{c}'>{article}<div class=sidebar>side</div></div>" for c in ("layout has-sidebar", "no-sidebar", "sidebar-right", "comments-open")],
        f"<form action=x><nav>menu</nav>{article}<input></form>", f"{article}<div class=related><article>teaser</article></div>",
    ):
        assert extracted(page) == story, page
    assert extracted("<p>a<svg/>b</p><object data=y /><p>c</p>") == "ab c"
    assert extracted("<object data=y><p>rest</p><p>more") == "rest more"
    assert extracted("<svg><text>no</text></svg><p>yes<script>'<p>'</script></p>") == "yes"
    assert extracted("<form><p>A page without any article in the form of its server.</p></form><p>end</p>") == "A page without any article in the form of its server. end"
    assert extracted("<article><h1>Title</h1><form><p>All of the story is in a form.</p></form></article>") == "Title All of the story is in a form."
    assert extracted("<nav>only a menu</nav>") == "only a menu"
    assert extracted("<p>Hi</p><div class=comments>Many words that are no part of the story</div>") == "Hi"


def test_style_tree_removes_what_a_host_repeats(spark):
    same = "<div class=box><p>Read our terms and follow us for news.</p></div>"
    rows = [(i, "http://a.example/" + str(i), f"<body>{same}<div class=story><p>Story number {i} tells of {i * i}.</p></div></body>") for i in range(12)]
    rows.append((99, "http://b.example/", rows[0][2]))
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Story number 4 tells of 16."
    assert got[99].startswith("Read our terms")  # one page alone says nothing about its host
    copies = spark.createDataFrame([(i, "http://c.example/", "<p>all alike</p>") for i in range(5)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract_main_text(copies).collect()} == {"all alike"}


def test_copies_of_a_page_are_no_evidence(spark):
    page = lambda i, part: f"<body><div class=story><p>Story {i} tells of {i * i}.</p>{part}</div><i>{i}</i></body>"
    pages = [page(i, "") for i in range(6)] + [page(50, "<blockquote>Only this story quotes.</blockquote><ul><li>one</li></ul>")] * 4
    rows = [(i, "http://a.example/" + str(i), p) for i, p in enumerate(pages)]
    rows += [(99, "http://a.example/99", page(50, "<blockquote>Only this story quotes.</blockquote><ul><li>one</li></ul><script>1</script><nav>n</nav>"))]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (6, 7, 8, 9, 99)} == {"Story 50 tells of 2500. Only this story quotes. one 50"}
    assert got[2].startswith("Story 2 tells of 4.")


def test_language_id(spark):
    rnd = random.Random(1)
    made = {"aa": "abcdefghi", "bb": "fghijklmno", "cc": "äöüßxyzq"}
    rows = [(i, " ".join("".join(rnd.choice(made[l]) for _ in range(6)) for _ in range(30)), l, "s") for i, l in enumerate(list(made) * 30)]
    rows += [(900, None, "aa", "s"), (901, " 12 .", "aa", "s"), (902, "abc", None, "s"), (903, LONG, "bb", "s")]
    docs = frame(spark, rows)
    profiles = language_id.train(docs, allowed=F.col("id") % 5 != 1)
    got = {r.doc_id: r for r in language_id.identify(docs, profiles).collect()}
    assert all(got[i].lang_pred == l for i, _, l, _ in rows[:90])
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_language_distance_by_hand():
    p = language_id.learn({"x": ["ab ab"], "y": ["zz"]}, top=50)
    mine = language_id.ranked(language_id.grams("ab"), 50)
    profile = language_id.ranked(language_id.grams("ab ab"), 50).tolist()
    off = sum(abs(profile.index(g) - i) if g in profile else 50 for i, g in enumerate(mine.tolist()))
    assert p.predict("ab") == ("x", 1 - off / (50 * len(mine)))


def test_toxicity(spark):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(200)]
    bad = ["bozo", "clodpate", "nitwit"]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad + ["b0zo", "NITWIT!"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, LONG, "en", "s"), (2003, LONG + " you bozo " * 50, "en", "s")]
    labels += [(5, 1, None), (None, 1, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 5
    model = toxicity.train(docs, marks, allowed=fold("id") != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == labels[i][2] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == len(rows)
    blank = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, blank).collect()} == {0.0}


def test_isotonic_and_trees():
    rnd = np.random.RandomState(0)
    x = rnd.rand(600, 3)
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(float)
    trees = boosting.fit_trees(x, y, np.ones(600))
    assert ((trees.margin(x) > 0) == (y == 1)).mean() > 0.97
    iso = boosting.fit_isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert iso(np.array([0.0, 1, 2.5, 4, 9])).tolist() == [0, 0, 0.5, 1, 1]


def test_mixing(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", "hot" if i % 10 < 7 else f"s{i % 10}") for i in range(400)] + [(900, None, "en", None), (901, "", "en", "empty"), (902, "x y", "en", None), (902, "x y", "en", None)]
    got = mixing.mix_sources(frame(spark, rows), entropy_share=0.95).collect()
    assert len(got) == len(rows)
    words = collections.Counter()
    mixed = collections.Counter()
    for r in got:
        words[r.source] += r.n_words
        mixed[r.source] += r.n_words * r.copies
    total = sum(words.values())
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1)
    p = {s: n / total for s, n in words.items() if n}
    a = np.log(weight["hot"] / weight["s7"]) / np.log(p["hot"] / p["s7"])
    for s in p:
        assert weight[s] == pytest.approx(p[s] ** a / sum(q**a for q in p.values()), rel=1e-6)
        assert abs(mixed[s] - weight[s] * total) <= 10
    entropy = -sum(w * math.log(w) for w in weight.values() if w) / math.log(len(p))
    repeats = max(weight[s] / p[s] for s in p)
    assert entropy == pytest.approx(0.95, abs=1e-6) or repeats == pytest.approx(2.0, abs=1e-6)
    assert repeats <= 2 + 1e-9
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [r.copies for r in mixing.mix_sources(frame(spark, [(1, None, "en", "a")])).collect()] == [1]


def test_license_scan(spark):
    text = "Intro line here.\nReleased under the MIT License.\n\nlicensed under the APACHE license, version 2.0\nmore"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, LONG, "en", "a"), (5, "Released under the MIT", "en", "a"), (6, license_scan._MIT.replace("person", "body"), "en", "a")]
    got = license_scan.license_scan(frame(spark, rows)).collect()
    found = collections.Counter((r.doc_id, r.unit_kind, r.unit, r.license_id) for r in got)
    assert found[1, "line", 1, "MIT"] == 2 and found[1, "line", 3, "Apache-2.0"] == 2 and found[6, "line", 0, "MIT"] == 1
    for r in got:
        unit = next(t for i, t, *_ in rows if i == r.doc_id)
        parts = unit.split("\n") if r.unit_kind == "line" else re.split(r"\n[ \t\r]*\n", unit)
        a, b = set(license_scan.bigrams(parts[r.unit])), set(license_scan.bigrams(license_scan.TEMPLATES[r.license_id][r.variant]))
        assert r.dice == pytest.approx(2 * len(a & b) / (len(a) + len(b))) and r.dice >= 0.8
    assert not {2, 3, 4} & {r.doc_id for r in got}
    assert license_scan.license_scan(frame(spark, [])).collect() == []


def test_native_operators_run_no_python(spark):
    docs = frame(spark, corpus())
    for df in (license_scan.license_scan(docs), mixing.mix_sources(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_registry():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert json.dumps(sorted(QUERIES))
