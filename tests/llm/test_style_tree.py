"""The style tree against a plain version, and that the tree decides what goes."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract
from tessera.llm.html_extract import HOLDS, INSIDE, NAMED, NO_BRANCH, PART

SCHEMA = "page_id long, url string, html string"


def entropy(values):
    n = len(values)
    return 1.0 if n == 1 else (math.log(n) - sum(c * math.log(c) for c in collections.Counter(values).values()) / n) / math.log(n)


def brute(pages, threshold=0.1, style_weight=0.1, least_pages=3, least_part=0.01, least_share=0.15):
    """Texts of pages (host, html), all statistics in plain dictionaries keyed by whole paths."""
    parsed = []
    for host, html in pages:
        page = html_extract.parse_page(html or "")
        plain, nodes = html_extract.tree_of(page)
        parsed.append((host, page, plain, nodes))
    low, parts = {}, {}
    for host in {h for h, _ in pages}:
        distinct = {}
        for h, page, _, nodes in parsed:
            if h == host:
                distinct.setdefault("\n".join(w for _, w, _ in page.blocks), []).append((page, nodes))
        if len(distinct) < least_pages:
            continue
        seen = collections.defaultdict(list)
        for same in distinct.values():
            # one of the copies of a page; the tests give copies equal markup
            page, nodes = same[0]
            for path, (texts, flags) in nodes.items():
                seen[path].append(("\n".join(texts), " ".join(page.children.get(path, ())), sum(map(len, texts)), flags))
        content = {p: entropy([r[0] for r in rows]) for p, rows in seen.items()}
        style = {p: entropy([r[1] for r in rows]) for p, rows in seen.items()}
        flags = {p: [any(r[3] & bit for r in rows) for bit in (INSIDE, PART, HOLDS, NO_BRANCH, NAMED)] for p, rows in seen.items()}
        information = {p: content[p] * sum(r[2] for r in rows) / len(rows) for p, rows in seen.items()}
        low[host], parts[host] = set(), set()
        for p, rows in seen.items():
            if len(rows) < least_pages or len(rows) < least_part * len(distinct):
                continue
            family = [q for q in seen if q[:-1] == p[:-1]]
            inside, part, holds, no_branch, named = flags[p]
            if part:
                parts[host].add(p)
            best = max(information[q] for q in family)
            small = style.get(p[:-1], 0.0) < 0.5 and information[p] < least_share * best and not no_branch
            unclear = (any(flags[q][2] for q in family) or part) and information[p] < best
            repeated = (1 - style_weight) * content[p] + style_weight * style[p] < threshold
            if not holds and (repeated and named if inside else repeated or small or unclear):
                low[host].add(p)
    out = []
    for host, page, plain, _ in parsed:
        kept = []
        for (path, w, ok), main in zip(page.blocks, plain):
            up = [path[: i + 1] for i in range(len(path))]
            if low.get(host, set()).isdisjoint(up) and (main or not ok and not parts.get(host, set()).isdisjoint(up)):
                kept.append(w)
        out.append(" ".join([w for (_, w, _), keep in zip(page.blocks, plain) if keep] if host not in low or not kept else kept))
    return out


def made_pages(seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "story", "news", "more", "river", "stone"]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    pages = []
    for i in range(60):
        host = f"h{i % 7 % 4}"
        nav = "<nav><ul>" + "".join(f"<li><a href=x>{some(1)}</a>" for _ in range(rnd.randint(2, 5))) + "</ul></nav>"
        body = "".join(f"<p>{some(rnd.randint(5, 40))}</p>" for _ in range(rnd.randint(1, 6)))
        if host == "h0":
            main = f"<article><h1>{some(4)}</h1><header>{some(3)}</header>{body}<p class=share>Share this story</p></article>"
        elif host == "h1":
            main = f"<div class=story>{body}</div><div class=extra>{some(2)}</div>"
        elif host == "h2":
            main = f"<h1>{some(3)}</h1><div id=c{i}>{body}</div><div class=sidebar>{some(rnd.randint(1, 30))}</div>"
        else:
            main = f"<main>{body}</main><div class='related'><article>{some(6)}</article></div>"
        pages.append((host, f"<html><body>{nav if i % 5 else ''}{main}<div class=ad>{some(4)}</div><footer>&copy; {host}</footer></body></html>"))
        if i % 9 == 0:
            pages += [pages[-1]] * 3
    return pages + [("lone", pages[3][1]), ("h0", None), ("h0", ""), ("h1", "<p>another page altogether</p>")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_version(spark, seed):
    pages = made_pages(seed)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], SCHEMA)
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == brute(pages)


def test_the_tree_decides(spark, monkeypatch):
    pages = made_pages(4)
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], SCHEMA)
    with_tree = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    low_nodes = html_extract.low_nodes
    monkeypatch.setattr(html_extract, "low_nodes", lambda once, **k: low_nodes(once, **k).withColumn("low", F.array().cast("array<bigint>")))
    without = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    changed = [i for i, (h, p) in enumerate(pages) if h != "lone" and p and with_tree[i] != without[i]]
    assert len(changed) > 0.5 * len(pages)
    assert "Share this story" not in " ".join(with_tree[i] for i, (h, _) in enumerate(pages) if h == "h0")


def test_names_and_attributes_do_not_cut_an_article(spark):
    parts = ["<header><h1>Title</h1></header>", "<div style='overflow:hidden'><p>one</p></div>", "<p title='the hidden truth'>two</p>", "<p data-id='nav'>three</p>", "<section id='discussion'>four</section>", "<div class='notice banner'>five</div>", "<p data-hidden=1>six</p>"]
    gone = ["<p hidden>x</p>", "<div class='comments'>x</div>", "<aside>x</aside>", "<div class='post ad'>x</div>", "<p aria-hidden='true'>x</p>", "<nav>x</nav>"]
    rows = [(1, "http://a/1", f"<body><article>{''.join(parts + gone)}</article></body>")]
    rows += [(10 + i, f"http://b/{i}", f"<body><article>{''.join(p.replace('>', '>' + str(i) + ' ', 1) if p.startswith('<p') else p for p in parts + gone)}<p>{i * 'w '}</p></article></body>") for i in range(1, 3)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == "Title one two three four five six"
    assert got[11] == "Title one 1 two 1 three four five 1 six w" and " x" not in got[12]


def test_repeated_text_stays_in_articles_unless_it_has_a_parts_name(spark):
    rows = [(i, f"http://a/{i}", f"<body><article><h2>Introduction</h2><p>Story {i}</p><div class=box><p>As always.</p></div><div class=share><p>Follow us for more.</p></div><p>of <math><mi>x</mi><mo>=</mo><mn>{i * i}</mn></math></p></article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "Introduction Story 3 As always. of x=9"


def plain_divs(n=60):
    """Pages without landmarks, article tags or telling names: a menu that repeats, a line that varies, a text, a foot."""
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfgl" for b in ("an", "ei", "or", "um", "yst")]
    some = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows, texts = [], {}
    for i in range(n):
        paragraphs = [some(rnd.randint(20, 60)) for _ in range(rnd.randint(2, 6))]
        texts[i] = " ".join(paragraphs)
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((i, f"http://plain/{i}", f"<body><div class=qa><a href=/>Home</a> <a href=/n>News</a></div><div class=qb>{some(3)}</div><div class=qc>{body}</div><div class=qd>page {i} {some(2)}</div></body>"))
    return rows, texts


def test_entropy_decides_where_no_label_helps(spark):
    """Labels alone fail on such pages, and each of the two entropy tests is needed."""
    rows, texts = plain_divs()
    df = spark.createDataFrame(rows, SCHEMA)
    of = lambda **how: {r.page_id: r.text for r in html_extract.extract_main_text(df, **how).collect()}
    assert of() == texts
    changed = lambda **how: sum(t != texts[i] for i, t in of(**how).items())
    assert changed(least_pages=10**9) == changed(threshold=-1, least_share=-1) == changed(least_share=-1) == len(rows)
