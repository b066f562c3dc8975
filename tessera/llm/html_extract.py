"""Main-text extraction with a site style tree.

Pages of one host are merged by node: a node is the path of (tag, class or id) labels from the root.  Over the host's
distinct pages (copies of a page count once) two distributions are counted for each node, that of its content (a hash
of its text) and that of its presentation (a hash of its children's labels).  Their normalised entropies are 0 where
all pages agree and 1 where all differ.  Two importances decide which branches go from every page of the host:

- a content node whose text hardly varies (both entropies weighed together, below ``threshold``) is boilerplate; inside
  the article, where headings may repeat, only if it also has the name of another part (a box to share or subscribe);
- outside the article, the children of one presentation node compete by information, the entropy of their content
  times their mean length.  In a template (a presentation node whose own children hardly vary) one with less than
  ``least_share`` of the greatest information goes.  Of the others those beside a branch that holds the article, and
  those labelled as a menu, footer, sidebar or the like, go unless they are the most informative.

The tree judges nodes that stand in at least ``least_pages`` and ``least_part`` of a host's distinct pages, so the list
of a host's low nodes is at most the nodes of 1 / ``least_part`` pages, however many pages there are.  Where it has no
evidence, on hosts with fewer pages and for rarer nodes, labels alone decide: blocks outside the article (else the main
element) go, and landmark tags and roles and a few names.

Removed before the tree: scripts, styles, media and forms, hidden elements and what it can't see because it varies,
adverts and reader comments.  Inside an article nothing goes by its name but elements named exactly as adverts or
comments, and by its tag only menus, asides and footers.  An element that holds the article or most of the page's
text always stays (a form round the page, a layout class that names a sidebar).  An element of code or media that its
own tag does not close is empty: what follows it stays.  <head> ends at the first element or text of the body.  A
page of which nothing would be left keeps what was dropped.

Text rules: character references are decoded, white space inside a block becomes one space, blocks are joined in
page order by one space.  Null or empty html gives an empty text; null urls share one host; ids may be null or
repeat, each row is extracted by itself.  A page is parsed once; the statistics are counted by hashes, so a host
with very many pages meets in no single task.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import broadcast_if_small, stored

# HTML's element kinds, and labels of page parts that are not the article.
RAW = frozenset("script style noscript iframe textarea".split())  # content is no markup
MEDIA = frozenset("template svg object select button canvas video audio annotation annotation-xml".split())  # content is markup, never the article
HEAD = frozenset("base link meta title script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
FLOWING = INLINE | MEDIA
LANDMARKS = frozenset("nav footer aside header dialog menu".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
VARYING = re.compile(r"ads?|advert\w*|ad[-_].+|.+[-_]ads?|adsbygoogle|sponsor\w*|comments?|comment-?list|comments?[-_](?:area|list|section|body)|disqus.*", re.I)  # adverts and comments
SURE = frozenset("ad ads advert advertisement adsbygoogle sponsored comments commentlist comment-list comments-area comments-section disqus_thread".split())  # even inside an article
PARTS = re.compile(
    r"(?:(?:site|page|main|top|global|primary|cookie|side|bottom)[-_])?(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|banner|cookies?|consent|notice|popup|modal|overlay|"
    r"newsletter|subscribe|share|sharing|social|related|recommended|promo|replies|respond|discussion|pagination|pager|toolbar|widget|search|login|copyright)"
    r"(?:[-_](?:bar|box|area|list|links|notice|banner|wrapper|container|inner|top|left|right|nav|menu))*",
    re.I,
)  # other parts of a page, outside the article
SECONDARY = re.compile(r"comment|repl|promo|advert|sponsor|related", re.I)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@lru_cache(8192)
def _label(tag: str, attributes: str, inside: bool) -> tuple[str, str, bool]:
    """An element's label in the style tree, its kind: '' for content, 'part' for a part of the page that is not the
    article, 'never' for what is no part of any; and whether it has a part's name ``inside`` an article, which says little."""
    label, named = tag, False
    part, never = tag in LANDMARKS and not (inside and tag == "header"), tag in FORMS
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            never = True
        elif name == "role":
            part = part or value.lower() in ROLES
        elif name in ("class", "id"):
            label += ("." if name == "class" else "#") + re.sub(r"\d+", "0", value)
            names = value.lower().split()
            if inside:
                never = never or not SURE.isdisjoint(names)
                named = named or any(PARTS.fullmatch(n) or VARYING.fullmatch(n) for n in names)
            elif tag not in INLINE:
                never = never or any(VARYING.fullmatch(n) for n in names)
                part = part or any(PARTS.fullmatch(n) for n in names)
    if tag in ("html", "body"):
        return label, "", False
    if tag in ("article", "main") and not SECONDARY.search(label):  # comments and teasers are often articles themselves
        return label, "", False
    return label, "never" if never or part and inside else "part" if part else "", named


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(65536)
def _node(path: tuple[str, ...]) -> int:
    return _hash(" > ".join(path))


@dataclass
class _Part:
    """An element that is dropped unless ``_dropped`` decides otherwise."""

    tag: str
    label: str
    kind: str
    closed: bool = False


@lru_cache(64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}\b[^>]*>", re.I)


_RESUMES = re.compile(r"<(?:body|article|main)\b", re.I)


def _after_raw(page: str, at: int, tag: str) -> int:
    """Where to go on after an element of raw content that opens before ``at``; ``at`` if it is empty."""
    end = _ends(tag).search(page, at)
    if tag in ("script", "style"):  # code may hold anything
        while end and not end[1]:
            end = _ends(tag).search(page, end.end())
        if not end:
            found = _RESUMES.search(page, at)
            return found.start() if found else len(page)
        return end.end()
    if not end or not end[1] or tag != "noscript" and _RESUMES.search(page, at, end.start()):
        return at
    return end.end()


def _dropped(parts: list[_Part], blocks: list[list[tuple]]) -> set[int]:
    """The numbers of the parts that are dropped."""
    chars: dict[int, int] = {}  # text outside links in a part
    articles: dict[tuple[int, ...], int] = {}  # text of articles by the parts round them
    total = 0
    lost = {i for i, part in enumerate(parts) if part.tag not in MEDIA or part.closed}
    media = {i for i in lost if parts[i].tag in MEDIA or parts[i].tag == "head"}
    for block in blocks:
        for text, _, chain, holders, link in block:
            n = len(text.strip())
            if link or not n or any(i in media for i in chain):
                continue
            total += n
            chain = tuple(i for i in chain if i in lost)
            for i in chain:
                chars[i] = chars.get(i, 0) + n
            if holders is not None and chain == (outside := tuple(i for i in holders if i in lost)):
                articles[outside] = articles.get(outside, 0) + n
    dropped = set(lost)
    for chain, n in articles.items():
        before = max((articles.get(chain[:i], 0) for i in range(len(chain))), default=0)
        if chain and n > before and not any(parts[i].tag in ("article", "main") for i in chain) and (not before or not any(SECONDARY.search(parts[i].label) for i in chain)):
            dropped -= set(chain)
    dropped -= {i for i, n in chars.items() if 2 * n > total and parts[i].tag not in LANDMARKS and not (SECONDARY.search(parts[i].label) and total > n)}
    if total and not any(dropped.isdisjoint(chain) and text.strip() for block in blocks for text, _, chain, *_ in block):
        return media
    return dropped


@dataclass
class Page:
    """What may be main text: blocks (path, text, whether labels alone would keep it), and the labels of each node's
    children.  ``parts`` are the nodes of page parts that aren't the article, ``named`` those inside it that have such a name."""

    blocks: list[tuple[tuple[str, ...], str, bool]] = field(default_factory=list)
    children: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    parts: set[tuple[str, ...]] = field(default_factory=set)
    named: set[tuple[str, ...]] = field(default_factory=set)


def parse_page(page: str) -> Page:
    blocks: list[list[tuple]] = []  # pieces of text: text, path, parts that hold it, parts round its article, whether in a link
    labels: list[tuple[tuple[str, ...], str, tuple[int, ...]]] = []
    parts: list[_Part] = []
    stack: list[tuple[str, tuple[int, ...], tuple[int, ...] | None]] = []  # tag, the parts that hold it, itself included, and those round its article
    paths: list[tuple[str, ...]] = [()]
    text: list[tuple] = []
    links = 0
    out = Page()

    def flush() -> None:
        if text:
            blocks.append(text.copy())
            text.clear()

    def close(depth: int) -> None:
        nonlocal links
        if any(x[0] not in FLOWING for x in stack[depth:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[depth:])
        del stack[depth:], paths[depth + 1 :]

    def innermost(tags: tuple[str, ...] | frozenset, until: tuple[str, ...] | frozenset = ()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in until:
                return -1
        return -1

    def add(piece: str) -> None:
        text.append((piece, paths[-1], *(stack[-1][1:] if stack else ((), None)), links > 0))

    at = 0
    while m := _TOKEN.search(page, at):
        in_head = bool(stack) and stack[-1][0] == "head"
        if m.start() > at:
            if in_head and not page[at : m.start()].isspace():
                close(len(stack) - 1)
                in_head = False
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if (i := innermost((tag,))) >= 0:
                if tag in MEDIA:
                    parts[stack[i][1][-1]].closed = True
                close(i)
            elif tag == "p":
                flush()
            continue
        attributes = m[3] or m[6] or ""
        empty = attributes.endswith("/")
        if in_head and tag not in HEAD:
            close(len(stack) - 1)
            in_head = False
        if tag in RAW or tag == "title" and in_head:
            at = at if empty else _after_raw(page, at, tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr") and text:
                add(" ")
            continue
        if tag in ("body", "article", "main") and (i := innermost(MEDIA - {"template"})) >= 0:  # not closed
            close(next(k for k in range(i + 1) if stack[k][0] in MEDIA))
        elif tag in CLOSES_P and (i := innermost(("svg", "math"), ("foreignobject", "desc", "annotation-xml"))) >= 0:
            close(i)
        if tag in CLOSES_P and (i := innermost(("p",), ("table", "td", "th", "button", "article"))) >= 0:
            close(i)
        elif tag in SAME and (i := innermost((tag, "dt", "dd") if tag in ("dt", "dd") else (tag, "td", "th") if tag in ("td", "th") else (tag,), SAME[tag])) >= 0:
            close(i)
        if tag not in FLOWING:
            flush()
        chain, holders = stack[-1][1:] if stack else ((), None)
        label, kind, named = _label(tag, attributes, holders is not None)
        if named:
            out.named.add((*paths[-1], label))
        if tag in MEDIA or tag == "head":
            kind = "never"
        if kind:
            parts.append(_Part(tag, label, kind, tag in MEDIA and empty))
            chain = (*chain, len(parts) - 1)
            if kind == "part":
                out.parts.add((*paths[-1], label))
        labels.append((paths[-1], label, chain))
        if not empty:
            links += tag == "a"
            stack.append((tag, chain, chain if holders is None and tag in ("article", "main") else holders))
            paths.append((*paths[-1], label))
    if at < len(page) and not re.match(r"</?[a-zA-Z!][^>]*\Z", page[at:]):
        if stack and stack[-1][0] == "head":
            close(len(stack) - 1)
        add(page[at:])
    flush()

    dropped = _dropped(parts, blocks)
    never = {i for i in dropped if parts[i].kind == "never"}
    for block in blocks:
        pieces = [x for x in block if never.isdisjoint(x[2])]
        joined = "".join(x[0] for x in pieces)
        words = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
        if words:
            out.blocks.append((pieces[0][1], words, all(dropped.isdisjoint(x[2]) for x in pieces)))
    for path, label, chain in labels:
        if never.isdisjoint(chain):
            out.children.setdefault(path, []).append(label)
    return out


def parse(page: str) -> tuple[list[tuple[tuple[str, ...], str]], dict[tuple[str, ...], list[str]]]:
    """Blocks that labels alone keep, in page order as (path, text), and the labels of each node's children."""
    got = parse_page(page)
    return [(path, words) for path, words, plain in got.blocks if plain], got.children


def _is(label: str, tag: str) -> bool:
    return label == tag or label.startswith((tag + ".", tag + "#"))


def main_blocks(blocks: list[tuple[tuple[str, ...], str]]) -> list[tuple[tuple[str, ...], str]]:
    for part in ("article", "main"):
        if inside := [b for b in blocks if any(_is(x, part) for x in b[0])]:
            return inside
    return blocks


def _depth(path: tuple[str, ...], part: str) -> int:
    """The length of the path to its outermost element of that tag; 0 if there is none."""
    return next((i + 1 for i, x in enumerate(path) if _is(x, part)), 0)


INSIDE, PART, HOLDS, NO_BRANCH, NAMED = 1, 2, 4, 8, 16
_NO_BRANCH = re.compile(rf"(?:h[1-6]|{'|'.join(sorted(INLINE))})(?:[.#]|\Z)", re.S)


def tree_of(page: Page) -> tuple[list[bool], dict[tuple[str, ...], tuple[list[str], int]]]:
    """Which blocks labels alone make the main text, and the texts and flags of every node.

    Flags: inside the article, labelled as another part, holding the article, a heading or an inline element, inside the
    article with the name of another part.
    """
    kept = [b for b in page.blocks if b[2]]
    region = next((part for part in ("article", "main") if any(_depth(b[0], part) for b in kept)), None)
    plain = [b[2] and (region is None or _depth(b[0], region) > 0) for b in page.blocks]
    nodes: dict[tuple[str, ...], tuple[list[str], int]] = {}
    for (path, words, _), main in zip(page.blocks, plain, strict=True):
        depth = _depth(path, region) if region and main else 0
        for i in range(1, len(path) + 1):
            texts, flags = nodes.get(path[:i], ([], 0))
            texts.append(words)
            if depth:
                flags |= HOLDS if i <= depth else INSIDE
            if path[:i] in page.parts:
                flags |= PART
            if path[:i] in page.named:
                flags |= NAMED
            if _NO_BRANCH.match(path[i - 1]):
                flags |= NO_BRANCH
            nodes[path[:i]] = (texts, flags)
    return plain, nodes


_SEEN = "node: long, parent: long, content: long, style: long, chars: long, flags: int"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([(n, pa.int64()) for n in ("node", "parent", "content", "style", "chars")] + [("flags", pa.int32())]))
    for batch in _small(batches):
        nodes, texts, plain, seen, same = [], [], [], [], []
        for html in batch.column("html").to_pylist():
            page = parse_page(html or "")
            flags, tree = tree_of(page)
            plain.append([1 if main else 0 if ok else 2 for main, (_, _, ok) in zip(flags, page.blocks, strict=True)])
            texts.append([w for _, w, _ in page.blocks])
            nodes.append([[_node(path[: i + 1]) for i in range(len(path))] for path, _, _ in page.blocks])
            same.append(_hash("\n".join(texts[-1])))
            rows = []
            for path, (words, mark) in tree.items():
                rows.append({"node": _node(path), "parent": _node(path[:-1]), "content": _hash("\n".join(words)), "style": _hash(" ".join(page.children.get(path, ()))), "chars": sum(map(len, words)), "flags": mark})
            seen.append(rows)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("id", "url", "host")), pa.array(texts, pa.list_(pa.string())), pa.array(nodes, pa.list_(pa.list_(pa.int64()))), pa.array(plain, pa.list_(pa.int32())), pa.array(seen, kinds), pa.array(same, pa.int64())],
            ["id", "url", "host", "texts", "nodes", "plain", "seen", "page"],
        )


def _entropy(seen: DataFrame, what: str, *more: Column) -> DataFrame:
    """Normalised entropy of ``what`` over the pages of each (host, node), and the sums ``more``."""
    each = seen.groupBy("host", "node", what).agg(F.count("*").alias("c"), F.sum("chars").alias("chars"), F.bit_or("flags").alias("flags"), F.min("parent").alias("parent"))
    total = each.groupBy("host", "node").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("s"), *more)
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return total.withColumn(what, F.round(entropy, 9)).drop("s")


def low_nodes(once: DataFrame, *, threshold: float, style_weight: float, least_pages: int, least_part: float, least_share: float) -> DataFrame:
    """(host, low, parts) for every host with enough distinct pages (host, seen): the nodes whose branches go, and the
    labelled parts that were judged."""
    hosts = once.groupBy("host").agg(F.count("*").alias("distinct_pages")).where(F.col("distinct_pages") >= least_pages)
    seen = once.join(hosts, "host").select("host", F.explode("seen").alias("s")).select("host", "s.*")
    content = _entropy(seen, "content", F.sum("chars").alias("chars"), F.bit_or("flags").alias("flags"), F.min("parent").alias("parent"))
    weighed = content.join(_entropy(seen, "style").drop("pages"), ["host", "node"]).join(hosts, "host")
    weighed = weighed.withColumn("information", F.round(F.col("content") * F.col("chars") / F.col("pages"), 6))
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    family = weighed.groupBy("host", "parent").agg(F.max("information").alias("best"), F.bool_or(flag(HOLDS)).alias("beside_article"))
    above = weighed.select("host", F.col("node").alias("parent"), F.col("style").alias("template"))
    judged = weighed.where((F.col("pages") >= least_pages) & (F.col("pages") >= F.col("distinct_pages") * least_part))
    judged = judged.join(family, ["host", "parent"]).join(above, ["host", "parent"], "left")
    repeated = (1 - style_weight) * F.col("content") + style_weight * F.col("style") < threshold
    small = (F.coalesce("template", F.lit(0.0)) < 0.5) & (F.col("information") < least_share * F.col("best")) & ~flag(NO_BRANCH)
    unclear = (F.col("beside_article") | flag(PART)) & (F.col("information") < F.col("best"))
    goes = F.when(flag(HOLDS), False).when(flag(INSIDE), repeated & flag(NAMED)).otherwise(repeated | small | unclear)
    lists = judged.groupBy("host").agg(F.collect_list(F.when(goes, F.col("node"))).alias("low"), F.collect_list(F.when(flag(PART), F.col("node"))).alias("parts"))
    return hosts.select("host").join(lists, "host", "left").select("host", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("low", "parts")])


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.1, style_weight: float = 0.1, least_pages: int = 3, least_part: float = 0.01, least_share: float = 0.15) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, host string, texts array<string>, nodes array<array<long>>, plain array<int>, seen array<struct<{_SEEN}>>, page long"
    parsed = stored(rows.mapInArrow(_parsed, schema), "parsed")
    once = parsed.groupBy("host", "page").agg(F.min("seen").alias("seen"))
    low = stored(low_nodes(once, threshold=threshold, style_weight=style_weight, least_pages=least_pages, least_part=least_part, least_share=least_share), "low")
    mine = F.array_distinct(F.flatten("nodes"))
    both = parsed.join(broadcast_if_small(low), "host", "left").withColumn("hit", F.array_intersect(mine, "low")).withColumn("known", F.array_intersect(mine, "parts"))
    plain = F.expr("filter(texts, (t, i) -> plain[i] = 1)")
    kept = F.expr("filter(texts, (t, i) -> not arrays_overlap(nodes[i], hit) and (plain[i] = 1 or plain[i] = 2 and arrays_overlap(nodes[i], known)))")
    text = F.when(F.col("low").isNull() | (F.size("kept") == 0), plain).otherwise(F.col("kept"))
    out = both.withColumn("kept", kept).select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(text, " ").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
