"""Text expressions: terms, token estimates, sentences, identity text and citation markers.

Everything here builds Catalyst expressions; only Unicode normalisation, which Spark lacks, is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: what a Latin token and a CJK run are.
LATIN_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.+-]*"
CJK_RUN = r"[\u3400-\u4DBF\u4E00-\u9FFF]+"
CJK_CHAR = r"[\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"
WORD = r"[A-Za-z0-9]+(?:[._+/-][A-Za-z0-9]+)*"
SENTENCE_END = r"(?<=[。！？!?；;.])"
CASE_NUMBER = r"\((\d{4})\)([一-鿿A-Za-z0-9]{1,30}?)第?(\d{1,10})号"
# Fixed pattern: references to statute chunks (L..:C1) and decision chunks (C..:S1) in either kind of bracket.
CITATION = r"\[(?:L[A-Za-z0-9-]+:C\d+|C[A-Za-z0-9-]+:S\d+)\]|【(?:L[A-Za-z0-9-]+:C\d+|C[A-Za-z0-9-]+:S\d+)】"
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"
UNICODE_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def latin_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0)), F.lower)


def cjk_grams(text: Column, sizes: Sequence[int]) -> Column:
    """All n-grams of every CJK run: run by run, size by size."""
    runs = F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))

    def grams(run: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - size + 1)
        return F.when(F.length(run) >= size, F.transform(starts, lambda i: run.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, lambda run: F.flatten(F.array(*[grams(run, n) for n in sizes]))))


def query_terms(text: Column, *, stop_terms: Sequence[str] = (), cjk_sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """Ordered distinct terms: Latin tokens, then CJK grams; stop terms go last."""
    if any(n <= 0 for n in cjk_sizes):
        raise ValueError("n-gram sizes must be positive")
    terms = F.array_distinct(F.concat(latin_tokens(text), cjk_grams(text, cjk_sizes)))
    return F.array_except(terms, F.array(*[F.lit(t.lower()) for t in stop_terms])) if stop_terms else terms


def index_parts(text: Column) -> Column:
    """Full-text index tokens: Latin tokens cut at anything but letters and digits, and CJK 2- and 3-grams."""
    tokens = F.concat(latin_tokens(text), cjk_grams(text, (2, 3)))
    return F.array_remove(F.flatten(F.transform(tokens, lambda t: F.split(t, r"[_.+-]+"))), "")


def term_weight(term: Column) -> Column:
    return F.when(F.length(term) >= 3, 2).otherwise(1)


def token_estimate(text: Column) -> Column:
    """CJK characters + Latin tokens + an eighth of the other characters; at least 1, but 0 for an empty text."""
    cjk = F.regexp_count(text, F.lit(CJK_CHAR))
    estimate = cjk + F.regexp_count(text, F.lit(WORD))
    rest = F.floor((F.length(text) - cjk) / 8).cast("int")
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(estimate + rest, F.lit(1)))


def sentences(text: Column) -> Column:
    """Non-blank trimmed sentences; a sentence ends after its closing mark."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, UNICODE_ENDS, "")), lambda s: F.length(s) > 0)


def collapsed(text: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, UNICODE_SPACE, " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def identity_hash(text: Column) -> Column:
    """SHA-256 of the text in compatibility form, white space collapsed."""
    return F.sha2(F.encode(collapsed(nfkc(text)), "UTF-8"), 256)


def case_number(text: Column) -> Column:
    """``(year)court type serial号`` in compatibility form, without white space and leading zeros; null if there is none."""
    plain = F.regexp_replace(nfkc(text), UNICODE_SPACE, "")
    part = lambda i: F.regexp_extract(plain, CASE_NUMBER, i)
    return F.when(part(3) != "", F.concat(F.lit("("), part(1), F.lit(")"), part(2), part(3).cast("bigint").cast("string"), F.lit("号")))


def citations(text: Column) -> Column:
    """Ordered distinct references, brackets removed."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: m.substr(F.lit(2), F.length(m) - 2)))


def strip_citations(text: Column, available: Column) -> Column:
    """Known references in square brackets, unknown ones removed."""
    marks = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    between = F.split(text, CITATION, -1)
    inner = F.transform(marks, lambda m: m.substr(F.lit(2), F.length(m) - 2))
    shown = F.concat(F.transform(inner, lambda r: F.when(F.array_contains(available, r), F.concat(F.lit("["), r, F.lit("]"))).otherwise("")), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def questions(text: Column) -> Column:
    """Trimmed questions of more than one character: what runs up to a question mark.  Every run between marks and line ends
    is taken once, with the sign that ends it if one does: a run without a question is not tried again from each character."""
    runs = F.regexp_extract_all(text, F.lit(r"[^\n。！？?!]++[\n。！？?!]?"), F.lit(0))
    asked = F.filter(runs, lambda r: F.right(r, F.lit(1)).isin("？", "?"))
    return F.filter(F.transform(asked, lambda q: F.trim(q)), lambda q: F.length(q) > 1)


# Fixed pattern: authority references in square brackets, which are numbered, and references to materials.
NUMBERED = r"\[(?:L[a-zA-Z0-9-]+:C\d+|C[a-zA-Z0-9-]+:S\d+)\]"


def numbered_citations(text: Column, *, markdown: bool = False) -> Column:
    """Authority references as numbers in order of first appearance; in markdown, these and material references as code."""
    marks = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(0))
    order, between = F.array_distinct(marks), F.split(text, NUMBERED, -1)
    shown = F.transform(marks, lambda m: F.concat(F.lit("["), F.array_position(order, m).cast("string"), F.lit("]")))
    out = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(out, r"\[(\d+|M\d+:C\d+)\]", "`[$1]`") if markdown else out


def cited_only(text: Column, references: Column) -> Column:
    """Those of ``references`` (an array, in its order) that the text cites in square brackets."""
    marks = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(0))
    return F.filter(references, lambda r: F.array_contains(marks, F.concat(F.lit("["), r, F.lit("]"))))


def issue(text: Column) -> Column:
    """A charge without its closing word."""
    return F.regexp_replace(F.regexp_replace(text, UNICODE_ENDS, ""), "罪$", "")


def preview(text: Column, n: int) -> Column:
    return F.substring(collapsed(text), 1, n)


# The tools that search, and what they search.
SEARCHES = {"search_case_materials": "案件材料", "search_legal_authorities": "法规依据", "search_guiding_cases": "相关案例"}


def search_description(tool: Column, query: Column) -> Column:
    """What a search is about, in 80 characters of its query; null for other tools or without a query."""
    what = F.lit(None).cast("string")
    for name, label in SEARCHES.items():
        what = F.when(tool == name, label).otherwise(what)
    return F.when(query != "", F.concat(F.lit("检索“"), preview(query, 80), F.lit("”相关的"), what))


def joined(*parts: Column) -> Column:
    """Non-empty parts, each a text or an array of texts, joined by a blank."""
    arrays = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
    return F.array_join(F.filter(F.flatten(F.array(*arrays)), lambda x: x.isNotNull() & (x != "")), " ")


def one(text: Column) -> Column:
    return F.array(text)
