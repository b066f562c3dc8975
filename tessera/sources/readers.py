"""Dataset readers: JSONL, JSON arrays, TREC and nested relevance judgments, markdown trees and manifests.

A malformed record is a rejected row with a reason, never an error; what is fatal for a whole file raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(record, reason): blank lines are skipped, a malformed line has no record and the reason ``malformed``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = StructType.fromDDL(f"{schema}, _bad string")
    parsed = lines.withColumn("r", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    names = [f.name for f in kind.fields if f.name != "_bad"]
    return parsed.select(F.when(~bad, F.struct(*[F.col(f"r.{n}").alias(n) for n in names])).alias("record"), F.when(bad, "malformed").alias("reason"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(ord, record) of a file that is one JSON array; anything else is an error when it is read."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{schema}>>")
    checked = F.when(F.trim("value").startswith("["), rows).otherwise(F.raise_error(F.lit("not a JSON array")))
    return whole.select(F.posexplode(checked).alias("ord", "record"))


def grade(value: Column) -> Column:
    """0 to 3, from a number or its digits; else null."""
    number = F.try_to_number(F.trim(value.cast("string")), F.lit("9")).cast("int")
    return F.when(number.between(0, 3), number)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade, reason) from lines of four fields."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    whole = F.size("p") == 4
    graded = grade(F.get("p", F.lit(3)))
    reason = F.when(~whole, "malformed").when(graded.isNull(), "invalid_grade")
    return parts.select(F.when(whole, F.get("p", F.lit(0))).alias("query_id"), F.when(whole, F.get("p", F.lit(2))).alias("doc_id"), F.when(whole, graded).alias("grade"), reason.alias("reason"))


def read_nested_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) from one JSON object of objects."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    each = whole.select(F.explode("m").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "g"))
    return each.select("query_id", "doc_id", grade(F.col("g")).alias("grade"))


def qrels_of_matches(records: DataFrame, *, query_id: str, matches: str) -> DataFrame:
    """Grade 1 for every id that a record lists."""
    return records.select(F.col(query_id).cast("string").alias("query_id"), F.explode(F.col(matches).cast("array<string>")).alias("doc_id"), F.lit(1).alias("grade"))


def read_qrels(spark: SparkSession, path: str, *, query_id: str = "query_id", matches: str = "match_id") -> DataFrame:
    """(query_id, doc_id, grade, reason) of a file of any of the three shapes, told by how it begins: records that list their
    matches (an array of them, or one a line), one object of objects, or lines of four fields."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("value")).first()
    if first is None:
        raise ValueError("the file holds no judgments")
    record = f"`{query_id}` string, `{matches}` array<string>"
    if first.value.startswith("["):
        records = read_json_array(spark, path, record).select("record.*")
    elif first.value.startswith("{") and f'"{matches}"' in first.value:
        records = read_jsonl(spark, path, record).where("record is not null").select("record.*")
    elif first.value.startswith("{"):
        nested = read_nested_qrels(spark, path)
        return nested.withColumn("reason", F.when(F.col("grade").isNull(), "invalid_grade"))
    else:
        return read_trec(spark, path)
    return qrels_of_matches(records, query_id=query_id, matches=matches).withColumn("reason", F.lit(None).cast("string"))


def settled_judgments(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, repeats); a pair with different grades is an error."""
    pairs = qrels.groupBy("query_id", "doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("other"), (F.count("*") - 1).alias("repeats"))
    agreed = F.when(F.col("grade") == F.col("other"), F.col("grade")).otherwise(F.raise_error(F.concat(F.lit("conflicting grades for "), F.col("query_id"), F.lit("/"), F.col("doc_id"))).cast("int"))
    return pairs.select("query_id", "doc_id", agreed.alias("grade"), "repeats")


def rejections(records: DataFrame) -> DataFrame:
    return records.where("reason is not null").groupBy("reason").agg(F.count("*").alias("rejected"))


def read_markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, body) of every .md file below ``path`` whose name has no leading underscore; ``meta`` maps the
    single-line keys of the front matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_]*.md").load(path)
    text = files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿|\r", "").alias("t"))
    head = F.regexp_extract("t", r"(?s)\A---\n(.*?)\n---\n?", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\w+:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r"^\w+:(.*)$", 1)), "^[\"']|[\"']$", "")))
    return text.select("path", F.map_from_entries(F.array_distinct(entries)).alias("meta"), F.regexp_replace("t", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def normalized_markdown(body: Column) -> Column:
    """Without blank lines and rules; heading, quote and bold marks stripped."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:#+|>+)\s*", ""), r"\*\*", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[-*_]{3,}$")), "\n")


def official_url(url: Column, hosts: list[str]) -> Column:
    """https, and the host or a subdomain of one of ``hosts``."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | host.endswith("." + h)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & fits, F.lit(False))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (name, size, sha256) with ``status``: ok, missing, size or hash."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha"))
    both = manifest.join(files, "name", "left")
    return both.select("name", F.when(F.col("found_size").isNull(), "missing").when(F.col("found_size") != F.col("size"), "size").when(F.col("found_sha") != F.col("sha256"), "hash").otherwise("ok").alias("status"))
