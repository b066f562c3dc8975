"""From raw documents to packed training sequences, in five stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import readings
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import pack
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import tokenizer_path
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.tables import drop_stored, quoted, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null or empty text is rejected; rows that repeat are judged alike."""
    judged = quality_rules(docs, carry=tuple(docs.columns))
    # explode_outer keeps Spark from pushing the test below the features, where they would be computed twice
    return judged.select(F.explode_outer(F.when(F.col("kept"), F.array("carried"))).alias("r")).where("r is not null").select("r.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that of the smallest id, of several such that of the smallest hash of
    its text.  Rows decide, so an id of several texts stays with each that no smaller id has.  Rows without an id or
    without a word link with nothing and stay, repeated or not."""
    mark = F.xxhash64("text")
    groups = stored(ngram_jaccard_join(docs, k=5, percent=80, mark=mark), "groups")
    first = groups.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("w")).select(F.col("w.doc_id").alias("id"), F.col("w.mark").alias("mark"))
    linkable = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), mark.alias("mark"), linkable.alias("linkable"))
    kept = rows.where("linkable").join(first, ["id", "mark"], "left_semi")
    if not groups.where("component is not null").groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "mark"])
    return kept.unionByName(rows.where("not linkable")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller ids hold; those of which nothing is left go, and so do texts that are
    null or without a word.  Rows without an id are kept whole; words are joined by one space in all rows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup(docs, row=F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in others]))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col("row." + quoted(c)) for c in others}
    return cut.where("kept <> ''").select(*[columns[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, every file in the order of the mixture: sources side by side,
    the readings of a document apart.  A null source is a source of its own; a text without a word costs nothing; rows that
    repeat are dealt each by itself."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = readings(docs).repartition(files, F.floor(F.col("place") * files)).sortWithinPartitions("place")
    return mixed.select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens.  A null or empty text is its end mark alone."""
    return pack(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("packing", packed),
]

# Exact packing by column generation has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is a written table that the next one reads."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
