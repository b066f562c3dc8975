"""Queries by way of data sources, table functions and streams in place of calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import table_functions
from tessera.plans.base import ORACLES, query, table
from tessera.session import shared_folder
from tessera.sources import connector
from tessera.streaming import ledger_stream


@query("SELECT page_id AS id, url AS source, sha256(html) AS digest FROM pages WHERE page_id >= 10")
def corpus_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the corpus connector."""
    read = connector.register(spark).read.format("corpus").options(path=f"{sf}/pages.parquet", id="page_id", content="html", source="url").load()
    return read.where("id >= 10").select("id", "source", F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))


@query("SELECT doc_id AS id, source, sha256(text) AS digest FROM documents WHERE source IN (SELECT min(source) FROM documents) AND text IS NOT NULL")
def corpus_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of one source by the corpus connector."""
    read = connector.register(spark).read.format("corpus").options(path=f"{sf}/documents.parquet", id="doc_id", content="text", source="source").load()
    first = read.agg(F.min("source").alias("first")).first().first
    return read.where((F.col("source") == first) & F.col("content").isNotNull()).select("id", "source", F.sha2(F.encode("content", "UTF-8"), 256).alias("digest"))


@query(r"SELECT doc_id, sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS signs, true AS within FROM documents WHERE regexp_matches(text, '\S') GROUP BY doc_id")
def sql_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's chunks by SQL: no sign is lost, and none is over its budget."""
    table_functions.register(spark)
    return spark.sql(rf"""SELECT doc_id, sum(length(regexp_replace(c.content, '\\s', ''))) AS signs, max(c.tokens) <= 300 AS within
        FROM parquet.`{sf}/documents.parquet` d, LATERAL split_text(d.text, 200, 300) c GROUP BY doc_id""")


_ASKED = "SELECT text FROM benchmark ORDER BY item_id LIMIT 1"


@query(f"""WITH t AS (SELECT unnest(list_distinct(list_transform(regexp_extract_all(({_ASKED}), '[A-Za-z0-9][A-Za-z0-9_.+-]*'), lambda x: lower(x)))) AS term)
SELECT doc_id, sum(CASE WHEN length(term) >= 3 THEN 2 ELSE 1 END)::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, any_value(length(text)), doc_id) AS rank
FROM t JOIN documents ON contains(lower(text), term) GROUP BY doc_id QUALIFY rank <= 20""")
def sql_lexical_matches(spark: SparkSession, sf: str) -> DataFrame:
    """One item's ranking of the documents by SQL."""
    table_functions.register(spark)
    asked = table(spark, sf, "benchmark").orderBy("item_id").first().text
    return spark.sql(f"""WITH m AS (SELECT * FROM lexical_matches(TABLE(SELECT doc_id, text AS content FROM parquet.`{sf}/documents.parquet`), :asked, 20) ORDER BY score DESC, length, doc_id LIMIT 20)
        SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, length, doc_id) AS rank FROM m""", {"asked": asked})


@query(ORACLES["token_ledger_fold"])
def token_ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """``token_ledger_fold`` by keyed state over a stream of three micro-batches."""
    i, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "click", "settle").when(kind == "purchase", "release").otherwise("reserve")
    requests = table(spark, sf, "events").select(F.col("user_id").alias("scope"), i.alias("seq"), op.alias("op"), (i % 3).cast("string").alias("key"), (i % 4 * 50 + 50).alias("tokens"), (i % 5 * 40).alias("input_tokens"), (i % 5 * 20).alias("output_tokens"))
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ends = requests.agg(F.max("seq").alias("last")).first().last or 0
    for part in range(3):
        some = requests.where((F.col("seq") * 3 > ends * part) & (F.col("seq") * 3 <= ends * (part + 1)) | (F.lit(part == 0) & (F.col("seq") <= 0)))
        some.coalesce(1).write.parquet(f"{folder}/in/{part}")
    stream = ledger_stream.rocksdb(spark).readStream.schema(requests.schema).options(maxFilesPerTrigger=1, recursiveFileLookup="true").parquet(f"{folder}/in")
    out = ledger_stream.ledger_stream(stream, limit=600)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
