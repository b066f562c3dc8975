"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fill_middle, language_id, license_scan, mixing, personal_data
from tessera.llm import quality_rules as rules
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.embedding_dedup import oracle as embedding_dedup_oracle
from tessera.llm.html_extract import extract_main_text
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import pack
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.tables import table
from tessera.llm.toxicity import score_toxicity, train
from tessera.llm.vector_codes import oracle as vector_codes_oracle
from tessera.llm.vector_codes import vector_codes


def _fold(col: str, folds: int) -> Column:
    return F.crc32(F.col(col).cast("string")) % folds


def _held_out(folds: int, fold: int) -> Column:
    """Whether a document is in the fold that nothing is learned from; one without an id isn't."""
    return F.coalesce(_fold("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.train(docs, allowed=_fold("id", 3) != 1)
    return language_id.identify(docs, profiles).select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, allowed=_fold("id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def personal_data_digests(docs: DataFrame, model: dict) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as one string."""
    found = personal_data.find_personal_data(docs, model)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(of_kind, personal_data.KINDS)
    listed = personal_data.span_list
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("base"), F.col("added")).alias("spans"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data_digests(docs, personal_data.train(docs))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with the digests of its outputs and of the texts rebuilt from them."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    made = fill_middle.fill_in_middle(docs)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_packing": op6_packing,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_license_scan": op8_license_scan,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_personal_data": op12_personal_data,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_source_mixing": mixing.oracle(),
    "op3_quality_rules": rules.oracle(),
    "op5_embedding_dedup": embedding_dedup_oracle(),
    "op8_license_scan": license_scan.oracle(),
    "op11_vector_codes": vector_codes_oracle(),
    "op13_fill_in_middle": fill_middle.oracle(),
}
