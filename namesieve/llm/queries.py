"""Queries of the numbered operators over the shared tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm import audit, bpe, chat, decontaminate, language, lines, near, packing, parsing, periods
from namesieve.llm import pages as web
from namesieve.llm import substrings, toxicity
from namesieve.llm.ship import ship

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words",
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicModel:
    """Model of the rows outside the held-out quarter."""
    train = toxicity.labelled_texts(docs.where(~held_out()), labels.where(~held_out()))
    return toxicity.fit_toxicity(docs, train)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(~held_out()))
    return language.identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    kind = rows.schema["conv_id"].dataType.simpleString()
    extra = spark.range(2).select(
        F.lit(-7).cast(kind).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return chat.digest(chat.read_back(chat.chat_windows(rows.union(extra))))


def op4_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.clean_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces).withColumnRenamed("key", "doc_id").drop("gap")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.remove_earlier(_table(spark, sf_dir, "documents")).drop("kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows of a null or repeated id are told apart by their text.
    docs = _table(spark, sf_dir, "documents").select(
        F.struct(F.col("doc_id").alias("id"), near.text_hash("text").alias("tid")).alias("row"), "text"
    )
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), "row")
    return found.select(
        F.col("row.id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.main_text(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), prepare=periods.plant)
    return periods.runs_digest(found)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language, op3_chat_windows, op4_clean_lines, op5_best_fit_packing, op6_jaccard_join,
        op7_token_counts, op8_prefix_free_parsing, op9_decontamination, op10_substring_dedup, op11_html_extraction,
        op12_filter_audit, op13_periodic_runs,
    )
}
