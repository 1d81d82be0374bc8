"""The corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, packing.

Each stage works on all rows that its predecessor kept and its decisions take effect.  All but the
last return the columns of documents.  A row is known by its id and the hash of its text, so rows of
null or repeated ids do not take each other's verdict.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm import near, substrings, toxicity
from namesieve.llm.decontaminate import contamination
from namesieve.llm.queries import fit_toxicity, pack_documents
from namesieve.llm.ship import ship
from namesieve.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.3."""
    model = fit_toxicity(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return _where(docs, toxicity.score(_keyed(docs), model, "_row"), F.col("score") < 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    ship(spark)
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover; a document without words left goes.

    Texts that lose nothing stay as they are, blanks included.
    """
    ship(spark)
    cut = substrings.removed_rows(docs).where("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), F.col("kept_text").alias("_text")
    )
    # Rows equal in id and text lose the same.
    joined = docs.join(cut.groupBy("_id", "_tid").agg(F.min("_text").alias("_text")), _same_row(), "left")
    text = F.coalesce("_text", "text")
    rows = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_text").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return rows.where(F.col("_text").isNull() | (F.col("_text") != "")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _where(docs, contamination(_keyed(docs), items, "_row"), F.col("n_hit") == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    ship(spark)
    return pack_documents(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with ``_row``: the id and the hash of the text."""
    return docs.select(F.struct(F.col("doc_id").alias("id"), near.text_hash("text").alias("tid")).alias("_row"), "text")


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (near.text_hash("text") == F.col("_tid"))


def _where(docs: DataFrame, verdicts: DataFrame, passes) -> DataFrame:
    """Rows that no verdict fails: only the failing rows, the few, are matched."""
    failed = verdicts.where(~passes).select(F.col("_row.id").alias("_id"), F.col("_row.tid").alias("_tid")).distinct()
    return docs.join(failed, _same_row(), "left_anti")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Scores of trained models and tokens are not expressible in SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written to the shared checkpoint folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
