"""Classification of lines that arrive as files in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namesieve.operators.lexicon import Lexicon
from namesieve.operators.rules import Profile, classify
from namesieve.session import checkpointed


class LabelSink:
    """Writes the labels of micro-batches, each batch once.

    A batch is written down before anything looks at it, so the source is read once; its distinct
    strings are labelled once.  Rows and a line of the ledger (``batch_id, rows, strings``) are kept in a
    folder of the batch's number, so a batch that is repeated after a failure replaces its own rows.
    """

    def __init__(self, target: str, lexicon: Lexicon, prof: Profile | None = None):
        self.target, self.lexicon, self.prof = target, lexicon, prof

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(batch.select("input"))
        labelled = classify(rows, self.lexicon, self.prof).withColumn("batch_id", F.lit(batch_id).cast("long"))
        labelled.write.mode("overwrite").json(f"{self.target}/rows/batch={batch_id}")
        counts = rows.agg(
            F.lit(batch_id).cast("long").alias("batch_id"), F.count("*").alias("rows"),
            F.count_distinct("input").alias("strings"),
        )
        counts.write.mode("overwrite").json(f"{self.target}/ledger/batch={batch_id}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """``batch_id, input, prediction`` of the batches in the ledger: unfinished ones are left out."""
        done = spark.read.schema("input STRING, prediction STRING, batch_id LONG, batch LONG").json(f"{self.target}/rows")
        return done.join(self.ledger(spark).select("batch_id"), "batch_id", "left_semi").select("batch_id", "input", "prediction")

    def ledger(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("batch_id LONG, rows LONG, strings LONG").json(f"{self.target}/ledger")


def classify_stream(
    spark: SparkSession,
    source: str,
    target: str,
    state: str,
    lexicon: Lexicon,
    prof: Profile | None = None,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Label every line of new files; the rows are read through ``LabelSink(target, ...)``."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(source)
        .select(F.col("value").alias("input"))
    )
    return (
        lines.writeStream.foreachBatch(LabelSink(target, lexicon, prof).write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
