"""Writers.  Each one is a distributed write; none collects rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.operators.ranks import dense_positions
from namesieve.session import checkpointed


LINES_PER_FILE = 1_000_000


def write_ordered(
    lines: DataFrame, path: str, order: str = "line_no", total: int | None = None, per_file: int = LINES_PER_FILE
) -> None:
    """Text lines ``value`` in the order of a dense number, ``per_file`` numbers in each file.

    The file of a line follows from its number, so nothing is sampled and the input is run once.
    Without ``total``, one more than the largest number, the lines are written down before to find it.
    """
    if total is None:
        lines = checkpointed(lines.select(order, "value"))
        total = int(lines.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("n")).first().n)
    files = max(1, -(-total // per_file))
    place = F.floor(F.col(order) / per_file).cast("int")
    lines.repartitionById(files, place).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_tagged(df: DataFrame, path: str, total: int | None = None, per_file: int = LINES_PER_FILE) -> None:
    """Tab-joined ``fields`` in ``line_no`` order."""
    rows = df.select("line_no", F.array_join("fields", "\t").alias("value"))
    write_ordered(rows, path, "line_no", total, per_file)


def write_numbered_files(df: DataFrame, path: str, files: int, file_no: str = "file_no", value: str = "value") -> None:
    """Text file number k holds the lines of ``file_no`` k, in order of their text."""
    rows = df.select(F.col(file_no).cast("int").alias("_file"), F.col(value).cast("string").alias("value"))
    placed = rows.repartitionById(files, F.col("_file")).sortWithinPartitions("_file", "value")
    placed.select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """Headed CSV, optionally with a fixed number of records per file."""
    out = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if records_per_file:
        out = out.option("maxRecordsPerFile", records_per_file)
    out.csv(path)


# Files that one task writes in turn.
FILES_PER_TASK = 200


def write_chunks(df: DataFrame, path: str, records_per_file: int, *order: str) -> None:
    """Headed CSV in files of ``records_per_file``, all but the last one full, written by many tasks.

    The records of a task are a whole number of files: they are dealt by their place in ``order``.
    """
    placed = dense_positions(df, *order, out="_place")
    each = records_per_file * FILES_PER_TASK
    tasks = max(1, -(-df.count() // each))
    dealt = placed.repartitionById(tasks, F.floor(F.col("_place") / each).cast("int"))
    write_csv(dealt.sortWithinPartitions("_place").drop("_place"), path, records_per_file)


def write_sorted_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct strings in order, one per line."""
    df.select(F.col(column).alias("value")).distinct().orderBy("value").write.mode(
        "overwrite"
    ).text(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> list[str]:
    """Sparse features and encoded label as LibSVM lines; returns the label order.  Indices count from 1."""
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # the classes, a few
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    entries = F.arrays_zip(F.col(features)["indices"].alias("i"), F.col(features)["values"].alias("v"))
    texts = F.transform(entries, lambda e: F.concat_ws(":", (e["i"] + 1).cast("string"), e["v"].cast("string")))
    line = F.concat_ws(" ", number.cast("double").cast("string"), F.array_join(texts, " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return labels


def write_predictions_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
