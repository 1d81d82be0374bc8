"""Queries of the readers and writers: a given table is written to files and read back from them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.operators.ranks import dense_positions
from namesieve.plans import inputs
from namesieve.plans.inputs import table
from namesieve.plans.registry import query
from namesieve.session import ensure_checkpoint_dir
from namesieve.sources import readers, writers


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{name}-{uuid4().hex}"


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, value``: orders by key as tab-separated lines."""
    fields = F.concat_ws("\t", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = table(spark, sf, "orders").select("o_orderkey", fields.alias("value"))
    return dense_positions(rows, "o_orderkey", out="line_no").select("line_no", "value")


@query
def line_numbers(spark, sf):
    """Two files of unequal size, each a folder of part files: the numbers of all lines follow the files."""
    lines = _order_lines(spark, sf)
    path = scratch(spark, "lines")
    early = F.col("value").like("%\tF\t%")
    for name, part in (("a", lines.where(early)), ("b", lines.where(~early))):
        dense = dense_positions(part.select(F.col("line_no").alias("old"), "value"), "old", out="line_no")
        writers.write_ordered(dense, f"{path}/{name}")
    read = readers.numbered_lines(spark, [f"{path}/a", f"{path}/b"], by_folder=True)
    return read.select("line_no", "file_line", F.substring_index("value", "\t", 1).cast("long").alias("o_orderkey"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, fields``: pages as records with markup in fields 2 and 3, or in 3 and 4 of fifteen."""
    xml = F.regexp_replace("html", r"[\t\n\r]", " ")
    plain = F.array("page_id", "url", xml, F.concat(F.lit("<li><a>"), "page_id", F.lit("</a></li>")))
    wide = F.concat(F.array("page_id", "url", F.lit("-")), F.array(xml), F.array_repeat(F.lit("x"), 11))
    pages = table(spark, sf, "pages").select("html", "url", F.col("page_id").cast("string").alias("page_id"), F.col("page_id").alias("no"))
    rows = pages.select("no", F.when(F.col("no") % 2 == 0, plain).otherwise(wide).alias("fields"))
    return dense_positions(rows, "no", out="line_no")


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, value``: the records as lines."""
    return _records(spark, sf).select("line_no", F.array_join("fields", "\t").alias("value"))


@query
def tagged_file(spark, sf):
    """Tagged records in several files, read back in their order with their markup fields."""
    path = scratch(spark, "tagged")
    writers.write_tagged(_records(spark, sf), path, per_file=40)
    cells = readers.markup_cells(readers.read_tagged(spark, path))
    return cells.select("line_no", "col", F.md5("xml").alias("xml"))


@query
def word_list_files(spark, sf):
    """Word lists written as one folder of files for each list and language, and read by wildcard."""
    path = scratch(spark, "words")
    lists = inputs.word_lists(spark, sf).where("list IN ('type', 'subject', 'location')")
    upper = lists.select(F.upper("term").alias("value"), "list", F.when(F.length("term") % 2 == 0, "fr").otherwise("en").alias("lang"))
    for name in ("type", "subject", "location"):
        own = upper.where(F.col("list") == name)
        own.where("lang = 'fr'").select("value").write.text(f"{path}/{name}.fr.txt")
        own.where("lang = 'en'").select("value").write.text(f"{path}/{name}.txt")
    return readers.read_dictionaries(spark, {n: f"{path}/{n}*.txt" for n in ("type", "subject", "location")})


@query
def labelled_file(spark, sf):
    """Labelled strings as headed CSV in files of at most a thousand records; missing weights become 1."""
    path = scratch(spark, "labelled")
    rows = inputs.labelled_segments(spark, sf).select(
        F.regexp_replace("input", r"[\r\n]", " ").alias("input"), F.col("doc_id").cast("string").alias("id"), "label",
        F.when(F.col("pos") % 3 > 0, F.col("numdocs").cast("double")).alias("numdocs"),
    )
    writers.write_csv(rows, path, records_per_file=1000)
    read = readers.read_labelled(spark, path)
    return read.groupBy("id", "label").agg(
        F.count("*").alias("n"), F.sum("numdocs").alias("numdocs"), F.sum(F.length("input")).alias("n_chars")
    )


@query
def chunk_sizes(spark, sf):
    """Records for each file when a table is split into files of 500."""
    path = scratch(spark, "chunks")
    writers.write_chunks(table(spark, sf, "orders").select("o_orderkey"), path, 500, "o_orderkey")
    read = spark.read.schema("o_orderkey LONG").option("header", True).csv(path)
    sizes = read.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("records"))
    return sizes.groupBy("records").agg(F.count("*").alias("files"))


@query
def gold_file(spark, sf):
    """A gold table without header; the prefix of its labels goes."""
    path = scratch(spark, "gold")
    rows = inputs.labels(spark, sf).select(
        F.concat_ws("\t", F.concat(F.lit("VER_"), "label"), "prediction", F.lit("x"), F.concat(F.lit('say "'), "doc_id")).alias("value")
    )
    rows.write.text(path)
    return readers.read_gold(spark, path)


@query
def line_file(spark, sf):
    """One string for each line, blank lines included."""
    path = scratch(spark, "plain")
    inputs.pieces(table(spark, sf, "conversations"), "text").select(F.col("input").alias("value")).write.text(path)
    return readers.read_lines(spark, path).groupBy("input").agg(F.count("*").alias("n"))


@query
def mapping_file(spark, sf):
    """Abbreviations over several files with headers: the last line of the last file wins."""
    path = scratch(spark, "mapping")
    rows = dense_positions(table(spark, sf, "orders"), "o_orderkey", out="no")
    value = F.concat(F.lower("o_orderpriority"), F.lit(',"'), "o_orderstatus", F.lit(", "), F.col("o_custkey").cast("string"), F.lit('"'))
    for name, part in (("a", rows.where("no % 4 = 0")), ("b", rows.where("no % 4 > 0"))):
        header = spark.range(1).select(F.lit(-1).cast("long").alias("no"), F.lit("abbreviation,replacement").alias("value"))
        lines = header.unionByName(part.select("no", value.alias("value")))
        writers.write_ordered(dense_positions(lines, "no", out="line_no"), f"{path}/{name}", per_file=1 << 62)
    return readers.read_mapping(spark, [f"{path}/a", f"{path}/b"])


@query
def result_file(spark, sf):
    """Semicolon-separated results behind a header with a byte-order mark."""
    path = scratch(spark, "results")
    totals = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("q"), F.sum((F.col("o_totalprice") * 100).cast("bigint")).alias("d")
    )
    body = totals.select(F.concat_ws(";", "o_orderpriority", "o_orderstatus", "q", "d", F.lit("0.5"), F.lit("")).alias("value"))
    header = spark.range(1).select(F.lit("﻿Dataset;Classifier;Num queries;Durations;Precision;Recall").alias("value"))
    numbered = header.withColumn("no", F.lit(0)).unionByName(body.withColumn("no", F.lit(1)))
    writers.write_ordered(dense_positions(numbered, "no", "value", out="line_no"), path, per_file=1 << 62)
    return readers.read_matcher_results(spark, path)


@query
def ragged_file(spark, sf):
    """Lines with too many tabs: those behind the fifth belong to the last field."""
    path = scratch(spark, "ragged")
    words = F.slice(F.split(F.regexp_replace("text", r"[\r\n]", " "), " "), 1, 12)
    docs = table(spark, sf, "documents").where("length(text) > 0")
    docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.array_join(words, "\t")).alias("value")).write.text(path)
    return readers.read_grants(spark, path)


@query
def sorted_lines(spark, sf):
    """Distinct tokens in order, one for each line."""
    path = scratch(spark, "sorted")
    tokens = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("token"))
    writers.write_sorted_lines(tokens, "token", path)
    return readers.numbered_lines(spark, path).select("line_no", F.col("value").alias("token"))


@query
def prediction_file(spark, sf):
    """Labels as JSON lines."""
    path = scratch(spark, "json")
    writers.write_predictions_json(inputs.labels(spark, sf).select("doc_id", "prediction"), path)
    return spark.read.schema("doc_id LONG, prediction STRING").json(path)


@query
def libsvm_file(spark, sf):
    """Embeddings as LibSVM lines with their labels in order."""
    path = scratch(spark, "libsvm")
    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.struct(
            F.sequence(F.lit(0), F.size("embedding") - 1).cast("array<long>").alias("indices"),
            F.transform("embedding", lambda v: F.round(v.cast("double"), 3) + 0.0).alias("values"),
        ).alias("features"),
    )
    writers.write_libsvm(rows, path)
    fields = F.split("value", " ")
    read = spark.read.text(path).select(
        F.get(fields, F.lit(0)).cast("double").alias("label"),
        F.substring_index(F.get(fields, F.lit(1)), ":", 1).cast("int").alias("first_index"),
        F.substring_index(F.get(fields, F.lit(1)), ":", -1).cast("double").alias("first_value"),
        F.size(fields).alias("n_fields"),
    )
    return read.groupBy("label", "first_index", "first_value", "n_fields").agg(F.count("*").alias("n"))


@query
def translation_file(spark, sf):
    """Pairs for each language in one JSON list, as the translation step leaves them."""
    path = scratch(spark, "translations")
    pairs = table(spark, sf, "nation").select(
        F.concat(F.lit("l"), F.col("n_regionkey").cast("string")).alias("lang"), F.array("n_name", F.lower("n_name")).alias("pair")
    )
    entry = pairs.groupBy("lang").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    text = F.concat(F.lit('["'), "lang", F.lit('",'), F.to_json("pairs"), F.lit("]"))
    whole = entry.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("]")).alias("value"))
    whole.write.text(path)
    return readers.read_translations(spark, path)
