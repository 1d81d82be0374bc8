"""Readers; all schemas are explicit and every record carries a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve.functions.text import language_of_path, repair_ragged, strip_label_prefix
from namesieve.operators.dataset import nested_docs, variant_docs
from namesieve.operators.lexicon import LISTS, measured_side, normalise_terms
from namesieve.operators.ranks import running_total

LABELLED = "input STRING, id STRING, label STRING, numdocs DOUBLE"
GOLD = "verified_label STRING, label STRING, flag STRING, input STRING"
NESTED = (
    "response STRUCT<docs: ARRAY<STRUCT<id: STRING, name: STRING,"
    " _childDocuments_: ARRAY<STRUCT<`variant.name`: STRING>>>>>"
)
VARIANTS = "response STRUCT<docs: ARRAY<STRUCT<id: STRING, `variant.name`: STRING>>>"
MATCHER = (
    "dataset STRING, classifier STRING, num_queries BIGINT, durations BIGINT,"
    " precision DOUBLE, recall DOUBLE"
)
GRANTS = ("id1", "id2", "freq", "org_xml1", "org_xml2", "matched_id", "matched_name")


def read_word_list(spark: SparkSession, paths: str | list[str], name: str) -> DataFrame:
    """``list, lang, term`` from files with one term per line; paths may hold wildcards."""
    lines = spark.read.text(paths).select(
        F.lit(name).alias("list"),
        language_of_path(F.col("_metadata.file_path")).alias("lang"),
        F.col("value").alias("term"),
    )
    return lines.where("term <> ''")


def read_dictionaries(
    spark: SparkSession, globs: dict[str, str | list[str]], keep_empty_terms: bool = True
) -> DataFrame:
    """All word lists as one normalised, distinct table.  ``globs`` maps list name to files."""
    unknown = set(globs) - set(LISTS)
    if unknown:
        raise ValueError(f"unknown word lists: {sorted(unknown)}")
    out = None
    for name, paths in globs.items():
        part = read_word_list(spark, paths, name)
        out = part if out is None else out.unionByName(part)
    return normalise_terms(out, keep_empty_terms)


def numbered_lines(spark: SparkSession, path: str | list[str], by_folder: bool = False) -> DataFrame:
    """``file, line_no, file_line, value``: positions over all files by path, and within each file.

    With ``by_folder`` the part files of a folder, in the order of their names, are one file.

    Files may be split.  A first pass counts the lines of each split; running totals by file and
    offset of the split give every split its first number, so numbers are dense and follow the files
    however the splits are scheduled.  Both passes plan the same splits; a line outside the numbers
    of its split means that a file changed in between and fails the job.
    """
    source = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    counted = source.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    numbered = running_total(counted, F.col("n"), "file", "start", out="upto").withColumn("base", F.col("upto") - F.col("n"))
    whole = F.regexp_extract("file", "^(.*)/[^/]*$", 1) if by_folder else F.col("file")
    in_file = F.col("base") - F.min("base").over(W.partitionBy(whole))
    splits = measured_side(numbered.select("file", "start", "first", "n", "base", in_file.alias("file_base")))
    offset = F.col("at") - F.col("first")
    checked = F.when((offset >= 0) & (offset < F.col("n")), offset).otherwise(
        F.raise_error(F.lit("a file changed while its lines were numbered")).cast("long")
    )
    lines = source.join(splits, ["file", "start"]).withColumn("offset", checked)
    return lines.select(
        "file", (F.col("base") + F.col("offset")).alias("line_no"),
        (F.col("file_base") + F.col("offset")).alias("file_line"), "value",
    )


def tagged_columns(fields: Column, fixed_column: int | None = None) -> Column:
    """0-based positions of the markup fields of a record."""
    if fixed_column is not None:
        return F.array(F.lit(fixed_column))
    wide = F.array(F.lit(3), F.lit(4))
    return F.when(F.size(fields) == 15, wide).otherwise(F.array(F.lit(2), F.lit(3)))


def split_tagged(lines: DataFrame, fixed_column: int | None = None) -> DataFrame:
    """``line_no, fields, xml_cols`` from ``line_no, value``."""
    stripped = F.regexp_replace("value", r"^[ \n\r]+|[ \n\r]+$", "")
    fields = F.split(stripped, "\t")
    return lines.select("line_no", fields.alias("fields")).withColumn(
        "xml_cols", tagged_columns(F.col("fields"), fixed_column)
    )


def read_tagged(spark: SparkSession, path: str, fixed_column: int | None = None) -> DataFrame:
    return split_tagged(numbered_lines(spark, path), fixed_column)


def markup_cells(tagged: DataFrame) -> DataFrame:
    """One row per markup field: ``line_no, col, xml``."""
    return tagged.select("line_no", "fields", F.explode("xml_cols").alias("col")).select(
        "line_no", "col", F.get("fields", F.col("col")).alias("xml")
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LABELLED).option("header", True).option("escape", '"').csv(path)
    return rows.fillna({"numdocs": 1.0})


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(GOLD).option("sep", "\t").option("quote", "").csv(path)
    return rows.withColumn("verified_label", strip_label_prefix(F.col("verified_label")))


def read_nested_docs(spark: SparkSession, path: str) -> DataFrame:
    return nested_docs(spark.read.schema(NESTED).option("multiLine", True).json(path))


def read_variant_docs(spark: SparkSession, path: str) -> DataFrame:
    return variant_docs(spark.read.schema(VARIANTS).option("multiLine", True).json(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("input"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``abbreviation, replacement``; the last line of each abbreviation over all files by path."""
    from namesieve.operators.tokens import last_mapping

    parsed = F.from_csv("value", F.lit("abbreviation STRING, replacement STRING"), {"escape": '"'})
    # The first line of every file is its header.
    rows = numbered_lines(spark, path).where("file_line > 0 AND value <> ''")
    return last_mapping(rows.select("line_no", parsed.alias("row")).select("line_no", "row.*"))


def read_matcher_results(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated results.  The header, with or without a byte-order mark, is skipped."""
    return spark.read.schema(MATCHER).option("header", True).option("sep", ";").option(
        "enforceSchema", True
    ).csv(path)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    """Ragged tab-separated lines: tabs after the fifth belong to the last field."""
    fields = F.split(repair_ragged(F.col("value")), "\t")
    return spark.read.text(path).select(
        *[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(GRANTS)]
    )


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """``lang, source, target`` from a JSON list of ``[lang, [[source, target], ...]]``."""
    # mixed arrays: the outer pair is read as strings, the second string is JSON again
    raw = spark.read.option("wholetext", True).text(path)
    entries = raw.select(
        F.explode(F.from_json("value", "ARRAY<ARRAY<STRING>>")).alias("entry")
    ).select(
        F.get("entry", F.lit(0)).alias("lang"),
        F.explode(F.from_json(F.get("entry", F.lit(1)), "ARRAY<ARRAY<STRING>>")).alias("pair"),
    )
    return entries.select(
        "lang",
        F.get("pair", F.lit(0)).alias("source"),
        F.get("pair", F.lit(1)).alias("target"),
    )
