"""Acronym tables built from labelled strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namesieve.functions.shape import extract_acronyms


def with_acronyms(df: DataFrame, text: str = "input") -> DataFrame:
    """Rows that hold at least one acronym, with the array column ``acronyms``."""
    return df.withColumn("acronyms", extract_acronyms(F.col(text))).where(F.size("acronyms") > 0)


def ambiguous_acronyms(df: DataFrame, id_col: str = "id", text: str = "input") -> DataFrame:
    """Acronym tuples tied to two or more ids, with the number of ids.

    Ids are made distinct per tuple before they are counted, so a frequent tuple never
    gathers its rows in one task.
    """
    pairs = (
        with_acronyms(df, text)
        .select(F.array_join("acronyms", " ").alias("acronyms"), F.col(id_col).alias("id"))
        .distinct()
    )
    return (
        pairs.groupBy("acronyms")
        .agg(F.count("id").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("n_ids >= 2")
    )


def ambiguous_acronym_ids(df: DataFrame, id_col: str = "id", text: str = "input") -> DataFrame:
    """The ids behind each ambiguous tuple, one row per pair."""
    ambiguous = ambiguous_acronyms(df, id_col, text).select("acronyms")
    pairs = (
        with_acronyms(df, text)
        .select(F.array_join("acronyms", " ").alias("acronyms"), F.col(id_col).alias("id"))
        .distinct()
    )
    return pairs.join(ambiguous, "acronyms", "left_semi")


def acronym_whitelist(*sources: DataFrame, text: str = "input") -> DataFrame:
    """Distinct acronym tuples of several sources, joined by blanks."""
    out = None
    for source in sources:
        part = with_acronyms(source, text).select(F.array_join("acronyms", " ").alias("acronym"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
