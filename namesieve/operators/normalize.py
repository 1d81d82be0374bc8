"""Preprocessing of a string column: base form, stripped form, form without stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.functions.text import (
    drop_words,
    normalize_name,
    normalize_name_v1,
    strip_enumerators,
)
from namesieve.operators.tokens import lookup_words


def preprocess(
    df: DataFrame,
    stop_words: tuple[str, ...],
    text: str = "input",
    generation: int = 2,
) -> DataFrame:
    """Add ``base`` (normalised), ``norm`` (enumerators stripped) and ``norm_no_sw``."""
    base = normalize_name(F.col(text)) if generation == 2 else normalize_name_v1(F.col(text))
    return (
        df.withColumn("base", base)
        .withColumn("norm", strip_enumerators(F.col("base")))
        .withColumn("norm_no_sw", without_stop_words("norm", stop_words))
    )


def without_stop_words(norm: str, stop_words: tuple[str, ...]) -> Column:
    """Drop stop words by a hash-set test against a bounded literal list."""
    if not stop_words:
        return F.expr(norm)
    return F.array_join(drop_words(f"split({norm}, ' ')", stop_words), " ")


def remove_stopwords_by_join(
    df: DataFrame, stop_terms: DataFrame, key: str, text: str = "norm"
) -> DataFrame:
    """The same for a stop-word table of any size, joined on the word.

    Rows that lose every word survive with an empty string.
    """
    position = df.select(key, F.posexplode(F.split(text, " ")).alias("pos", "word"))
    stops = stop_terms.select(F.col("term").alias("word")).distinct().withColumn("stop", F.lit(True))
    kept = (
        lookup_words(position, stops, "word")
        .where("stop IS NULL")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("kept"))
        .select(key, F.array_join(F.col("kept.word"), " ").alias("norm_no_sw"))
    )
    return df.join(kept, key, "left").withColumn(
        "norm_no_sw", F.coalesce(F.col("norm_no_sw"), F.lit(""))
    )
