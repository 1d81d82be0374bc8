"""Overlap of word lists with a corpus, and corpus words that no list holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve.operators.lexicon import measured_side
from namesieve.operators.tokens import lookup_words

ENGLISH = ("en", "manual")


def mark_found(list_tokens: DataFrame, corpus_tokens: DataFrame) -> DataFrame:
    """List tokens with ``found``: does the corpus contain the token."""
    # only list tokens leave the corpus side, so its vocabulary is never shuffled whole
    listed = measured_side(list_tokens.select("token").distinct())
    seen = corpus_tokens.select("token").join(listed, "token", "left_semi").distinct()
    return lookup_words(list_tokens, seen.withColumn("found", F.lit(True)), "token").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def overlap(marked: DataFrame, by: str, distinct: bool) -> DataFrame:
    """``found, total, found_pct`` per language or per list."""
    rows = marked.dropDuplicates([by, "token"]) if distinct else marked
    return (
        rows.groupBy(by)
        .agg(F.count_if("found").alias("found"), F.count("*").alias("total"))
        .withColumn("found_pct", 100.0 * F.col("found") / F.col("total"))
    )


def list_flags(list_tokens: DataFrame) -> DataFrame:
    """Per token: is it in an English list, is it in another list."""
    english = F.col("lang").isin(*ENGLISH)
    return list_tokens.groupBy("token").agg(
        F.bool_or(english).alias("in_en"), F.bool_or(~english).alias("in_other")
    )


def flag_corpus(corpus_tokens: DataFrame, list_tokens: DataFrame) -> DataFrame:
    """Corpus tokens with ``found, found_en, found_others, found_novel``."""
    no = F.lit(False)
    return (
        lookup_words(corpus_tokens, list_flags(list_tokens), "token")
        .withColumn("found_en", F.coalesce("in_en", no))
        .withColumn("found_others", F.coalesce("in_other", no))
        .withColumn("found", F.col("found_en") | F.col("found_others"))
        .withColumn("found_novel", F.col("found_others") & ~F.col("found_en"))
        .drop("in_en", "in_other")
    )


def _labels() -> Column:
    # labels come from a closed set of two, so the collected set stays tiny
    return F.array_join(F.array_sort(F.collect_set("label")), ",")


def string_flags(flagged: DataFrame) -> DataFrame:
    """Any-flags and label set of every distinct string."""
    return flagged.groupBy("input").agg(
        *[F.bool_or(c).alias(c) for c in ("found", "found_en", "found_others", "found_novel")],
        _labels().alias("label_set"),
    )


def category(strings: DataFrame) -> DataFrame:
    return strings.withColumn(
        "type",
        F.when(F.col("found_novel"), "found novel")
        .when(F.col("found"), "found not novel")
        .otherwise("not found"),
    )


def category_share(strings: DataFrame) -> DataFrame:
    """Count and share of strings per category."""
    counts = category(strings).groupBy("type").agg(F.count("*").alias("n"))
    # the window sees the three counted categories only
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def label_set_counts(strings: DataFrame) -> DataFrame:
    return strings.groupBy("label_set").agg(F.count("*").alias("n"))


def unmatched_tokens(flagged: DataFrame) -> DataFrame:
    """Corpus tokens in no list: a sample string, the labels and the count."""
    return (
        flagged.where(~F.col("found"))
        .groupBy("token")
        .agg(F.min("input").alias("sample_input"), _labels().alias("labels"), F.count("*").alias("cnt"))
    )


def novel_tokens(list_tokens: DataFrame) -> DataFrame:
    """Tokens of non-English lists that no English list holds."""
    english = F.col("lang").isin(*ENGLISH)
    return (
        list_tokens.where(~english)
        .select("token")
        .distinct()
        .join(list_tokens.where(english).select("token").distinct(), "token", "left_anti")
    )
