"""Membership within one edit of a listed term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.operators.lexicon import Lexicon

# --- fixed values --------------------------------------------------------------
MIN_TERM = 5  # shorter terms match exactly only
ALPHABET = "[a-z0-9 ]"  # characters a query may have in place of, or in addition to, the term's


def deletions(text: Column) -> Column:
    """The string itself and every string with one character less."""
    return F.concat(
        F.array(text),
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
        ),
    )


def within_one_edit(query: Column, term: Column) -> Column:
    """One deletion of any character, or one new character taken from the alphabet."""
    outside_query = F.regexp_replace(query, ALPHABET, "")
    outside_term = F.regexp_replace(term, ALPHABET, "")
    return (F.levenshtein(query, term, 1) >= 0) & (
        (outside_query == outside_term) | (F.length(outside_query) < F.length(outside_term))
    )


def fuzzy_match(queries: DataFrame, terms: DataFrame, text: str = "query") -> DataFrame:
    """Distinct ``text`` values equal to a term or one edit away from a term of 5+ characters.

    Two strings within one edit share the string itself or a one-deletion variant, so both
    sides are expanded to these signatures (linear in the length) and joined on equality.
    """
    distinct = queries.select(F.col(text).alias("query")).distinct()
    listed = terms.select("term").distinct()
    exact = distinct.join(listed.select(F.col("term").alias("query")), "query", "left_semi")
    long_terms = listed.where(F.length("term") >= MIN_TERM).select(
        "term", F.explode(F.array_distinct(deletions(F.col("term")))).alias("signature")
    )
    signed = distinct.where(F.length("query") >= MIN_TERM - 1).select(
        "query", F.explode(F.array_distinct(deletions(F.col("query")))).alias("signature")
    )
    near = signed.join(
        long_terms,
        (signed["signature"] == long_terms["signature"])
        & within_one_edit(signed["query"], long_terms["term"]),
        "left_semi",
    ).select("query")
    return exact.unionByName(near).distinct().select(F.col("query").alias(text))


def fuzzy_subject_terms(content: DataFrame, lexicon_terms: DataFrame, longest: int) -> DataFrame:
    """Word-list rows ``(fuzzy_subject, term)`` for n-grams of ``norm_no_sw`` near a subject.

    The rows join the ordinary term table, so fuzzy profiles run the same rule plan.
    """
    from namesieve.functions.shape import grams  # local: only needed here

    subjects = lexicon_terms.where(F.col("list").isin("subject", "subject_modifier"))
    found = content.select(
        F.explode(grams(F.split("norm_no_sw", " "), longest + 1)).alias("g")
    ).select(F.col("g.term").alias("query"))
    return fuzzy_match(found, subjects).select(
        F.lit("fuzzy_subject").alias("list"), F.col("query").alias("term")
    )


def fuzzy_lexicon(content: DataFrame, lexicon_terms: DataFrame) -> Lexicon:
    """Lexicon for profiles with fuzzy subjects, closed over the strings in ``content``."""
    plain = Lexicon.compile(lexicon_terms)
    extra = fuzzy_subject_terms(content, lexicon_terms, plain.max_words("subject"))
    return Lexicon.compile(lexicon_terms.select("list", "term").unionByName(extra))
