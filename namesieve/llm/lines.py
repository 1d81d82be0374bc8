"""Line-first quality cleaning with built-in functions only.

Each line is judged by itself (closing punctuation, navigation, boilerplate, symbol noise);
failing lines go, and a document is kept only if enough of its text is left.

Defined results: a null or blank text has no words and is not kept; equal rows get equal results;
an empty table gives an empty table; other columns pass through, and names of the added columns
that clash with them are replaced by the added ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\f\r"

# Phrases of lines that are not prose.
BOILERPLATE = (
    r"all rights reserved|cookie (?:policy|settings|preferences)|privacy policy|terms of (?:use|service)"
    r"|licensed under|spdx-license|copyright|permission is hereby granted|without warrant"
    r"|enable javascript|subscribe to our|sign up for|click here|log ?in to continue|share this"
)
MENU_MARKS = "|>»›"
NAVIGATION = r"^(?:home|menu|next|previous|back to top|skip to content)$"
CLOSING = r"[.!?…。！？:;][\"'”’»)\]]*$"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the cleaning.

    ``max_symbol_share`` and ``max_mark_share`` are shares of a line's characters outside blanks,
    ``min_kept_share`` is the share of a document's word characters that has to stay.  Lines of
    fewer than ``min_words`` words may lack closing punctuation;
    lines with ``menu_marks`` separators of menus are navigation.
    """

    min_words: int = 4
    menu_marks: int = 3
    max_symbol_share: float = 0.1
    max_mark_share: float = 0.2
    min_kept_share: float = 0.5
    window: int = 5
    max_repeat_pct: int = 20
    min_doc_words: int = 10


def words_of(text: Column) -> Column:
    """Words between blanks of a text, as an array; empty for null and blank texts."""
    trimmed = F.btrim(text, F.lit(TRIM))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANKS)
    )


def _count(text: Column, pattern: str) -> Column:
    """Characters that match a character class; most lines have none and are scanned once."""
    left = F.length(F.regexp_replace(text, f"{pattern}+", ""))
    return F.when(text.rlike(pattern), F.length(text) - left).otherwise(F.lit(0))


def line_passes(line: Column, rules: LineRules) -> Column:
    """Whether a line stays.  Lines without a word always stay: they hold no text to judge."""
    core = F.btrim(line, F.lit(TRIM))
    size = F.length(core)
    short = F.size(F.split(core, BLANKS, rules.min_words)) < rules.min_words
    return (core == "") | (
        (short | core.rlike(CLOSING))
        & (_count(core, f"[{MENU_MARKS}]") < rules.menu_marks)
        & ~core.rlike("(?i)" + NAVIGATION)
        & ~core.rlike("(?i)" + BOILERPLATE)
        & (_count(core, "[#*$%&|<>]") <= rules.max_symbol_share * size)
        & (_count(core, "[!?*#~=_]") <= rules.max_mark_share * size)
    )


def _repeat_words(words: Column, ordered: Column, width: int) -> Column:
    """Words covered by windows whose words occur twice or more, from (hash, start) in order.

    Equal hashes are neighbours; the words behind them are compared as well.
    """

    def same(a: Column, b: Column) -> Column:
        alike = F.slice(words, a["i"] + 1, width) == F.slice(words, b["i"] + 1, width)
        return F.when(a["h"] == b["h"], alike).otherwise(F.lit(False))

    twice = F.filter(
        ordered,
        lambda w, k: same(w, F.get(ordered, k - 1)) | same(w, F.get(ordered, k + 1)),
    )
    starts = F.sort_array(F.transform(twice, lambda w: w["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, at: F.struct(
            (acc["n"] + at + width - F.greatest(at, acc["end"])).alias("n"),
            (at + width).alias("end"),
        ),
    )
    return covered["n"]


def measures(df: DataFrame, text: str, rules: LineRules = LineRules()) -> DataFrame:
    """Add the base measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Window hashes stay inside the row: there is no exchange, and the sort by hash is done only for
    documents in which some hash occurs twice.
    """
    width = rules.window
    column = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words_of(column)).withColumn(
        "_lines", F.filter(F.split(column, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_hashes",
        F.when(
            F.col("n_words") >= width,
            F.transform(
                F.slice("_each", F.lit(1), F.size("_each") - (width - 1)),
                lambda h, i: F.xxhash64(h, *(F.get("_each", i + k) for k in range(1, width))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    in_order = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(repeated, in_order))
    repeat_words = F.coalesce(_repeat_words(F.col("_words"), F.col("_ordered"), width), F.lit(0))
    df = df.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(column, "[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeat_words.cast("long"),
        }
    )
    failed = (F.col("n_words") < rules.min_doc_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words")
    )
    return df.withColumn("base_failed", failed).drop("_words", "_lines", "_each", "_hashes", "_ordered")


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Measures, the text without failing lines, and the verdict.

    Adds ``cleaned_text``, ``n_lines``, ``n_lines_removed``, ``kept_chars`` and ``kept`` to the
    columns of :func:`measures`.  ``kept`` is false if the base rules fail or if less than
    ``min_kept_share`` of the word characters stays.
    """
    df = measures(df, text, rules)
    column = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_all", F.split(column, "\n"))
    df = df.withColumn("_good", F.filter("_all", lambda line: line_passes(line, rules)))
    df = df.withColumn("cleaned_text", F.array_join("_good", "\n"))
    df = df.withColumn(
        "kept_chars", F.length(F.regexp_replace("cleaned_text", BLANKS, "")).cast("long")
    )
    enough = F.col("kept_chars") >= rules.min_kept_share * F.col("word_chars")
    return df.withColumns(
        {
            "n_lines": F.size("_all").cast("long"),
            "n_lines_removed": (F.size("_all") - F.size("_good")).cast("long"),
            "kept": ~F.col("base_failed") & enough,
        }
    ).drop("_all", "_good")
