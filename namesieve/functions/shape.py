"""Lexical shape of a string: lengths, capitals, acronyms, compounds, tag sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.functions.text import words


def char_len(text: Column) -> Column:
    return F.length(text)


def word_len(text: Column) -> Column:
    """Number of blanks plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def freq_capitals(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        F.regexp_count(text, F.lit(r"\p{Lu}")) / F.length(text)
    )


def is_upper(word: Column) -> Column:
    """At least one cased character and none of them lower or title case."""
    return word.rlike(r"\p{Lu}") & ~word.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(word: Column) -> Column:
    """Every run of letters starts with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(word, F.lit(r"(\p{L}+)"), F.lit(1))
    return (F.size(runs) > 0) & F.forall(runs, lambda r: r.rlike(r"^\p{Lu}\p{Ll}*$"))


def freq_all_caps(text: Column) -> Column:
    tokens = words(text)
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(
        F.size(F.filter(tokens, is_upper)) / F.size(tokens)
    )


def _one_of(alternatives: tuple[str, ...]) -> str:
    return "^(" + "|".join(alternatives) + ")$"


def alnum_words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda w: w != "")


def extract_acronyms(text: Column) -> Column:
    """Acronym-like words, then a trailing parenthesised acronym if it is new."""
    candidates = F.filter(
        alnum_words(text),
        lambda w: (w == F.upper(w))
        & ~w.rlike(fixed.NOT_AN_ACRONYM)
        & ~w.rlike(_one_of(fixed.ROMAN_NUMERALS)),
    )
    bare = F.transform(
        candidates,
        lambda w: F.regexp_replace(
            F.regexp_replace(w, fixed.ACRONYM_LEAD, ""), fixed.ACRONYM_PREFIX, ""
        ),
    )
    inline = F.filter(bare, lambda w: F.regexp_count(w, F.lit("[A-Z]")) >= 3)
    trailing = F.regexp_extract(text, fixed.TRAILING_PARENTHESES, 1)
    is_new = (
        (F.length(trailing) >= 3)
        & ~trailing.rlike(_one_of(fixed.ROMAN_NUMERALS))
        & ~F.array_contains(inline, trailing)
    )
    # Most strings have no run of capitals at all; they skip the token work.
    return F.when(
        text.rlike(r"[A-Z][A-Z0-9]*[A-Z][A-Z0-9]*[A-Z]|\)$"),
        F.concat(inline, F.when(is_new, F.array(trailing)).otherwise(F.array().cast("array<string>"))),
    ).otherwise(F.array().cast("array<string>"))


def has_acronym_v1(text: Column, norm_is_subject: Column) -> Column:
    """First-generation acronym test; ``norm_is_subject`` tells if the normalised string is one."""
    single = F.size(words(text)) == 1
    mixed = (text != F.upper(text)) & (text != F.lower(text)) & ~is_title(text)
    shouting = (text == F.upper(text)) & ~norm_is_subject
    considered = F.filter(
        alnum_words(text),
        lambda w: ~w.rlike(fixed.NOT_AN_ACRONYM) & ~w.rlike(_one_of(fixed.ROMAN_NUMERALS_V1)),
    )
    has_roman = F.exists(
        alnum_words(text),
        lambda w: ~w.rlike(fixed.NOT_AN_ACRONYM) & w.rlike(_one_of(fixed.ROMAN_NUMERALS_V1)),
    )
    some_lower = F.exists(considered, lambda w: w != F.upper(w))
    acronym_like = F.exists(
        considered,
        lambda w: F.regexp_count(
            F.regexp_replace(
                F.regexp_replace(w, fixed.ACRONYM_LEAD, ""), fixed.ACRONYM_PREFIX_RUN, ""
            ),
            F.lit("[A-Z]"),
        )
        >= 3,
    )
    multi = (
        (acronym_like & some_lower)
        | (text.rlike(fixed.TRAILING_PARENTHESES) & ~has_roman)
        | (text.rlike(fixed.LEADING_CAPITALS_V1) & ~has_roman)
    )
    return F.when(single, mixed | shouting).otherwise(multi)


def split_linked_words(text: Column) -> Column:
    """``abc.def.`` and ``abc/def`` become separate words."""

    def parts(w: Column) -> Column:
        return (
            F.when(
                F.lower(w).rlike(fixed.DOTTED_COMPOUND),
                F.regexp_extract_all(w, F.lit(r"(?U)(\w+\.)"), F.lit(1)),
            )
            .when(
                F.lower(w).rlike(fixed.SLASHED_COMPOUND),
                F.regexp_extract_all(w, F.lit(r"(?U)(\w+\.?)"), F.lit(1)),
            )
            .otherwise(F.array(w))
        )

    return F.array_join(F.flatten(F.transform(words(text), parts)), " ")


def collapse_runs(tags: Column) -> Column:
    """Drop entries equal to the one before."""
    return F.filter(tags, lambda t, i: (i == 0) | (t != F.get(tags, i - 1)))


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, "_")


def gram_rows(df: DataFrame, tokens: Column, longest: int) -> DataFrame:
    """``n, term``: a row for each contiguous n-gram of words, n = 1..``longest``.

    Every position is a row with the words that follow it, so no list of all n-grams of a text is built.
    """
    rows = df.select(tokens.alias("ws"))
    names = [f"w{k}" for k in range(longest)]
    shifted = [F.slice("ws", k + 1, F.size("ws")).alias(name) for k, name in enumerate(names)]
    at = rows.where("size(ws) > 0").select(F.inline(F.arrays_zip(*shifted)).alias(*names))
    found = [
        F.struct(F.lit(n).alias("n"), F.when(F.col(names[n - 1]).isNotNull(), F.concat_ws(" ", *names[:n])).alias("term"))
        for n in range(1, longest + 1)
    ]
    return at.select(F.inline(F.array(*found))).where("term IS NOT NULL")


def grams(tokens: Column, longest: int) -> Column:
    """Contiguous word n-grams as structs ``(start, n, term)``, n = 1..``longest``.

    Capping the length is exact for membership tests when no listed term is longer.
    """

    def of(ws: Column) -> Column:
        return F.flatten(
            F.transform(
                ws,
                lambda w, i: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(longest), F.size(ws) - i)),
                    lambda n: F.struct(
                        i.alias("start"),
                        n.alias("n"),
                        # by position: a slice would copy the whole array for every n-gram
                        F.array_join(
                            F.transform(F.sequence(i, i + n - 1), lambda j: F.get(ws, j)), " "
                        ).alias("term"),
                    ),
                ),
            )
        )

    # binds the token array once; a lambda body would otherwise repeat its computation
    return F.flatten(F.transform(F.array(tokens), of))
