"""Normalisation steps, each one Column -> Column and all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from namesieve import fixed


def sql_string(value: str) -> str:
    """Quote ``value`` as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def nfc(text: Column) -> Column:
    """Unicode NFC.

    Strings whose code points are all below U+0300 are already composed, so only the
    rest reach the composer (a static method of the ICU library that Spark ships).
    """
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike(r"[^\x00-\u02FF]"), composed).otherwise(text)


def words(text: Column) -> Column:
    """White-space separated words; never contains empty strings."""
    return F.filter(F.split(text, fixed.SPACE_RUN), lambda w: w != "")


def fold_word(word: Column) -> Column:
    """Lower-case a word unless it consists of capitals, dots and commas."""
    return F.when(word.rlike(fixed.ALL_CAPS_TOKEN), word).otherwise(F.lower(word))


def case_fold_tokens(text: Column) -> Column:
    return F.array_join(F.transform(words(text), fold_word), " ")


def strip_entities(text: Column) -> Column:
    return F.regexp_replace(text, fixed.ENTITY, "")


def ampersand_to_and(text: Column) -> Column:
    return F.regexp_replace(text, fixed.AMPERSAND, " and ")


def d_apostrophe(text: Column) -> Column:
    return F.replace(text, F.lit(fixed.D_APOSTROPHE), F.lit(" de "))


def strip_punct(text: Column) -> Column:
    return F.regexp_replace(text, fixed.NOT_ALNUM_OR_SPACE, "")


def squeeze_trim(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, fixed.SPACE_RUN, " "))


def normalize_name(text: Column) -> Column:
    """Composition, case folding, entities, ampersand, apostrophe, punctuation, spaces."""
    out = case_fold_tokens(nfc(text))
    for step in (strip_entities, ampersand_to_and, d_apostrophe, strip_punct, squeeze_trim):
        out = step(out)
    return out


def normalize_name_v1(text: Column) -> Column:
    """First-generation variant: words end at single blanks, no composition."""
    out = F.array_join(F.transform(F.split(text, " "), fold_word), " ")
    out = strip_entities(out)
    out = F.replace(out, F.lit(fixed.AMPERSAND_V1), F.lit(" and "))
    return squeeze_trim(strip_punct(d_apostrophe(out)))


def remove_bullet(text: Column) -> Column:
    return F.regexp_replace(text, fixed.BULLET, "")


def remove_leading_and(text: Column) -> Column:
    return F.regexp_replace(text, fixed.LEADING_AND, "")


def remove_leading_the(text: Column) -> Column:
    return F.regexp_replace(text, fixed.LEADING_THE, "")


def remove_numbering(text: Column) -> Column:
    bare = F.regexp_replace(text, fixed.LEADING_ORDINAL, "")
    return F.regexp_replace(bare, fixed.TRAILING_NUMBER, "")


def remove_affiliated(text: Column) -> Column:
    return F.regexp_replace(text, fixed.LEADING_AFFILIATED, "")


def strip_enumerators(norm: Column) -> Column:
    """Bullet, leading "and"/"the", ordinals and "affiliated", in this order."""
    for step in (
        remove_bullet,
        remove_leading_and,
        remove_leading_the,
        remove_numbering,
        remove_affiliated,
    ):
        norm = step(norm)
    return norm


def member_of(value: str, members: Iterable[str]) -> str:
    """SQL text of a hash-set membership test of ``value`` in a bounded set of literals."""
    literals = ", ".join(sql_string(m) for m in sorted(set(members)))
    return f"({value} IN ({literals}))" if literals else "(false)"


def drop_words(tokens: str, members: Iterable[str]) -> Column:
    """Array column ``tokens`` without the words of a bounded literal set."""
    return F.expr(f"filter({tokens}, w -> NOT {member_of('w', members)})")


def strip_label_prefix(label: Column) -> Column:
    return F.regexp_replace(label, "VER_", "")


def language_of_path(path: Column) -> Column:
    """``name.xx.txt``, a file or a folder of part files, -> ``xx``; without a language part English."""
    lang = F.regexp_extract(path, r"\.(\w{2,})\.txt(?:/[^/]*)?$", 1)
    return F.when(lang == "", F.lit("en")).otherwise(lang)


def special_char_flag(text: Column) -> Column:
    """True if something other than letters, blanks and dots occurs."""
    return F.regexp_replace(text, r" |\.", "").rlike(r"(?U)\W|\d")


def parent_id(child_id: Column) -> Column:
    """``123-4`` -> ``123``; other ids stay as they are."""
    return F.regexp_replace(child_id, r"^(\d+)-.+$", "$1")


def protect_ampersand(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit("and"))


def repair_ragged(line: Column, fields: int = 6) -> Column:
    """Keep the first ``fields - 1`` tabs as separators and blank out later ones."""
    parts = F.split(line, "\t", fields)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\t"), F.lit(" "))), "\t")
