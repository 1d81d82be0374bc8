"""Word lists as one table, and membership joins against it.

A word-list table has the columns ``list, lang, term``.  :class:`Lexicon` compiles it to
one row per term with a bit mask of the lists that hold the term, so that any number of
lists is probed with a single join.

Joins against single lists use :func:`measured_side`, which checks the size before hinting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.functions.text import normalize_name, words
from namesieve.session import checkpointed

LISTS = (
    "type",
    "subject",
    "subject_modifier",
    "org_modifier",
    "common_subject",
    "word_ending",
    "location",
    "company_name",
    "university",
    "company_suffix",
    "company_type",
    "allow",
    "deny",
    "acronym_allow",
    "expanded_subject",
    "stop_word",
    "fuzzy_subject",
)
BIT = {name: 1 << i for i, name in enumerate(LISTS)}

MAX_LISTS = 62  # bits of a mask

# Beyond these sizes the term table is joined by shuffle.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
# Stop words and organisation modifiers are tested inside expressions, as literal sets.
LITERAL_TERMS = 50_000
# Up to this many terms, n-grams of words are looked up inside expressions too.
SPAN_TERMS = 20_000


def mask_of(*names: str) -> int:
    out = 0
    for name in names:
        out |= BIT[name]
    return out


def normalise_terms(terms: DataFrame, keep_empty_terms: bool = True) -> DataFrame:
    """Normalise the ``term`` column as strings are normalised, and remove repeats."""
    out = terms.withColumn("term", normalize_name(F.col("term")))
    if not keep_empty_terms:
        out = out.where(F.col("term") != "")
    return out.distinct()


@dataclass(frozen=True)
class Lexicon:
    """A compiled word-list table with the measured sizes that choose the join strategy."""

    terms: DataFrame  # term, mask
    n_terms: int
    n_bytes: int
    longest: dict[str, int]  # list -> largest number of words in a term
    longest_chars: dict[str, int]
    stop_words: tuple[str, ...]
    org_modifiers: tuple[str, ...]
    common_subjects: tuple[str, ...]
    first_words: tuple[str, ...] | None  # first words of all terms; None if too many
    bits: dict[str, int]  # list -> its bit, lists of registered rules included
    masks: dict[str, int] | None = None  # term -> mask; None if there are too many

    @classmethod
    def compile(cls, terms: DataFrame, extra: tuple[str, ...] = ()) -> "Lexicon":
        """Build from normalised ``(list, term)`` rows; ``extra`` names lists beyond the known ones."""
        names = (*LISTS, *extra)
        if len(set(names)) < len(names) or len(names) > MAX_LISTS:
            raise ValueError(f"names of lists are unique, at most {MAX_LISTS}")
        bits = {name: 1 << i for i, name in enumerate(names)}
        bit = F.lit(None).cast("bigint")
        for name in reversed(names):
            bit = F.when(F.col("list") == name, F.lit(bits[name])).otherwise(bit)
        # rule 3 compares in lower case on both sides
        term = F.when(F.col("list") == "expanded_subject", F.lower("term")).otherwise(F.col("term"))
        spark_bits = terms.select(term.alias("term"), bit.cast("bigint").alias("bit")).where(
            "bit IS NOT NULL"
        )
        # subject lookups also see the subject modifiers
        spark_bits = spark_bits.withColumn(
            "bit",
            F.when(
                F.col("bit") == BIT["subject_modifier"],
                F.col("bit").bitwiseOR(F.lit(BIT["subject"])),
            ).otherwise(F.col("bit")),
        )
        compiled = checkpointed(
            spark_bits.groupBy("term").agg(F.expr("bit_or(bit)").alias("mask"))
        )
        n_words = F.size(words(F.col("term")))
        stats = [F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")]
        for name in names:
            listed = F.col("mask").bitwiseAND(F.lit(bits[name])) != 0
            stats.append(F.coalesce(F.max(F.when(listed, n_words)), F.lit(0)).alias(f"w_{name}"))
            stats.append(F.coalesce(F.max(F.when(listed, F.length("term"))), F.lit(0)).alias(f"c_{name}"))
            stats.append(F.count(F.when(listed, 1)).alias(f"k_{name}"))
        row = compiled.agg(*stats).first()

        inline = ("stop_word", "org_modifier", "common_subject")
        for name in inline:
            if row[f"k_{name}"] > LITERAL_TERMS:
                raise ValueError(f"list {name} has more than {LITERAL_TERMS} terms")
        few = row.n <= SPAN_TERMS
        wanted = F.lit(True) if few else F.col("mask").bitwiseAND(F.lit(mask_of(*inline))) != 0
        literals = compiled.where(F.col("term").isNotNull() & wanted).collect()

        def literal(name: str) -> tuple[str, ...]:
            return tuple(sorted(r.term for r in literals if r.mask & BIT[name]))

        first = compiled.where("term <> ''").select(F.substring_index("term", " ", 1).alias("w"))
        firsts = first.distinct().limit(LITERAL_TERMS + 1).collect()
        return cls(
            terms=compiled,
            n_terms=row.n,
            n_bytes=row.b,
            longest={name: row[f"w_{name}"] for name in names},
            longest_chars={name: row[f"c_{name}"] for name in names},
            stop_words=literal("stop_word"),
            org_modifiers=literal("org_modifier"),
            common_subjects=literal("common_subject"),
            first_words=tuple(r.w for r in firsts) if len(firsts) <= LITERAL_TERMS else None,
            bits=bits,
            masks={r.term: r.mask for r in literals} if few else None,
        )

    @property
    def fits_broadcast(self) -> bool:
        return self.n_terms <= BROADCAST_ROWS and self.n_bytes <= BROADCAST_BYTES

    @property
    def literal(self) -> bool:
        """Few enough terms to look n-grams up inside expressions, where no row has to be exploded."""
        return self.masks is not None and self.first_words is not None and self.fits_broadcast

    def terms_of(self, mask: int) -> dict[int, dict[str, int]]:
        """The terms of the lists in ``mask`` with what they have of it, by their number of words."""
        found: dict[int, dict[str, int]] = {}
        for term, own in (self.masks or {}).items():
            if own & mask:
                found.setdefault(term.count(" ") + 1, {})[term] = own & mask
        return found

    def side(self) -> DataFrame:
        """The term table, hinted for broadcast only while its measured size is small."""
        return F.broadcast(self.terms) if self.fits_broadcast else self.terms

    def max_words(self, *names: str) -> int:
        return max([1, *(self.longest[n] for n in names)])


def hit_list(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(BIT[name])) != 0


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """Materialise a side of a join, and tell whether it turned out small enough to broadcast."""
    side = checkpointed(df)
    width = sum(
        (F.coalesce(F.octet_length(n), F.lit(0)) for n, t in side.dtypes if t == "string"),
        F.lit(0),
    )
    row = side.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return side, row.n <= BROADCAST_ROWS and row.b <= BROADCAST_BYTES


def measured_side(df: DataFrame) -> DataFrame:
    """Materialise a word-list side and hint it for broadcast only if it turned out small.

    The other side is then not shuffled; a large list leaves the join to the planner.
    """
    side, small = measured(df)
    return F.broadcast(side) if small else side


def dictionary_exact(df: DataFrame, terms: DataFrame, text: str, flag: str = "listed") -> DataFrame:
    """Flag rows whose ``text`` is a listed term.  ``terms`` has one column ``term``."""
    keys = terms.select(F.col("term").alias(text)).distinct().withColumn(flag, F.lit(True))
    return df.join(measured_side(keys), text, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def keep_listed(df: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    keys = terms.select(F.col("term").alias(text)).distinct()
    return df.join(measured_side(keys), text, "left_semi")


def drop_listed(df: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    keys = terms.select(F.col("term").alias(text)).distinct()
    return df.join(measured_side(keys), text, "left_anti")


def select_lists(terms: DataFrame, without: tuple[str, ...]) -> DataFrame:
    """Word-list rows except those of the named lists."""
    return terms.where(~F.col("list").isin(*without))


def pooled_phrases(
    terms: DataFrame,
    without: tuple[str, ...] = ("allow", "deny", "location", "stop_word"),
) -> DataFrame:
    """Distinct non-blank phrases over all lists but the excluded ones."""
    phrase = F.trim(F.col("term"))
    return select_lists(terms, without).select(phrase.alias("phrase")).where("phrase <> ''").distinct()
