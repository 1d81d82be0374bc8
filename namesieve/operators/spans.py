"""Span annotation: which stretches of a string are listed terms.

All questions a rule asks about word lists ("does any n-gram belong to list L", "is the
last word a type", "is everything after word 2 a subject") are answered from one array of
hits per string.  The hits come from one explode, one join with the compiled term table
and one aggregation on the key of the string; when the input is already partitioned by
that key the aggregation adds no exchange.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.functions.text import member_of
from namesieve.operators.lexicon import Lexicon

PROBE = "struct<slot:int,start:int,n:int,term:string>"
SPANS = "array<struct<start:int,n:int,mask:bigint>>"
KEEP_ROW = -1

# What a probed term stands for.
NORM, CONTENT, CONTENT_AND = 0, 1, 2
WHOLE, EXPANDED, RAW_TYPE, RAW_SUBJECT = 3, 4, 5, 6
SUFFIX, RAW, BASE, ACRONYM, ENDING = 7, 8, 9, 10, 11
CUSTOM = 100  # the first slot of registered rules


def no_probes() -> Column:
    return F.array().cast(f"array<{PROBE}>")


def exact_probe(slot: int, term: Column) -> Column:
    """Probe the whole of ``term``; a null term is not probed."""
    probe = F.struct(
        F.lit(slot).alias("slot"),
        F.lit(0).alias("start"),
        F.lit(0).alias("n"),
        term.alias("term"),
    )
    return F.when(term.isNotNull(), F.array(probe)).otherwise(no_probes())


def gram_probes(
    slot: int,
    tokens: str,
    longest: int,
    first_words: tuple[str, ...] | None = None,
    wanted: str = "true",
) -> Column:
    """Probe the word n-grams of a token column, n = 1..``longest``.

    An n-gram can only be listed if its first word starts some term, so other positions are
    skipped before anything is built (``first_words`` of the lexicon, if it is small enough).
    ``wanted`` restricts the longer n-grams; it may refer to the start ``i`` and length ``k``.
    """
    starts = (
        f"filter(transform({tokens}, (w, i) -> IF({member_of('w', first_words)}, i, -1)), i -> i >= 0)"
        if first_words is not None
        else f"transform({tokens}, (w, i) -> i)"
    )
    probe = f"named_struct('slot', {slot}, 'start', i, 'n', {{k}}, 'term', {{term}})"
    if longest <= 1:
        return F.expr(f"transform({starts}, i -> {probe.format(k=1, term=f'get({tokens}, i)')})")
    # by position: a slice would copy the whole array for every n-gram
    joined = f"array_join(transform(sequence(i, i + k - 1), j -> get({tokens}, j)), ' ')"
    gram = probe.format(k="k", term=f"IF(k = 1, get({tokens}, i), {joined})")
    lengths = f"sequence(1, least({longest}, size({tokens}) - i))"
    if wanted != "true":
        lengths = f"filter({lengths}, k -> k = 1 OR {wanted})"
    return F.expr(f"flatten(transform({starts}, i -> transform({lengths}, k -> {gram})))")


def ending_probes(tokens: Column, longest_ending: int) -> Column:
    """Suffixes of at least four characters that leave at least four characters before them."""

    def of_word(word: Column, index: Column) -> Column:
        longest = F.least(F.lit(longest_ending), F.length(word) - 4)
        suffixes = F.transform(
            F.sequence(F.lit(4), longest),
            lambda k: F.struct(
                F.lit(ENDING).alias("slot"),
                index.alias("start"),
                F.lit(1).alias("n"),
                F.right(word, k).alias("term"),
            ),
        )
        return F.when(longest >= 4, suffixes).otherwise(no_probes())

    return F.flatten(F.transform(tokens, of_word))


def literal_mask(term: str, terms: dict[str, int]) -> str:
    """SQL text of the mask of ``term``: one hash-set test for each list."""
    bits = sorted({1 << i for own in terms.values() for i in range(own.bit_length()) if own >> i & 1})
    tests = (f"IF({member_of(term, (t for t, own in terms.items() if own & bit))}, {bit}L, 0L)" for bit in bits)
    return f"({' | '.join(tests)})" if bits else "0L"


def _starts(tokens: str, members: Iterable[str]) -> str:
    return f"filter(transform({tokens}, (w, i) -> IF({member_of('w', members)}, i, -1)), i -> i >= 0)"


def literal_spans(tokens: str, lexicon: Lexicon, mask: int, longest: int, wanted: str = "true") -> str:
    """SQL text of ``array<struct<start, n, mask>>``: the listed n-grams of a token column.

    For a lexicon whose terms are literals: what :func:`gram_probes` and :func:`find_spans` give, without
    a row for each probe.  Only terms of the lists in ``mask`` count.
    """
    by_words = lexicon.terms_of(mask)
    parts = []
    for k, terms in sorted(by_words.items()):
        if k > longest:
            continue
        if k == 1:
            hit = f"named_struct('start', i, 'n', 1, 'mask', {literal_mask(f'get({tokens}, i)', terms)})"
            parts.append(f"transform({_starts(tokens, terms)}, i -> {hit})")
            continue
        words_of = ", ".join(f"get({tokens}, i + {j})" for j in range(k))
        here = re.sub(r"\bk\b", str(k), wanted)
        room = f"i + {k} <= size({tokens}) AND ({here})"
        gram = f"filter(array(concat_ws(' ', {words_of})), t -> {member_of('t', terms)})"
        hit = f"named_struct('start', i, 'n', {k}, 'mask', {literal_mask('t', terms)})"
        starts = f"filter({_starts(tokens, {t.split(' ')[0] for t in terms})}, i -> {room})"
        parts.append(f"flatten(transform({starts}, i -> transform({gram}, t -> {hit})))")
    if not parts:
        return f"cast(array() AS {SPANS})"
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def literal_endings(tokens: str, lexicon: Lexicon, mask: int) -> str:
    """SQL text of the positions of words with a listed ending, as :func:`ending_probes` looks for them."""
    by_length: dict[int, list[str]] = {}
    for terms in lexicon.terms_of(mask).values():
        for term in terms:
            by_length.setdefault(len(term), []).append(term)
    tests = [
        f"(length(w) >= {k + 4} AND {member_of(f'right(w, {k})', terms)})"
        for k, terms in sorted(by_length.items())
        if k >= 4
    ]
    if not tests:
        return "cast(array() AS array<int>)"
    return f"filter(transform({tokens}, (w, i) -> IF({' OR '.join(tests)}, i, -1)), i -> i >= 0)"


def union_mask(spans: str) -> str:
    return f"aggregate({spans}, 0L, (a, h) -> a | h.mask)"


def exact_masks(df: DataFrame, lexicon: Lexicon, terms: dict[str, Column]) -> DataFrame:
    """Adds the mask of each whole term, 0 if it is not listed: a broadcast join for each."""
    for name, term in terms.items():
        side = lexicon.side().select(F.col("term").alias("_term"), F.col("mask").alias("_mask"))
        joined = df.withColumn("_key", term).join(F.broadcast(side), F.col("_key") == F.col("_term"), "left")
        df = joined.withColumn(name, F.coalesce("_mask", F.lit(0).cast("bigint"))).drop("_key", "_term", "_mask")
    return df


def find_spans(
    df: DataFrame, lexicon: Lexicon, keys: list[str], carried: list[str], probes: Column
) -> DataFrame:
    """Replace ``probes`` by ``hits``: array of ``(slot, start, n, mask)``.

    ``carried`` columns depend on ``keys``; they travel on one row per string only.  In a shuffle join
    that row has a term of its own, which no list can hold, so these rows do not meet in one task.
    """
    own = F.concat(F.lit("\x00"), F.hex(F.xxhash64(*keys)))
    keep = F.struct(
        F.lit(KEEP_ROW).alias("slot"),
        F.lit(0).alias("start"),
        F.lit(0).alias("n"),
        (F.lit(None).cast("string") if lexicon.fits_broadcast else own).alias("term"),
    )
    # the kept row comes first, so position 0 carries the columns of the string
    exploded = df.select(
        *keys,
        F.posexplode(F.concat(F.array(keep), probes)).alias("at", "probe"),
        F.struct(*carried).alias("row"),
    ).select(*keys, "probe.*", F.when(F.col("at") == 0, F.col("row")).alias("row"))
    matched = exploded.join(lexicon.side(), "term", "left").where(
        f"mask IS NOT NULL OR slot = {KEEP_ROW}"
    )
    hit = F.when(F.col("mask").isNotNull(), F.struct("slot", "start", "n", "mask"))
    return (
        matched.groupBy(*keys)
        .agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list(hit).alias("hits"))
        .select(*keys, "row.*", "hits")
    )


def mask_at(slot: int, hits: str = "hits") -> Column:
    """Union of the list masks of all hits in a slot."""
    return F.expr(
        f"aggregate(filter({hits}, h -> h.slot = {slot}), 0L, (a, h) -> a | h.mask)"
    )
