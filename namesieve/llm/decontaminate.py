"""Benchmark decontamination over a distributed positional inverted index, built-in functions only.

Index: postings (term, doc_id, position, surrounding words) of training tokens.  A test window of
``width`` words is looked up from its rarest term: that term's posting list, shifted by the term's
offset in the window, gives candidate starts; the other terms' positions are intersected from the
words that the posting carries, so the long lists of frequent words are never moved.

Only terms that are the rarest of some window are stored, with frequencies counted over all
documents.  The table of those terms is broadcast after its size is measured; beyond the limit the
postings are joined by a shuffle, in which the rarest terms of all have short lists.

Defined results: words are runs of digits, letters and non-ASCII characters after lower-casing A-Z;
a null text has no words; an item without words has no window; an item shorter than ``width`` is one
window; repeated rows are separate rows with equal results; empty tables give no hits; extra columns
are left out.  Ids may be null: such rows are kept and matched like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.session import checkpointed

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z are folded, which for ASCII texts is what ``lower`` does."""
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
    return F.when(
        text.isNull(), F.array().cast("array<string>")
    ).otherwise(F.array_remove(F.split(folded, SEPARATORS), ""))


def item_windows(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """Distinct windows of the items: ``grams`` (array of words) with ``item``."""
    rows = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w"))
    rows = rows.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    return rows.select(
        "item", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("grams")
    ).distinct()


def _measured(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The table, written once, and whether its counted rows allow a broadcast."""
    df = checkpointed(df)
    return df, df.limit(limit + 1).count() <= limit


def term_frequencies(docs: DataFrame, terms: DataFrame, text: str, limit: int) -> DataFrame:
    """Occurrences of the given distinct ``term``s in all documents."""
    terms, small = _measured(terms, limit)
    tokens = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    known = tokens.join(F.broadcast(terms), "term", "left_semi") if small else tokens
    counts = known.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select(
        "term", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def lookups(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Distinct windows with their rarest term and its offset: ``grams, items, term, offset``."""
    grams = windows.groupBy("grams").agg(F.sort_array(F.collect_set("item")).alias("items"))
    each = grams.select("grams", F.posexplode("grams").alias("offset", "term"))
    rarest = (
        each.join(frequencies, "term")
        .groupBy("grams")
        .agg(F.min(F.struct("n", "term", "offset")).alias("r"))
    )
    return grams.join(rarest, "grams").select(
        "grams", "items", F.col("r.term").alias("term"), F.col("r.offset").alias("offset")
    )


def postings(docs: DataFrame, terms: DataFrame, doc: str, text: str, width: int, small: bool):
    """Positional postings of the given terms: ``term, doc, pos`` and the words around.

    ``context`` holds the words from ``width - 1`` before to ``width - 1`` after the position, with
    ``lead`` words before it: enough to intersect the lists of all terms of a window.
    """
    rows = docs.select(F.col(doc).alias("doc"), words_of(F.col(text)).alias("w"))
    rows = rows.select("doc", "w", F.posexplode("w").alias("pos", "term"))
    lead = F.least(F.col("pos"), F.lit(width - 1))
    around = F.slice("w", F.col("pos") - lead + 1, lead + width).alias("context")
    if small:
        rows = rows.join(F.broadcast(terms), "term", "left_semi")
        return rows.select("term", "doc", "pos", lead.alias("lead"), around)
    rows = rows.select("term", "doc", "pos", lead.alias("lead"), around)
    return rows.join(terms, "term", "left_semi")


def phrase_matches(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Exact phrase matches: ``doc, start`` (word position from 0), ``length, items``."""
    windows = item_windows(items, item, item_text, width)
    vocabulary = windows.select(F.explode("grams").alias("term")).distinct()
    frequencies = checkpointed(term_frequencies(docs, vocabulary, text, broadcast_rows))
    wanted, small = _measured(lookups(windows, frequencies), broadcast_rows)
    index = postings(docs, wanted.select("term").distinct(), doc, text, width, small)
    hits = index.join(F.broadcast(wanted) if small else wanted, "term")
    size = F.size("grams")
    first = F.col("lead") - F.col("offset")
    return hits.where(
        (first >= 0) & (F.slice("context", F.greatest(first, F.lit(0)) + 1, size) == F.col("grams"))
    ).select(
        "doc", (F.col("pos") - F.col("offset")).alias("start"), size.alias("length"), "items"
    )


def proximity_matches(
    docs: DataFrame,
    items: DataFrame,
    within: int = 10,
    n_terms: int = 3,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Documents in which the ``n_terms`` rarest distinct words of an item stand within ``within`` words.

    Returns ``doc, item, start``: every position of the rarest term from which all others are found
    less than ``within`` words away.  Items with fewer distinct words use all of them.
    """
    rows = items.select(F.col(item).alias("item"), words_of(F.col(item_text)).alias("w"))
    words = rows.select("item", F.explode(F.array_distinct("w")).alias("term"))
    frequencies = checkpointed(
        term_frequencies(docs, words.select("term").distinct(), text, broadcast_rows)
    )
    ranked = words.join(frequencies, "term").groupBy("item").agg(
        F.slice(F.sort_array(F.collect_set(F.struct("n", "term"))), 1, n_terms).alias("r")
    )
    ranked = ranked.select("item", F.transform("r", lambda x: x["term"]).alias("terms"))
    wanted, small = _measured(ranked.withColumn("term", F.col("terms")[0]), broadcast_rows)
    index = postings(docs, wanted.select("term").distinct(), doc, text, within, small)
    hits = index.join(F.broadcast(wanted) if small else wanted, "term")
    return hits.where(F.size(F.array_except("terms", "context")) == 0).select(
        "doc", "item", F.col("pos").alias("start")
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Per document: ``n_words, n_hit, items`` (ids of items with occurring windows, as strings).

    ``n_hit`` counts the words inside any occurrence of a window.  Documents without a match never
    move: their row meets the matches by the id, and repeated ids share the matches found for them.
    """
    matches = phrase_matches(docs, items, doc, text, **options)
    merged = matches.groupBy("doc").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(
            F.array_distinct(F.flatten(F.collect_list(F.col("items").cast("array<string>"))))
        ).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (
                acc["n"]
                + F.greatest(
                    F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"])
                )
            ).alias("n"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
    )["n"]
    merged = merged.select("doc", covered.cast("long").alias("n_hit"), "items")
    rows = docs.select(
        F.col(doc).alias("_doc"), F.size(words_of(F.col(text))).cast("long").alias("n_words")
    )
    return rows.join(merged, F.col("_doc").eqNullSafe(F.col("doc")), "left").select(
        F.col("_doc").alias(doc),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
