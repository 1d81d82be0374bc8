"""Token tables: corpus frequencies, rank bands, translation and tagging of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve import fixed
from namesieve.functions.shape import collapse_runs
from namesieve.functions.text import fold_word, nfc, words
from namesieve.operators.lexicon import measured
from namesieve.session import checkpointed


def token_frequency(df: DataFrame, text: str = "input", rows: str | None = None) -> DataFrame:
    """``token, cnt`` over lower-cased words; combined before the shuffle.

    ``rows`` names a column that tells how many rows a row stands for.
    """
    weight = F.col(rows).cast("long") if rows else F.lit(1).cast("long")
    return (
        df.select(F.explode(words(F.lower(text))).alias("token"), weight.alias("rows"))
        .groupBy("token")
        .agg(F.sum("rows").alias("cnt"))
    )


def top_tokens(freq: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent tokens with their rank; ties by token."""
    top = freq.orderBy(F.desc("cnt"), "token").limit(n)
    # the window only sees the n rows kept by the distributed top-n
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cnt"), "token")))


def rank_bands(freq: DataFrame, first: int = 1_000, second: int = 10_000) -> DataFrame:
    """Band 1, 2 or 3 of every token, and the rank inside the first two bands."""
    ranked = F.broadcast(top_tokens(freq, second).select("token", "rank"))
    return freq.join(ranked, "token", "left").select(
        "token",
        "cnt",
        "rank",
        F.when(F.col("rank") <= first, 1).when(F.col("rank") <= second, 2).otherwise(3).alias("band"),
    )


FREQUENT = 10_000


def join_frequent_first(rows: DataFrame, freq: DataFrame, key: str) -> DataFrame:
    """Left join of token rows with a vocabulary that may be too large to broadcast.

    The most frequent tokens, which would overload single tasks, are a fixed number of rows
    and are broadcast; rows with other tokens join by shuffle.
    """
    hot = F.broadcast(freq.orderBy(F.desc("cnt"), key).limit(FREQUENT))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(freq, key, "left")
    return rows.join(hot, key).unionByName(rest)


def lookup_words(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join of word rows with a table that has one row per word, whatever its size.

    A table beyond the broadcast size joins by shuffle, but the most frequent words of the rows are
    looked up by broadcast, so no task gets all rows of one word.
    """
    table, small = measured(side)
    if small:
        return rows.join(F.broadcast(table), key, "left")
    often = rows.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key).limit(FREQUENT)
    hot = F.broadcast(checkpointed(often.select(key).join(table, key, "left")))
    rest = rows.join(hot.select(key), key, "left_anti").join(table, key, "left")
    return rows.join(hot, key).unionByName(rest)


def placed(df: DataFrame, key: str) -> DataFrame:
    """Rows of one key in one partition: their words are then put together again without a shuffle.

    The texts are shuffled once; a row for each word would be many times as large.  The partitions are
    not merged: they are small as texts, but what the words take in memory is many times that.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, F.col(key))


def frequency_stats(
    df: DataFrame, freq: DataFrame, key: str, text: str = "input", is_placed: bool = False
) -> DataFrame:
    """Min, max and mean corpus count of the words of each string.

    A count of 1 always takes part; unknown words count 0; ``( ) ,`` are removed first.
    """
    df = df if is_placed else placed(df.select(key, text), key)
    plain = F.translate(F.col(text), "(),", "")
    # equal words of one string are looked up once
    seen = (
        df.select(key, F.explode(words(F.lower(plain))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("times"))
    )
    side, small = measured(freq)
    found = seen.join(F.broadcast(side), "token", "left") if small else join_frequent_first(seen, side, "token")
    counted = found.withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    stats = counted.groupBy(key).agg(
        F.min("cnt").alias("lo"),
        F.max("cnt").alias("hi"),
        F.sum(F.col("cnt") * F.col("times")).alias("total"),
        F.sum("times").alias("n"),
    )
    one = F.lit(1).cast("bigint")
    return df.select(key).join(stats, key, "left").select(
        key,
        F.least(one, F.coalesce("lo", one)).alias("min_freq"),
        F.greatest(one, F.coalesce("hi", one)).alias("max_freq"),
        ((F.coalesce("total", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 1)).alias("mean_freq"),
    )


def last_mapping(mapping: DataFrame) -> DataFrame:
    """One replacement per abbreviation; the last line wins."""
    return mapping.groupBy("abbreviation").agg(F.max_by("replacement", "line_no").alias("replacement"))


def _rejoin(positions: DataFrame, df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Collect a value per word position back into an ordered array, one per string."""
    built = positions.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("o")
    )
    return df.join(built.select(key, F.col("o.v").alias(out)), key, "left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast("array<string>"))
    )


def translate_tokens(
    df: DataFrame, mapping: DataFrame, key: str, text: str = "input", out: str = "translated", is_placed: bool = False
) -> DataFrame:
    """Replace known abbreviations word by word; other words stay as they are."""
    df = df if is_placed else placed(df, key)
    spread = df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))
    side = mapping.select(F.col("abbreviation").alias("low"), "replacement")
    joined = lookup_words(spread.withColumn("low", F.lower("word")), side, "low").withColumn(
        "new", F.coalesce("replacement", "word")
    )
    return _rejoin(joined, df, key, "new", out).withColumn(out, F.array_join(out, " "))


def tag_table(terms: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """``token, tag``: the tag of the last list that holds the token."""
    tag, priority = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, value) in enumerate(fixed.TAG_BY_LIST):
        tag = F.when(F.col("list") == name, value).otherwise(tag)
        priority = F.when(F.col("list") == name, i).otherwise(priority)
    rows = terms.select(F.col("term").alias("token"), tag.alias("tag"), priority.alias("prio")).where(
        "tag IS NOT NULL AND token <> ''"
    )
    base = len(fixed.TAG_BY_LIST)
    if rare is not None:
        rows = rows.unionByName(
            rare.select("token", F.lit(fixed.TAG_RARE).alias("tag"), F.lit(base).alias("prio"))
        )
    spark = terms.sparkSession
    words_of = (
        (fixed.AND_WORDS, fixed.TAG_AND),
        (fixed.OF_WORDS, fixed.TAG_OF),
        (fixed.IN_WORDS, fixed.TAG_IN),
        (fixed.ROMAN_NUMERALS, fixed.TAG_ROMAN),
    )
    closed = [(w, t, base + 1 + i) for i, (ws, t) in enumerate(words_of) for w in ws]
    literal = ", ".join(f"struct('{w}', '{t}', {p})" for w, t, p in closed)
    fixed_rows = spark.range(1).select(F.expr(f"inline(array({literal}))").alias("token", "tag", "prio"))
    return rows.unionByName(fixed_rows).groupBy("token").agg(F.max_by("tag", "prio").alias("tag"))


def top_level_table(terms: DataFrame, top_level: DataFrame) -> DataFrame:
    """``token, tag`` with the top-level tag for company, university and type words."""
    listed = terms.where(F.col("list").isin("company_name", "university", "company_type")).select(
        F.col("term").alias("token")
    )
    extra = top_level.select(F.explode(words(F.lower("term"))).alias("token"))
    return listed.unionByName(extra).distinct().withColumn("tag", F.lit(fixed.TAG_TOP_LEVEL))


def tag_sequences(
    df: DataFrame,
    tags: DataFrame,
    key: str,
    text: str = "input",
    keep: DataFrame | None = None,
    default: str = fixed.TAG_UNKNOWN,
    out: str = "tags",
    is_placed: bool = False,
) -> DataFrame:
    """Tag of every lower-cased word, runs of equal tags collapsed.

    Words in ``keep`` (the most frequent ones) stand for themselves.
    """
    df = df if is_placed else placed(df, key)
    spread = df.select(key, F.posexplode(words(F.lower(text))).alias("pos", "token"))
    if keep is not None:
        tags = tags.join(keep.select("token", F.lit(True).alias("kept")), "token", "full_outer").select(
            "token", F.when(F.col("kept"), F.col("token")).otherwise(F.col("tag")).alias("tag")
        )
    joined = lookup_words(spread, tags, "token").withColumn(
        "tag", F.coalesce("tag", F.lit(default))
    )
    return _rejoin(joined, df, key, "tag", out).withColumn(out, collapse_runs(F.col(out)))


def flat_tokens(df: DataFrame, text: str, *carried: str) -> DataFrame:
    """One row per word, composed and case-folded but with its punctuation."""
    return df.select(*carried, F.explode(words(nfc(F.col(text)))).alias("word")).select(
        fold_word(F.col("word")).alias("token"), *carried
    )
