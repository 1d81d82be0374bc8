"""Data-set preparation: nested documents, weights, splits, samples, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve.functions.text import parent_id, words
from namesieve.operators.ranks import dense_positions
from namesieve.operators.tokens import lookup_words
from namesieve.session import checkpointed


def nested_docs(raw: DataFrame) -> DataFrame:
    """Parent names and child variants of ``response.docs`` as one table.

    Children take the id of their parent; parents without children have no variants.
    """
    docs = raw.select(F.explode("response.docs").alias("d")).select("d.*")
    parents = docs.select(F.col("name").alias("input"), "id", F.lit("name").alias("name_type"))
    children = docs.select("id", F.explode("_childDocuments_").alias("c")).select(
        F.col("c.`variant.name`").alias("input"), "id", F.lit("variant").alias("name_type")
    )
    return parents.unionByName(children)


def variant_docs(raw: DataFrame) -> DataFrame:
    """Flat variants; the id is the number before the first dash."""
    docs = raw.select(F.explode("response.docs").alias("d")).select("d.*")
    return docs.select(F.col("`variant.name`").alias("input"), parent_id(F.col("id")).alias("id"))


def with_label(df: DataFrame, label: str) -> DataFrame:
    """Text as string, missing weights as 1, one label for the whole source."""
    out = df.withColumn("input", F.col("input").cast("string")).withColumn("label", F.lit(label))
    return out.fillna({"numdocs": 1}) if "numdocs" in df.columns else out


def attach_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Corpus counts of labelled strings, null where a string was not seen."""
    return lookup_words(df, counts.select("input", "numdocs"), "input")


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def top_weighted(df: DataFrame, n: int, weight: str = "numdocs", tie: str = "input") -> DataFrame:
    return df.orderBy(F.desc(weight), tie).limit(n)


def single_word_top(df: DataFrame, n: int = 20, weight: str = "numdocs", tie: str = "input") -> DataFrame:
    return top_weighted(df.where(F.size(words(F.col("input"))) == 1), n, weight, tie)


def slice_sorted(df: DataFrame, start: int, stop: int, *order: str | Column) -> DataFrame:
    """Rows ``start .. stop - 1`` in a given order."""
    return df.orderBy(*order).offset(start).limit(stop - start)


def draw_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that depends on the key and the seed only."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def shuffled_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in random order, the same ones however the data is partitioned."""
    return df.orderBy(draw_order(F.col(key), seed), key).limit(n)


# hexadecimal digits of the draw that form a bucket: 16**4 buckets per label
BUCKET_DIGITS = 4


def stratified_split(
    df: DataFrame, key: str, label: str = "label", fraction: float = 0.5, seed: int = 0
) -> DataFrame:
    """Exact split that keeps label ratios: ``part`` is ``train`` or ``test``.

    The first ``round(fraction * n)`` rows of each label in draw order are training rows.
    Counts per (label, bucket of the draw) find the bucket in which a label's boundary
    falls; only that bucket, about one row in 65,536, is ranked.
    """
    drawn = df.withColumn("draw", draw_order(F.col(key), seed)).withColumn(
        "bucket", F.substring("draw", 1, BUCKET_DIGITS)
    )
    counts = drawn.groupBy(F.col(label).alias("cut_label"), "bucket").agg(F.count("*").alias("n"))
    upto = W.partitionBy("cut_label").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    wanted = F.floor(F.sum("n").over(W.partitionBy("cut_label")) * fraction + 0.5)
    cut = (
        counts.withColumn("upto", F.sum("n").over(upto))
        .withColumn("wanted", wanted)
        .where("upto >= wanted AND upto - n < wanted OR wanted = 0")
        .groupBy("cut_label")
        .agg(
            F.min("bucket").alias("cut_bucket"),
            F.min_by(F.col("wanted") - (F.col("upto") - F.col("n")), "bucket").alias("cut_need"),
        )
    )
    # one row per label
    placed = drawn.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("cut_label")))
    columns = [*df.columns, "part"]
    clear = placed.where("bucket <> cut_bucket").withColumn(
        "part", F.when(F.col("bucket") < F.col("cut_bucket"), "train").otherwise("test")
    )
    ranked = placed.where("bucket = cut_bucket").withColumn(
        "part",
        F.when(
            F.row_number().over(W.partitionBy("cut_label").orderBy("draw", key)) <= F.col("cut_need"),
            "train",
        ).otherwise("test"),
    )
    return clear.select(*columns).unionByName(ranked.select(*columns))


def draw_number(total: int, seed: int, *parts: Column) -> Column:
    """A number below ``total`` that depends on ``parts`` and the seed only."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(total)


def resample(df: DataFrame, key: str, files: int, rows: int, seed: int = 0) -> DataFrame:
    """``files`` samples of exactly ``rows`` rows each, drawn with replacement, as ``file_no`` and ``df``.

    Rows are ranked in draw order of their key, so the samples depend on keys and seed only and not on
    partitions.  A row that is drawn often joins its draws, never the other way round.
    """
    ranked = checkpointed(dense_positions(df.withColumn("_draw", draw_order(F.col(key), seed)), "_draw", key, out="_rank"))
    total = ranked.count()
    if total == 0:
        return df.limit(0).select(F.lit(0).alias("file_no"), *df.columns)
    number = F.col("id")
    draws = df.sparkSession.range(files * rows).select(
        F.floor(number / rows).cast("int").alias("file_no"),
        draw_number(total, seed, F.floor(number / rows), number % rows).alias("_rank"),
    )
    return draws.join(ranked, "_rank").select("file_no", *df.columns)


def translate_lists(terms: DataFrame, translations: DataFrame) -> DataFrame:
    """Translated word lists; entries that translate to themselves or are missing drop out."""
    useful = translations.where(F.lower("source") != F.lower("target")).select(
        F.col("source").alias("term"), "target", F.col("lang").alias("target_lang")
    )
    return terms.select("list", F.trim("term").alias("term")).join(useful, "term").select(
        "list", F.col("target_lang").alias("lang"), F.col("target").alias("term")
    )
