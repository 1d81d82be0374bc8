"""How filters of documents interact: what each removes at each place of every order.

The orders are numbered by their Lehmer rank, so all orders that begin alike are one interval of
ranks.  A document that fails a set of filters (a mask) is removed at step s by exactly the orders
whose first s - 1 filters are outside the mask and whose s-th is in it: a few intervals for each
mask and step.  Documents are counted by part and mask; each count is added at the start of its
intervals and taken away behind their ends, and a prefix sum over the ranks gives the totals of
every order, without a row for any order and document.

Copies are found by grouping SHA-256 values of whole texts, with counts combined before each
shuffle, so a text that a third of all rows share is a few rows when its group is formed.

Defined results: a null text is empty, a null part is the empty string; a document of a null id
fails no copy filter and is no original of others; rows of one id and text are counted each, and
the least id's rows all are originals; ids without a label are neither good nor toxic, and one good
(toxic) label of an id is enough; no documents give no rows; the results have the named columns only.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesieve.llm.lines import words_of

FILTERS = "ABCDE"
COPY = "E"
MAX_FILTERS = 8


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The four filters that look at one text: short, repetitive, shouting, with symbols."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 100,
        "B": 100 * distinct < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(failed: dict[str, Column], filters: str = FILTERS) -> Column:
    """The failed filters as bits, the first filter the lowest."""
    bits = [F.when(failed[f], 1 << i).otherwise(0) for i, f in enumerate(filters) if f in failed]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def document_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``id, part, sha, mask, n``: rows of equal id, part and text counted together."""
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", words_of(F.col("text")))
    mask = mask_of(failures(F.col("text"), F.col("words")))
    sha = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    return (
        rows.select("id", "part", sha.alias("sha"), mask.alias("mask"))
        .groupBy("id", "part", "sha", "mask")
        .agg(F.count("*").alias("n"))
    )


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``good`` and ``toxic``; rows of a null id are spread by their text and match nothing."""
    marks = (
        labels.where(F.col(key).isNotNull())
        .groupBy(F.concat(F.lit("i"), F.col(key).cast("string")).alias("_at"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    own = F.concat(F.lit("i"), F.col("id").cast("string"))
    at = F.coalesce(own, F.concat(F.lit("n"), F.hex("sha")))
    joined = rows.withColumn("_at", at).join(marks, "_at", "left").drop("_at")
    return joined.fillna(False, ["good", "toxic"])


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``part, mask, good, toxic, n``: the copies of a smaller id's text get ``bit``."""
    known = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    texts = rows.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
        F.min(known).alias("least"),
    )
    lowest = F.min("least.id").over(Window.partitionBy("sha"))
    originals = F.when(F.col("least.id") == F.col("lowest"), F.col("least.n")).otherwise(0)
    counted = texts.withColumn("lowest", lowest).withColumn("copies", F.col("n") - F.col("unknown") - originals)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), F.col("copies").alias("n")),
    )
    split = counted.select("part", "good", "toxic", F.explode(both).alias("each")).where("each.n > 0")
    return split.groupBy("part", "each.mask", "good", "toxic").agg(F.sum("each.n").alias("n"))


def removal_intervals(n: int, mask: int) -> list[tuple[int, int, int]]:
    """``step, start, end`` of the ranks whose orders remove the mask at that step.

    A prefix of s filters is the ranks [r, r + (n - s)!): r sums, for each place i, the smaller
    filters not used before times (n - i)!.
    """
    found: list[tuple[int, int, int]] = []

    def extend(rank: int, step: int, unused: list[int]) -> None:
        span = factorial(n - step)
        for digit, one in enumerate(unused):
            start = rank + digit * span
            if mask >> one & 1:
                if found and found[-1][0] == step and found[-1][2] == start:
                    found[-1] = (step, found[-1][1], start + span)
                else:
                    found.append((step, start, start + span))
            else:
                extend(start, step + 1, [u for u in unused if u != one])

    if mask:
        extend(0, 1, list(range(n)))
    return found


def interval_table(spark: SparkSession, n: int) -> DataFrame:
    """``mask, step, start, end`` for all masks of ``n`` filters: its size depends on ``n`` only."""
    rows = [(mask, *each) for mask in range(1, 1 << n) for each in removal_intervals(n, mask)]
    return spark.createDataFrame(rows, "mask int, step int, start int, end int")


def order_names(filters: str) -> list[str]:
    """All orders by Lehmer rank, the first digit of a rank the coarsest."""
    names = []
    for rank in range(factorial(len(filters))):
        unused, name = list(filters), ""
        for place in range(len(filters) - 1, -1, -1):
            digit, rank = divmod(rank, factorial(place))
            name += unused.pop(digit)
        names.append(name)
    return names


def step_totals(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows for every part, order and step from ``part, mask, good, toxic, n``."""
    size, spark = len(filters), masks.sparkSession
    if not 1 <= size <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters: all their orders are listed")
    ranks = factorial(size)
    measures = {
        "removed": F.col("n"),
        "good_lost": F.when(F.col("good"), F.col("n")).otherwise(0),
        "toxic_lost": F.when(F.col("toxic"), F.col("n")).otherwise(0),
    }
    counts = masks.groupBy("part", "mask").agg(*[F.sum(v).alias(m) for m, v in measures.items()])
    # Differences at both ends of each interval, and a zero for each rank that none touches.
    ends = F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")),
                   F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))
    table = F.broadcast(interval_table(spark, size).withColumn("at", ends).drop("start", "end"))
    changes = counts.join(table, "mask").select("part", "step", F.explode("at").alias("at"), *measures)
    changes = changes.where(F.col("at.rank") < ranks).select(
        "part", "step", "at.rank", *[(F.col(m) * F.col("at.sign")).alias(m) for m in measures]
    )
    parts = _part_totals(counts, filters)
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"),
        *[F.lit(0).cast("long").alias(m) for m in measures],
    )
    differences = grid.unionByName(changes).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in measures])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = differences.select("part", "step", "rank", *[F.sum(m).over(along).alias(m) for m in measures])
    name = F.element_at(F.array(*map(F.lit, order_names(filters))), F.col("rank") + 1)
    named = summed.withColumn("filter_order", name).withColumn(
        "place", F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1)))
    )
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gone = named.withColumn("gone", F.sum("removed").over(before))
    whole = gone.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "place")))
    return whole.join(parts, "part").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - F.col("gone")).alias("kept"), "removed",
        (F.element_at("fails", F.col("place")) - F.col("removed")).alias("redundant"),
        F.element_at("only", F.col("place")).alias("unique_fails"),
        "good_lost", "toxic_lost", "shapley",
    )


def _part_totals(counts: DataFrame, filters: str) -> DataFrame:
    """``part, total, fails, only``: documents, and by filter those that fail it or it alone."""
    def held(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("removed")).otherwise(0))

    bits = [1 << i for i in range(len(filters))]
    return counts.groupBy("part").agg(
        F.sum("removed").alias("total"),
        F.array(*[held(F.col("mask").bitwiseAND(b) != 0) for b in bits]).alias("fails"),
        F.array(*[held(F.col("mask") == b) for b in bits]).alias("only"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``step_totals`` of the five filters over whole texts; E fails copies of a smaller id's text."""
    rows = with_labels(document_masks(docs, key, text, part), labels, key)
    return step_totals(with_copies(rows, 1 << FILTERS.index(COPY)))
