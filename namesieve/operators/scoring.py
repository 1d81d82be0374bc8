"""Evaluation tables: scores, ablation, slices, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.fixed import GEN
from namesieve.operators.rules import RULE_COLUMNS


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def score_columns(tp: Column, predicted: Column, actual: Column, beta: float = 1.0) -> list[Column]:
    """Precision, recall and F-beta from their counts; 0 where a denominator is 0."""
    p, r = _ratio(tp, predicted), _ratio(tp, actual)
    b2 = beta * beta
    f = _ratio((1 + b2) * p * r, b2 * p + r)
    return [p.alias("precision"), r.alias("recall"), f.alias("f_score")]


def score(
    df: DataFrame,
    gold: str = "label",
    predicted: str = "prediction",
    weight: str | None = None,
    by: tuple[str, ...] = (),
    beta: float = 1.0,
) -> DataFrame:
    """Precision, recall, F-beta and support of label GEN, optionally weighted and grouped."""
    w = F.col(weight).cast("double") if weight else F.lit(1)
    zero = F.lit(0.0) if weight else F.lit(0)
    is_gold, is_pred = F.col(gold) == GEN, F.col(predicted) == GEN

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, w)), zero)

    counts = df.groupBy(*by).agg(
        total(is_gold & is_pred).alias("tp"),
        total(is_pred).alias("n_predicted"),
        total(is_gold).alias("support"),
    )
    tp, pred, actual = F.col("tp"), F.col("n_predicted"), F.col("support")
    return counts.select(*by, *score_columns(tp, pred, actual, beta), "support")


def accuracy(df: DataFrame, gold: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.agg(
        F.avg((F.col(gold) == F.col(predicted)).cast("int")).alias("accuracy"),
        F.count_if(F.col(predicted) == GEN).alias("n_gen"),
    )


def cumulative_prefix(matrix: DataFrame, *carried: str) -> DataFrame:
    """First non-null prediction of the first k rules, one column per k."""
    return matrix.select(
        *carried,
        *[
            F.coalesce(*RULE_COLUMNS[: k + 1], F.lit("None")).alias(f"prefix_{k:02d}")
            for k in range(len(RULE_COLUMNS))
        ],
    )


def ablation(
    labelled: DataFrame, gold: str = "label", rules: tuple[str, ...] = RULE_COLUMNS
) -> DataFrame:
    """Scores of every rule alone and of every prefix of the cascade.

    Rows that agree in the label and in all rules are counted first, so the many systems are compared
    once for each such pattern; only the one-row result is unpivoted.  A column ``rows`` tells how many
    rows a row stands for.
    """
    weight = F.sum("rows") if "rows" in labelled.columns else F.count("*")
    labelled = labelled.groupBy(F.col(gold), *rules).agg(weight.alias("rows"))
    systems: dict[str, Column] = {}
    for i, name in enumerate(rules):
        systems[name] = F.col(name)
        systems[name.replace("rule_", "rule_00-")] = F.coalesce(*rules[: i + 1])
    is_gold = F.col(gold) == GEN

    def rows_with(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0).cast("bigint"))

    aggs = [rows_with(F.lit(True)).alias("total"), rows_with(is_gold).alias("actual")]
    for name, value in systems.items():
        aggs += [
            rows_with(value.isNotNull()).alias(f"{name}#n"),
            rows_with(value == GEN).alias(f"{name}#p"),
            rows_with((value == GEN) & is_gold).alias(f"{name}#t"),
        ]
    wide = labelled.agg(*aggs)
    long = wide.select(
        "total",
        "actual",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("system"),
                        F.col(f"`{name}#n`").alias("n"),
                        F.col(f"`{name}#p`").alias("p"),
                        F.col(f"`{name}#t`").alias("t"),
                    )
                    for name in systems
                ]
            )
        ).alias("s"),
    ).select("total", "actual", "s.*")
    return long.select(
        "system",
        F.col("n").alias("prediction_count"),
        *score_columns(F.col("t"), F.col("p"), F.col("actual")),
        (F.col("n") / F.col("total")).alias("pct_predicted"),
    )


def rule_overlap(matrix: DataFrame, rules: tuple[str, ...] = RULE_COLUMNS) -> DataFrame:
    """How many rules fire on a string: number of strings per count."""
    fired = sum((F.col(c).isNotNull().cast("int") for c in rules), F.lit(0))
    return matrix.select(fired.alias("n_rules")).groupBy("n_rules").agg(F.count("*").alias("n"))


def describe_counts(histogram: DataFrame, value: str, count: str = "n") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles from a value histogram.

    Working from ``(value, count)`` keeps the exact percentiles independent of the row count.
    """
    v, n = F.col(value), F.col(count)
    mean = F.sum(v * n) / F.sum(n)
    # The square of a length of 46,341 is no integer any more, and sums of squares soon are no long.
    square = v.cast("decimal(10)") * v.cast("decimal(10)")
    squares = F.sum((square * n.cast("decimal(17)")).cast("decimal(38)")).cast("double")
    variance = (squares - F.sum(n) * mean * mean) / (F.sum(n) - 1)
    quart = [
        F.expr(f"percentile({value}, {q}, {count})").alias(name)
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    ]
    return histogram.agg(
        F.sum(n).alias("n"),
        mean.alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
        F.min(v).alias("min"),
        *quart,
        F.max(v).alias("max"),
    )


def length_histogram(df: DataFrame, text: str = "input", width: int | None = None) -> DataFrame:
    """Strings per length, or per length bin of ``width`` characters."""
    length = F.length(text)
    cell = length if width is None else (F.floor(length / width) * width)
    return df.groupBy(cell.cast("int").alias("length")).agg(F.count("*").alias("n"))


def score_by_length(df: DataFrame, gold: str = "label", predicted: str = "prediction") -> DataFrame:
    """Scores and share of decided rows per string length."""
    is_gold, is_pred = F.col(gold) == GEN, F.col(predicted) == GEN
    counts = df.groupBy(F.length("input").alias("input_len")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(predicted) != "None", 1)).alias("decided"),
        F.count_if(is_gold & is_pred).alias("tp"),
        F.count_if(is_pred).alias("p"),
        F.count_if(is_gold).alias("a"),
    )
    return counts.select(
        "input_len",
        "n",
        *score_columns(F.col("tp"), F.col("p"), F.col("a")),
        (F.col("decided") / F.col("n")).alias("pct_predicted"),
    )


def score_short(df: DataFrame, below: int = 15, gold: str = "label", predicted: str = "prediction") -> DataFrame:
    """Scores on the strings shorter than ``below`` and their share of the data."""
    short = F.length("input") < below
    is_gold, is_pred = F.col(gold) == GEN, F.col(predicted) == GEN
    counts = df.agg(
        F.count("*").alias("total"),
        F.count_if(short).alias("n"),
        F.count_if(short & is_gold & is_pred).alias("tp"),
        F.count_if(short & is_pred).alias("p"),
        F.count_if(short & is_gold).alias("a"),
    )
    return counts.select(
        "n",
        (F.col("n") / F.col("total")).alias("share"),
        *score_columns(F.col("tp"), F.col("p"), F.col("a")),
    )


def system_crosstab(df: DataFrame, systems: dict[str, str]) -> DataFrame:
    """Rows per label for each system; counted in one pass, then unpivoted."""
    aggs = []
    for name, column in systems.items():
        aggs += [
            F.count_if(F.col(column) == label).alias(f"{name}#{label}") for label in ("GEN", "SPE")
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("system"),
                F.col(f"`{name}#GEN`").alias("gen"),
                F.col(f"`{name}#SPE`").alias("spe"),
            )
            for name in systems
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("s")).select("s.*")


def compare_profiles(df: DataFrame, before: str, after: str) -> DataFrame:
    """Changed predictions between two systems, by the class the first one gave."""
    changed = ~F.col(before).eqNullSafe(F.col(after))
    return df.groupBy(F.col(before).alias("before")).agg(
        F.count_if(changed).alias("n_changed"),
        F.count("*").alias("n"),
        F.avg(changed.cast("int")).alias("share_changed"),
    )


def regression_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected against actual label per key, with a status column."""
    joined = expected.select(key, F.col("label").alias("expected")).join(
        actual.select(key, F.col("prediction").alias("actual")), key
    )
    same = F.col("expected").eqNullSafe(F.col("actual"))
    return joined.withColumn("status", F.when(same, "success").otherwise("failure"))


def baseline_delta(df: DataFrame, system: str, base: str, cand: str, by: str, values: list[str]) -> DataFrame:
    """Relative difference of a candidate system to a baseline per data set."""
    left = df.where(F.col(system) == base).select(by, *[F.col(v).alias(f"{v}_b") for v in values])
    right = df.where(F.col(system) == cand).select(by, *[F.col(v).alias(f"{v}_c") for v in values])
    return left.join(right, by).select(
        by,
        *[((F.col(f"{v}_c") - F.col(f"{v}_b")) / F.col(f"{v}_b")).alias(v) for v in values],
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def errors(df: DataFrame, gold: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.where(F.col(gold) != F.col(predicted))


def correct(df: DataFrame, gold: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.where(F.col(gold) == F.col(predicted))


def share_different(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg((~F.col(a).eqNullSafe(F.col(b))).cast("int")).alias("share_different"))
