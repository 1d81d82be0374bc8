"""Plans and results of steps that grow with the input."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from namesieve.operators import features, rules
from namesieve.session import tuned

STRINGS = [
    "Department of Physics", "general dept of applied physics and law", "central general graduate university", "x",
    "", None, "dept. of medicine", "central acme", "theoretical and experimental physics institute", "ABCD", "New York",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_terms_make_no_row_for_each_probe(spark, lexicon):
    df = spark.createDataFrame([(s,) for s in STRINGS], "input string")
    for prof in (rules.profile(), rules.profile_v1(), rules.profile_v1(fuzzy_subjects=False)):
        fast = rules.rule_matrix(df, lexicon, prof)
        plan = plan_of(fast)
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        plain = rules.rule_matrix(df, replace(lexicon, masks=None), prof)
        assert sorted(map(repr, fast.collect())) == sorted(map(repr, plain.collect()))


def test_rows_of_one_key_are_shuffled_once(spark, tmp_path):
    from namesieve.operators import tokens

    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "Dept a"), (1, "b"), (None, "x"), (2, None)], "id int, input string").write.parquet(path)
    df = spark.read.parquet(path)
    mapping = spark.createDataFrame([("dept", "Department")], "abbreviation string, replacement string")
    done = tokens.translate_tokens(df, mapping, "id")
    lines = plan_of(done).split("\n")
    # Only texts are shuffled, not the words that were collected.
    assert not [b for a, b in zip(lines, lines[1:]) if "Exchange hashpartitioning" in a and "collect_list" in b]
    got = sorted((r.id or 0, sorted(r.translated.split())) for r in done.collect())
    assert got == [(0, []), (1, ["Department", "a", "b"]), (1, ["Department", "a", "b"]), (2, [])]


def test_rows_are_counted_by_pattern_before_systems_are_compared(spark):
    from namesieve.operators import scoring

    rows = [("GEN", "GEN", None), ("SPE", "GEN", "SPE"), ("GEN", None, None), (None, None, "SPE")] * 3
    df = spark.createDataFrame(rows, "label string, rule_00 string, rule_01 string")
    names = ("rule_00", "rule_01")
    done = scoring.ablation(df, rules=names)
    assert "keys=[label" in plan_of(done)
    merged = df.groupBy("label", *names).agg(F.count("*").alias("rows"))
    assert sorted(map(repr, done.collect())) == sorted(map(repr, scoring.ablation(merged, rules=names).collect()))
    first = {r.system: r for r in done.collect()}["rule_00"]
    assert (first.prediction_count, first.precision, first.recall, first.pct_predicted) == (6, 0.5, 0.5, 0.5)


def test_gram_rows_build_no_list_of_all_grams(spark):
    from namesieve.functions import shape

    df = spark.createDataFrame([("a b c",), ("",), (None,), ("a",)], "t string")
    done = shape.gram_rows(df, F.split("t", " "), 3)
    want = [(1, ""), (1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a b"), (2, "b c"), (3, "a b c")]
    assert sorted((r.n, r.term) for r in done.collect()) == want


def test_part_files_of_a_folder_are_one_file(spark, tmp_path):
    from namesieve.sources import readers, writers

    lines = spark.range(25).selectExpr("id AS line_no", "concat('l', id) AS value")
    for name in ("a", "b"):
        writers.write_ordered(lines, str(tmp_path / name), per_file=10)
    read = readers.numbered_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")], by_folder=True)
    assert sorted((r.line_no, r.file_line, r.value) for r in read.collect()) == [
        (i, i % 25, f"l{i % 25}") for i in range(50)
    ]


def test_tasks_do_not_grow_with_the_input(spark):
    """A shuffle of the rule stages is merged by its bytes, not down to one partition for each core."""
    tuned(spark)
    few, many = (
        spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("input")).distinct() for n in (100, 1_000_000)
    )
    assert few.rdd.getNumPartitions() == 1
    assert many.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_tag_ngrams_copy_no_slices(spark):
    rows = [(1, ["a", "b", None, "a", "b"]), (2, ["a"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    grams = df.select("id", features._grams(F.col("tags"), (2, 3)).alias("g"))
    assert dict(grams.collect()) == {1: ["a b", "b", "a", "b a"], 2: [], 3: [], 4: []}
    assert "slice(" not in plan_of(grams)
