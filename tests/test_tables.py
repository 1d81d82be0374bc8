import random

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from namesieve.operators import acronyms, dataset, kernel, overlap, scoring, similarity, tokens


def test_stratified_split_is_exact_and_repeatable(spark):
    rows = [(i, "GEN" if i % 3 else "SPE") for i in range(1001)] + [(2000, "ODD"), (2001, None)]
    df = spark.createDataFrame(rows, "id int, label string")
    a = {r.id: r.part for r in dataset.stratified_split(df, "id", fraction=0.3, seed=5).collect()}
    b = {r.id: r.part for r in dataset.stratified_split(df.repartition(5), "id", fraction=0.3, seed=5).collect()}
    assert a == b and len(a) == len(rows)
    for label in ("GEN", "SPE", "ODD", None):
        ids = [i for i, x in rows if x == label]
        assert sum(a[i] == "train" for i in ids) == int(0.3 * len(ids) + 0.5)


def test_split_of_tiny_and_full_fractions(spark):
    df = spark.createDataFrame([(i, "GEN") for i in range(9)], "id int, label string")
    for fraction, n in ((0.0, 0), (1.0, 9), (0.5, 5)):
        got = dataset.stratified_split(df, "id", fraction=fraction).where("part = 'train'").count()
        assert got == n


def test_row_index_and_resample(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    assert sorted(r.row_index for r in dataset.row_index(df).collect()) == list(range(1000))
    got = dataset.resample(df, 3, 400, seed=1)
    assert [r["count"] for r in got.groupBy("file_no").count().collect()] == [400] * 3


def test_scores(spark):
    rows = [("GEN", "GEN", 2.0), ("GEN", "SPE", 1.0), ("SPE", "GEN", 4.0), ("SPE", "SPE", 8.0)]
    df = spark.createDataFrame(rows, "label string, prediction string, w double")
    r = scoring.score(df, weight="w").first()
    assert (r.precision, r.recall, r.support) == (2 / 6, 2 / 3, 3.0)
    none = scoring.score(df.withColumn("prediction", F.lit("SPE"))).first()
    assert (none.precision, none.recall, none.f_score) == (0.0, 0.0, 0.0)


def test_frequency_stats_with_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b (c)"), (2, ""), (3, "a a zz")], "id int, input string")
    freq = spark.createDataFrame([("a", 10), ("b", 5), ("c", 2)], "token string, cnt bigint")
    want = {1: (1, 10, 18 / 4), 2: (1, 1, 1.0), 3: (0, 10, 21 / 4)}
    for hot in (1, 100):
        monkeypatch.setattr(tokens, "FREQUENT", hot)
        got = {r.id: (r.min_freq, r.max_freq, r.mean_freq) for r in tokens.frequency_stats(df, freq, "id").collect()}
        assert got == want


def test_tags_prefer_later_lists_and_keep_frequent_words(spark):
    lists = spark.createDataFrame(
        [("location", "oslo"), ("type", "oslo"), ("stop_word", "of"), ("subject", "law")], "list string, term string"
    )
    df = spark.createDataFrame([(1, "Oslo oslo OF law xx yy"), (2, "")], "id int, input string")
    got = {r.id: r.tags for r in tokens.tag_sequences(df, tokens.tag_table(lists), "id").collect()}
    assert got == {1: ["^T", "^of", "^S", "^nf"], 2: []}
    keep = spark.createDataFrame([("law",), ("xx",)], "token string")
    kept = tokens.tag_sequences(df, tokens.tag_table(lists), "id", keep=keep).where("id = 1").first()
    assert kept.tags == ["^T", "^of", "law", "xx", "^nf"]


def test_translation_keeps_order(spark):
    df = spark.createDataFrame([(1, "Dept Sci. x sci."), (2, "")], "id int, input string")
    mapping = spark.createDataFrame([("sci.", "Science")], "abbreviation string, replacement string")
    got = {r.id: r.translated for r in tokens.translate_tokens(df, mapping, "id").collect()}
    assert got == {1: "Dept Science x Science", 2: ""}


def test_overlap_and_acronyms(spark):
    corpus = spark.createDataFrame([("law", "law x", "GEN"), ("x", "law x", "GEN"), ("loi", "loi", "SPE")], "token string, input string, label string")
    lists = spark.createDataFrame([("law", "a", "en"), ("law", "a", "en"), ("loi", "b", "fr"), ("recht", "c", "de")], "token string, list string, lang string")
    got = {r.lang: (r.found, r.total) for r in overlap.overlap(overlap.mark_found(lists, corpus), "lang", True).collect()}
    assert got == {"en": (1, 1), "fr": (1, 1), "de": (0, 1)}
    flags = overlap.category(overlap.string_flags(overlap.flag_corpus(corpus, lists)))
    assert {r.input: r.type for r in flags.collect()} == {"law x": "found not novel", "loi": "found novel"}
    rows = spark.createDataFrame([(1, "Foo ABCD"), (2, "ABCD bar"), (3, "XYZQ"), (3, "XYZQ")], "id int, input string")
    amb = acronyms.ambiguous_acronyms(rows).collect()
    assert [(r.acronyms, r.n_ids) for r in amb] == [("ABCD", 2)]


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, c int, vector array<double>").repartition(5)
    got = similarity.similar_pairs(df.where("c = 0"), df.where("c <> 0"), 15).collect()
    want = sorted(
        ((np.dot(a[2], b[2]), a[0], b[0]) for a in rows if a[1] == 0 for b in rows if b[1] != 0), reverse=True
    )[:15]
    assert [(r.query_id, r.other_id) for r in got] == [(a, b) for _, a, b in want]


def test_kernel_map_approximates_kernel(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice((0.0, 1.0)) for _ in range(5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    fitted = kernel.fit_kernel(df, 5, key="id", landmarks=40)
    got = np.array([r.mapped.toArray() for r in kernel.apply_kernel(df, fitted).orderBy("id").collect()])
    x = np.array([v for _, v in rows])
    assert np.allclose(got @ got.T, (x @ x.T / 5 + 1) ** 2, atol=1e-4)


def test_lookups_of_any_size_agree(spark, lexicon, terms, monkeypatch):
    """The shuffle branches, with hot words sent around, equal the broadcast ones."""
    from dataclasses import replace

    from namesieve.operators import lexicon as lists
    from namesieve.operators import rules, tokens
    from namesieve.operators.normalize import remove_stopwords_by_join

    texts = ["the Department of Physics", "dept dept applied physics", "the the Oslo lab", "", "law of the ltd."] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "k int, input string")
    mapping = spark.createDataFrame([("dept", "department"), ("lab", "laboratory")], "abbreviation string, replacement string")
    tags = tokens.tag_table(terms)
    stops = spark.createDataFrame([("the",), ("of",)], "term string")

    def everything():
        found = [
            tokens.translate_tokens(df, mapping, "k").select("k", "translated"),
            tokens.tag_sequences(df, tags, "k").select("k", "tags"),
            remove_stopwords_by_join(df.withColumn("norm", df["input"]), stops, "k").select("k", "norm_no_sw"),
        ]
        return [sorted(map(repr, x.collect())) for x in found]

    small = everything()
    plain = sorted(map(repr, rules.rule_matrix(df, lexicon).collect()))
    monkeypatch.setattr(lists, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(tokens, "FREQUENT", 2)
    assert everything() == small
    assert not lexicon.fits_broadcast
    assert sorted(map(repr, rules.rule_matrix(df, replace(lexicon, first_words=None)).collect())) == plain
