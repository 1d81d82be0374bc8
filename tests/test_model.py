import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesieve.operators import features, kernel, learning, ranks, rules, search, similarity, stages, svm
from namesieve.session import checkpointed

OPTIONS = features.FeatureOptions(
    top_level_word=True, all_caps=True, min_df_joined=2, min_df_ngrams=2, rare_words=True, max_word_freq=True
)


def training(spark, n=300):
    rng = random.Random(2)
    gen = ["Department of Physics", "dept applied physics", "physics dept", "central law", "law"]
    spe = ["Foo University", "ACME ltd.", "Oslo lab", "XYZQ group", "Bar technologies"]
    rows = []
    for i in range(n):
        pool, label = (gen, "GEN") if i % 2 else (spe, "SPE")
        rows.append((rng.choice(pool) + rng.choice(["", " a", " north", " unit 3"]), label, float(i % 5 + 1)))
    rows += [("cdc", "GEN", 1000.0)]
    return spark.createDataFrame(rows, "input string, label string, numdocs double")


def test_positions_and_totals_follow_the_order_only(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    for parts in (1, 5, 16):
        df = spark.createDataFrame(rows, "k int, v int").repartition(parts)
        got = ranks.dense_positions(df, "k").collect()
        assert sorted((r.position, r.k) for r in got) == [(i, i) for i in range(1000)]
        total = {r.k: r.total for r in ranks.running_total(df, F.col("v"), F.desc("k")).collect()}
        upto = 0
        for k, v in sorted(rows, reverse=True):
            upto += v
            assert total[k] == upto
    assert ranks.dense_positions(spark.createDataFrame([], "k int"), "k").collect() == []


def test_quantiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.choice((0.0, 1.5, 2.0, rng.random())), rng.randrange(4), None if i % 9 else 3.0) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, n int, y double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = features.exact_quantiles(df, ["x", "y"], shares, "n")
    assert np.allclose(got["x"], np.quantile([x for x, n, _ in rows for _ in range(n)], shares))
    assert set(got["y"]) == {3.0} and features.exact_quantiles(df.where("false"), ["x"], shares) == {"x": []}
    edges = features.bin_edges(df, ["x", "y"], 4)
    values = [x for x, _, _ in rows]
    want = sorted({float(q) for q in np.quantile(values, [0.25, 0.5, 0.75]) if min(values) < q < max(values)})
    assert np.allclose(edges["x"], want) and edges["y"] == []


@pytest.fixture(scope="module")
def trained(spark, terms, lexicon):
    """Training rows, what was prepared from them, and a model; the costly part, done once."""
    train = checkpointed(training(spark, 120))
    data = learning.Training.prepare(train, lexicon, terms, terms.where("list = 'type'"), OPTIONS)
    fitted = features.fit_features(data.raw, OPTIONS, "rows")
    linear = svm.fit_squared_hinge(data.examples(fitted), 0.01, 1e-4)
    return train, data, learning.HybridModel(OPTIONS, data.state, fitted, linear)


def test_hybrid_learns_overrides_and_survives_saving(spark, terms, lexicon, trained, tmp_path):
    train, data, model = trained
    assert model.svm.gradient_norm <= 1e-4 * model.svm.first_norm
    done = {r.input: (r.margin, r.prediction) for r in model.score_distinct(data.matrix).collect()}
    labels = {r.input: r.label for r in train.collect()}
    right = [done[x][1] == label for x, label in labels.items() if x != "cdc"]
    assert done["cdc"][1] == "SPE" and sum(right) > 0.9 * len(right)
    path = str(tmp_path / "model")
    stages.pipeline_of(model, terms).write().save(path)
    again = stages.load_pipeline(path)
    strings = spark.createDataFrame([(x,) for x in ("Department of Physics", "Foo University", "", "cdc", "new words")], "input string")
    rows = {r.input: r for r in again.transform(strings).select("input", "margin", "prediction").collect()}
    assert len(rows) == 5 and rows["cdc"].prediction == "SPE"
    for text in ("Department of Physics", "Foo University"):
        if text in done:
            assert abs(rows[text].margin - done[text][0]) < 1e-9 and rows[text].prediction == done[text][1]
    assert stages.model_of(again).options == model.options
    vectors = checkpointed(model.features.vectors(data.raw))
    over = features.feature_overhead(vectors).first()
    assert 0 < over.density < 1 and over.mean_nonzero > 5 and over.n_features == model.features.size
    from namesieve.sources.writers import write_libsvm

    classes = write_libsvm(vectors.join(train.select("input", "label"), "input"), str(tmp_path / "svm"))
    assert classes == ["GEN", "SPE"] and spark.read.format("libsvm").load(str(tmp_path / "svm")).count() == 120


def test_document_frequencies_count_rows(trained):
    _, data, model = trained
    fitted = model.features
    vocabulary = fitted.vocabulary.collect()
    assert sorted(r.id for r in vocabulary) == list(range(fitted.size)) and fitted.n_rows == 120
    assert [(r.grp, r.term) for r in sorted(vocabulary, key=lambda r: r.id)] == sorted((r.grp, r.term) for r in vocabulary)
    first = {r.term: r.df for r in vocabulary if r.grp == "rule_first"}
    assert sum(first.values()) == 120
    # Frequencies also count the string that a list decides.
    assert {r.token for r in data.state.freq.collect()} >= {"cdc"} and "cdc" not in {r.input for r in data.kept.collect()}
    # A dictionary beyond the broadcast size gives the same rows.
    before = sorted(map(tuple, fitted.encode(data.raw).collect()))
    from namesieve.operators import lexicon as lists

    small, lists.BROADCAST_ROWS = lists.BROADCAST_ROWS, 0
    often, features.FREQUENT_TERMS = features.FREQUENT_TERMS, 5
    try:
        assert sorted(map(tuple, fitted.encode(data.raw).collect())) == before
    finally:
        lists.BROADCAST_ROWS, features.FREQUENT_TERMS = small, often


def examples(spark, n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d)) < 0.3
    x[:5] = False
    y = np.where(x @ rng.normal(size=d) + rng.normal(size=n) > 0, 1, -1)
    s = rng.integers(0, 6, n).astype(float)
    rows = [
        ({"size": d, "indices": np.flatnonzero(r).tolist(), "values": [1.0] * int(r.sum())}, int(a), float(b))
        for r, a, b in zip(x, y, s)
    ]
    kind = "features struct<size: long, indices: array<long>, values: array<double>>, target int, weight double"
    return spark.createDataFrame(rows, kind), np.c_[x.astype(float), np.ones(n)], y, s


@pytest.mark.parametrize("tables", (False, True))
def test_gradient_vanishes_at_the_optimum(spark, tables, monkeypatch):
    df, x, y, s = examples(spark, 80, 8)
    if tables:
        monkeypatch.setattr(svm, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(svm, "FREQUENT_FEATURES", 3)
    half = [1, 3, 5]
    members = spark.createDataFrame([(0, i) for i in range(8)] + [(1, i) for i in half], "cand int, id long")
    weights, stats = svm.fit_weights(df, members, {0: 0.05, 1: 0.02}, 1e-3, 10)
    found = weights.collect()
    for cand, cost, own in ((0, 0.05, range(8)), (1, 0.02, half)):
        w = np.zeros(9)
        for r in found:
            if r.cand == cand:
                w[r.id] = r.weight
        gap = np.maximum(0, 1 - y * (x @ w))
        gradient = w - 2 * cost * x.T @ (s * y * gap)
        _, norm, first = stats[cand]
        assert abs(np.linalg.norm(gradient[[*own, 8]]) - norm) < 1e-6 * first and norm <= 1e-3 * first
        assert {r.id for r in found if r.cand == cand} == {-1, *own}
    if not tables:
        rows = spark.createDataFrame([("a", 3, 2.0), ("b", None, None)], "k string, id long, value double")
        margins = svm.linear_margins(rows, weights.where("cand = 0"), "k")
        w = {r.id: r.weight for r in found if r.cand == 0}
        assert {r.k: round(r.margin, 9) for r in margins.collect()} == {"a": round(2 * w[3] + w[-1], 9), "b": round(w[-1], 9)}


def test_search_equals_a_single_fit(spark, terms, lexicon, trained):
    train, data, model = trained
    dev = train.where("input <> 'cdc'")
    weaker = replace(OPTIONS, rules=(18,), word_list=False, word_list_top=False, top_level_word=False, n_bins=2)
    best, trials = search.search(
        train, dev, lexicon, terms, terms.where("list = 'type'"), [(OPTIONS, 0.01), (weaker, 0.001)], shares=(0.5, 1.0),
        tolerance=1e-4,
    )
    assert [t["rung"] for t in trials] == [0, 0, 1] and best[0] in (OPTIONS, weaker)
    last = trials[-1]
    if last["candidate"] == 0:
        done = {r.input: r.prediction for r in model.score_distinct(data.matrix).collect()}
        rows = [(r.label, done[r.input], r.numdocs) for r in dev.collect()]
        hit = sum(w for a, b, w in rows if a == b == "GEN")
        total = sum(w for a, _, w in rows if a == "GEN") + sum(w for _, b, w in rows if b == "GEN")
        assert abs(2 * hit / total - last["f_score"]) < 1e-9


def test_search_points_are_seeded():
    assert learning.random_options(3, seed=4) == learning.random_options(3, seed=4)
    assert learning.random_options(3, seed=4) != learning.random_options(3, seed=5)


@pytest.mark.parametrize("sparse", (False, True))
def test_similar_pairs_skip_blocks_that_cannot_win(spark, sparse, monkeypatch):
    monkeypatch.setattr(similarity, "FIRST_PAIRS", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) * (rng.random((300, 12)) < 0.25 if sparse else 1.0)
    x[:6] *= 20
    if sparse:
        rows = [(i, ({"indices": np.flatnonzero(v).tolist(), "values": v[v != 0].tolist()}, i % 3)) for i, v in enumerate(x)]
        kind = "id long, v struct<vector: struct<indices: array<long>, values: array<double>>, side: int>"
    else:
        rows = [(i, (v.tolist(), i % 3)) for i, v in enumerate(x)]
        kind = "id long, v struct<vector: array<double>, side: int>"
    df = spark.createDataFrame(rows, kind).select("id", "v.*")
    left, right = df.where("side = 0"), df.where("side > 0")
    found, counts = similarity.counted_pairs(left, right, 10, rows=24)
    a, b = [i for i in range(300) if i % 3 == 0 and x[i].any()], [i for i in range(300) if i % 3 and x[i].any()]
    pairs = [(float(x[i] @ x[j]), i, j) for i in a for j in b if ((x[i] != 0) & (x[j] != 0)).any()]
    want = sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:10]
    assert [(r.query_id, r.other_id) for r in found.orderBy(F.desc("dot"), "query_id", "other_id").collect()] == [p[1:] for p in want]
    assert counts.scored + counts.skipped <= len(a) * len(b) and counts.skipped > 0
    if not sparse:
        assert counts.scored + counts.skipped == len(a) * len(b)
    if sparse:
        return
    every = similarity.counted_pairs(left, right, 10**6, rows=128)[0]
    assert every.count() == len(pairs)
    assert similarity.similar_pairs(left.where("false"), right, 5).count() == 0


def test_kernel_rows_of_dense_and_sparse_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 7)) * (rng.random((60, 7)) < 0.6)
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, features array<double>")
    sparse = spark.createDataFrame(
        [(i, {"size": 7, "indices": np.flatnonzero(v).tolist(), "values": v[v != 0].tolist()}) for i, v in enumerate(x)],
        "k long, features struct<size: long, indices: array<long>, values: array<double>>",
    )
    for kind in ("rbf",):
        maps = [kernel.fit_kernel(df, 7, "k", kind=kind, landmarks=9) for df in (dense, sparse)]
        rows = [kernel.kernel_rows(df, m, "k").collect() for df, m in zip((dense, sparse), maps)]
        drawn = {r.no: r.key for r in maps[0].landmarks.collect()}
        for found in rows:
            got = {(r.k, r.no): r.kernel for r in found}
            assert len(got) == 60 * 9
            for (i, no), value in got.items():
                p, q = x[i], x[drawn[no]]
                want = (p @ q / 7 + 1) ** 2 if kind == "poly" else np.exp(-((p - q) ** 2).sum() / 7)
                assert abs(value - want) < 1e-9
        mapped = {r.k: np.array(r.mapped) for r in kernel.apply_kernel(sparse, maps[1], "k").collect()}
        a, b = drawn[0], drawn[1]
        assert abs(mapped[a] @ mapped[b] - {(r.k, r.no): r.kernel for r in rows[0]}[a, 1]) < 1e-6
