"""Findings of the third review round: long lengths, n-grams, the solver, similar pairs."""

import numpy as np
import pyarrow as pa

from namesieve.operators import scoring, similarity, svm
from namesieve.plans import catalogue
from namesieve.sources import writers


def test_describe_counts_of_long_strings(spark):
    hist = spark.createDataFrame([(1, 2), (50_000, 1), (2_000_000_000, 10)], "length int, n long")
    row = scoring.describe_counts(hist, "length").first()
    values = [1, 1, 50_000] + [2_000_000_000] * 10
    mean = sum(values) / len(values)
    assert row.n == 13 and row.max == 2_000_000_000 and abs(row["mean"] - mean) < 1e-3
    assert abs(row["std"] / (sum((v - mean) ** 2 for v in values) / 12) ** 0.5 - 1) < 1e-9


def test_token_ngrams_go_up_to_three_words(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "station")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.n: (r.n_grams, r.n_distinct) for r in catalogue.token_ngrams(spark, str(tmp_path)).collect()}
    assert rows == {1: (4, 4), 2: (3, 3), 3: (2, 2)}


def test_blocks_and_leading_features_of_the_solver(monkeypatch):
    ids, y, s = [[0, 2, 3], [1], [], [2, 3]], [1.0, -1.0, 1.0, -1.0], [1.0, 2.0, 3.0, 0.5]
    batch = pa.RecordBatch.from_pydict({"ids": ids, "values": [[2.0] * len(i) for i in ids], "y": y, "s": s})
    block = next(svm.blocks_of(next(svm.pack(iter([batch])))))
    dense = np.zeros((4, 5))
    for row, places in enumerate(ids):
        dense[row, places] = 2.0
    dense[:, 4] = 1
    w = np.array([0.1, 0.2, 3.0, -0.3, 0.1])
    k = np.where(block[3] * (dense @ w) < 1, 2 * 0.5 * block[4], 0.0)
    lead = np.array([1, 2, 4])
    wanted = (dense.T * k) @ dense
    monkeypatch.setattr(svm, "PAIRS", 2)
    assert np.allclose(svm.leading_order(block, 0.5, w, lead).reshape(3, 3), wanted[np.ix_(lead, lead)])
    assert np.allclose(svm.dots(block, w), dense @ w)


def test_solver_adds_in_tasks_or_in_the_driver(spark, monkeypatch):
    """Features that come together need few rounds; both ways to add give the same optimum."""
    rows = [([j for j in range(40) if (i * (j // 4 + 3)) % 7 < 3], 1 if i % 7 < 3 else -1, 50.0 + i) for i in range(300)]
    schema = "ids array<long>, target int, weight double"
    made = spark.createDataFrame(rows, schema).selectExpr(
        "named_struct('size', 40L, 'indices', ids, 'values', transform(ids, i -> 1D)) AS features", "target", "weight"
    )
    rounds = []
    counted = svm.Newton.sums

    def sums(self, what, *more):
        rounds.append(what.__name__)
        return counted(self, what, *more)

    monkeypatch.setattr(svm.Newton, "sums", sums)
    direct = svm.fit_squared_hinge(made, 1.0, 1e-9)
    assert direct.gradient_norm <= 1e-9 * direct.first_norm
    assert rounds.count("second_order") <= 3 * direct.iterations
    monkeypatch.setattr(svm, "DIRECT_BYTES", 0)
    tasks = svm.fit_squared_hinge(made, 1.0, 1e-9)
    one, two = ({r.id: r.weight for r in m.weights.collect()} for m in (direct, tasks))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_rows_that_cannot_win_are_in_no_block(spark):
    """Short strings cannot reach the best pairs of long ones, in whatever block they would be."""
    rows = [(i, {"indices": [j for j in range(20) if i < 8 or j == i % 20], "values": [1.0] * (20 if i < 8 else 1)}) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, vector struct<indices: array<long>, values: array<double>>")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    kept = similarity.promising(similarity.entered(left, "id", "vector"), similarity.entered(right, "id", "vector"), 5)
    assert kept[0].count() == 4 and kept[1].count() == 4 and kept[2] == 20.0
    found, counts = similarity.counted_pairs(left, right, 5)
    assert [(r.query_id, r.other_id) for r in found.orderBy("query_id", "other_id").collect()] == [(0, 1), (0, 3), (0, 5), (0, 7), (2, 1)]
    assert counts.scored == 16


def test_chunks_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILES_PER_TASK", 2)
    rows = spark.createDataFrame([(i // 2,) for i in range(53)], "k long").repartition(4)
    writers.write_chunks(rows, str(tmp_path / "out"), 5, "k")
    files = [f for f in (tmp_path / "out").glob("part-*.csv")]
    assert sorted(len(f.read_text().splitlines()) - 1 for f in files) == [3] + [5] * 10
    assert len({f.name[:10] for f in files}) == 6
