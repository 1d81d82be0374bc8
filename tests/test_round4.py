"""Findings of the fourth review round: passes of the solver, similar pairs without copies of blocks."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from namesieve.operators import similarity, svm


def test_blocks_of_indicators_are_small_and_hold_known_features():
    """Places take four bytes and equal values one number; ids that are not asked for are left out."""
    ids = [[7, 40, 90], [5], [], [40, 41]]
    batch = pa.RecordBatch.from_pydict(
        {"ids": ids, "values": [[1.0] * len(i) for i in ids], "y": [1.0, -1.0, 1.0, -1.0], "s": [1.0, 2.0, 3.0, 0.5]}
    )
    packed = next(svm.pack(iter([batch]), np.array([7, 40, 90])))
    assert packed.column("at")[0].as_buffer().size == 4 * 4 and packed.column("values")[0].as_buffer().size == 8
    block = next(svm.blocks_of(packed))
    w = np.array([1.0, 10.0, 100.0, 0.5])
    assert svm.dots(block, w).tolist() == [111.5, 0.5, 0.5, 10.5]
    assert svm.spread_back(block, np.array([1.0, 2.0, 4.0, 8.0]), 4).tolist() == [1.0, 9.0, 1.0, 15.0]
    nothing = next(svm.blocks_of(next(svm.pack(iter([batch]), np.zeros(0, np.int64)))))
    assert svm.dots(nothing, np.array([0.5])).tolist() == [0.5] * 4


def test_directions_of_the_last_step_save_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((600, 80)) < 0.3
    y = np.where(x @ rng.normal(size=80) + 3 * rng.normal(size=600) > 0, 1, -1)
    rows = [(np.flatnonzero(r).tolist(), int(a)) for r, a in zip(x, y)]
    made = spark.createDataFrame(rows, "ids array<long>, target int").selectExpr(
        "named_struct('size', 80L, 'indices', ids, 'values', transform(ids, i -> 1D)) AS features", "target", "1D AS weight"
    )
    counted, seen = svm.Newton.sums, []

    def sums(self, what, *more):
        seen.append(what.__name__)
        return counted(self, what, *more)

    monkeypatch.setattr(svm.Newton, "sums", sums)
    # Only a few leading features, so that the rounds have something to do.
    monkeypatch.setattr(svm, "LEAD", 4)
    found = {}
    for kept in (0, 48):
        monkeypatch.setattr(svm, "KEPT", kept)
        seen.clear()
        model = svm.fit_squared_hinge(made, 1.0, 1e-8)
        assert model.gradient_norm <= 1e-8 * model.first_norm
        found[kept] = seen.count("second_order"), {r.id: r.weight for r in model.weights.collect()}
    assert found[48][0] < found[0][0]
    assert all(abs(found[0][1][i] - found[48][1][i]) < 1e-5 for i in found[0][1])


def test_blocks_are_not_copied_for_their_pairs(spark, monkeypatch):
    """Rows travel to their block only, in however many pairs of blocks they are scored."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    left, right = df.where("id < 150"), df.where("id >= 150")
    made = []
    packed = similarity.blocked

    def blocked(placed, rows=64):
        made.append(packed(placed, rows))
        return made[-1]

    monkeypatch.setattr(similarity, "blocked", blocked)
    found, _ = similarity.counted_pairs(left, right, 7, rows=16)
    pairs = sorted((-float(x[i] @ x[j]), i, j) for i in range(150) for j in range(150, 400))[:7]
    assert [(r.query_id, r.other_id) for r in found.orderBy(F.desc("dot"), "query_id").collect()] == [p[1:] for p in pairs]
    # every block is one row, and a side's blocks hold each of its rows once
    ids = [i for r in made[-2].collect() + made[-1].collect() for i in r.ids]
    assert len(ids) == len(set(ids)) and max(len(r.ids) for r in made[-1].collect()) <= 16


def test_rows_of_two_blocks_that_cannot_reach_the_limit_are_left_out():
    def block(rows):
        struct = [{"id": i, "e": [{"idx": j, "value": v} for j, v in r.items()]} for i, r in enumerate(rows)]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("e", pa.list_(pa.struct([("idx", pa.int64()), ("value", pa.float64())])))]))
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([struct], kind)], ["block", "rows"])
        packed = next(similarity.pack(iter([batch])))
        return {n: np.frombuffer(packed.column(n)[0].as_buffer(), t) for n, t in similarity.PACKED.items()}

    one, two = block([{1: 2.0, 5: 3.0}, {1: -2.0}, {9: 50.0}]), block([{5: 4.0, 1: 1.0}, {1: -3.0}, {7: 90.0}])
    x, y, dots = similarity.products(one, two, 6.0)
    assert sorted(zip(x.tolist(), y.tolist(), dots.tolist())) == [(0, 0, 14.0), (1, 1, 6.0)]
    x, y, dots = similarity.products(one, two, float("-inf"))
    assert sorted(zip(x.tolist(), y.tolist(), dots.tolist())) == [(0, 0, 14.0), (0, 1, -6.0), (1, 0, -2.0), (1, 1, 6.0)]
