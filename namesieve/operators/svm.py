"""Linear support vector machines with squared hinge loss over one long feature table.

Each candidate, a set of features and a cost c, minimises over its own coefficients
|w|^2 / 2 + c * sum_i s_i * max(0, 1 - y_i * w.x_i)^2  (the intercept is the coefficient of a constant
feature and part of w) by Newton steps, each solved by preconditioned conjugate gradients.  The
problem is strictly convex, so its solution does not depend on the method.

All candidates take each pass over the examples together.  While the coefficients of all of them are
few enough to broadcast (``BROADCAST_ROWS``), they are sent to the tasks, and each pass is one job: blocks
of examples are multiplied in place and their sums by feature combined.  Beyond that, coefficients,
gradients and directions are tables by candidate and feature: a margin is a join of the long table
with them and a sum by example, a gradient a join with one factor per example and a sum by feature,
and the driver sees a few sums for each candidate only.  Both ways compute the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesieve.operators.lexicon import BROADCAST_ROWS
from namesieve.session import checkpointed, ship

INTERCEPT = -1
# Features that may stand in so many examples that their rows are not shuffled.
FREQUENT_FEATURES = 10_000
STEPS = [0.5**i for i in range(12)]
# Features of the largest second derivatives whose block is inverted as a preconditioner, for all candidates.
LEAD = 1024
BENT = 1.05
# Cells of the matrix of leading features that are filled and multiplied at a time.
PAIRS = 1 << 21
# Share of the diagonal that is added to the block of leading features, which is summed in single precision.
ROUNDED = 1e-5
# Directions of a Newton step, with what the second derivative made of them, that correct the preconditioner of
# the next: their number, and bytes of all candidates' together.
KEPT, KEPT_BYTES = 48, 96 << 20
# Entries of examples that one task reads in a pass; every core has a task while there are fewer.
TASK_ENTRIES = 8 << 20


@dataclass(frozen=True)
class LinearModel:
    """``weights`` are ``id, weight, gradient`` with the intercept under number -1."""

    weights: DataFrame
    iterations: int
    gradient_norm: float
    first_norm: float

    def margins(self, encoded: DataFrame, *keys: str) -> DataFrame:
        """``keys, margin`` of encoded rows ``keys, id, value``; see ``linear_margins``."""
        return linear_margins(encoded, self.weights, *keys)


def linear_margins(encoded: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """``keys, margin``: sum of weight times value, and the intercept, of every key.

    A row with a null ``id`` only carries its key.
    """
    side = weights.select("id", "weight")
    side = F.broadcast(side) if weights.count() <= BROADCAST_ROWS else side
    part = F.coalesce("weight", F.lit(0.0)) * F.coalesce("value", F.lit(0.0))
    constant = weights.where(F.col("id") == INTERCEPT).agg(F.coalesce(F.max("weight"), F.lit(0.0))).first()[0]
    joined = encoded.withColumn("id", F.col("id").cast("long")).join(side, "id", "left")
    return joined.groupBy(*keys).agg((F.sum(part) + constant).alias("margin"))


def example_entries(examples: DataFrame) -> DataFrame:
    """``ex, id, value`` of ``ex, features``, the constant feature included."""
    kind = "array<struct<id: long, value: double>>"
    entries = F.arrays_zip(F.col("features")["indices"].alias("id"), F.col("features")["values"].alias("value"))
    constant = F.array(F.struct(F.lit(INTERCEPT).alias("id"), F.lit(1.0).alias("value")))
    both = F.concat(constant.cast(kind), F.coalesce(entries.cast(kind), F.array().cast(kind)))
    return examples.select("ex", F.inline(both).alias("id", "value"))


class Tables:
    """Examples ``features, target, weight`` (target 1 or -1) as two tables partitioned by example."""

    def __init__(self, examples: DataFrame):
        numbered = examples.where("weight > 0").withColumn("ex", F.monotonically_increasing_id())
        rows = checkpointed(numbered.repartition("ex"))
        self.rows = checkpointed(rows.select("ex", F.col("target").cast("double").alias("y"), F.col("weight").alias("s")))
        self.long = checkpointed(example_entries(rows))
        counts = checkpointed(self.long.groupBy("id").agg(F.count("*").alias("n")))
        self.ids = counts.select("id")
        self.hot = F.broadcast(checkpointed(counts.orderBy(F.desc("n"), "id").limit(FREQUENT_FEATURES).select("id")))

    def margins(self, table: DataFrame, small: bool, *names: str) -> DataFrame:
        """``ex, cand, y, s`` and for each coefficient column its dot product with the example."""
        side = table.select("cand", "id", *names)
        if small:
            joined = self.long.join(F.broadcast(side), "id")
        else:
            hot = F.broadcast(side.join(self.hot, "id"))
            cold = self.long.join(self.hot, "id", "left_anti").join(side, "id")
            joined = self.long.join(hot, "id").unionByName(cold)
        sums = joined.groupBy("ex", "cand").agg(*[F.sum(F.col(n) * F.col("value")).alias(n) for n in names])
        return sums.join(self.rows.hint("shuffle_hash"), "ex")

    def by_feature(self, factors: DataFrame, **sums: Column) -> DataFrame:
        """Sums by candidate and feature over the entries of the examples in ``factors``."""
        joined = factors.join(self.long.hint("shuffle_hash"), "ex")
        return joined.groupBy("cand", "id").agg(*[F.sum(s).alias(n) for n, s in sums.items()])


def _by_candidate(values: dict[int, float]) -> Column:
    """A number for each candidate as an expression."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col("cand"))


class TableNewton:
    """The state of all candidates that are not yet at their optimum, as a table."""

    def __init__(self, problem: Tables, members: DataFrame, costs: dict[int, float]):
        """``members`` are the ``cand, id`` pairs; the constant feature is a member always."""
        self.problem, self.costs = problem, costs
        constant = members.select("cand").distinct().select("cand", F.lit(INTERCEPT).cast("long").alias("id"))
        pairs = members.select(F.col("cand").cast("int").alias("cand"), F.col("id").cast("long").alias("id"))
        pairs = checkpointed(pairs.unionByName(constant).distinct().join(problem.ids, "id"))
        self.small = pairs.count() <= BROADCAST_ROWS
        self.state = checkpointed(self.at(pairs.select("cand", "id", F.lit(0.0).alias("w"))))

    def _cost(self) -> Column:
        return 2 * _by_candidate(self.costs) * F.col("s")

    def at(self, weights: DataFrame) -> DataFrame:
        """``cand, id, w, g, d``: coefficients, gradient and the diagonal of the second derivative."""
        gap, value = 1 - F.col("y") * F.col("w"), F.col("value")
        active = self.problem.margins(weights, self.small, "w").where(gap > 0).select(
            "ex", "cand", (-self._cost() * F.col("y") * gap).alias("first"), self._cost().alias("second")
        )
        sums = self.problem.by_feature(active, first=F.col("first") * value, second=F.col("second") * value * value)
        return weights.select("cand", "id", "w").join(sums, ["cand", "id"], "left").select(
            "cand", "id", "w",
            (F.col("w") + F.coalesce("first", F.lit(0.0))).alias("g"),
            (1 + F.coalesce("second", F.lit(0.0))).alias("d"),
        )

    def sums(self, table: DataFrame, *columns: Column) -> dict[int, tuple]:
        rows = table.groupBy("cand").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
        return {r.cand: tuple(r)[1:] for r in rows}

    def norms(self) -> dict[int, float]:
        return {k: sqrt(v[0]) for k, v in self.sums(self.state, F.col("g") * F.col("g")).items()}

    def curved(self, state: DataFrame) -> DataFrame:
        """Adds ``h``: the second derivative at ``w`` times the direction ``v``."""
        active = self.problem.margins(state, self.small, "w", "v").where(F.col("y") * F.col("w") < 1)
        factors = active.select("ex", "cand", (self._cost() * F.col("v")).alias("factor"))
        sums = self.problem.by_feature(factors, h=F.col("factor") * F.col("value"))
        joined = state.join(sums, ["cand", "id"], "left")
        return joined.withColumn("h", F.col("v") + F.coalesce("h", F.lit(0.0)))

    def direction(self, forcing: dict[int, float], rounds: int) -> DataFrame:
        """``cand, id, w, p``: the Newton direction by conjugate gradients, up to ``forcing``."""
        keys = ("cand", "id", "w", "d")
        r, d, v, h, p = (F.col(n) for n in ("r", "d", "v", "h", "p"))
        now = self.state.select(*keys, F.lit(0.0).alias("p"), (-F.col("g")).alias("r"), (-F.col("g") / d).alias("v"))
        first = {k: x[0] for k, x in self.sums(now, r * r / d).items()}
        left, ready = dict(first), []
        for _ in range(rounds):
            open_ = [k for k, x in left.items() if x > forcing[k] ** 2 * first[k]]
            if len(open_) < len(left):
                ready.append(now.where(~F.col("cand").isin(open_)).select("cand", "id", "w", "p"))
                left = {k: left[k] for k in open_}
                now = now.where(F.col("cand").isin(open_))
            if not left:
                break
            now = checkpointed(self.curved(now))
            found = self.sums(now, v * h, r * h / d, h * h / d)
            a = {k: left[k] / found[k][0] for k in left}
            after = {k: max(left[k] - 2 * a[k] * found[k][1] + a[k] ** 2 * found[k][2], 0.0) for k in left}
            b, left = {k: after[k] / left[k] for k in left}, after
            step = _by_candidate(a)
            now = now.select(*keys, (p + step * v).alias("p"), (r - step * h).alias("r"), "v").select(
                *keys, "p", "r", (r / d + _by_candidate(b) * v).alias("v")
            )
        else:
            ready.append(now.select("cand", "id", "w", "p"))
        out = ready[0]
        for more in ready[1:]:
            out = out.unionByName(more)
        return checkpointed(out)

    def steps(self, moved: DataFrame) -> dict[int, float]:
        """For each candidate the step of 1, 1/2, 1/4 ... along ``p`` with the least value."""

        def loss(t: float) -> Column:
            gap = F.greatest(1 - F.col("y") * (F.col("w") + t * F.col("p")), F.lit(0.0))
            return self._cost() / 2 * gap * gap

        losses = self.sums(self.problem.margins(moved, self.small, "w", "p"), *[loss(t) for t in STEPS])
        norms = self.sums(moved, F.col("w") * F.col("p"), F.col("p") * F.col("p"))
        best = {}
        for k, values in losses.items():
            total = [x + t * norms[k][0] + t * t * norms[k][1] / 2 for x, t in zip(values, STEPS)]
            best[k] = STEPS[min(range(len(STEPS)), key=total.__getitem__)]
        return best

    def run(self, tolerance: float, max_iter: int, cg_rounds: int) -> tuple[DataFrame, dict[int, tuple[int, float, float]]]:
        """``cand, id, weight, gradient`` and by candidate its iterations and gradient norms."""
        first = norms = self.norms()
        taken, finished, stats = 0, [], {}
        while True:
            done = [k for k, x in norms.items() if x <= tolerance * first[k] or taken >= max_iter]
            if done or not norms:
                finished.append(self.state.where(F.col("cand").isin(done)))
                stats |= {k: (taken, norms[k], first[k]) for k in done}
                self.state = self.state.where(~F.col("cand").isin(done))
            if len(done) == len(norms):
                break
            forcing = {
                k: max(min(0.1, sqrt(x / first[k])), tolerance * first[k] / (3 * x))
                for k, x in norms.items()
                if k not in done
            }
            moved = self.direction(forcing, cg_rounds)
            step = _by_candidate(self.steps(moved))
            self.state = checkpointed(self.at(moved.select("cand", "id", (F.col("w") + step * F.col("p")).alias("w"))))
            norms, taken = self.norms(), taken + 1
        out = finished[0]
        for more in finished[1:]:
            out = out.unionByName(more)
        return out.select("cand", "id", F.col("w").alias("weight"), F.col("g").alias("gradient")), stats


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


# A block of examples as one row: its arrays as bytes, so that a pass copies and converts nothing.
# Values that are all equal, as those of indicators, are one number.
PACKED = {"at": np.int32, "values": np.float64, "sizes": np.int32, "y": np.float64, "s": np.float64}
# Sums of one task travel in slices of this many numbers.
SLICE = 1 << 13
# Sums of all tasks up to this size are added by the driver, larger ones by tasks, slice by slice.
DIRECT_BYTES = 32 << 20


def pack(batches: Iterator[pa.RecordBatch], known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``ids, values, y, s`` of examples to one row of ``PACKED`` for each batch.

    Ids become places in the sorted ids ``known``; those that are not among them are left out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("ids")
        at, values = np.asarray(lists.flatten()), np.asarray(batch.column("values").flatten(), np.float64)
        sizes = np.diff(lists.offsets.to_numpy())
        if known is not None:
            ids, at = at, np.searchsorted(known, at)
            held = at < len(known)
            held[held] = known[at[held]] == ids[held]
            if not held.all():
                row = np.repeat(np.arange(len(sizes)), sizes)
                at, values, sizes = at[held], values[held], np.bincount(row[held], minlength=len(sizes))
        if len(values) and (values == values[0]).all():
            values = values[:1]
        arrays = {"at": at, "values": values, "sizes": sizes, "y": batch.column("y"), "s": batch.column("s")}
        packed = [pa.array([np.asarray(arrays[n], kind).tobytes()], pa.binary()) for n, kind in PACKED.items()]
        yield pa.RecordBatch.from_arrays(packed, list(PACKED))


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    """Feature places, values (or the one value), entries of each example, targets and weights.

    The constant feature is left out.
    """
    for row in range(batch.num_rows):
        at, values, sizes, y, s = (np.frombuffer(batch.column(n)[row].as_buffer(), kind) for n, kind in PACKED.items())
        # Wide places are read several times as fast as they would be narrow.
        yield at.astype(np.intp), values, sizes.astype(np.intp), y, s


def add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cand, slice, sums``: one row for each candidate and slice of a partition."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for cand, part, sums in zip(*(batch.column(n).to_pylist() for n in ("cand", "slice", "sums"))):
            values = np.frombuffer(sums)
            total[cand, part] = total[cand, part] + values if (cand, part) in total else values
    for (cand, part), values in total.items():
        yield slice_row(cand, part, values)


def slice_row(cand: int, part: int, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([cand], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cand", "slice", "sums"])


def dots(block: Block, w: np.ndarray) -> np.ndarray:
    at, values, sizes, y, _ = block
    out, held = np.full(len(y), w[-1]), sizes > 0
    if held.any():
        out[held] += np.add.reduceat(values * w[at], (np.cumsum(sizes) - sizes)[held])
    return out


def spread_back(block: Block, factor: np.ndarray, size: int, power: int = 1) -> np.ndarray:
    """Sums of ``factor`` times value by feature, the constant feature last."""
    at, values, sizes, _, _ = block
    out = np.bincount(at, values**power * np.repeat(factor, sizes), size)
    out[-1] += factor.sum()
    return out


def first_order(block: Block, cost: float, w: np.ndarray) -> np.ndarray:
    """Gradient of the loss and the diagonal of its second derivative."""
    _, _, _, y, s = block
    gap = 1 - y * dots(block, w)
    k = np.where(gap > 0, 2 * cost * s, 0.0)
    return np.concatenate([spread_back(block, -k * y * gap, len(w)), spread_back(block, k, len(w), 2)])


def second_order(block: Block, cost: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivative of the loss at ``w`` times ``v``."""
    _, _, _, y, s = block
    k = np.where(y * dots(block, w) < 1, 2 * cost * s, 0.0)
    return spread_back(block, k * dots(block, v), len(w))


def leading_order(block: Block, cost: float, w: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Second derivative of the loss among the features ``lead``, the constant one last, as one row."""
    at, values, sizes, y, s = block
    k, row = np.where(y * dots(block, w) < 1, 2 * cost * s, 0.0), np.repeat(np.arange(len(y)), sizes)
    n = len(lead)
    number = np.full(len(w), -1)
    number[lead] = np.arange(n)
    place = number[at]
    held = np.flatnonzero((place >= 0) & (k[row] > 0))
    active = np.flatnonzero(k > 0)
    order = np.zeros(len(y), np.int64)
    order[active] = np.arange(len(active))
    # Entries of active examples, by the place of their example among these.
    of, place, root = order[row[held]], place[held], np.sqrt(k)
    value = np.broadcast_to(values, at.shape)[held] * root[row[held]]
    out, many = np.zeros((n, n)), max(1, PAIRS // n)
    for start in range(0, len(active), many):
        # A bounded number of examples at a time, by one product of a matrix with itself.
        first, last = np.searchsorted(of, (start, start + many))
        part = np.zeros((min(many, len(active) - start), n), np.float32)
        part[of[first:last] - start, place[first:last]] = value[first:last]
        part[:, -1] = root[active[start : start + many]]
        out += part.T @ part
    return out.ravel()


def losses(block: Block, cost: float, w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The loss at all steps along ``p``."""
    _, _, _, y, s = block
    z, u = dots(block, w), dots(block, p)
    return np.array([(cost * s * np.maximum(1 - y * (z + t * u), 0) ** 2).sum() for t in STEPS])


class Newton:
    """Newton steps of all candidates with coefficients that are sent to the tasks."""

    def __init__(self, examples: DataFrame, members: DataFrame, costs: dict[int, float]):
        self.spark = ship(examples.sparkSession)
        rows = examples.where("weight > 0").select(
            F.coalesce(F.col("features")["indices"].cast("array<long>"), F.array().cast("array<long>")).alias("ids"),
            F.coalesce(F.col("features")["values"].cast("array<double>"), F.array().cast("array<double>")).alias("values"),
            F.col("target").cast("double").alias("y"), F.col("weight").cast("double").alias("s"),
        )
        ids = rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        pairs = members.select("cand", "id").distinct().join(ids, "id")
        table = pairs.groupBy("id").agg(F.collect_list("cand").alias("cands"), F.first("n").alias("n")).orderBy("id").toArrow()
        self.ids = np.append(table["id"].to_numpy(), INTERCEPT)
        self.member = {k: np.zeros(len(self.ids), bool) for k in costs}
        for i, cands in enumerate(table["cands"].to_pylist()):
            for k in cands:
                self.member[k][i] = True
        for mask in self.member.values():
            mask[-1] = True
        self.costs, self.size = costs, len(self.ids)
        self.kept = {k: [] for k in costs}
        # Examples refer to places in the list of ids; features of no candidate are left out.
        known = self.spark.sparkContext.broadcast(self.ids[:-1])
        kind = ", ".join(f"{n} binary" for n in PACKED)
        cores, entries = self.spark.sparkContext.defaultParallelism, int(np.sum(table["n"].to_numpy()))
        tasks = cores * max(1, -(-entries // (TASK_ENTRIES * cores)))
        self.blocks = checkpointed(rows.coalesce(tasks).mapInArrow(lambda batches: pack(batches, known.value), kind))
        known.destroy()
        self.parts = self.blocks.rdd.getNumPartitions()

    def sums(self, what, vectors: dict[int, tuple[np.ndarray, ...]], size: int) -> dict[int, np.ndarray]:
        """``what`` of every block for every candidate, summed."""
        shared, costs = self.spark.sparkContext.broadcast(vectors), self.costs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(size) for k in shared.value}
            for batch in batches:
                for block in blocks_of(batch):
                    for k, vector in shared.value.items():
                        sums = what(block, costs[k], *vector)
                        total[k][: len(sums)] += sums
            for k, values in total.items():
                for start in range(0, size, SLICE):
                    part = values[start : start + SLICE]
                    if part.any():
                        yield slice_row(k, start // SLICE, part)

        kind = "cand int, slice int, sums binary"
        parts = self.blocks.mapInArrow(run, kind)
        if self.parts * len(vectors) * size * 8 > DIRECT_BYTES:
            parts = parts.repartition("cand", "slice").mapInArrow(add_slices, kind)
        out = {k: np.zeros(size) for k in vectors}
        for batch in parts.toArrow().to_batches():
            for cand, part, sums in zip(*(batch.column(n).to_pylist() for n in ("cand", "slice", "sums"))):
                values = np.frombuffer(sums)
                out[cand][part * SLICE : part * SLICE + len(values)] += values
        shared.destroy()
        return out

    def gradients(self, w: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found = self.sums(first_order, {k: (x,) for k, x in w.items()}, 2 * self.size)
        return {
            k: (np.where(self.member[k], w[k] + f[: self.size], 0.0), 1 + f[self.size :]) for k, f in found.items()
        }

    def solvers(self, w, d) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
        """Approximate inverses of the second derivative: exact among leading features, else its diagonal."""
        most = max(1, int(LEAD / sqrt(len(w))))
        lead = {}
        for k in w:
            # Features whose loss hardly bends need no more than the diagonal.
            bent = np.flatnonzero(self.member[k][:-1] & (d[k][:-1] > BENT))
            top = np.sort(bent[np.argsort(-d[k][bent], kind="stable")[: most - 1]])
            lead[k] = np.append(top, self.size - 1)
        found = self.sums(leading_order, {k: (w[k], lead[k]) for k in w}, max(len(x) for x in lead.values()) ** 2)

        def solver(k: int) -> Callable[[np.ndarray], np.ndarray]:
            n = len(lead[k])
            block = found[k][: n * n].reshape(n, n)
            block = block + np.eye(n) + ROUNDED * np.diag(np.diag(block))
            try:
                half = np.linalg.inv(np.linalg.cholesky(block))
                inverse = half.T @ half
            except np.linalg.LinAlgError:
                # Rounded too far: the diagonal alone.
                inverse = np.diag(1 / d[k][lead[k]])

            pairs = self.kept[k]

            def solve(r: np.ndarray) -> np.ndarray:
                # The two loops of L-BFGS over the last step's directions.
                r, shares = r.copy(), []
                for v, h, vh in reversed(pairs):
                    shares.append(float(v @ r) / vh)
                    r -= shares[-1] * h
                out = r / d[k]
                out[lead[k]] = inverse @ r[lead[k]]
                for (v, h, vh), share in zip(pairs, reversed(shares)):
                    out += (share - float(h @ out) / vh) * v
                return out

            return solve

        return {k: solver(k) for k in w}

    def directions(self, w, g, d, forcing: dict[int, float], rounds: int) -> dict[int, np.ndarray]:
        """The Newton directions by conjugate gradients, up to ``forcing``."""
        solve = self.solvers(w, d)
        p, r = {k: np.zeros(self.size) for k in w}, {k: -g[k] for k in w}
        v = {k: solve[k](r[k]) for k in w}
        left = {k: float(r[k] @ v[k]) for k in w}
        first = dict(left)
        most = max(0, min(KEPT, KEPT_BYTES // (8 * self.size * len(self.costs))))
        used = {k: [] for k in w}
        for _ in range(rounds):
            open_ = [k for k in w if left[k] > forcing[k] ** 2 * first[k]]
            if not open_:
                break
            found = self.sums(second_order, {k: (w[k], v[k]) for k in open_}, self.size)
            for k in open_:
                h = np.where(self.member[k], v[k] + found[k], 0.0)
                a = left[k] / float(v[k] @ h)
                if len(used[k]) < most:
                    pair = v[k].astype(np.float32), h.astype(np.float32)
                    used[k].append((*pair, float(pair[0].astype(float) @ pair[1])))
                p[k], r[k] = p[k] + a * v[k], r[k] - a * h
                z = solve[k](r[k])
                after = float(r[k] @ z)
                v[k], left[k] = z + after / left[k] * v[k], after
        for k in w:
            self.kept[k] = [x for x in (self.kept[k] + used[k])[-most:] if x[2] > 0] if most else []
        return p

    def run(self, tolerance: float, max_iter: int, cg_rounds: int) -> tuple[DataFrame, dict[int, tuple[int, float, float]]]:
        """``cand, id, weight, gradient`` and by candidate its iterations and gradient norms."""
        w = {k: np.zeros(self.size) for k in self.costs}
        state = self.gradients(w)
        first = {k: float(np.linalg.norm(g)) for k, (g, _) in state.items()}
        taken, stats = dict.fromkeys(w, 0), {}
        while True:
            norm = {k: float(np.linalg.norm(state[k][0])) for k in w}
            open_ = [k for k in w if k not in stats and norm[k] > tolerance * first[k] and taken[k] < max_iter]
            stats |= {k: (taken[k], norm[k], first[k]) for k in w if k not in open_ and k not in stats}
            if not open_:
                break
            now = {k: w[k] for k in open_}
            # The last step is not solved beyond what is asked for.
            enough = {k: tolerance * first[k] / (3 * norm[k]) for k in open_}
            forcing = {k: max(min(0.1, sqrt(norm[k] / first[k])), enough[k]) for k in open_}
            p = self.directions(now, {k: state[k][0] for k in open_}, {k: state[k][1] for k in open_}, forcing, cg_rounds)
            found = self.sums(losses, {k: (w[k], p[k]) for k in open_}, len(STEPS))
            for k in open_:
                values = [x + (w[k] + t * p[k]) @ (w[k] + t * p[k]) / 2 for x, t in zip(found[k], STEPS)]
                w[k] = w[k] + STEPS[int(np.argmin(values))] * p[k]
                taken[k] += 1
            state |= self.gradients({k: w[k] for k in open_})
        tables = [
            pa.table({
                "cand": pa.array(np.full(int(self.member[k].sum()), k, np.int32)), "id": self.ids[self.member[k]],
                "weight": w[k][self.member[k]], "gradient": state[k][0][self.member[k]],
            })
            for k in w
        ]
        return self.spark.createDataFrame(pa.concat_tables(tables)), stats


def fit_weights(
    examples: DataFrame, members: DataFrame, costs: dict[int, float], tolerance: float, max_iter: int, cg_rounds: int = 100
) -> tuple[DataFrame, dict[int, tuple[int, float, float]]]:
    """``cand, id, weight, gradient`` of all candidates, and their iterations and gradient norms."""
    pairs = checkpointed(members.select(F.col("cand").cast("int").alias("cand"), F.col("id").cast("long").alias("id")).distinct())
    if pairs.count() <= BROADCAST_ROWS:
        method = Newton(examples, pairs, costs)
    else:
        method = TableNewton(Tables(examples), pairs, costs)
    return method.run(tolerance, max_iter, cg_rounds)


def fit_squared_hinge(
    examples: DataFrame, c: float = 1.0, tolerance: float = 1e-6, max_iter: int = 50
) -> LinearModel:
    """Fit on ``features, target, weight`` until the gradient is ``tolerance`` times the first one."""
    rows = checkpointed(examples.select("features", "target", "weight"))
    members = rows.where("weight > 0").select(F.lit(0).alias("cand"), F.explode("features.indices").alias("id"))
    weights, stats = fit_weights(rows, members, {0: c}, tolerance, max_iter)
    return LinearModel(checkpointed(weights.drop("cand")), *stats.get(0, (0, 0.0, 0.0)))
