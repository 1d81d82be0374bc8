"""Most similar pairs between two tables of vectors, by bounds and products of blocks.

Vectors, dense arrays or sparse features, become rows ``id, e`` of coordinates and values.  The range of
each coordinate on the other side bounds what a row can reach.  The rows that can reach most are paired
first; rows that cannot reach the k-th best pair found are left out, and more rows are taken, until all that
are left have been.  Rows of similar direction share a block, which is one packed row.  All pairs of blocks
are made by a Cartesian product of partitions, so no block is written for its pairs.  In a pair of blocks, rows
that cannot reach the limit by the coordinates that both blocks have are left out again, and the others are
multiplied.  No side passes through the driver or is refused for its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from namesieve.operators.lexicon import BROADCAST_ROWS
from namesieve.operators.ranks import dense_positions
from namesieve.session import checkpointed, ship

BLOCK_ROWS = 1024
# Block pairs of the round after the first blocks; each further round takes this many times more.
FIRST_PAIRS, GROWTH = 64, 16
# Blocks of a side that a task reads, and coordinates that are multiplied at a time.
TASK_BLOCKS, COLUMNS = 32, 2048
# Bounds are sums of rounded products.
SLACK = 1e-9


@dataclass(frozen=True)
class PairCounts:
    """How many pairs of rows were scored, and how many were skipped by the bounds of their blocks."""

    scored: int
    skipped: int
    rounds: int


def entries(df: DataFrame, vector: str) -> Column:
    """``array<struct<idx, value>>`` of a dense array or a sparse ``size, indices, values``."""
    kind = "array<struct<idx: long, value: double>>"
    if isinstance(df.schema[vector].dataType, ArrayType):
        return F.transform(F.col(vector), lambda v, i: F.struct(i.cast("long").alias("idx"), v.cast("double").alias("value")))
    pairs = F.arrays_zip(F.col(vector)["indices"].alias("idx"), F.col(vector)["values"].alias("value"))
    return pairs.cast(kind)


def entered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``row, id, e``: rows with their coordinates other than 0; a vector without any is left out."""
    listed = df.select(F.col(key).alias("id"), F.filter(entries(df, vector), lambda x: x["value"] != 0).alias("e"))
    return listed.where(F.size("e") > 0).withColumn("row", F.monotonically_increasing_id())


def ranges_of(rows: DataFrame) -> DataFrame:
    """``idx, hi, lo``: the range of each coordinate; 0 is in it if a row has no entry."""
    total = rows.count()
    lists = rows.select(F.inline("e").alias("idx", "value")).groupBy("idx").agg(
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("held")
    )
    full = F.col("held") == total
    return lists.select(
        "idx",
        F.when(full, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("hi"),
        F.when(full, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("lo"),
    )


def with_most(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Adds ``most``: what a row can reach with any of the others, by the range of each of their lists.

    Rows that share no coordinate with any of the others are left out.  The ranges are sent to the tasks
    while they are few enough; the rows are then neither shuffled nor written.
    """
    ranges = checkpointed(ranges_of(others))
    if ranges.count() > BROADCAST_ROWS:
        rows = checkpointed(rows)
        reach = rows.select("row", F.inline("e").alias("idx", "value")).join(ranges, "idx")
        most = F.sum(F.greatest(F.col("value") * F.col("hi"), F.col("value") * F.col("lo")))
        return checkpointed(rows.join(reach.groupBy("row").agg(most.alias("most")), "row"))
    table = ranges.orderBy("idx").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table[n].to_numpy() for n in ("idx", "hi", "lo")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, hi, lo = shared.value
        for batch in batches:
            lists = batch.column("e")
            at, values = (np.asarray(lists.flatten().field(n)) for n in range(2))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            place = np.searchsorted(idx, at)
            held = place < len(idx)
            held[held] = idx[place[held]] == at[held]
            place, row, values = place[held], row[held], values[held]
            most = np.bincount(row, np.maximum(values * hi[place], values * lo[place]), len(lists))
            met = np.bincount(row, minlength=len(lists)) > 0
            yield batch.append_column("most", pa.array(most)).filter(pa.array(met))

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(add, f"{kinds}, most double")


def reaches(bound: str, limit: float) -> Column:
    return F.col(bound) * (1 + F.signum(bound) * SLACK) + SLACK >= limit


def strongest(rows: DataFrame, count: int) -> DataFrame:
    """The rows of the ``count`` largest bounds, and those equal to the last."""
    cut = rows.select("most").orderBy(F.desc("most")).limit(count).agg(F.min("most")).first()[0]
    return rows if cut is None else checkpointed(rows.where(F.col("most") >= cut))


def promising(left: DataFrame, right: DataFrame, k: int) -> tuple[DataFrame, DataFrame, float]:
    """Rows of both sides that can reach the k-th best pair of the rows that can reach most, and its value."""
    left, right = with_most(left, right), with_most(right, left)
    # Rows of the largest bounds, about one block a side; their pairs only set the limit.
    seeds = [blocked(strongest(s, BLOCK_ROWS)) for s in (left, right)]
    _, limit = best_pairs(*seeds, k, float("-inf"))
    left, right = (checkpointed(s.where(reaches("most", limit))) for s in (left, right))
    return left, right, limit


def blocked(placed: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``block, ids, columns, ...``: rows ordered by their strongest coordinate, packed in blocks of ``rows``."""
    strongest = F.array_max(F.transform("e", lambda x: F.struct(F.abs(x["value"]).alias("size"), x["idx"].alias("idx"), x["value"].alias("value"))))
    ordered = placed.withColumn("top", strongest).select("id", "row", "e", F.col("top.idx").alias("t"), F.col("top.value").alias("v"))
    numbered = dense_positions(ordered, "t", "v", "id", "row")
    lists = numbered.groupBy(F.floor(F.col("position") / rows).alias("block")).agg(F.collect_list(F.struct("id", "e")).alias("rows"))
    kind = dict(placed.dtypes)["id"]
    return checkpointed(lists.mapInArrow(pack, f"block long, ids array<{kind}>, " + ", ".join(f"{n} binary" for n in PACKED)))


# A block as one row: its coordinates with their ranges, and of each entry the place of its coordinate and its value.
PACKED = {"columns": np.int64, "hi": np.float64, "lo": np.float64, "at": np.int32, "values": np.float64, "sizes": np.int32}


def column_ranges(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and least value of each coordinate, with 0 among them."""
    hi, lo = np.zeros(size), np.zeros(size)
    np.maximum.at(hi, at, values)
    np.minimum.at(lo, at, values)
    return hi, lo


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, rows`` to the arrays of ``PACKED``."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column("rows").slice(i, 1).flatten()
            lists = rows.field("e")
            idx, values = (np.asarray(lists.flatten().field(n)) for n in range(2))
            columns, at = np.unique(idx, return_inverse=True)
            hi, lo = column_ranges(at, values, len(columns))
            sizes = np.diff(lists.offsets.to_numpy())
            arrays = {"columns": columns, "hi": hi, "lo": lo, "at": at, "values": values, "sizes": sizes}
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.field("id"))
            packed = [pa.array([np.asarray(arrays[n], kind).tobytes()], pa.binary()) for n, kind in PACKED.items()]
            yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), ids, *packed], ["block", "ids", *PACKED])


@dataclass
class Entries:
    """Entries of a block: row, coordinate among those of both blocks, value; ``rows`` are those that are left."""

    rows: np.ndarray
    row: np.ndarray
    at: np.ndarray
    values: np.ndarray

    def keep(self, hi: np.ndarray, lo: np.ndarray, limit: float) -> "Entries":
        """Rows that can reach ``limit`` with rows of these ranges."""
        reach = np.maximum(self.values * hi[self.at], self.values * lo[self.at])
        bound = np.bincount(self.row, reach, len(self.rows))
        kept = ~(bound + np.abs(bound) * SLACK + SLACK < limit)
        if kept.all():
            return self
        held, number = kept[self.row], np.cumsum(kept) - 1
        return Entries(self.rows[kept], number[self.row[held]], self.at[held], self.values[held])

    def part(self, start: int, end: int) -> np.ndarray:
        out = np.zeros((len(self.rows), end - start))
        held = (self.at >= start) & (self.at < end)
        out[self.row[held], self.at[held] - start] = self.values[held]
        return out


def common(block: dict, places: np.ndarray, size: int) -> Entries:
    """Entries in the coordinates at ``places``, which are numbered from 0."""
    number = np.full(len(block["columns"]), -1)
    number[places] = np.arange(size)
    at, rows = number[block["at"]], np.arange(len(block["sizes"]))
    held = at >= 0
    return Entries(rows, np.repeat(rows, block["sizes"])[held], at[held], block["values"][held])


def products(one: dict, two: dict, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of two blocks and the dot product of those of their pairs that share a coordinate and reach ``limit``."""
    both, i, j = np.intersect1d(one["columns"], two["columns"], assume_unique=True, return_indices=True)
    size = len(both)
    a, b = common(one, i, size), common(two, j, size)
    hi, lo = two["hi"][j], two["lo"][j]
    while True:
        before = len(a.rows), len(b.rows)
        a = a.keep(hi, lo, limit)
        b = b.keep(*column_ranges(a.at, a.values, size), limit)
        if (len(a.rows), len(b.rows)) == before or not len(a.rows) or not len(b.rows):
            break
        hi, lo = column_ranges(b.at, b.values, size)
    dots = np.zeros((len(a.rows), len(b.rows)))
    meet = None if limit > 0 else np.zeros(dots.shape, np.float32)
    for start in range(0, size if dots.size else 0, COLUMNS):
        x, y = (e.part(start, min(start + COLUMNS, size)) for e in (a, b))
        dots += x @ y.T
        if meet is not None:
            # Only pairs that share a coordinate are pairs; those above 0 do.
            meet += (x != 0).astype(np.float32) @ (y != 0).T.astype(np.float32)
    found = dots >= limit if meet is None else (meet > 0) & (dots >= limit)
    x, y = np.nonzero(found)
    return a.rows[x], b.rows[y], dots[x, y]


ORDER = [("dot", "descending"), ("query_id", "ascending"), ("other_id", "ascending")]


def first_pairs(found: list[pa.Table], k: int) -> pa.Table:
    """The best ``k`` of some pairs; ties go to the smaller ids."""
    table = pa.concat_tables(found)
    if table.num_rows <= k:
        return table
    return table.take(pc.sort_indices(table, sort_keys=ORDER, null_placement="at_start")[:k])


def best_pairs(left: DataFrame, right: DataFrame, k: int, limit: float) -> tuple[DataFrame, float]:
    """``query_id, other_id, dot``: the best ``k`` pairs from ``limit`` on of two tables of blocks, and the new limit.

    A task holds its blocks of one side, one block of the other and its best ``k`` pairs.
    """
    sides = [side.toDF(*[f"{n}_{x}" for x in side.columns]) for side, n in ((left, "a"), (right, "b"))]
    # Few blocks are dealt out finely: several tasks a core.
    least_parts = isqrt(16 * left.sparkSession.sparkContext.defaultParallelism)
    sides = [side.repartition(max(least_parts, -(-side.count() // TASK_BLOCKS))) for side in sides]

    def block(batch: pa.RecordBatch, side: str, i: int) -> dict:
        arrays = {n: np.frombuffer(batch.column(f"{side}_{n}")[i].as_buffer(), kind) for n, kind in PACKED.items()}
        return arrays | {"ids": batch.column(f"{side}_ids").slice(i, 1).flatten()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = None, limit
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = block(batch, "a", i), block(batch, "b", i)
                x, y, dots = products(one, two, least)
                if not len(dots):
                    continue
                if len(dots) > k:
                    top = dots >= np.partition(dots, -k)[-k]
                    x, y, dots = x[top], y[top], dots[top]
                now = pa.table({"query_id": one["ids"].take(pa.array(x)), "other_id": two["ids"].take(pa.array(y)), "dot": dots})
                best = first_pairs([now] if best is None else [best, now], k)
                if best.num_rows == k:
                    least = max(least, pc.min(best["dot"]).as_py())
        if best is not None:
            yield from best.combine_chunks().to_batches()

    kinds = [dict(side.dtypes)["ids"].removeprefix("array<").removesuffix(">") for side in (left, right)]
    pairs = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl"))
    scored = pairs.mapInArrow(run, f"query_id {kinds[0]}, other_id {kinds[1]}, dot double")
    found = checkpointed(scored.orderBy(F.desc("dot"), "query_id", "other_id").limit(k))
    state = found.agg(F.count("*").alias("n"), F.min("dot").alias("last")).first()
    return found, max(limit, state.last) if state.n == k else limit


def counted_pairs(
    queries: DataFrame, others: DataFrame, k: int, key: str = "id", vector: str = "vector", rows: int = BLOCK_ROWS
) -> tuple[DataFrame, PairCounts]:
    """The best ``k`` pairs, and how many pairs were scored and skipped.

    Pairs share at least one coordinate; ties go to the smaller ids.
    """
    ship(queries.sparkSession)
    left, right = entered(queries, key, vector), entered(others, key, vector)
    total = left.count() * right.count()
    left, right, limit = promising(left, right, k)
    pairs, rounds = FIRST_PAIRS, 0
    while True:
        sizes, most = (left.count(), right.count()), isqrt(pairs) * rows
        taken = [s if n <= most else strongest(s, most) for s, n in zip((left, right), sizes)]
        found, limit = best_pairs(*(blocked(t, rows) for t in taken), k, limit)
        pairs, rounds = pairs * GROWTH, rounds + 1
        if max(sizes) <= most:
            break
        left, right = left.where(reaches("most", limit)), right.where(reaches("most", limit))
    scored = sizes[0] * sizes[1]
    return found, PairCounts(scored, int(total - scored), rounds)


def similar_pairs(
    queries: DataFrame, others: DataFrame, k: int, key: str = "id", vector: str = "vector"
) -> DataFrame:
    """The ``k`` pairs with the largest dot product, ``(query_id, other_id, dot)``."""
    return counted_pairs(queries, others, k, key, vector)[0]
