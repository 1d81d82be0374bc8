"""Kernel approximation: vectors mapped to similarities with a few landmark rows.

Landmarks are a table of postings.  Dot products with them are a join on the coordinate and a sum, so
sparse and dense vectors take the same path.  Only the kernel matrix of the landmarks among
themselves, as many rows and columns as the caller asks for, is factored in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve.operators.dataset import draw_order
from namesieve.operators.lexicon import measured_side
from namesieve.operators.similarity import entries
from namesieve.session import checkpointed


@dataclass(frozen=True)
class KernelMap:
    """``landmarks`` are ``no, key, norm, idx, value``; ``root`` the inverse root of their kernel matrix."""

    kind: str
    degree: int
    gamma: float
    count: int
    landmarks: DataFrame
    root: np.ndarray

    def value(self, dot: Column, norm: Column, own: Column) -> Column:
        if self.kind == "poly":
            return F.pow(self.gamma * dot + 1.0, F.lit(float(self.degree)))
        return F.exp(-self.gamma * F.greatest(norm + own - 2 * dot, F.lit(0.0)))


def postings(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, norm, idx, value`` of the entries that are not 0; a vector without any has one empty row."""
    listed = df.select(F.col(key).alias("key"), F.filter(entries(df, vector), lambda x: x["value"] != 0).alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda total, x: total + x["value"] * x["value"])
    return listed.select("key", norm.alias("norm"), F.inline_outer("e").alias("idx", "value"))


def kernel_rows(df: DataFrame, fitted: KernelMap, key: str = "input", vector: str = "features") -> DataFrame:
    """``key, no, kernel``: the similarity of every row with every landmark."""
    rows = postings(df, key, vector)
    side = fitted.landmarks.where("idx IS NOT NULL").select("no", "idx", F.col("value").alias("own"))
    dots = rows.join(measured_side(side), "idx", "left").groupBy("key", "no").agg(
        F.max("norm").alias("norm"), F.sum(F.col("value") * F.col("own")).alias("dot")
    )
    # Landmarks that share no coordinate with a row have dot product 0.
    found = dots.groupBy("key").agg(
        F.max("norm").alias("norm"),
        F.map_from_entries(F.collect_list(F.when(F.col("no").isNotNull(), F.struct("no", "dot")))).alias("dots"),
    )
    norms = fitted.landmarks.groupBy("no").agg(F.max("norm").alias("own")).orderBy("no").collect()
    every = F.array(*[F.struct(F.lit(r.no).alias("no"), F.lit(r.own).alias("own")) for r in norms])
    each = found.select("key", "norm", "dots", F.inline(every).alias("no", "own"))
    dot = F.coalesce(F.try_element_at("dots", F.col("no")), F.lit(0.0))
    return each.select(F.col("key").alias(key), "no", fitted.value(dot, F.col("norm"), F.col("own")).alias("kernel"))


def fit_kernel(
    df: DataFrame,
    size: int,
    key: str = "input",
    column: str = "features",
    kind: str = "poly",
    degree: int = 2,
    landmarks: int = 100,
    seed: int = 0,
) -> KernelMap:
    """Draw landmark rows by key hash and factor their kernel matrix."""
    drawn = df.select(F.col(key).alias("key"), F.col(column).alias("vector"), draw_order(F.col(key), seed).alias("draw"))
    # The window sees the landmarks only.
    number = F.row_number().over(W.orderBy("draw", "key")) - 1
    chosen = checkpointed(drawn.orderBy("draw", "key").limit(landmarks).withColumn("no", number))
    count = chosen.count()
    table = postings(chosen, "no", "vector").withColumnRenamed("key", "no").join(chosen.select("no", "key"), "no")
    table = checkpointed(table)
    plain = KernelMap(kind, degree, 1.0 / size, count, table, np.eye(count))
    gram = np.zeros((count, count))
    for r in kernel_rows(chosen.withColumnRenamed("no", "at"), plain, "at", "vector").collect():
        gram[r["at"], r["no"]] = r["kernel"]
    u, s, _ = np.linalg.svd(gram)
    root = (u / np.sqrt(np.maximum(s, 1e-12))) @ u.T
    return KernelMap(kind, degree, 1.0 / size, count, table, root)


def apply_kernel(
    df: DataFrame, fitted: KernelMap, key: str = "input", column: str = "features", out: str = "mapped"
) -> DataFrame:
    """``key`` and the mapped array: the kernel row of each vector times the root, a batch at a time."""
    rows = kernel_rows(df, fitted, key, column).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("no", "kernel"))), lambda x: x["kernel"]).alias("row")
    )
    shared, count = df.sparkSession.sparkContext.broadcast(fitted.root), fitted.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
            mapped = (flat @ shared.value).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1) * count, pa.int32())
            arrays = [batch.column(key), pa.ListArray.from_arrays(ends, pa.array(mapped))]
            yield pa.RecordBatch.from_arrays(arrays, [key, out])

    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {out} array<double>")
