"""Session settings shared by jobs, queries and tests."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

# Partitions that a shuffle writes before small ones are merged.
SHUFFLED = 1024


def build_session(app_name: str = "namesieve", **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return tuned(builder.getOrCreate())


def tuned(spark: SparkSession) -> SparkSession:
    """Settings for stages that do much work on few bytes.

    A string of 60 bytes costs far more work in the rule stages than the default sizes of merged
    partitions assume, so a shuffle is written in many partitions and these are merged by their bytes,
    not down to one for each core: up to 2 GB of it the largest task does not grow.  The groups collected
    there are single strings, so hash aggregation may hold many of them before it falls back to sorting.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(SHUFFLED))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "20000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by the session; only a local run may invent one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="namesieve-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute a scan that has fewer splits than the session has cores.

    Only inputs of a few row groups are affected; a large scan keeps its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source once per application; Spark copies it to every executor."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(root)}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
