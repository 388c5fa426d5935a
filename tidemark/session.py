"""Session defaults, checkpointing and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is only ever broadcast when it was measured and found at or below these.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Shuffle partition count is left to adaptive execution: the initial number is only an
    upper bound that AQE coalesces, so the same code serves a laptop and a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``. On a local master a
    fresh temporary folder stands in where it is unset; elsewhere executors could not see one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and, written out, bytes. No more rows are read."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0))
    rows, measured = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and measured <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after measuring; beyond the bound the planner's own shuffle join
    (with adaptive skew splitting) is used unchanged."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give CPU-heavy row work enough tasks: a scan that already has several partitions per
    core (any large table) is left alone, a small one is redistributed round-robin."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
