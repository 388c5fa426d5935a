"""Building blocks that stay exact when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    ``row_number() <= k`` plans a WindowGroupLimit below the exchange, so each map task ships
    at most ``k`` rows per key however hot the key is.
    """
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_k(df, keys, order, 1)


def with_group_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-key aggregates by aggregate + join instead of an unbounded window.

    The aggregate combines map-side; the join's build side has one row per key, so adaptive
    execution can split a hot probe partition. Null keys compare equal.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    for name in keys:
        totals = totals.withColumnRenamed(name, f"__k_{name}")
    cond = None
    for name in keys:
        c = F.col(name).eqNullSafe(F.col(f"__k_{name}"))
        cond = c if cond is None else cond & c
    return df.join(totals, cond).drop(*[f"__k_{name}" for name in keys])


def ordinal_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1, 2, 3 ... inside every key for an unbounded group, without one task per key.

    Rows are range-partitioned on (keys, order), numbered inside each partition, and shifted
    by the number of rows the same key has in earlier partitions. The partitioned rows are
    checkpointed once so that both uses see the same layout. ``order`` must be total.
    """
    laid = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn("__pid", F.spark_partition_id())
    )
    counts = laid.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = Window.partitionBy(*keys, "__pid").orderBy(*[F.col(c) for c in order])
    return (
        laid.join(shift, [*keys, "__pid"])
        .withColumn(out, (F.row_number().over(local) + F.col("__shift")).cast("bigint"))
        .drop("__pid", "__shift")
    )


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group (one aggregated row reaches the driver)."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, window_rows: int = 1_000_000) -> DataFrame:
    """Row numbers per key: a plain window while every group was measured to fit a task,
    :func:`ordinal_within` beyond that. Both give the same numbers."""
    if largest_group(df, keys) <= window_rows:
        return df.withColumn(
            out, F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order])).cast("bigint")
        )
    return ordinal_within(df, keys, order, out)
