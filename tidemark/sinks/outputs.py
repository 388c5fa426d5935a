"""Outputs of a published cycle (K-1, K-2, K-3, K-6, K-7)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import change_counts
from tidemark.operators.rank import priority_order


def ordered_changes(changes: DataFrame) -> DataFrame:
    """K-1: a cycle's changes laid out by entity in reading order.

    An entity's document is a sorted run of rows, not one gathered array, so an entity with a
    large share of all changes is written by several tasks.
    """
    order = [F.col("entity"), priority_order(F.col("priority")), F.col("ord")]
    return changes.repartitionByRange(*order).sortWithinPartitions(*order)


def write_changes(changes: DataFrame, path: str, buckets: int = 64) -> None:
    """K-1: JSON lines below ``bucket=..`` folders, so one reader finds an entity's document by
    its hash without listing every entity."""
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int")
    ordered_changes(changes).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").json(path)


def cycle_index(changes: DataFrame) -> DataFrame:
    """K-2: entity -> counts per priority."""
    return change_counts(changes)


def cycle_meta(changes: DataFrame, from_cycle: str, to_cycle: str, now: Column, engine: str, charts: bool, areas: bool) -> DataFrame:
    """K-3: one row about the cycle."""
    from tidemark.functions.cycles import effective_at

    effective = effective_at(F.lit(to_cycle).cast("date"))
    return changes.agg(F.count_distinct("entity").alias("changed")).select(
        F.lit(1).alias("schema_version"), F.lit(from_cycle).alias("from_cycle"), F.lit(to_cycle).alias("to_cycle"), (effective > now).alias("upcoming"),
        effective.alias("effective_at"), F.lit(charts).alias("includes_charts"), F.lit(areas).alias("includes_airspace"), "changed",
        F.lit(engine).alias("engine"), now.alias("generated_at"),
    )


def append_run(spark: SparkSession, record: dict, schema: str, path: str) -> str:
    """K-6: one run record; the id is new for every run, so no record overwrites another."""
    run_id = record.get("run_id") or uuid.uuid4().hex
    spark.createDataFrame([{**record, "run_id": run_id}], schema).write.mode("append").partitionBy("cycle").json(path)
    return run_id


def review_packet(changes: DataFrame, watched: DataFrame, busiest: DataFrame, findings: DataFrame) -> DataFrame:
    """K-7: action and ifr changes of the watched and the busiest entities with their audit
    findings; no timestamps and a fixed order, so equal input gives equal output."""
    chosen = watched.select("entity").unionByName(busiest.select("entity")).distinct()
    notes = findings.groupBy("entity").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "level", "reason"))).alias("findings"))
    kept = changes.filter(F.col("priority").isin("action", "ifr")).join(chosen, "entity", "left_semi").join(notes, "entity", "left")
    return kept.orderBy("entity", priority_order(F.col("priority")), "ord")
