"""Structured Streaming wrappers over the batch functions (X-1 .. X-7)."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import cycles
from tidemark.operators import history


def on_new_cycles(
    spark: SparkSession, drops: str, schema: str, snapshots: str, handle: Callable[[DataFrame, DataFrame, str, str], DataFrame | None],
    history_path: str, checkpoint: str,
) -> StreamingQuery:
    """X-1 + X-2: snapshot rows dropped as files are stored per cycle and file, and each cycle that
    grew is compared with the newest earlier one; so is the cycle after it, whose base it is.

    The snapshots are a table, not state. A cycle may arrive in any number of files, batches and
    orders: its rows are those of all its files. A replayed batch overwrites the same files'
    partitions and the same cycles of the history, so a restart after a failure changes nothing.
    """

    def run(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle", "drop").parquet(snapshots)
        stored = session.read.parquet(snapshots)
        arrived = {r["cycle"] for r in batch.select(F.col("cycle").cast("string").alias("cycle")).distinct().collect()}
        # The cycles are the store's folders: no data is read to list them.
        known = sorted({unquote(m[1]) for path in stored.inputFiles() if (m := re.search("/cycle=([^/]*)/", path))})
        base_of = dict(zip(known[1:], known))
        side = lambda c: stored.filter(F.col("cycle") == F.lit(c).cast(stored.schema["cycle"].dataType)).drop("cycle", "drop")
        for cycle in known[1:]:
            base = base_of[cycle]
            if cycle in arrived or base in arrived:
                changes = handle(side(base), side(cycle), base, cycle)
                if changes is not None:
                    # The cycle's whole folder: a cycle that no longer has changes keeps none.
                    history.replace_cycle(changes, cycle, history_path)

    stream = spark.readStream.schema(schema).parquet(drops).withColumn("drop", F.md5(F.col("_metadata.file_path")))
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incomplete_cycles(meta: DataFrame) -> DataFrame:
    """X-6: cycles published without charts or areas, to run again once those arrive."""
    return meta.filter(~F.col("includes_charts") | ~F.col("includes_airspace")).select("from_cycle", "to_cycle")


def with_status(meta: DataFrame) -> DataFrame:
    """X-4: whether a cycle is upcoming is read off the clock, not stored."""
    return meta.withColumn("upcoming", cycles.effective_at(F.to_date("to_cycle")) > F.current_timestamp())


def first_sightings(stream: DataFrame, ids: list[str], event_time: str, delay: str) -> DataFrame:
    """X-3: each (reader, entity, id) once; state older than the watermark is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(ids)


def notifications(changes: DataFrame, readers: DataFrame) -> DataFrame:
    """X-5, per batch: one digest per (reader, cycle). ``readers(reader, entity, mode, home)``:
    mode 'action' keeps entities with actions, the home entity is always in."""
    per = changes.groupBy("entity", "cycle").agg(F.count_if(F.col("priority") == "action").alias("actions"), F.count(F.lit(1)).alias("total"))
    mine = readers.join(per, "entity").filter((F.col("mode") != "action") | (F.col("actions") > 0) | F.col("home"))
    return mine.groupBy("reader", "cycle").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("actions").alias("actions"), F.sum("total").alias("total")
    )


def notify(stream: DataFrame, readers: DataFrame, sent: str, checkpoint: str) -> StreamingQuery:
    """X-5: first emission per (reader, cycle) only: digests already in the ``sent`` table are
    left out, and the table is what survives a restart."""

    def run(batch: DataFrame, _epoch: int) -> None:
        session = batch.sparkSession
        new = notifications(batch, readers)
        try:
            done = session.read.parquet(sent).select("reader", "cycle")
            new = new.join(done, ["reader", "cycle"], "left_anti")
        except Exception as missing:  # noqa: BLE001 - the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        new.write.mode("append").parquet(sent)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cycle_counts(stream: DataFrame, event_time: str, days: int, delay: str, anchor: str, keys: list[str]) -> DataFrame:
    """X-7: counts per event-time cycle window."""
    from datetime import date

    offset = (date.fromisoformat(anchor) - date(1970, 1, 1)).days % days
    window = F.window(event_time, f"{days} days", f"{days} days", f"{offset} days")
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("cycle"), *keys, "n")
    )
