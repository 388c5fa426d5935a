"""State that outlives a watermark: what each reader has seen, and companions that come after their snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Cells that one reader's ids are dealt to, so that a reader with very many ids is no single state.
SHARDS = 16


def new_to_reader(stream: DataFrame, keep_days: int, shards: int = SHARDS) -> DataFrame:
    """X-3: (reader, entity, id, at) the first time a reader meets an id of an entity.

    ``stream(reader string, entity string, id string, at timestamp)``. No row is too late: an id that is
    older than all others is new if the reader has not met it. An id is forgotten once the reader's newest
    row in its cell is more than ``keep_days`` after the last row that held it; a reader who never comes
    again keeps the ids of that time. Rows without a reader, id or time say nothing; a null entity is one of
    its own. State is kept in the checkpoint, so a restart repeats nothing.
    """
    keep = pd.Timedelta(days=keep_days)

    def cell(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entities, ids, seen = state.get if state.exists else ([], [], [])
        last = {(e, i): pd.Timestamp(t, unit="us") for e, i, t in zip(entities, ids, seen)}
        new = []
        # A trigger's rows of a cell are its own small part of one reader's rows: in the order of their time.
        for row in pd.concat(frames).sort_values(["at", "id"], kind="stable").itertuples(index=False):
            name = (row.entity, row.id)
            if name not in last or row.at - last[name] > keep:
                new.append((key[0], row.entity, row.id, row.at))
            last[name] = max(row.at, last.get(name, row.at))
        newest = max(last.values())
        kept = [(e, i, t.value // 1_000) for (e, i), t in last.items() if newest - t <= keep]
        state.update(tuple(map(list, zip(*kept))))
        if new:
            yield pd.DataFrame(new, columns=["reader", "entity", "id", "at"])

    rows = stream.select("reader", "entity", "id", "at").dropna(subset=["reader", "id", "at"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("entity", "id"), F.lit(shards)))
    return rows.groupBy("reader", "shard").applyInPandasWithState(
        cell, "reader string, entity string, id string, at timestamp", "entities array<string>, ids array<string>, seen array<long>",
        "append", GroupStateTimeout.NoTimeout,
    )


def companions(snapshots: DataFrame, feed: DataFrame, wait: str) -> DataFrame:
    """X-6: (cycle, kind, status): each companion of a published cycle, ``late`` if it came after the snapshot.

    ``snapshots(cycle, published timestamp)`` and ``feed(cycle, kind, arrived timestamp)`` are streams; rows that
    repeat a cycle, or a cycle's kind, within ``wait`` count once. An outer join in time: a companion belongs to
    its cycle up to ``wait`` before or after it was published, and a cycle that none came for in that time is told
    once as ``missing`` with a null kind, when the watermark has passed it.
    """
    cycles = snapshots.select("cycle", "published").withWatermark("published", wait).dropDuplicatesWithinWatermark(["cycle"])
    parts = feed.select(F.col("cycle").alias("of"), "kind", "arrived").withWatermark("arrived", wait).dropDuplicatesWithinWatermark(["of", "kind"])
    near = F.col("arrived").between(F.expr(f"published - interval {wait}"), F.expr(f"published + interval {wait}"))
    both = cycles.join(parts, (F.col("cycle") == F.col("of")) & near, "left_outer")
    status = F.when(F.col("of").isNull(), "missing").when(F.col("arrived") > F.col("published"), "late").otherwise("on time")
    return both.select("cycle", "kind", status.alias("status"))


def rerun_late(told: DataFrame, rerun: Callable[[SparkSession, str], None], checkpoint: str) -> StreamingQuery:
    """X-6: every cycle that late companions came for in a batch is run again, once for all of them.

    Only names of cycles reach the driver. A batch replayed after a failure reruns its cycles again, which a
    rerun that replaces the cycle whole (``history.replace_cycle``) does not notice.
    """

    def run(batch: DataFrame, _epoch: int) -> None:
        for row in batch.filter("status = 'late'").select("cycle").distinct().orderBy("cycle").collect():
            rerun(batch.sparkSession, row["cycle"])

    return told.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
