"""Every snapshot against the one before it, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.diff import with_digest


def all_differences(snapshots: DataFrame) -> DataFrame:
    """Long snapshot rows with their ``cycle`` to ``cycle, side, file, entity, items``: the distinct rows
    that a cycle removed or added against the cycle before it. The first cycle has nothing to compare with.

    A row's digest and cycles are all that is shuffled, once for all pairs; a digest has at most as
    many rows as there are cycles. Only rows that came or went are fetched.
    """
    rows = with_digest(snapshots, "cycle")
    order = Window.orderBy("cycle")  # a row per cycle
    steps = rows.select("cycle").distinct().select("cycle", F.lag("cycle").over(order).alias("before"), F.lead("cycle").over(order).alias("after"))
    of_row = Window.partitionBy("digest").orderBy("cycle")
    seen = rows.select("digest", "cycle").distinct().join(steps, "cycle")
    seen = seen.withColumns({"last": F.lag("cycle").over(of_row), "next": F.lead("cycle").over(of_row)})
    came = F.col("before").isNotNull() & ~F.col("last").eqNullSafe(F.col("before"))
    went = F.col("after").isNotNull() & ~F.col("next").eqNullSafe(F.col("after"))
    events = F.array(
        F.when(came, F.struct(F.col("cycle").alias("cycle"), F.lit("added").alias("side"))),
        F.when(went, F.struct(F.col("after").alias("cycle"), F.lit("removed").alias("side"))),
    )
    changes = seen.filter(came | went).select("digest", F.explode(F.array_compact(events)).alias("e")).select("digest", "e.cycle", "e.side")
    wanted = rows.join(changes.select("digest").distinct(), "digest", "left_semi")
    content = wanted.groupBy("digest").agg(F.any_value(F.struct("file", "entity", "items")).alias("row"))
    return changes.join(content, "digest").select("cycle", "side", "row.file", "row.entity", "row.items")
