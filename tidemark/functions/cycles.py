"""Cycle arithmetic (F-7, F-18, F-20, F-21) on dates, as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------
ANCHOR = "2026-09-03"
CYCLE_DAYS = 28
CHANGEOVER = "INTERVAL '09:01' HOUR TO MINUTE"
# --------------------------------------------------------------------------------------------


def cycle_on_or_before(day: Column, anchor: str = ANCHOR, days: int = CYCLE_DAYS) -> Column:
    """F-7: start of the cycle that holds ``day``."""
    start = F.lit(anchor).cast("date")
    steps = F.floor(F.datediff(day, start) / F.lit(days)).cast("int")
    return F.date_add(start, steps * days)


def in_effect(instant: Column, anchor: str = ANCHOR, days: int = CYCLE_DAYS) -> Column:
    """F-7/X-4: the cycle in effect at an instant; it changes over at 09:01 UTC."""
    return cycle_on_or_before((instant - F.expr(CHANGEOVER)).cast("date"), anchor, days)


def effective_at(cycle: Column) -> Column:
    return cycle.cast("timestamp") + F.expr(CHANGEOVER)


def edition(cycle: Column, days: int = CYCLE_DAYS) -> Column:
    """F-7: 'YYNN', the NN-th cycle of its year."""
    number = F.floor((F.dayofyear(cycle) - 1) / F.lit(days)).cast("int") + 1
    return F.concat(F.date_format(cycle, "yy"), F.lpad(number.cast("string"), 2, "0"))


def previous_edition(cycle: Column, days: int = CYCLE_DAYS) -> Column:
    return edition(F.date_sub(cycle, days), days)


def is_off_schedule(cycle: Column, anchor: str = ANCHOR, days: int = CYCLE_DAYS) -> Column:
    return F.datediff(cycle, F.lit(anchor).cast("date")) % days != 0


def published_at(cycle: Column, now: Column, days: int = CYCLE_DAYS) -> Column:
    """F-18: when the cycle before took effect, never later than now."""
    return F.least(effective_at(F.date_sub(cycle, days)), now)


def is_current_chart(link: Column, current_edition: Column) -> Column:
    """F-20: a chart link is served while its edition is not older than the current one."""
    linked = F.regexp_extract(link, r"/d-tpp/(\d{4})/", 1)
    return (linked != "") & (linked >= current_edition)


def cycle_dimension(spark: SparkSession, today: dt.date, count: int = 15) -> DataFrame:
    """F-21: cycle dates from one back, each effective at 09:01 UTC."""
    now = cycle_on_or_before(F.lit(today))
    first, last = F.date_sub(now, CYCLE_DAYS), F.date_add(now, CYCLE_DAYS * (count - 2))
    dates = F.explode(F.sequence(first, last, F.expr(f"INTERVAL {CYCLE_DAYS} DAYS"))).alias("cycle")
    return spark.range(1).select(dates).select(
        "cycle", effective_at(F.col("cycle")).alias("effective_at"), edition(F.col("cycle")).alias("edition")
    )
