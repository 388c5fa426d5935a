"""The whole way from two snapshots to published changes, gates and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.rules import AERO, RuleSet
from tidemark.functions import ids
from tidemark.functions import words as W
from tidemark.operators import collapse as C
from tidemark.operators import diff, quality, rank, views
from tidemark.operators.skew import first_per_key
from tidemark.plans.changes import ranked_changes
from tidemark.session import cut_lineage

PUBLIC = ["entity", "id", "priority", "category", "kind", "summary", "source", "original", "fields", "details", "procedures", "no_template", "mismatch"]


def attendance_records(old: DataFrame, new: DataFrame, rules: RuleSet = AERO, file: str = "APT_ATT") -> DataFrame:
    """D-9 as records: an entity's schedule rows are one text, compared as a whole."""
    from tidemark.functions.predicates import cell

    side = lambda df: df.filter(F.col("file") == file).select("entity", *[cell(F.col("row"), c).alias(c) for c in ("SKED_SEQ_NO", "MONTH", "DAY", "HOUR")])
    texts = lambda df: diff.schedule_texts(side(df), "entity", "SKED_SEQ_NO", ("MONTH", "DAY", "HOUR"))
    d = diff.schedule_diff(texts(old), texts(new))
    base = rank.base_priority(
        F.lit(file), F.lit("changed"), F.array(F.lit("MONTH"), F.lit("DAY"), F.lit("HOUR")), F.array("old", "new"), F.array().cast("array<string>"), rules
    )
    unattended = (F.col("old") == "") & (F.col("new") == "UNATNDD")
    return d.select(
        "entity", F.lit(file).alias("source"), "kind",
        F.when(unattended | F.col("same_hours"), "fyi").otherwise(base).alias("priority"), F.lit("airport").alias("category"),
        F.array(F.struct(F.lit("ATTENDANCE").alias("field"), "old", "new")).alias("fields"),
        F.lit(None).cast("map<string,string>").alias("row"), F.create_map().cast("map<string,string>").alias("context"),
        F.lit(None).cast("map<string,string>").alias("new_row"),
    )


def shape(records: DataFrame, cycle: Column, extra: DataFrame | None = None, translations: DataFrame | None = None) -> DataFrame:
    """Described, deduplicated, checked and numbered changes (W-1 .. W-4, T-14, F-8, F-9).

    ``extra`` are chart and area records that come with their summary; they skip the phrase
    dedupe and meet the rest at the summary dedupe.
    """
    described = W.describe(records, translations)
    shown = cut_lineage(described.filter(F.col("priority") != "hidden").withColumn("rid", F.md5(F.concat_ws("|", "rid", F.to_json("phrases")))).drop("summary"))
    shown = first_per_key(shown, ["entity", "rid"], [F.col("priority")])
    said = views.phrase_dedupe(shown)
    checked = W.check_summaries(said).withColumn("stage", F.lit(0))
    if extra is not None:
        more = C.event(extra, **{c: F.col(c) for c in ("entity", "source", "kind", "priority", "category", "summary") if c in extra.columns})
        more = more.withColumns({"original": F.lit(None).cast("string"), "phrases": F.array("summary"), "no_template": F.lit(False), "mismatch": F.array().cast("array<string>"), "stage": F.lit(1)})
        checked = checked.unionByName(more.select(*checked.columns))
    order = [F.col("stage"), F.col("priority") != "action", F.col("phrases"), F.col("rid")]
    unique = first_per_key(checked, ["entity", "summary"], order)
    fields = F.when(F.size("fields") > 0, F.col("fields")).when(
        F.col("row").isNotNull() & F.col("original").isNull() & (F.col("source") != "APT_CON"), ids.row_fields(F.col("kind"), F.col("row"))
    )
    out = ids.numbered_ids(unique, cycle, [rank.priority_order(F.col("priority")), *order])
    return out.withColumn("fields", F.coalesce(fields, F.array().cast(C.FIELD))).select(*PUBLIC, F.struct("stage", (F.col("priority") != "action").alias("late"), "phrases", "rid").alias("ord"))


def publish_pair(
    old: DataFrame, new: DataFrame, cycle: str, rules: RuleSet = AERO, extra: DataFrame | None = None,
    translations: DataFrame | None = None, old_sets: DataFrame | None = None, new_sets: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(public changes, hidden counts per entity) of a snapshot pair ``(file, entity, row)``."""
    schedules = F.col("file") == "APT_ATT"
    raw = ranked_changes(old.filter(~schedules), new.filter(~schedules), rules, sub_key=("FRQ", "FREQ"))
    raw = raw.unionByName(attendance_records(old, new, rules))
    records = cut_lineage(C.collapse(raw, old_sets, new_sets, rules))
    hidden = records.filter(F.col("priority") == "hidden").groupBy("entity").agg(F.count(F.lit(1)).alias("hidden"))
    return shape(records, F.lit(cycle), extra, translations), hidden


def gate(changes: DataFrame, pair: DataFrame, past: DataFrame, old_counts: DataFrame, new_counts: DataFrame, current: Column, gap_ok: bool = False) -> DataFrame:
    """Q-1 .. Q-5 for one publication: all errors and warnings."""
    return quality.combine_gates(
        quality.cycle_gate(pair, current, gap_ok),
        quality.input_gate(old_counts, new_counts),
        quality.change_gate(changes),
        quality.volume_gate(changes, past),
    )
