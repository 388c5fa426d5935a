"""Two snapshots to ranked raw change records, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config.rules import RuleSet
from tidemark.functions import predicates as P
from tidemark.operators import diff, pairing, rank
from tidemark.session import cut_lineage

RECORD = ["entity", "source", "kind", "priority", "category", "fields", "row", "context", "new_row"]


def ranked_changes(old: DataFrame, new: DataFrame, rules: RuleSet, text_overrides: bool = True, sub_key: tuple[str, str] | None = None) -> DataFrame:
    """D-1..D-8, R-1..R-4: one record per edited, added or removed row.

    ``sub_key`` names (file, column) whose rows are uses of one thing: losing a use while the
    thing stays is an edit (D-8), gaining one on a known thing is fyi.
    """
    difference = diff.slot_insensitive_difference(old, new, rules)
    paired = cut_lineage(pairing.pair_rows(difference, rules))
    edits = paired.filter(F.col("old_items").isNotNull() & F.col("new_items").isNotNull()).select(
        "file", "entity",
        F.map_from_entries("old_items").alias("old_row"),
        F.map_from_entries("new_items").alias("new_row"),
    )
    edits = edits.withColumn("fields", diff.edits(F.col("file"), F.col("old_row"), F.col("new_row"), rules))
    edits = rank.edit_priority(edits, rules, text_overrides)
    changed = edits.select(
        "entity", F.col("file").alias("source"), F.lit("changed").alias("kind"), "priority",
        plain_fields(F.col("fields")).alias("fields"),
        F.lit(None).cast("map<string,string>").alias("row"),
        diff.context(F.col("new_row"), rules).alias("context"),
        "new_row",
    )
    rows = paired.filter(F.col("old_items").isNull() | F.col("new_items").isNull()).select(
        "file", "entity",
        F.when(F.col("old_items").isNotNull(), "removed").otherwise("added").alias("kind"),
        F.map_from_entries(F.coalesce("old_items", "new_items")).alias("row"),
    )
    lost = None
    if sub_key:
        rows, lost = _uses(rows, old, new, *sub_key)
    else:
        rows = rows.withColumn("existed", F.lit(False))
    whole = rank.row_priority(rows, rules).select(
        "entity", F.col("file").alias("source"), "kind", "priority",
        F.array().cast("array<struct<field:string,old:string,new:string>>").alias("fields"),
        diff.visible_row(F.col("row"), rules).alias("row"),
        F.create_map().cast("map<string,string>").alias("context"),
        F.lit(None).cast("map<string,string>").alias("new_row"),
    )
    out = changed.unionByName(whole)
    if lost is not None:
        out = out.unionByName(lost)
    return out.withColumn("category", rank.category(F.col("source"), F.col("kind"), F.col("fields"), rules)).select(*RECORD)


def plain_fields(fields):
    return F.transform(
        fields, lambda f: F.struct(f["field"].alias("field"), f["old"].alias("old"), f["new"].alias("new"))
    )


def _uses(rows: DataFrame, old: DataFrame, new: DataFrame, file: str, column: str) -> tuple[DataFrame, DataFrame]:
    """D-8: flag added uses of known things and turn lost uses into edits."""
    sub = P.cell(F.col("row"), column)
    keys = lambda df, flag: df.filter(F.col("file") == file).select("entity", sub.alias("sub")).distinct().withColumn(flag, F.lit(True))
    mine = F.col("file") == file
    marked = (
        rows.withColumn("sub", F.when(mine, sub))
        .join(keys(new, "in_new"), ["entity", "sub"], "left")
        .join(keys(old, "in_old"), ["entity", "sub"], "left")
        .withColumn("lost", mine & (F.col("kind") == "removed") & F.coalesce("in_new", F.lit(False)))
        .withColumn("existed", mine & F.coalesce("in_old", F.lit(False)))
    )
    use = "FREQ_USE"
    lost = marked.filter("lost").select(
        "entity", F.col("file").alias("source"), F.lit("changed").alias("kind"), F.lit("fyi").alias("priority"),
        F.array(F.struct(F.lit(use).alias("field"), P.cell(F.col("row"), use).alias("old"), F.lit("").alias("new"))).alias("fields"),
        F.lit(None).cast("map<string,string>").alias("row"),
        F.create_map(F.lit(column), F.col("sub")).alias("context"),
        F.lit(None).cast("map<string,string>").alias("new_row"),
    )
    return marked.filter(~F.col("lost")).select("file", "entity", "kind", "row", "existed"), lost
