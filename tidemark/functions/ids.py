"""Stable change ids (F-8) and the whole-row field view (F-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import file_base

# --- Fixed values: the parts of a change that make its identity -----------------------------
KEY_PARTS = ("row", "fields", "context", "procedures", "folded", "chart", "key")
# --------------------------------------------------------------------------------------------


def change_key(df: DataFrame) -> Column:
    """Canonical JSON of what a change is, whatever words describe it. Parts the change does
    not carry are left out; a change with no part at all is known by its summary."""
    parts = [c for c in KEY_PARTS if c in df.columns]

    def present(name: str) -> Column:
        c = F.col(name)
        kind = df.schema[name].dataType.typeName()
        if kind in ("array", "map"):
            return F.when(F.size(c) > 0, c)
        if kind == "struct":
            return c
        return F.when(c != "", c)

    members = {name: present(name) for name in parts}
    has_none = F.lit(True)
    for value in members.values():
        has_none = has_none & value.isNull()
    members["kind"] = F.col("kind")
    members["source"] = file_base(F.col("source"))
    members["summary"] = F.when(has_none, F.col("summary") if "summary" in df.columns else F.lit(""))
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]))


def change_id(entity: Column, cycle: Column, key: Column) -> Column:
    """F-8: first 12 hex digits of SHA-1 over entity, cycle and key."""
    return F.substring(F.sha1(F.concat_ws("|", entity, cycle, key)), 1, 12)


def numbered_ids(df: DataFrame, cycle: Column, order: list[Column]) -> DataFrame:
    """W-4: ids with '#2', '#3' ... appended to the key of later records that share it.

    Numbering inside a key goes through :func:`ordinal`: a window while every key was measured
    to fit a task, range partitions with offsets when copies of one key pile up.
    """
    from tidemark.operators.skew import ordinal

    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("__key", change_key(df)).withColumn("__place", place)
    n = F.col("__n")
    suffix = F.when(n > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise(F.lit(""))
    out = ordinal(keyed, ["entity", "__key"], ["__place"], "__n")
    return out.withColumn("id", change_id(F.col("entity"), cycle, F.concat(F.col("__key"), suffix))).drop("__key", "__place", "__n")


def row_fields(kind: Column, row: Column) -> Column:
    """F-9: a whole row as the fields it brought or took away."""
    gone = kind == "removed"
    return F.transform(
        F.map_entries(F.map_filter(row, lambda k, v: ~k.startswith("_"))),
        lambda e: F.struct(
            e["key"].alias("field"),
            F.when(gone, e["value"]).otherwise("").alias("old"),
            F.when(gone, "").otherwise(e["value"]).alias("new"),
        ),
    )
