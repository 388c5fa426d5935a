"""Snapshot difference (D-1, D-2, D-6 .. D-10).

A snapshot is a long table ``(file, entity, row MAP<STRING,STRING>)``. A row's identity is its
sorted (column, value) entries, so column order, row order and missing columns never matter. Snapshots
are compared by 128-bit digests of their rows; only the rows that turn out to differ are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.rules import RuleSet
from tidemark.functions import predicates as P
from tidemark.functions.text import lit_array, same_schedule

EDIT = "struct<field:string,old:string,new:string,size:string>"


def row_map(columns: dict[str, Column]) -> Column:
    """A snapshot row: every value a trimmed string, blank and missing the same."""
    pairs = []
    for name, value in columns.items():
        pairs += [F.lit(name), F.coalesce(F.trim(value.cast("string")), F.lit(""))]
    return F.create_map(*pairs)


def money(column: str) -> Column:
    """A double as text that every engine prints alike."""
    return F.col(column).cast("decimal(18,2)").cast("string")


def snapshot(df: DataFrame, file: str, entity: Column, columns: dict[str, Column]) -> DataFrame:
    """A typed table as snapshot rows. ``items`` is the row's identity, laid out in column order
    at plan time; ``row`` is the same as a map. A plan computes only the one it uses."""
    text = lambda v: F.coalesce(F.trim(v.cast("string")), F.lit(""))
    items = F.array(*[F.struct(F.lit(c).alias("key"), text(columns[c]).alias("value")) for c in sorted(columns)])
    return df.select(F.lit(file).alias("file"), entity.cast("string").alias("entity"), items.alias("items"), row_map(columns).alias("row"))


def row_items(row: Column) -> Column:
    return F.array_sort(F.map_entries(row))


def with_digest(df: DataFrame, *more: str, slots=()) -> DataFrame:
    """Rows with their identity, a 128-bit digest of it and columns of theirs; with ``slots`` also a
    digest (``content``) without those columns."""
    identity = F.col("items") if "items" in df.columns else row_items(F.col("row"))
    out = df.select(*more, "file", "entity", identity.alias("items"))
    digest = lambda items: F.struct(F.xxhash64("file", "entity", items).alias("a"), F.xxhash64(F.lit(1), items, "entity", "file").alias("b"))
    out = out.withColumn("digest", digest(F.col("items")))
    return out.withColumn("content", digest(slotless(F.col("items"), slots))) if slots else out


def _presence(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Every distinct digest of either snapshot once, flagged by where it occurs.

    Digests are all that is shuffled: copies combine map-side, a hot entity spreads over all tasks.
    """
    keyed = lambda df, was: df.select(*keys, F.lit(was).alias("in_old"), F.lit(not was).alias("in_new"))
    return keyed(old, True).unionByName(keyed(new, False)).groupBy(*keys).agg(F.bool_or("in_old").alias("in_old"), F.bool_or("in_new").alias("in_new"))


def _rows_of(old: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct rows behind one-sided digests (``digest, in_old``), with their side."""
    def fetch(df: DataFrame, was: bool, side: str) -> DataFrame:
        wanted = found.filter(F.col("in_old") == was).select("digest")
        rows = df.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value(F.struct("file", "entity", "items")).alias("row"))
        return rows.select("row.file", "row.entity", "row.items", F.lit(side).alias("side"))

    return fetch(old, True, "removed").unionByName(fetch(new, False, "added"))


def set_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-1: distinct rows found on one side only, with ``side`` 'removed' or 'added'."""
    old, new = with_digest(old), with_digest(new)
    return _rows_of(old, new, _presence(old, new, "digest").filter(F.col("in_old") != F.col("in_new")))


def slotless(items: Column, slot_columns) -> Column:
    slots = lit_array(slot_columns)
    return F.filter(items, lambda e: ~F.array_contains(slots, e["key"]))


def slot_insensitive_difference(old: DataFrame, new: DataFrame, rules: RuleSet) -> DataFrame:
    """D-1 with D-2 for numbered lists: a row of a list table whose content (slot columns
    aside) still exists on the other side has only moved, and is no change."""
    if not rules.slot_columns or not rules.remark_files:
        return set_difference(old, new)
    old, new = with_digest(old, slots=rules.slot_columns), with_digest(new, slots=rules.slot_columns)
    listed = F.col("file").isin(*rules.remark_files)
    tag = lambda df: df.withColumn("content", F.when(listed, F.col("content")))
    present = _presence(tag(old), tag(new), "digest", "content")
    sides = present.filter("content is not null").groupBy("content").agg(F.bool_or("in_old").alias("o"), F.bool_or("in_new").alias("n"))
    stays = sides.filter("o and n").select("content")
    return _rows_of(old, new, present.filter(F.col("in_old") != F.col("in_new")).join(stays, "content", "left_anti"))


def edits(file: Column, old_row: Column, new_row: Column, rules: RuleSet) -> Column:
    """D-6: the columns that really changed, in name order, with small changes marked soft."""
    columns = F.array_sort(F.array_distinct(F.concat(F.map_keys(old_row), F.map_keys(new_row))))
    value = lambda row, c: F.coalesce(F.try_element_at(row, c), F.lit(""))
    pairs = F.transform(
        columns, lambda c: F.struct(c.alias("field"), value(old_row, c).alias("old"), value(new_row, c).alias("new"))
    )
    kept = P.kept_declination(file, old_row, new_row)

    def matters(f: Column) -> Column:
        name, old, new = f["field"], f["old"], f["new"]
        return (
            (old != new)
            & (~P.is_noise(name, rules) | F.array_contains(kept, name))
            & ~name.startswith("_")
            & ~P.is_blank_fill(name, old, new)
            & ~P.is_phone_format(name, old, new)
        )

    sized = F.transform(
        F.filter(pairs, matters),
        lambda f: F.struct(
            f["field"].alias("field"), f["old"].alias("old"), f["new"].alias("new"),
            P.change_size(f["field"], f["old"], f["new"], rules).alias("size"),
        ),
    )
    return F.filter(sized, lambda f: F.coalesce(f["size"], F.lit("")) != "drop")


def context(row: Column, rules: RuleSet) -> Column:
    """D-7: the columns of the new row that a description needs."""
    wanted = lit_array(rules.context_columns)
    return F.map_filter(row, lambda k, v: F.array_contains(wanted, k) & (v != ""))


def visible_row(row: Column, rules: RuleSet) -> Column:
    """The part of a whole row that is published: no blanks, ids or bookkeeping."""
    return F.map_filter(row, lambda k, v: (v != "") & ~P.is_in(k, rules.id_columns) & ~P.is_noise(k, rules))


def still_used(removed: DataFrame, new: DataFrame, file: str, column: str) -> DataFrame:
    """D-8: removed rows of ``file`` whose sub-key still exists at the entity in the new
    snapshot (the entry lost one use, it did not go away)."""
    key = P.cell(F.col("row"), column)
    alive = new.filter(F.col("file") == file).select("entity", key.alias("sub")).distinct()
    rows = removed.filter(F.col("file") == file).withColumn("sub", key)
    return rows.join(alive, ["entity", "sub"], "left_semi").drop("sub")


def schedule_texts(rows: DataFrame, entity: str, seq: str, parts: tuple[str, ...]) -> DataFrame:
    """D-9, one side: an entity's schedule rows as one text in sequence order.

    Every part is spelled per row and made distinct per entity first, so what is gathered is
    the entity's vocabulary of parts and not its rows.
    """
    values = F.array_distinct(F.filter(F.array(*[F.trim(F.col(c)) for c in parts]), lambda v: v != ""))
    spoken = F.filter(values, lambda v: v != "ALL")
    part = F.when(F.size(values) == 0, F.lit("")).when(F.size(spoken) == 0, F.lit("ALL")).otherwise(F.array_join(spoken, " "))
    first = (
        rows.select(F.col(entity).alias("entity"), F.coalesce(F.col(seq).try_cast("double"), F.lit(0.0)).alias("seq"), part.alias("part"))
        .filter(F.col("part") != "")
        .groupBy("entity", "part")
        .agg(F.min("seq").alias("seq"))
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda s: s["part"]), "; ")
    return first.groupBy("entity").agg(text.alias("text"))


def schedule_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-9: entities whose schedule text changed; both inputs come from :func:`schedule_texts`."""
    o, n = old.withColumnRenamed("text", "o"), new.withColumnRenamed("text", "n")
    joined = o.join(n, "entity", "full_outer").select(
        "entity", F.coalesce("o", F.lit("")).alias("old"), F.coalesce("n", F.lit("")).alias("new")
    )
    kind = F.when(F.col("old") == "", "added").when(F.col("new") == "", "removed").otherwise("changed")
    both = (F.col("old") != "") & (F.col("new") != "")
    same = F.coalesce(same_schedule(F.when(both, F.col("old")), F.when(both, F.col("new"))), F.lit(False))
    return joined.filter(F.col("old") != F.col("new")).select("entity", kind.alias("kind"), "old", "new", same.alias("same_hours"))


def set_members_diff(old: DataFrame, new: DataFrame, name: str, member: str) -> DataFrame:
    """D-10: members of a named set that came or went, one row each (never a gathered set)."""
    tag = lambda df, was: df.select(
        F.col(name).alias("name"), F.col(member).alias("member"), F.lit(was).alias("o"), F.lit(not was).alias("n")
    )
    flags = tag(old, True).unionByName(tag(new, False)).groupBy("name", "member").agg(
        F.bool_or("o").alias("o"), F.bool_or("n").alias("n")
    )
    change = F.when(F.col("n"), F.lit("added")).otherwise(F.lit("removed"))
    return flags.filter(F.col("o") != F.col("n")).select("name", "member", change.alias("change"))
