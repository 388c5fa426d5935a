"""Which entity a row is about (J-1, J-2, J-3, J-11, J-15, S-11, S-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import rules as R
from tidemark.functions import predicates as P
from tidemark.operators.diff import row_items
from tidemark.session import is_bounded


def first_match(rows: DataFrame, ids: DataFrame, candidates: list[Column], out: str = "entity") -> DataFrame:
    """J-1 over typed columns: the first candidate that is a known id, null when none is.

    Each candidate is one left join against the distinct ids; the planner broadcasts them when
    they are small and otherwise shuffles with adaptive skew splitting.
    """
    known = ids.select(F.col(ids.columns[0]).alias("__id")).filter(F.col("__id").isNotNull()).distinct()
    if is_bounded(known):
        known = F.broadcast(known)
    hits = []
    for n, candidate in enumerate(candidates):
        rows = rows.join(known.withColumnRenamed("__id", f"__hit{n}"), candidate == F.col(f"__hit{n}"), "left")
        hits.append(F.col(f"__hit{n}"))
    return rows.withColumn(out, F.coalesce(*hits)).drop(*[f"__hit{n}" for n in range(len(candidates))])


def attribute_rows(rows: DataFrame, ids: DataFrame, owner_columns=R.OWNER_COLUMNS, strict: bool = True, strict_files=R.STRICT_FILES) -> DataFrame:
    """J-1 over map rows ``(file, row)``; identical rows are one row.

    Candidate values are exploded with their position, matched by one equi-join, and the
    earliest match is kept. Unless ``strict`` (or a strict file), any other value of the row
    may match after all owner columns, in column order.
    """
    items = rows.select("file", row_items(F.col("row")).alias("items")).distinct()
    row = F.map_from_entries("items")
    owners = F.array(*[F.upper(P.cell(row, c)) for c in owner_columns])
    rest = F.transform("items", lambda e: F.upper(e["value"]))
    loose = F.lit(not strict) & ~P.starts_with_any(F.col("file"), strict_files)
    candidates = F.when(loose, F.concat(owners, rest)).otherwise(owners)
    pos = items.select("file", "items", F.posexplode(candidates).alias("pos", "value")).filter(F.col("value") != "")
    known = ids.select(F.col(ids.columns[0]).alias("value")).distinct()
    if is_bounded(known):
        known = F.broadcast(known)
    first = pos.join(known, "value").groupBy("file", "items").agg(F.min(F.struct("pos", "value")).alias("hit"))
    return first.select("file", F.col("hit.value").alias("entity"), F.map_from_entries("items").alias("row"))


def attribute_both_ends(rows: DataFrame, ids: DataFrame, end_columns: list[Column]) -> DataFrame:
    """J-2: a row belongs to every known entity at one of its ends, once each."""
    ends = F.array_distinct(F.filter(F.array(*end_columns), lambda v: v.isNotNull()))
    known = ids.select(F.col(ids.columns[0]).alias("entity")).distinct()
    if is_bounded(known):
        known = F.broadcast(known)
    return rows.withColumn("entity", F.explode(ends)).join(known, "entity")


def split_code(code: Column) -> Column:
    """F-1: struct<name, other> of a dotted procedure code; the versioned part is the name."""
    parts = F.filter(F.split(F.upper(F.coalesce(code, F.lit(""))), r"\."), lambda p: p != "")
    versioned = F.filter(parts, lambda p: p.rlike(r"\d$"))
    name = F.coalesce(F.try_element_at(versioned, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit(""))
    other = F.coalesce(F.try_element_at(F.filter(parts, lambda p: p != name), F.lit(1)), F.lit(""))
    return F.struct(name.alias("name"), other.alias("other"))


def attribute_through(rows: DataFrame, bridge: DataFrame, key: Column, bridge_key: str, entity: str) -> DataFrame:
    """J-3: rows reach their entities through a bridge table (route point -> procedure ->
    entities). Distinct bridge pairs keep the hop from multiplying copies."""
    pairs = bridge.select(F.col(bridge_key).alias("__via"), F.col(entity).alias("entity")).filter(
        (F.col("__via") != "") & (F.col("entity") != "")
    ).distinct()
    return rows.withColumn("__via", key).join(pairs, "__via").drop("__via")


def entity_ids(*snapshots: DataFrame, column: str) -> DataFrame:
    """S-11: distinct non-blank ids over all given snapshots."""
    ids = [s.select(F.upper(F.trim(F.col(column).cast("string"))).alias("entity")) for s in snapshots]
    return reduce(DataFrame.unionByName, ids).filter(F.col("entity") != "").distinct()


def name_lists(ids: DataFrame, states: DataFrame) -> DataFrame:
    """S-12: known ids (3-4 letters) and state codes (2 letters), as ``kind, name``."""
    tidy = lambda df, kind, form: df.select(
        F.lit(kind).alias("kind"), F.upper(F.trim(F.col(df.columns[0]))).alias("name")
    ).filter(F.col("name").rlike(form))
    return tidy(ids, "id", "^[A-Z]{3,4}$").unionByName(tidy(states, "state", "^[A-Z]{2}$")).distinct()


def public_entities(rows: DataFrame) -> DataFrame:
    """J-5: entities open to the public: by use code where the row has one, else by having an
    ICAO id; site type A or blank."""
    row = F.col("row")
    up = lambda c: F.upper(F.trim(P.cell(row, c)))
    public = F.when(F.map_contains_key(row, F.lit("FACILITY_USE_CODE")), up("FACILITY_USE_CODE") == "PU").otherwise(up("ICAO_ID") != "")
    return (
        rows.filter(public & up("SITE_TYPE_CODE").isin("A", ""))
        .select(
            up("ARPT_ID").alias("entity"),
            up("LAT_DECIMAL").try_cast("double").alias("lat"),
            up("LONG_DECIMAL").try_cast("double").alias("lon"),
        )
        .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def resolve_ids(texts: DataFrame, text: str, directory: DataFrame) -> DataFrame:
    """J-15: free-text id lists to entities: by id, else alternate id, else id less a leading
    K; each once per text, unmatched words kept with a null entity."""
    words = texts.withColumn("word", F.explode(F.array_distinct(F.split(F.upper(F.trim(F.col(text))), r"[\s,;]+")))).filter(
        F.col("word") != ""
    )
    ids = directory.select(F.col("entity").alias("by_id")).distinct()
    alternates = directory.filter(F.col("alternate") != "").groupBy(F.col("alternate").alias("alt")).agg(F.min("entity").alias("by_alt"))
    stripped = F.when(F.col("word").rlike("^K[A-Z]{3}$"), F.substring("word", 2, 3))
    return (
        words.join(ids, F.col("word") == F.col("by_id"), "left")
        .join(alternates, F.col("word") == F.col("alt"), "left")
        .join(ids.withColumnRenamed("by_id", "by_strip"), stripped == F.col("by_strip"), "left")
        .withColumn("entity", F.coalesce("by_id", "by_alt", "by_strip"))
        .drop("by_id", "alt", "by_alt", "by_strip")
    )
