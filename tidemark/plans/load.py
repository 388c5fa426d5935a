"""Archives to snapshots that can be compared: reading, cleaning and attribution in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import attribute, places
from tidemark.operators.diff import row_items
from tidemark.session import cut_lineage
from tidemark.sources import archive

# --- Fixed values ---------------------------------------------------------------------------
ROUTE_FILES = ("STAR_RTE", "DP_RTE")
BRIDGE_FILES = ("STAR_APT", "DP_APT")
CODE_COLUMNS = ("STAR_COMPUTER_CODE", "DP_COMPUTER_CODE")
TWO_ENDED, ENDS = ("PFR",), ("Orig", "Dest")
NEAR_FILES = ("NAV",)
NEAR_COLUMN = "_NEAR_NM"
# --------------------------------------------------------------------------------------------


def _upper(column: str) -> Column:
    return F.upper(F.trim(P.cell(F.col("row"), column)))


def _procedure() -> Column:
    """The procedure a row is of, from whichever code column it has."""
    return attribute.split_code(F.coalesce(*[F.nullif(_upper(c), F.lit("")) for c in CODE_COLUMNS])).getField("name")


def attributed(rows: DataFrame, ids: DataFrame, strict: bool = False, around: DataFrame | None = None, radius_nm: float = places.NEAR_NM) -> DataFrame:
    """One snapshot's rows ``(file, row)`` to ``(file, entity, row)`` for the known ids (J-1 .. J-4).

    Routes name no entity: they reach theirs through the procedure's list in the same snapshot. Rows with
    two ends belong to both. Navaids that name no known entity go to the nearest of ``around(entity, lat,
    lon)`` within the radius, with the distance in ``_NEAR_NM``. Rows of nobody are left out.
    """
    rows = cut_lineage(rows.select("file", "row"))
    file = F.col("file")
    route, ends = file.isin(*ROUTE_FILES), P.starts_with_any(file, TWO_ENDED)
    named = attribute.attribute_rows(rows.filter(~route & ~ends), ids, strict=strict)
    both = attribute.attribute_both_ends(rows.filter(ends), ids, [_upper(c) for c in ENDS]).select("file", "entity", "row")
    bridge = rows.filter(file.isin(*BRIDGE_FILES)).select(_procedure().alias("via"), _upper("ARPT_ID").alias("entity"))
    bridge = bridge.join(ids.select(F.col(ids.columns[0]).alias("entity")).distinct(), "entity", "left_semi")
    routes = attribute.attribute_through(rows.filter(route), bridge, _procedure(), "via", "entity").select("file", "entity", "row")
    out = [named, both, routes]
    if around is not None:
        near = P.starts_with_any(file, NEAR_FILES)
        said = named.filter(near).select("file", row_items(F.col("row")).alias("items"))
        lost = rows.filter(near).withColumn("items", row_items(F.col("row"))).join(said, ["file", "items"], "left_anti")
        lost = lost.withColumns({"lat": P.cell(F.col("row"), "LAT_DECIMAL").try_cast("double"), "lon": P.cell(F.col("row"), "LONG_DECIMAL").try_cast("double")})
        found = places.nearest_within(lost.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()), around, radius_nm)
        out.append(found.select("file", "entity", F.map_concat("row", F.create_map(F.lit(NEAR_COLUMN), F.col("nm_label"))).alias("row")))
    return reduce(DataFrame.unionByName, [d.select("file", "entity", "row") for d in out])


def load_pair(spark: SparkSession, paths: str | list[str], old_cycle: str, new_cycle: str, strict: bool = False, radius_nm: float = places.NEAR_NM) -> tuple[DataFrame, DataFrame]:
    """S-1 .. S-11 and J-1 .. J-5: two cycles out of archives, attributed to the entities of either, ready
    for ``publish_pair``."""
    rows = cut_lineage(archive.read_snapshots(spark, paths))
    of = lambda cycle: rows.filter(F.col("cycle") == F.lit(cycle).cast("date")).select("file", "row")
    base = rows.filter("file = 'APT_BASE'")
    ids = cut_lineage(base.select(_upper("ARPT_ID").alias("entity")).filter("entity != ''").distinct())
    return tuple(attributed(of(c), ids, strict, attribute.public_entities(of(c).filter("file = 'APT_BASE'")), radius_nm) for c in (old_cycle, new_cycle))
