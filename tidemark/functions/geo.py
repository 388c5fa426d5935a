"""Distances, polygon measures and altitude labels (F-4, F-5, F-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------
EARTH_RADIUS_NM = 3440.065
# --------------------------------------------------------------------------------------------


def nautical_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """F-4: great-circle distance."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2 * EARTH_RADIUS_NM)


def altitude(value: Column, code: Column, unit: Column) -> Column:
    """F-5: 'SFC', 'class A' for negatives, 'FL180', '2,500 ft MSL'."""
    code, unit = F.upper(F.coalesce(code, F.lit(""))), F.upper(F.coalesce(unit, F.lit("")))
    n = value.try_cast("double")
    text = F.trim(F.coalesce(value, F.lit("?")))
    shown = F.when(code == "", "MSL").otherwise(code)
    return (
        F.when((code == "SFC") | ((n == 0) & code.isin("", "AGL", "SFC")), "SFC")
        .when(n.isNull(), F.when(text == "", "?").otherwise(text))
        .when(n < 0, "class A")
        .when((unit == "FL") | (code == "STD"), F.concat(F.lit("FL"), F.format_string("%03d", n.cast("int"))))
        .otherwise(F.concat(F.format_number(n.cast("int"), 0), F.lit(" ft "), shown))
    )


def layer_label(low: Column, high: Column) -> Column:
    """F-5: 'low-high', a unit both share said once."""
    unit = F.regexp_extract(low, r"^\S+( .+)$", 1)
    folded = (unit != "") & high.endswith(unit)
    return F.concat(F.when(folded, F.substring_index(low, " ", 1)).otherwise(low), F.lit("-"), high)


def ring_edges(ring: Column) -> Column:
    """A ring's edges as struct<x1,y1,x2,y2>, closed back to its first point."""
    closing = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        closing,
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )


def edge_terms(edge: Column, scale: Column) -> tuple[Column, Column, Column]:
    """F-6: one edge's share of doubled area and of the centroid sums."""
    cross = edge["x1"] * scale * edge["y2"] * 60 - edge["x2"] * scale * edge["y1"] * 60
    return cross, (edge["y1"] + edge["y2"]) * cross, (edge["x1"] + edge["x2"]) * cross
