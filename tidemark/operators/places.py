"""Joins by place: nearest within a radius, points in polygons, layer and boundary diffs
(J-4, J-6, J-7, J-8, D-11, R-6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators.skew import top_k
from tidemark.session import broadcast_if_bounded, cut_lineage

# --- Fixed values ---------------------------------------------------------------------------
NEAR_NM = 10.0
NEAREST = 5
#: Rings of a search grow by this factor; targets that a place looks at on average before the search begins in a finer ring.
RING_STEP, RING_TARGETS, MOST_RINGS = 4, 64, 12
AREA_SHARE = 0.02
SHIFT_NM = 0.2
BOX_CELL = 0.5
# --------------------------------------------------------------------------------------------


def _band(lat: Column, height: float) -> Column:
    return F.floor(lat / F.lit(height)).cast("int")


def _column_count(band: Column, height: float) -> Column:
    """How many longitude cells a latitude band has: at its most polar neighbour a cell is
    still at least one radius wide."""
    polar = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(height), F.lit(89.9))
    return F.greatest(F.floor(F.lit(360.0) * F.cos(F.radians(polar)) / F.lit(height)), F.lit(1)).cast("int")


def _column(lon: Column, count: Column) -> Column:
    share = (lon + 180) / 360
    return F.pmod(F.floor(share * count).cast("int"), count)


def nearest_within(points: DataFrame, targets: DataFrame, radius_nm: float = NEAR_NM, k: int = NEAREST) -> DataFrame:
    """J-4: up to ``k`` targets within the radius of every point, closest first.

    ``points`` and ``targets`` carry ``lat, lon``; targets also ``entity``. Both sides meet in
    grid cells one ring wide (longitude cells widen toward the poles). Copies at one spot
    are handled once: points are looked up per distinct place, and a place keeps only its
    first ``k`` targets, because no more can ever be chosen.

    Where targets are dense the search begins in a ring smaller than the radius: a place that has
    ``k`` targets inside a ring is settled, as none outside is closer, and only the others look further.
    """
    homes = top_k(targets.select("entity", "lat", "lon").distinct(), ["lat", "lon"], [F.col("entity")], k)
    homes = cut_lineage(homes.select("entity", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")))
    spots = cut_lineage(points.select("lat", "lon").distinct())
    found = []
    for reach in _rings(spots, homes, radius_nm):
        best = top_k(_hits(spots, homes, reach), ["lat", "lon"], [F.col("nm"), F.col("entity")], k, rank="rank")
        if reach < radius_nm:
            best = cut_lineage(best)
            full = best.filter(F.col("rank") == k).select("lat", "lon")
            spots = cut_lineage(spots.join(full, ["lat", "lon"], "left_anti"))
            best = best.join(full, ["lat", "lon"], "left_semi")
        found.append(best)
    best = reduce(DataFrame.unionByName, found)
    return points.join(best, ["lat", "lon"]).withColumn("nm_label", F.bround("nm", 0).cast("int").cast("string"))


def _in_cells(places: DataFrame, lat: str, lon: str, height: float) -> DataFrame:
    """Each place with its cell (``band``, ``cell``)."""
    places = places.withColumn("band", _band(F.col(lat), height))
    return places.withColumn("cell", _column(F.col(lon), _column_count(F.col("band"), height)))


def _rings(spots: DataFrame, homes: DataFrame, radius_nm: float) -> list[float]:
    """The reaches of a search, ascending to the radius. The first is so small that a place has few targets
    around it, by counts of both sides per cell."""
    out = [radius_nm]
    while len(out) < MOST_RINGS:
        height = out[0] / 60 * 1.0001
        per_cell = lambda df, lat, lon, name: _in_cells(df, lat, lon, height).groupBy("band", "cell").agg(F.count(F.lit(1)).alias(name))
        cells = per_cell(spots, "lat", "lon", "spots").join(per_cell(homes, "t_lat", "t_lon", "homes"), ["band", "cell"])
        met, looking = cells.agg(F.sum(F.col("spots").cast("double") * F.col("homes")), F.sum("spots")).first()
        if not looking or met <= RING_TARGETS * looking:
            break
        out.insert(0, out[0] / RING_STEP)
    return out


def _hits(spots: DataFrame, homes: DataFrame, reach: float) -> DataFrame:
    """Every target within ``reach`` of a place."""
    height = reach / 60 * 1.0001
    spots = spots.withColumn("band", F.explode(F.array(*[_band(F.col("lat"), height) + d for d in (-1, 0, 1)])))
    count = _column_count(F.col("band"), height)
    around = F.array_distinct(F.array(*[F.pmod(_column(F.col("lon"), count) + d, count) for d in (-1, 0, 1)]))
    spots = spots.withColumn("cell", F.explode(around))
    nm = geo.nautical_miles(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    hits = spots.join(broadcast_if_bounded(_in_cells(homes, "t_lat", "t_lon", height)), ["band", "cell"])
    return hits.select("lat", "lon", "entity", nm.alias("nm")).filter(F.col("nm") <= reach)


# --- polygons -------------------------------------------------------------------------------


def with_box(pieces: DataFrame) -> DataFrame:
    """S-10: the bounding box of a piece, from its rings."""
    points = F.flatten("rings")
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return pieces.withColumns({"s": F.array_min(lat), "w": F.array_min(lon), "n": F.array_max(lat), "e": F.array_max(lon)})


def contains(rings: Column, lat: Column, lon: Column) -> Column:
    """J-7: even-odd test over every ring, so holes work."""

    def crosses(edge: Column) -> Column:
        straddles = (edge["y1"] > lat) != (edge["y2"] > lat)
        at = (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0)) + edge["x1"]
        return F.when(straddles & (lon < at), 1).otherwise(0)

    per_ring = lambda ring: F.aggregate(geo.ring_edges(ring), F.lit(0), lambda acc, e: acc + crosses(e))
    total = F.aggregate(F.transform(rings, per_ring), F.lit(0), lambda acc, n: acc + n)
    return F.pmod(total, F.lit(2)) == 1


def layers_over(points: DataFrame, pieces: DataFrame, cell: float = BOX_CELL) -> DataFrame:
    """J-6 + J-7: every (point, piece layer) where the point lies inside.

    Boxes are spread over their grid cells and meet points by cell equality, then the box test; only
    what passes meets the piece's rings, which are never copied into cells.
    """
    down = lambda c: F.floor(c / F.lit(cell)).cast("int")
    pieces = cut_lineage(with_box(pieces).withColumn("piece", F.monotonically_increasing_id()))
    boxes = pieces.select("piece", "s", "w", "n", "e").withColumn("gy", F.explode(F.sequence(down(F.col("s")), down(F.col("n")))))
    boxes = boxes.withColumn("gx", F.explode(F.sequence(down(F.col("w")), down(F.col("e")))))
    spots = points.select("entity", "lat", "lon").withColumns({"gy": down(F.col("lat")), "gx": down(F.col("lon"))})
    inside_box = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    near = spots.join(boxes, ["gy", "gx"]).filter(inside_box).select("entity", "lat", "lon", "piece")
    hits = near.join(pieces.select("piece", "rings", "name", "ltype", "cls", "layer"), "piece").filter(contains(F.col("rings"), F.col("lat"), F.col("lon")))
    return hits.select("entity", "name", "ltype", "cls", "layer").distinct()


def layer_changes(points: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """J-8: layers over each point, old against new; only what differs is returned.

    Both snapshots are tested in one pass (pieces tagged by side), and the sets gathered per
    (point, area) hold layer labels, a small vocabulary.
    """
    both = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    hits = layers_over(points, both.withColumn("layer", F.concat_ws("\u0001", "side", "layer")))
    side = F.substring_index("layer", "\u0001", 1)
    label = F.substring_index("layer", "\u0001", -1)
    sets = hits.withColumn("side", side).withColumn("label", label).groupBy("entity", "name", "ltype").agg(
        F.first("cls").alias("cls"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "old", F.col("label")))).alias("was"),
        F.array_sort(F.collect_set(F.when(F.col("side") == "new", F.col("label")))).alias("now"),
    )
    kind = F.when(F.size("was") == 0, "added").when(F.size("now") == 0, "removed").otherwise("changed")
    return sets.filter(F.col("was") != F.col("now")).withColumn("kind", kind)


def footprints(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """F-6: area (square NM) and centroid per key, summed over pieces and rings."""

    def ring_sums(ring: Column) -> Column:
        scale = F.cos(F.radians(ring[0]["lat"])) * 60
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))

        def add(acc: Column, edge: Column) -> Column:
            a, y, x = geo.edge_terms(edge, scale)
            return F.struct((acc["a"] + a).alias("a"), (acc["y"] + y).alias("y"), (acc["x"] + x).alias("x"))

        return F.aggregate(geo.ring_edges(ring), zero, add)

    rings = pieces.select(*keys, F.explode(F.filter("rings", lambda r: F.size(r) >= 3)).alias("ring"))
    sums = rings.select(*keys, ring_sums(F.col("ring")).alias("t")).groupBy(*keys).agg(
        F.sum("t.a").alias("a"), F.sum("t.y").alias("y"), F.sum("t.x").alias("x")
    )
    zero = F.col("a") == 0
    at = lambda c: F.when(zero, 0.0).otherwise(F.col(c) / (F.nullif(F.col("a"), F.lit(0.0)) * 3))
    return sums.select(*keys, (F.abs("a") / 2).alias("area"), at("y").alias("lat"), at("x").alias("lon"))


def boundary_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """D-11: per area and layer, whether it is new, removed or its boundary moved (area by
    more than 2 % or centroid by more than 0.2 NM); a re-digitised boundary is no change."""
    keys = ["name", "ltype", "layer"]
    o = footprints(old, keys).select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("area", "lat", "lon")])
    n = footprints(new, keys).select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("area", "lat", "lon")])
    j = o.join(n, keys, "full_outer")
    shift = F.hypot(
        (F.col("n_lat") - F.col("o_lat")) * 60,
        (F.col("n_lon") - F.col("o_lon")) * 60 * F.cos(F.radians("o_lat")),
    )
    resized = F.abs(F.col("n_area") - F.col("o_area")) > F.greatest("o_area", "n_area") * AREA_SHARE
    change = (
        F.when(F.col("o_area").isNull(), "new").when(F.col("n_area").isNull(), "removed").when(resized | (shift > SHIFT_NM), "moved")
    )
    return j.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change")


def area_changes(points: DataFrame, old: DataFrame, new: DataFrame, owners: DataFrame) -> DataFrame:
    """J-8 + D-11 + R-6: one record per entity and area, always action. What an entity sees
    overhead is said first; owners are told of other shelves and boundaries only when nothing
    was said from their point of view."""
    areas = lambda df: df.groupBy("name", "ltype").agg(F.first("cls").alias("cls"))
    everything = areas(old.unionByName(new))
    seen = layer_changes(points, old, new)
    mine = owners.select("entity", "name", "ltype").distinct().withColumn("owns", F.lit(True))
    title = F.concat_ws(" ", F.initcap("name"), F.lit("class"), F.col("cls"))
    seen = seen.join(mine, ["entity", "name", "ltype"], "left")
    who = F.when(F.col("owns"), F.concat(F.lit("class "), F.col("cls"))).otherwise(title)
    was, now = F.array_join("was", ", "), F.array_join("now", ", ")
    text = (
        F.when(F.col("kind") == "added", F.concat(F.lit("now under "), who, F.lit(": "), now))
        .when(F.col("kind") == "removed", F.concat(F.lit("no longer under "), who, F.lit(" (was "), was, F.lit(")")))
        .otherwise(F.concat(who, F.lit(" over the field: "), was, F.lit(" -> "), now))
    )
    overhead = seen.select("entity", "name", "ltype", "kind", text.alias("summary"))
    there = lambda df, flag: df.select("name", "ltype").distinct().withColumn(flag, F.lit(True))
    state = everything.join(there(old, "in_old"), ["name", "ltype"], "left").join(there(new, "in_new"), ["name", "ltype"], "left")
    bits = boundary_changes(old, new).groupBy("name", "ltype").agg(
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("change") == c, F.col("layer")))), ", ").alias(c)
            for c in ("new", "removed", "moved")
        ]
    )
    quiet = mine.join(overhead.select("entity", "name", "ltype"), ["entity", "name", "ltype"], "left_anti")
    owned = quiet.join(state, ["name", "ltype"]).join(bits, ["name", "ltype"], "left")
    label = F.concat(F.lit("class "), F.col("cls"), F.lit(" airspace"))
    say = lambda c, before, after="": F.when(F.col(c) != "", F.concat(F.lit(before), F.col(c), F.lit(after)))
    details = F.concat_ws("; ", say("new", "new "), say("removed", "removed "), say("moved", "boundary moved (", ")"))
    owned = owned.select(
        "entity", "name", "ltype",
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed").alias("kind"),
        F.when(F.col("in_old").isNull(), F.concat(F.lit("new "), label))
        .when(F.col("in_new").isNull(), F.concat(label, F.lit(" removed")))
        .when(details != "", F.concat(label, F.lit(": "), details))
        .alias("summary"),
    ).filter(F.col("summary").isNotNull())
    return overhead.unionByName(owned).withColumn("priority", F.lit("action")).withColumn("source", F.lit("CLS_ARSP_SHP"))
