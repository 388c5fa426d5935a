"""Attribution and joins by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import attribute, diff, places
from workload.core import query_set
from workload.pairs import AGED_OUT, ARRIVED, table

QUERIES, ORACLES, query = query_set()


# --- J-1 --------------------------------------------------------------------------------------
@query("""
WITH rich AS (SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_acctbal > 5000
              UNION SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 45)
SELECT coalesce(s.id, p.id) AS entity, count(*) AS lines, sum(l_linenumber) AS slots
FROM lineitem l LEFT JOIN rich s ON s.id = CAST(l_suppkey AS VARCHAR) LEFT JOIN rich p ON p.id = CAST(l_partkey AS VARCHAR)
WHERE coalesce(s.id, p.id) IS NOT NULL GROUP BY 1""")
def ordered_attribution(spark, sf):
    """A line belongs to its supplier when that id is known, else to its part."""
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("id"))
    p = table(spark, sf, "part").filter("p_size > 45").select(F.col("p_partkey").cast("string").alias("id"))
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    out = attribute.first_match(lines, s.union(p), [F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")])
    return out.filter("entity is not null").groupBy("entity").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_linenumber").cast("bigint").alias("slots")
    )


@query("""
WITH ids AS (SELECT n_name AS id FROM nation),
r AS (SELECT DISTINCT CASE WHEN c_acctbal > 0 THEN 'NATION_' || c_nationkey ELSE '' END AS owner, c_mktsegment AS seg, 'NATION_' || (c_nationkey) AS other, c_name
      FROM customer)
SELECT CASE WHEN owner <> '' THEN owner ELSE other END AS entity, CAST(owner <> '' AS BOOLEAN) AS by_owner, count(*) AS n
FROM r WHERE (CASE WHEN owner <> '' THEN owner ELSE other END) IN (SELECT id FROM ids) GROUP BY 1, 2""")
def loose_attribution(spark, sf):
    """Map rows: the owner column first, then any value of the row."""
    c = table(spark, sf, "customer")
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    rows = diff.snapshot(c, "CUST", F.lit(""), {"ARPT_ID": F.when(F.col("c_acctbal") > 0, nation).otherwise(""), "SEGMENT": F.col("c_mktsegment"), "ELSEWHERE": nation, "NAME": F.col("c_name")})
    out = attribute.attribute_rows(rows.select("file", "row"), table(spark, sf, "nation").select("n_name"), strict=False)
    return out.groupBy("entity", (F.col("row")["ARPT_ID"] != "").alias("by_owner")).agg(F.count(F.lit(1)).alias("n"))


# --- J-2 --------------------------------------------------------------------------------------
@query("""
WITH known AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
legs AS (SELECT event_id, user_id AS a, CAST(floor(value) AS BIGINT) AS b FROM events)
SELECT entity, count(*) AS events, max(event_id) AS last FROM (
  SELECT event_id, a AS entity FROM legs UNION SELECT event_id, b FROM legs) x
JOIN known ON c_custkey = entity GROUP BY entity""")
def two_ended_attribution(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("other"))
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    out = attribute.attribute_both_ends(e, known, [F.col("user_id"), F.col("other")])
    return out.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last"))


# --- J-3, F-1 ---------------------------------------------------------------------------------
@query("""
WITH code AS (SELECT DISTINCT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN 'FIX.PART' || l_partkey ELSE 'PART' || l_partkey || '.FIX' END AS code FROM lineitem),
named AS (SELECT l_orderkey, list_filter(string_split(code, '.'), lambda p: regexp_matches(p, '[0-9]$'))[1] AS name FROM code),
bridge AS (SELECT DISTINCT 'PART' || l_partkey AS via, s_nationkey AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT CAST(nation AS VARCHAR) AS entity, count(*) AS points, count(DISTINCT name) AS procedures
FROM named JOIN bridge ON via = name GROUP BY 1""")
def bridge_attribution(spark, sf):
    """Route points reach nations through their procedure: point -> part code -> supplier nation."""
    li = table(spark, sf, "lineitem")
    part = F.concat(F.lit("PART"), F.col("l_partkey").cast("string"))
    code = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("FIX."), part)).otherwise(F.concat(part, F.lit(".FIX")))
    points = li.select("l_orderkey", "l_partkey", code.alias("code")).distinct()
    bridge = li.join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(
        part.alias("procedure"), F.col("s_nationkey").cast("string").alias("entity")
    )
    # counted per procedure first: the hop multiplies one row per procedure, not per point
    named = points.groupBy(attribute.split_code(F.col("code"))["name"].alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = attribute.attribute_through(named, bridge, F.col("name"), "procedure", "entity")
    return out.groupBy("entity").agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("procedures"))


# --- J-4 --------------------------------------------------------------------------------------
def customer_points(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"),
        (F.lit(30) + F.col("c_acctbal") / 1000).alias("lat"),
        (F.col("c_nationkey") * 0.5 - 100).alias("lon"),
    )


def supplier_points(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("entity"),
        (F.lit(30) + F.col("s_acctbal") / 1000).alias("lat"),
        (F.col("s_nationkey") * 0.5 - 100).alias("lon"),
    )


POINTS_SQL = """
cp AS (SELECT c_custkey AS entity, 30 + c_acctbal / 1000 AS lat, c_nationkey * 0.5::DOUBLE - 100 AS lon FROM customer),
sp AS (SELECT s_suppkey AS entity, 30 + s_acctbal / 1000 AS lat, s_nationkey * 0.5::DOUBLE - 100 AS lon FROM supplier)
"""


@query(f"""
WITH {POINTS_SQL},
d AS (SELECT cp.entity AS customer, sp.entity AS supplier,
  2 * 3440.065 * asin(sqrt(sin((radians(sp.lat) - radians(cp.lat)) / 2) ** 2
     + cos(radians(cp.lat)) * cos(radians(sp.lat)) * sin(radians(sp.lon - cp.lon) / 2) ** 2)) AS nm FROM cp, sp),
r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY nm, supplier) AS rank FROM d WHERE nm <= 60)
SELECT customer, supplier, round(nm, 4) AS nm, rank FROM r WHERE rank <= 5""")
def nearest_within_radius(spark, sf):
    near = places.nearest_within(
        customer_points(spark, sf).withColumnRenamed("entity", "customer"), supplier_points(spark, sf), radius_nm=60.0
    )
    return near.select("customer", F.col("entity").alias("supplier"), F.round("nm", 4).alias("nm"), F.col("rank").cast("bigint").alias("rank"))


# --- J-6, J-7, J-8 ----------------------------------------------------------------------------
def nation_pieces(spark, sf, shift: float):
    """Two layers per nation around its place: a core box with a hole, and a wider shelf that
    the new snapshot moves east (even nations keep it)."""
    n = table(spark, sf, "nation").filter("n_regionkey < 4") if shift else table(spark, sf, "nation").filter("n_regionkey > 0")
    lat, lon = F.lit(30) + F.col("n_nationkey") * 0.3, F.col("n_nationkey") * 0.5 - 100
    moved = F.when(F.col("n_regionkey") >= 2, F.lit(shift)).otherwise(F.lit(0.0))
    box = lambda dy, dx, at: F.array(
        *[F.struct((lon + at + x).alias("lon"), (lat + y).alias("lat")) for y, x in ((-dy, -dx), (-dy, dx), (dy, dx), (dy, -dx))]
    )
    core = F.struct(F.lit("SFC-3,000 ft MSL").alias("layer"), F.array(box(1.5, 0.75, F.lit(0.0)), box(0.25, 0.375, F.lit(0.0))).alias("rings"))
    shelf = F.struct(F.lit("3,000-10,000 ft MSL").alias("layer"), F.array(box(2.25, 1.25, moved)).alias("rings"))
    return n.select(F.col("n_name").alias("name"), F.lit("CLASS_B").alias("ltype"), F.lit("B").alias("cls"), F.explode(F.array(core, shelf)).alias("p")).select(
        "name", "ltype", "cls", "p.layer", "p.rings"
    )


PIECES_SQL = f"""
WITH {POINTS_SQL},
nat AS (SELECT n_name AS name, n_regionkey AS reg, 30 + n_nationkey * 0.3::DOUBLE AS lat, n_nationkey * 0.5::DOUBLE - 100 AS lon FROM nation),
shape(layer, ring, i, y, x) AS (VALUES
 ('SFC-3,000 ft MSL', 0, 0, -1.5, -0.75), ('SFC-3,000 ft MSL', 0, 1, -1.5, 0.75), ('SFC-3,000 ft MSL', 0, 2, 1.5, 0.75), ('SFC-3,000 ft MSL', 0, 3, 1.5, -0.75),
 ('SFC-3,000 ft MSL', 1, 0, -0.25, -0.375), ('SFC-3,000 ft MSL', 1, 1, -0.25, 0.375), ('SFC-3,000 ft MSL', 1, 2, 0.25, 0.375), ('SFC-3,000 ft MSL', 1, 3, 0.25, -0.375),
 ('3,000-10,000 ft MSL', 0, 0, -2.25, -1.25), ('3,000-10,000 ft MSL', 0, 1, -2.25, 1.25), ('3,000-10,000 ft MSL', 0, 2, 2.25, 1.25), ('3,000-10,000 ft MSL', 0, 3, 2.25, -1.25)),
side(side, shift) AS (VALUES ('old', 0.0), ('new', 0.375)),
v AS (SELECT side, name, layer, ring, i, nat.lat + y::DOUBLE AS y,
        nat.lon + CASE WHEN layer LIKE '3%' AND reg >= 2 THEN shift::DOUBLE ELSE 0 END + x::DOUBLE AS x
      FROM nat, shape, side WHERE (side = 'old' AND reg > 0) OR (side = 'new' AND reg < 4)),
edge AS (SELECT a.side, a.name, a.layer, a.ring, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
         FROM v a JOIN v b ON a.side = b.side AND a.name = b.name AND a.layer = b.layer AND a.ring = b.ring AND b.i = (a.i + 1) % 4),
hit AS (SELECT cp.entity, side, name, layer FROM cp, edge
        WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        GROUP BY ALL HAVING count(*) % 2 = 1)
"""


@query(f"""{PIECES_SQL},
s AS (SELECT entity, name, coalesce(string_agg(layer, ', ' ORDER BY layer) FILTER (side = 'old'), '') AS was,
             coalesce(string_agg(layer, ', ' ORDER BY layer) FILTER (side = 'new'), '') AS now FROM hit GROUP BY ALL)
SELECT entity, name, was, now, CASE WHEN was = '' THEN 'added' WHEN now = '' THEN 'removed' ELSE 'changed' END AS kind
FROM s WHERE was <> now""")
def point_in_polygon_layers(spark, sf):
    out = places.layer_changes(customer_points(spark, sf), nation_pieces(spark, sf, 0.0), nation_pieces(spark, sf, 0.375))
    return out.select("entity", "name", F.array_join("was", ", ").alias("was"), F.array_join("now", ", ").alias("now"), "kind")


# --- F-6, D-11 --------------------------------------------------------------------------------
@query(f"""{PIECES_SQL},
first_lat AS (SELECT side, name, layer, ring, y FROM v WHERE i = 0),
t AS (SELECT e.side, e.name, e.layer, sum((x1 * k) * (y2 * 60) - (x2 * k) * (y1 * 60)) AS a,
        sum((y1 + y2) * ((x1 * k) * (y2 * 60) - (x2 * k) * (y1 * 60))) AS sy, sum((x1 + x2) * ((x1 * k) * (y2 * 60) - (x2 * k) * (y1 * 60))) AS sx
      FROM edge e JOIN (SELECT *, cos(radians(y)) * 60 AS k FROM first_lat) f USING (side, name, layer, ring) GROUP BY ALL),
m AS (SELECT side, name, layer, abs(a) / 2 AS area, sy / (3 * a) AS lat, sx / (3 * a) AS lon FROM t),
j AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.layer, n.layer) AS layer, o.area AS oa, n.area AS na,
        sqrt(((n.lat - o.lat) * 60) ** 2 + ((n.lon - o.lon) * 60 * cos(radians(o.lat))) ** 2) AS shift
      FROM (SELECT * FROM m WHERE side = 'old') o FULL JOIN (SELECT * FROM m WHERE side = 'new') n USING (name, layer))
SELECT name, layer, CASE WHEN oa IS NULL THEN 'new' WHEN na IS NULL THEN 'removed' ELSE 'moved' END AS change
FROM j WHERE oa IS NULL OR na IS NULL OR abs(na - oa) > 0.02 * greatest(oa, na) OR shift > 0.2""")
def boundary_changes(spark, sf):
    return places.boundary_changes(nation_pieces(spark, sf, 0.0), nation_pieces(spark, sf, 0.375)).select("name", "layer", "change")


@query()
def area_change_records(spark, sf):
    """What each entity is told: what changed overhead, else about the area it owns."""
    owners = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("entity"), F.col("n_name").alias("name"), F.lit("CLASS_B").alias("ltype")
    )
    return places.area_changes(customer_points(spark, sf), nation_pieces(spark, sf, 0.0), nation_pieces(spark, sf, 0.375), owners)


# --- F-5 --------------------------------------------------------------------------------------
@query("""
WITH a AS (SELECT CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS val,
  CASE WHEN s_nationkey < 5 THEN 'SFC' WHEN s_nationkey < 10 THEN 'AGL' WHEN s_nationkey < 15 THEN 'STD' ELSE 'MSL' END AS code, CAST(floor(s_acctbal) AS BIGINT) AS n FROM supplier),
l AS (SELECT CASE WHEN code = 'SFC' THEN 'SFC' WHEN n = 0 AND code = 'AGL' THEN 'SFC' WHEN n < 0 THEN 'class A'
  WHEN code = 'STD' THEN 'FL' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') ELSE format('{:,}', n) || ' ft ' || code END AS low, code FROM a)
SELECT CASE WHEN low LIKE '% ft MSL' THEN replace(low, ' ft MSL', '') ELSE low END || '-' || '18,000 ft MSL' AS label, count(*) AS n FROM l GROUP BY 1""")
def altitude_labels(spark, sf):
    nation = F.col("s_nationkey")
    code = F.when(nation < 5, "SFC").when(nation < 10, "AGL").when(nation < 15, "STD").otherwise("MSL")
    low = geo.altitude(F.floor("s_acctbal").cast("string"), code, F.lit(""))
    label = geo.layer_label(low, geo.altitude(F.lit("18000"), F.lit("MSL"), F.lit("")))
    return table(spark, sf, "supplier").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- J-15 -------------------------------------------------------------------------------------
@query("""
WITH d AS (SELECT 'S' || s_suppkey AS entity, 'K' || s_suppkey AS alternate FROM supplier),
t AS (SELECT c_custkey, 's' || CAST(floor(c_acctbal / 50) AS BIGINT) || ' K' || c_nationkey || ';zz, s' || c_nationkey || ' k' || c_nationkey AS text FROM customer),
w AS (SELECT DISTINCT c_custkey, unnest(regexp_split_to_array(upper(text), '[\\s,;]+')) AS word FROM t)
SELECT c_custkey, word, coalesce(a.entity, b.entity) AS entity FROM w
LEFT JOIN d a ON a.entity = word LEFT JOIN d b ON b.alternate = word""")
def id_resolution(spark, sf):
    k = F.col("s_suppkey").cast("string")
    directory = table(spark, sf, "supplier").select(F.concat(F.lit("S"), k).alias("entity"), F.concat(F.lit("K"), k).alias("alternate"))
    n = F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("s"), F.floor(F.col("c_acctbal") / 50).cast("string"), F.lit(" K"), n, F.lit(";zz, s"), n, F.lit(" k"), n)
    texts = table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return attribute.resolve_ids(texts, "text", directory).select("c_custkey", "word", "entity")
