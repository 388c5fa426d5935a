"""Rule predicates, event steps, wording and outputs over rows shaped from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config.rules import AERO
from tidemark.functions import cycles, ids
from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.functions import words as W
from tidemark.operators import attribute, charts, collapse, glossary, quality, rank
from tidemark.operators import translation as TR
from tidemark.sinks import outputs
from tidemark.sources import archive
from tidemark.streaming import cycles as streaming
from workload.core import query_set
from workload.pairs import table
from workload.views import CURRENT, LOG_SQL, change_log, nation_lists

QUERIES, ORACLES, query = query_set()


def s(value):
    return value.cast("string")


def money(column):
    return s(F.col(column).cast("decimal(18,2)"))


def row_of(**values):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])


# --- S-3, S-6, F-3 ----------------------------------------------------------------------------
@query("""
SELECT CAST(p_partkey AS VARCHAR) AS part, CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END || 'L/' || CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END AS rwy, p_brand AS brand FROM part""")
def row_cleaning(spark, sf):
    p = table(spark, sf, "part")
    size = s(F.col("p_size"))
    raw = p.select(row_of(**{"PART": F.concat(F.lit(" "), s(F.col("p_partkey")), F.lit(" ")), "RWY_ID": F.concat(size, F.lit("L/"), size), "EFF_DATE": "x", "BRAND": F.concat("p_brand", F.lit("  "))}).alias("row"))
    r = archive.clean_rows(raw).select("row", F.map_contains_key("row", F.lit("EFF_DATE")).alias("dated")).filter(~F.col("dated"))
    return r.select(F.col("row")["PART"].alias("part"), F.col("row")["RWY_ID"].alias("rwy"), F.col("row")["BRAND"].alias("brand"))


# --- S-4, S-8, P-1 ----------------------------------------------------------------------------
@query("""
WITH m AS (SELECT DISTINCT o_custkey AS cycle, o_orderpriority AS p FROM orders)
SELECT c.cycle, f.p AS file FROM (SELECT DISTINCT cycle FROM m) c, (SELECT DISTINCT o_orderpriority AS p FROM orders) f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cycle = c.cycle AND m.p = f.p)""")
def required_tables(spark, sf):
    """Customers without an order of some priority class, as snapshots that lack a table."""
    o = table(spark, sf, "orders")
    found = o.select(F.col("o_custkey").alias("cycle"), P.file_base(F.concat("o_orderpriority", F.lit(".csv"))).alias("file"))
    return archive.missing_files(found, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


# --- S-12 -------------------------------------------------------------------------------------
@query("""
SELECT 'id' AS kind, upper(substr(c_mktsegment, 1, 4)) AS name FROM customer UNION SELECT 'state', upper(lang) FROM documents WHERE regexp_full_match(upper(lang), '[A-Z]{2}')""")
def name_lists(spark, sf):
    return attribute.name_lists(table(spark, sf, "customer").select(F.substring("c_mktsegment", 1, 4)), table(spark, sf, "documents").select("lang"))


# --- J-5 --------------------------------------------------------------------------------------
@query("""
SELECT CAST(c_custkey AS VARCHAR) AS entity, round(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), 4) AS lat FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 20""")
def public_entities(spark, sf):
    c = table(spark, sf, "customer")
    row = row_of(ARPT_ID=s(F.col("c_custkey")), FACILITY_USE_CODE=F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "PU").otherwise("PR"), SITE_TYPE_CODE=F.when(F.col("c_nationkey") < 20, "A").otherwise("H"), LAT_DECIMAL=money("c_acctbal"), LONG_DECIMAL="1.5")
    return attribute.public_entities(c.select(row.alias("row"))).select("entity", F.round("lat", 4).alias("lat"))


# --- P-6, P-8 ---------------------------------------------------------------------------------
@query("""
WITH f AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS o, CAST(o_totalprice * CASE o_orderstatus WHEN 'O' THEN 0.85 WHEN 'F' THEN 0.95 ELSE 1.1 END AS DECIMAL(18,2)) AS n FROM orders)
SELECT o_orderkey AS order_no, o > 0 AND n < o AND (CAST(o AS DOUBLE) - CAST(n AS DOUBLE) >= 500 OR (CAST(o AS DOUBLE) - CAST(n AS DOUBLE)) / CAST(o AS DOUBLE) >= 0.1) AS cut FROM f""")
def declared_distance_cuts(spark, sf):
    st = F.col("o_orderstatus")
    new = s((F.col("o_totalprice") * F.when(st == "O", 0.85).when(st == "F", 0.95).otherwise(1.1)).cast("decimal(18,2)"))
    fields = F.array(F.struct(F.lit("LNDG_DIST_AVBL").alias("field"), money("o_totalprice").alias("old"), new.alias("new")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_no"), P.distance_was_cut(fields).alias("cut"))


# --- R-1, R-3 over whole rows -----------------------------------------------------------------
@query("""
SELECT l_returnflag AS flag, l_linestatus AS status, CASE l_returnflag
   WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 'fyi' ELSE 'action' END WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'fyi' ELSE 'action' END ELSE CASE WHEN l_linenumber > 5 THEN 'fyi' ELSE 'ifr' END END AS priority, count(*) AS n
FROM lineitem GROUP BY ALL""")
def whole_row_ranks(spark, sf):
    """Lines as three kinds of whole rows: strips (helipads fyi), weather stations (new ones
    fyi) and device remarks (action words are ifr)."""
    li = table(spark, sf, "lineitem")
    flag, no = F.col("l_returnflag"), F.col("l_linenumber")
    file = F.when(flag == "A", "APT_RWY").when(flag == "N", "AWOS").otherwise("NAV_RMK")
    row = row_of(
        RWY_ID=F.when(no == 1, "H1").otherwise(F.concat_ws("/", F.lit("09"), F.lit("27"))), REMARK=F.when((flag == "R") & (no <= 5), "TWR CLSD").otherwise("NONE"),
        QTY=s(F.col("l_quantity").cast("int")),
    )
    kind = F.when((flag == "N") & (F.col("l_linestatus") == "O"), "added").otherwise("removed")
    ranked = rank.row_priority(li.select("l_returnflag", "l_linestatus", file.alias("file"), kind.alias("kind"), row.alias("row"), F.lit(False).alias("existed")), AERO)
    return ranked.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "priority").agg(F.count(F.lit(1)).alias("n"))


# --- C-1 --------------------------------------------------------------------------------------
@query("""
WITH p AS (SELECT o_custkey AS e, CASE WHEN o_orderstatus = 'O' THEN 'added' ELSE 'removed' END AS kind, p_size, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
w AS (SELECT e, kind, string_agg(DISTINCT 'runway ' || p_size || ' ' || p_size || 'x50 ft turf', '; ' ORDER BY 'runway ' || p_size || ' ' || p_size || 'x50 ft turf') AS runways, min(o_orderkey) AS ctaf FROM p GROUP BY ALL)
SELECT CAST(e AS VARCHAR) AS entity, kind, CASE kind WHEN 'removed' THEN 'action' ELSE 'fyi' END AS priority,
  CASE kind WHEN 'added' THEN 'new airport in FAA database' ELSE 'airport removed from FAA database' END || ': Field ' || e || ', ' || runways || ', CTAF ' || ctaf AS summary FROM w""")
def whole_entity_lines(spark, sf):
    """Customers as new or removed entities: their parts are strips, their first order the CTAF."""
    o = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    j = o.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "O", "added").otherwise("removed")
    e, size = s(F.col("o_custkey")), s(F.col("p_size"))
    base = j.select(e.alias("e"), kind.alias("k"), F.lit("APT_BASE").alias("f"), row_of(ARPT_NAME=F.concat(F.lit("FIELD "), e)).alias("row")).dropDuplicates(["e", "k"])
    strips = j.select(e.alias("e"), kind.alias("k"), F.lit("APT_RWY").alias("f"), row_of(RWY_ID=size, RWY_LEN=size, RWY_WIDTH="50", SURFACE_TYPE_CODE="TURF").alias("row"))
    first = j.groupBy(e.alias("e"), kind.alias("k")).agg(F.min("o_orderkey").alias("key"))
    freqs = first.select("e", "k", F.lit("FRQ").alias("f"), row_of(FREQ=s(F.col("key")), FREQ_USE="CTAF").alias("row"))
    rows = base.unionByName(strips).unionByName(freqs)
    records = collapse.event(rows, entity=F.col("e"), source=F.col("f"), kind=F.col("k"), priority=F.lit("fyi"), row=F.col("row"))
    events, _ = collapse.whole_entities(records)
    return events.select("entity", "kind", "priority", "summary")


# --- C-2, C-3 ---------------------------------------------------------------------------------
@query()
def runway_renumbering(spark, sf):
    """Parts as strips of their brand: economy strips went, small ones came."""
    p = table(spark, sf, "part").filter(F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD", "PROMO", "LARGE", "MEDIUM"))
    kind = F.when(F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO"), "removed").otherwise("added")
    number = F.lpad(s(F.floor(F.col("p_size") * 36 / 51).cast("int") + 1), 2, "0")
    row = row_of(RWY_ID=number, RWY_LEN=s(F.floor("p_retailprice").cast("int")), RWY_WIDTH="75", SURFACE_TYPE_CODE="ASPH")
    records = collapse.event(p, entity=F.col("p_brand"), source=F.lit("APT_RWY"), kind=kind, priority=F.lit("action"), row=row)
    pairs = collapse.runway_pairs(records)
    return collapse.runway_events(records, pairs).select("entity", "kind", "summary")


# --- C-8 --------------------------------------------------------------------------------------
@query("""
WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, 'PART ' || l_partkey AS t, l_returnflag = 'R' AS is_table, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber = 1) > 0 AS act, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, l_linenumber FROM lineitem) GROUP BY ALL),
g AS (SELECT entity, t, bool_or(is_table) AS told, bool_or(act) AS act, sum(n) FILTER (is_table) AS tables, sum(n) FILTER (NOT is_table) AS edits FROM t GROUP BY ALL)
SELECT entity, t AS remark, CASE WHEN told THEN 'APT_RMK' ELSE 'FRQ' END AS source, CASE WHEN act THEN 'action' ELSE 'fyi' END AS priority, CAST(CASE WHEN told THEN tables ELSE 1 END AS BIGINT) AS n FROM g""")
def remarks_said_once(spark, sf):
    """A part's remark in the remark table (returned lines) and on frequency rows (other lines)."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("in_table"), "l_linenumber").distinct()
    text = F.concat(F.lit("PART "), s(F.col("l_partkey")))
    in_table = F.col("in_table")
    edit = F.array(F.struct(F.lit("REMARK").alias("field"), F.lit("").alias("old"), text.alias("new")))
    records = collapse.event(
        li, entity=s(F.col("l_suppkey")), source=F.when(in_table, "APT_RMK").otherwise("FRQ"), kind=F.when(in_table, "added").otherwise("changed"),
        priority=F.when(~in_table & (F.col("l_linenumber") == 1), "action").otherwise("fyi"), fields=F.when(in_table, F.array().cast(collapse.FIELD)).otherwise(edit),
        row=F.when(in_table, row_of(REMARK=text)), context=row_of(FREQ=s(F.col("l_linenumber"))),
    )
    said = F.coalesce(F.col("row")["REMARK"], F.try_element_at("fields", F.lit(1))["new"])
    return collapse.said_once(records).groupBy("entity", said.alias("remark"), "source", "priority").agg(F.count(F.lit(1)).alias("n"))


# --- J-12 -------------------------------------------------------------------------------------
@query("""
WITH b AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS k, CASE l_returnflag WHEN 'R' THEN 'removed' ELSE 'added' END AS kind FROM lineitem WHERE l_linestatus = 'O'),
g AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS k, CASE l_returnflag WHEN 'R' THEN 'removed' ELSE 'added' END AS kind, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS angle FROM lineitem WHERE l_linestatus = 'F')
SELECT CAST(e AS VARCHAR) AS entity, kind, CASE kind WHEN 'added' THEN 'new ' ELSE '' END || 'ILS RWY ' || k || ' with ' || string_agg('glideslope ' || angle || '°', ', ' ORDER BY 'glideslope ' || angle || '°') || CASE kind WHEN 'removed' THEN ': removed' ELSE '' END AS summary, count(*) AS parts
FROM b JOIN g USING (e, k, kind) GROUP BY e, k, kind""")
def whole_with_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    whole = F.col("l_linestatus") == "O"
    row = F.when(whole, row_of(RWY_END_ID=s(F.col("l_partkey")))).otherwise(row_of(RWY_END_ID=s(F.col("l_partkey")), G_S_ANGLE=s(F.col("l_quantity").cast("int"))))
    rows = li.select(s(F.col("l_suppkey")).alias("e"), kind.alias("k"), F.when(whole, "ILS_BASE").otherwise("ILS_GS").alias("f"), F.to_json(row).alias("j")).distinct()
    records = collapse.event(rows, entity=F.col("e"), source=F.col("f"), kind=F.col("k"), priority=F.lit("fyi"), row=F.from_json("j", "map<string,string>"))
    events, _ = collapse.whole_and_parts(records)
    return events.select("entity", "kind", "summary", F.size("folded").cast("bigint").alias("parts"))


# --- C-9 --------------------------------------------------------------------------------------
@query("""
WITH f AS (SELECT DISTINCT l_suppkey AS e, s_nationkey AS c, CASE l_returnflag WHEN 'R' THEN 'removed' ELSE 'added' END AS kind, 'SITE ' || l_linenumber AS site, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS freq FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
s AS (SELECT e, c, kind, 'Site' || substr(site, 5) || ' RCAG ' || string_agg(freq, ', ' ORDER BY freq) AS said FROM f GROUP BY e, c, kind, site),
g AS (SELECT e, c, coalesce(string_agg(said, ' and ' ORDER BY said) FILTER (kind = 'removed'), '') AS gone, coalesce(string_agg(said, ' and ' ORDER BY said) FILTER (kind = 'added'), '') AS come FROM s GROUP BY ALL)
SELECT CAST(e AS VARCHAR) AS entity, CASE WHEN gone <> '' AND come <> '' THEN 'changed' WHEN come <> '' THEN 'added' ELSE 'removed' END AS kind,
 CASE WHEN gone <> '' AND come <> '' THEN 'center (ARTCC ' || c || ') frequencies: ' || gone || ' -> ' || come WHEN come <> '' THEN 'new center (ARTCC ' || c || ') frequencies: ' || come ELSE 'center (ARTCC ' || c || ') frequencies discontinued: ' || gone END || '; RCAG' AS summary FROM g""")
def centre_sites(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    row = row_of(FACILITY_TYPE="RCAG", ARTCC_OR_FSS_ID=s(F.col("s_nationkey")), FACILITY=F.concat(F.lit("SITE "), s(F.col("l_linenumber"))), FREQ=s(F.col("l_quantity").cast("int")))
    kind = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    records = collapse.event(li, entity=s(F.col("l_suppkey")), source=F.lit("FRQ"), kind=kind, priority=F.lit("action"), row=row)
    events, _ = collapse.site_groups(records)
    return events.select("entity", "kind", "summary")


# --- C-12 -------------------------------------------------------------------------------------
@query("""
WITH f AS (SELECT DISTINCT l_suppkey AS e, 'F' || l_linenumber AS freq, 'P' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS p FROM lineitem),
n AS (SELECT e, freq, list_sort(list(p)) AS ps FROM f GROUP BY ALL),
t AS (SELECT e, freq || ' for ' || CASE WHEN len(ps) = 1 THEN ps[1] ELSE array_to_string(ps[1:len(ps) - 1], ', ') || ' and ' || ps[len(ps)] END AS part FROM n)
SELECT CAST(e AS VARCHAR) AS entity, 'frequencies now also listed for arrivals (STARs): ' || string_agg(part, '; ' ORDER BY part) AS summary FROM t GROUP BY e""")
def procedure_listings(spark, sf):
    li = table(spark, sf, "lineitem")
    row = row_of(FREQ=F.concat(F.lit("F"), s(F.col("l_linenumber"))), FREQ_USE=F.concat(F.lit("P"), s(F.col("l_quantity").cast("int")), F.lit(" STAR")))
    records = collapse.event(li, entity=s(F.col("l_suppkey")), source=F.lit("FRQ"), kind=F.lit("added"), priority=F.lit("fyi"), row=row)
    events, _ = collapse.listings(records)
    return events.select("entity", "summary")


# --- C-13 -------------------------------------------------------------------------------------
@query("""
WITH r AS (SELECT l_suppkey AS e, 'P' || chr(CAST(64 + l_linenumber AS INTEGER)) AS stem, 'P' || chr(CAST(64 + l_linenumber AS INTEGER)) || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS name, bool_or(l_returnflag <> 'R') AS live FROM lineitem GROUP BY ALL),
w AS (SELECT e, stem, min(name) AS was FROM r WHERE NOT live GROUP BY ALL),
l AS (SELECT r.e, name, CASE WHEN was IS NULL THEN name ELSE was || ' -> ' || name END AS label FROM r LEFT JOIN w ON w.e = r.e AND w.stem = r.stem WHERE live),
d AS (SELECT e, string_agg(name, ', ' ORDER BY name) AS gone FROM r WHERE NOT live AND NOT EXISTS (SELECT 1 FROM r x WHERE x.e = r.e AND x.stem = r.stem AND x.live) GROUP BY e),
u AS (SELECT e, string_agg(label, ', ' ORDER BY name) AS labels FROM l GROUP BY e)
SELECT CAST(coalesce(u.e, d.e) AS VARCHAR) AS entity, 'arrival/departure procedures new or updated: ' || coalesce(labels, 'none') || coalesce('; removed: ' || gone, '') AS summary FROM u FULL JOIN d ON u.e = d.e""")
def procedure_rollup(spark, sf):
    """Lines as procedure rows: the slot is the stem, the quantity the version."""
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("P"), F.chr(F.col("l_linenumber") + 64), s(F.col("l_quantity").cast("int")))
    kind = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    records = collapse.event(li, entity=s(F.col("l_suppkey")), source=F.lit("STAR_RTE"), kind=kind, priority=F.lit("fyi"), row=row_of(STAR_COMPUTER_CODE=F.concat(F.lit("FIX."), name)))
    events, _ = collapse.procedures(records)
    return events.select("entity", "summary")


# --- F-9 --------------------------------------------------------------------------------------
@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS entity, f.field, CASE WHEN s_acctbal < 0 THEN v ELSE '' END AS old, CASE WHEN s_acctbal < 0 THEN '' ELSE v END AS new
FROM (SELECT s_suppkey, s_acctbal, unnest([{'field': 'NAME', 'v': s_name}, {'field': 'NATION', 'v': CAST(s_nationkey AS VARCHAR)}]) AS f FROM supplier) x, LATERAL (SELECT f.v AS v)""")
def whole_row_fields(spark, sf):
    sup = table(spark, sf, "supplier")
    kind = F.when(F.col("s_acctbal") < 0, "removed").otherwise("added")
    f = F.explode(ids.row_fields(kind, row_of(NAME=F.col("s_name"), NATION=s(F.col("s_nationkey")), _NEAR="1")))
    return sup.select(s(F.col("s_suppkey")).alias("entity"), f.alias("f")).select("entity", "f.*")


# --- F-12, F-13 -------------------------------------------------------------------------------
@query("""
WITH u(code, say) AS (VALUES ('O', 'approach/departure, primary (APCH/P DEP/P)'), ('F', 'tower (local control) (LCL)'), ('P', 'OTHER'))
SELECT CAST(o_orderkey AS VARCHAR) AS entity, 'frequency ' || o_custkey || ' use: ' || say || ' -> none; declared distances: landing distance available (LDA) ' || format('{:,}', CAST(trunc(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) AS BIGINT)) || ' ft -> none' AS line
FROM orders JOIN u ON code = o_orderstatus""")
def edit_wording(spark, sf):
    st = F.col("o_orderstatus")
    use = F.when(st == "O", "APCH/P DEP/P").when(st == "F", "LCL").otherwise("OTHER")
    f = lambda c, o: F.struct(F.lit(c).alias("field"), o.alias("old"), F.lit("").alias("new"))
    fields = F.array(f("FREQ_USE", use), f("LNDG_DIST_AVBL", money("o_totalprice")))
    phrases = W.edit_phrases(F.lit("FRQ"), fields, row_of(FREQ=s(F.col("o_custkey"))))
    return table(spark, sf, "orders").select(s(F.col("o_orderkey")).alias("entity"), F.array_join(phrases, "; ").alias("line"))


# --- F-14, F-15 -------------------------------------------------------------------------------
@query("""
SELECT p_type AS type, CASE p_type WHEN 'ECONOMY' THEN 'new runway ' || p_size || ': ' || p_size || 'x' || p_size || ' ft turf' WHEN 'SMALL' THEN 'new weather station: AWOS-' || p_size WHEN 'LARGE' THEN 'new radar: ASR, hours ' || p_size
   WHEN 'MEDIUM' THEN 'new navaid: N' || p_size || ' VORTAC (' || p_size || ')' WHEN 'PROMO' THEN 'ATC service listed: S' || p_size ELSE 'new ATIS' || CASE WHEN p_size = 1 THEN '' ELSE ' ' || p_size END || ' (hours 0700)' END AS line, count(*) AS n FROM part GROUP BY ALL""")
def row_templates(spark, sf):
    p = table(spark, sf, "part")
    t, n = F.col("p_type"), s(F.col("p_size"))
    source = F.when(t == "ECONOMY", "APT_RWY").when(t == "SMALL", "AWOS").when(t == "LARGE", "RDR").when(t == "MEDIUM", "NAV_BASE").when(t == "PROMO", "ATC_SVC").otherwise("ATC_ATIS")
    row = row_of(
        RWY_ID=n, RWY_LEN=n, RWY_WIDTH=n, SURFACE_TYPE_CODE="TURF", ASOS_AWOS_TYPE=F.concat(F.lit("AWOS-"), n), RADAR_TYPE="ASR", RADAR_HRS=n, NAV_ID=F.concat(F.lit("N"), n), NAV_TYPE="VORTAC", FREQ=n,
        CTL_SVC=F.concat(F.lit("S"), n), ATIS_NO=F.concat(n), ATIS_HRS="0700",
    )
    line = W.row_summary(source, F.lit("added"), F.lit("action"), row)
    return p.groupBy(t.alias("type"), line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


# --- D-14 -------------------------------------------------------------------------------------
@query("""
WITH o AS (SELECT DISTINCT o_custkey AS doc, year(o_orderdate) * 100 + month(o_orderdate) AS alt FROM orders WHERE o_orderstatus = 'O'), n AS (SELECT DISTINCT o_custkey AS doc, year(o_orderdate) * 100 + month(o_orderdate) AS alt FROM orders WHERE o_orderstatus <> 'O'),
r AS (SELECT doc FROM o INTERSECT SELECT doc FROM n), g AS (SELECT * FROM o EXCEPT SELECT * FROM n), c AS (SELECT * FROM n EXCEPT SELECT * FROM o),
near AS (SELECT g.doc, g.alt AS g, c.alt AS c FROM g JOIN c ON g.doc = c.doc AND abs(g.alt - c.alt) <= 200),
p AS (SELECT doc, g, c FROM (SELECT *, count(*) OVER (PARTITION BY doc, g) AS ng, count(*) OVER (PARTITION BY doc, c) AS nc FROM near) WHERE ng = 1 AND nc = 1),
m AS (SELECT doc, count(*) AS moves FROM (SELECT doc FROM g UNION ALL SELECT doc FROM c) GROUP BY doc), q AS (SELECT doc, count(*) AS paired FROM p GROUP BY doc)
SELECT p.doc, CAST(g AS VARCHAR) AS old, CAST(c AS VARCHAR) AS new FROM p JOIN m USING (doc) JOIN q USING (doc) WHERE moves = 2 * paired AND p.doc IN (SELECT doc FROM r)""")
def minimum_moves(spark, sf):
    """Order months of a customer as minimums of two editions: all must pair within a step."""
    o = table(spark, sf, "orders")
    alt = s(F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    none = F.lit(None).cast("string")
    side = lambda which: o.filter(which).select(F.col("o_custkey").alias("doc"), alt.alias("alt"), none.alias("rvr"), none.alias("vis")).distinct()
    seen = o.filter("false").select(F.col("o_custkey").alias("doc"), alt.alias("value"))
    return charts.minimum_changes(side("o_orderstatus = 'O'"), side("o_orderstatus <> 'O'"), seen, seen).select("doc", "old", "new")


# --- A-5, T-11, T-12 --------------------------------------------------------------------------
@query("""
WITH t AS (SELECT text, bool_or(lang = 'en') AS plain FROM documents GROUP BY text)
SELECT count(*) AS texts, count(*) FILTER (plain) AS translated, count(*) FILTER (NOT plain) AS fallback FROM t""")
def translation_totals(spark, sf):
    d = table(spark, sf, "documents")
    plain = F.when(F.col("lang") == "en", F.concat("text", F.lit("."))).when(F.col("lang") == "de", F.col("text"))
    return glossary.translation_totals(d.select(F.col("text").alias("original"), plain.alias("plain")))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'Kept as written until it is translated.' WHEN 'fr' THEN 'Kept as written: no verified meaning for ' || upper(source) || '.'
  ELSE 'Kept as written: the plain version did not pass the checks.' END AS reason FROM documents""")
def untranslated_reasons(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    lang, none = F.col("lang"), F.array().cast("array<string>")
    plain = F.when(lang == "en", F.concat("text", F.lit("!"))).when(lang.isin("de"), F.lit(None).cast("string")).when(lang == "fr", F.col("text"))
    why = F.when(lang.isin("en", "de", "fr"), none).otherwise(F.array(F.lit("lost number 7")))
    return d.select("doc_id", TR.reason_line(F.col("text"), plain, why, F.when(lang == "fr", F.array(F.upper("source"))).otherwise(none)).alias("reason"))


# --- Q-5 --------------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
c AS (SELECT DISTINCT cycle AS a, cycle + 28 AS b FROM log), e AS (SELECT 'error' AS level, 'old cycle is off schedule' AS reason FROM c WHERE datediff('day', DATE '2024-01-01', a) % 28 <> 0
  UNION ALL SELECT 'error', 'new cycle is off schedule' FROM c WHERE datediff('day', DATE '2024-01-01', a) % 28 <> 0)
SELECT level, reason, count(*) AS n FROM e GROUP BY ALL""")
def gate_precedence(spark, sf):
    """Failed cycle checks silence every other gate."""
    log = change_log(spark, sf)
    pairs = log.select(F.col("cycle").alias("from_cycle"), F.date_add("cycle", 28).alias("to_cycle")).distinct()
    cycle = quality.cycle_gate(pairs, F.lit("2030-01-01").cast("date"), anchor="2024-01-01")
    volume = quality.volume_gate(log, quality.past_action_counts(log, F.lit(CURRENT).cast("date")), min_entities=500)
    return quality.combine_gates(cycle, volume).groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- Q-9 --------------------------------------------------------------------------------------
@query("""
SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN url LIKE 'http://%' THEN 'missing' WHEN html LIKE '%lang="fr"%' THEN 'digest differs' ELSE 'url differs' END AS problem FROM pages WHERE url LIKE 'http://%' OR html LIKE '%lang="fr"%' OR url LIKE '%?%'""")
def file_provenance(spark, sf):
    p = table(spark, sf, "pages").withColumn("path", s(F.col("page_id")))
    wrong = F.when(F.contains("html", F.lit('lang="fr"')), "x").otherwise("")
    manifest = p.select("path", F.sha2(F.concat("html", wrong), 256).alias("sha256"), F.substring_index("url", "?", 1).alias("url"))
    actual = p.filter(~F.col("url").startswith("http://")).select("path", F.sha2("html", 256).alias("sha256"), "url")
    return quality.provenance(manifest, actual)


# --- K-3, K-7, X-5 ----------------------------------------------------------------------------
@query(f"""{LOG_SQL}
SELECT '2024-01-01' AS from_cycle, '2024-01-29' AS to_cycle, false AS upcoming, count(DISTINCT entity) AS changed FROM log""")
def cycle_metadata(spark, sf):
    m = outputs.cycle_meta(change_log(spark, sf), "2024-01-01", CURRENT, F.lit("2024-01-29 09:01:00").cast("timestamp"), "1.0.0", True, False)
    return m.select("from_cycle", "to_cycle", "upcoming", "changed")


@query(f"""{LOG_SQL},
b AS (SELECT entity FROM log GROUP BY entity ORDER BY count(*) FILTER (priority = 'action') DESC, count(*) DESC, entity LIMIT 24), w AS (SELECT c_custkey AS entity FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT entity, id, CASE WHEN entity IN (SELECT entity FROM b) THEN 'warning: busy' ELSE '' END AS findings FROM log WHERE priority <> 'fyi' AND (entity IN (SELECT entity FROM b) OR entity IN (SELECT entity FROM w))""")
def review_packet(spark, sf):
    from tidemark.operators.views import busiest

    log = change_log(spark, sf)
    busy = busiest(log).select("entity")
    watched = nation_lists(spark, sf).filter(F.col("slug") == "BUILDING")
    notes = busy.withColumns({"level": F.lit("warning"), "reason": F.lit("busy")})
    out = outputs.review_packet(log, watched, busy, notes)
    return out.select("entity", "id", F.coalesce(F.array_join("findings", ", "), F.lit("")).alias("findings"))


@query(f"""{LOG_SQL},
p AS (SELECT entity, cycle, count(*) FILTER (priority = 'action') AS a, count(*) AS n FROM log GROUP BY ALL),
r AS (SELECT c_nationkey AS reader, c_custkey AS entity, CASE WHEN c_acctbal > 3000 THEN 'action' ELSE 'any' END AS mode, c_mktsegment = 'BUILDING' AS home FROM customer)
SELECT reader, CAST(cycle AS VARCHAR) AS cycle, count(*) AS entities, CAST(sum(a) AS BIGINT) AS actions, CAST(sum(n) AS BIGINT) AS total FROM r JOIN p USING (entity) WHERE mode = 'any' OR a > 0 OR home GROUP BY ALL""")
def reader_notifications(spark, sf):
    c = table(spark, sf, "customer")
    readers = c.select(F.col("c_nationkey").alias("reader"), F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 3000, "action").otherwise("any").alias("mode"), (F.col("c_mktsegment") == "BUILDING").alias("home"))
    return streaming.notifications(change_log(spark, sf), readers).withColumn("cycle", s(F.col("cycle")))


# --- F-20 -------------------------------------------------------------------------------------
@query("""
WITH l AS (SELECT o_orderkey, strftime(o_orderdate, '%y%m') AS e FROM orders)
SELECT o_orderkey AS order_no, e >= '9807' AS current FROM l""")
def current_charts(spark, sf):
    link = F.concat(F.lit(charts.CHART_LINK), F.date_format("o_orderdate", "yyMM"), F.lit("/X.PDF"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_no"), cycles.is_current_chart(link, F.lit("9807")).alias("current"))


# --- T-3 --------------------------------------------------------------------------------------
@query("""
WITH p AS (SELECT o_orderkey, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '00' AS a, lpad(CAST(12 + month(o_orderdate) AS VARCHAR), 2, '0') || '00' AS b, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey AS order_no, s <> 'P' AND p <> '2-HIGH' AS same FROM p""")
def same_schedules(spark, sf):
    """Hours texts in two spellings; a closing word or another day is a change."""
    h = lambda k: F.concat(F.lpad(s(F.month("o_orderdate") + k), 2, "0"), F.lit("00"))
    span = F.concat_ws("-", h(0), h(12))
    old = F.concat(F.lit("OPR "), span, F.lit(" MON-FRI, CLSD WEEKENDS"))
    st, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    days = F.when(p == "2-HIGH", "MON-THU").otherwise("WEEKDAYS")
    new = F.concat(span, F.lit(" "), days, F.when(st == "P", "; CLSD SAT").otherwise("; CLSD SAT-SUN"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_no"), T.same_schedule(old, new).alias("same"))
