"""Event building, charts, printed numbers and history over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import charts, collapse, diff, history
from workload.core import order_changes, query_set
from workload.pairs import AGED_OUT, ARRIVED, ORDERS_SQL, orders_pair, table
from workload.views import LOG_SQL, change_log

QUERIES, ORACLES, query = query_set()


# --- D-10 -------------------------------------------------------------------------------------
@query(f"""
WITH o AS (SELECT DISTINCT l_orderkey AS name, l_partkey AS member FROM lineitem WHERE l_shipdate < TIMESTAMP '{ARRIVED} 00:00:00'),
n AS (SELECT DISTINCT l_orderkey AS name, CASE WHEN l_returnflag = 'R' THEN l_partkey + 1 ELSE l_partkey END AS member FROM lineitem WHERE l_shipdate >= TIMESTAMP '{AGED_OUT} 00:00:00')
SELECT name, member, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o)
UNION ALL SELECT name, member, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def set_version_diff(spark, sf):
    li = table(spark, sf, "lineitem")
    ts = lambda d: F.lit(d).cast("timestamp_ntz")
    old = li.filter(F.col("l_shipdate") < ts(ARRIVED)).select("l_orderkey", "l_partkey")
    part = F.when(F.col("l_returnflag") == "R", F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    new = li.filter(F.col("l_shipdate") >= ts(AGED_OUT)).select("l_orderkey", part.alias("l_partkey"))
    return diff.set_members_diff(old, new, "l_orderkey", "l_partkey")


# --- D-8 --------------------------------------------------------------------------------------
@query(f"""
WITH {ORDERS_SQL},
r AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS order_no, priority, status, CAST(total AS VARCHAR) AS total FROM (
   SELECT o_custkey, o_orderkey, status, priority, total, ordered FROM o_old EXCEPT SELECT o_custkey, o_orderkey, status, priority, total, ordered FROM o_new))
SELECT entity, order_no, priority FROM r WHERE EXISTS (SELECT 1 FROM o_new n WHERE CAST(n.o_custkey AS VARCHAR) = r.entity AND n.priority = r.priority)""")
def lost_use(spark, sf):
    """Removed rows whose priority the customer still has on another order."""
    from workload.pairs import order_rows

    old, new = orders_pair(spark, sf)
    o, n = order_rows(old), order_rows(new)
    removed = diff.set_difference(o, n).filter(F.col("side") == "removed").select("file", "entity", F.map_from_entries("items").alias("row"))
    out = diff.still_used(removed, n, "ORDERS", "PRIORITY")
    return out.select("entity", F.col("row")["ORDER_NO"].alias("order_no"), F.col("row")["PRIORITY"].alias("priority"))


# --- D-9 --------------------------------------------------------------------------------------
@query(f"""
WITH p AS (SELECT user_id AS entity, CASE WHEN event_type = 'error' THEN 'ALL' ELSE upper(event_type) END AS a, strftime(ts, '%H00') AS b, hour(ts) AS seq, ts FROM events),
d AS (SELECT entity, seq, CASE WHEN a = 'ALL' THEN b ELSE a || ' ' || b END AS part, ts < TIMESTAMP '2024-01-16 00:00:00' AS o FROM p),
m AS (SELECT entity, o, part, min(seq) AS seq FROM d GROUP BY ALL),
t AS (SELECT entity, o, string_agg(part, '; ' ORDER BY seq, part) AS text FROM m GROUP BY ALL)
SELECT coalesce(x.entity, y.entity) AS entity, coalesce(x.text, '') AS old, coalesce(y.text, '') AS new,
  CASE WHEN x.text IS NULL THEN 'added' WHEN y.text IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM (SELECT * FROM t WHERE o) x FULL JOIN (SELECT * FROM t WHERE NOT o) y USING (entity) WHERE x.text IS DISTINCT FROM y.text""")
def schedule_diff(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        "user_id", F.hour("ts").alias("seq"), F.when(F.col("event_type") == "error", "ALL").otherwise(F.upper("event_type")).alias("what"),
        F.date_format("ts", "HH00").alias("at"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("o"),
    )
    texts = lambda df: diff.schedule_texts(df, "user_id", "seq", ("what", "at"))
    return diff.schedule_diff(texts(rows.filter("o")), texts(rows.filter("not o"))).select("entity", "kind", "old", "new")


# --- C-6 --------------------------------------------------------------------------------------
@query(f"""
WITH o AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R')
SELECT CAST(s AS VARCHAR) AS entity, 'PART ' || p AS remark FROM o WHERE (s, p) IN (SELECT s, p FROM n)
UNION ALL SELECT CAST(s AS VARCHAR), 'PART ' || p FROM n WHERE (s, p) IN (SELECT s, p FROM o)""")
def refiled_text(spark, sf):
    """Texts both removed (returned) and added (any other line) at a supplier say nothing."""
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    r = li.select(F.col("l_suppkey").cast("string").alias("entity"), kind.alias("kind"), F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("t")).distinct()
    records = collapse.event(r, entity=F.col("entity"), source=F.lit("APT_RMK"), kind=F.col("kind"), priority=F.lit("fyi"), row=F.create_map(F.lit("REMARK"), F.col("t")))
    gone = collapse.refiled(records)
    return records.join(gone, "rid", "left_semi").select("entity", F.col("row")["REMARK"].alias("remark"))


# --- C-7 --------------------------------------------------------------------------------------
@query("""
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, c_name AS old, CASE WHEN c_mktsegment = 'FURNITURE' THEN c_name || ' LTD' ELSE c_name END AS new FROM customer),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s FROM orders),
f AS (SELECT entity, k, 'FACILITY_NAME' AS field FROM o JOIN c USING (entity) WHERE c.old <> c.new AND s = 'O'
      UNION ALL SELECT entity, k, 'TWR_HRS' FROM o)
SELECT entity, k, field FROM f WHERE field <> 'FACILITY_NAME' OR NOT EXISTS (SELECT 1 FROM c WHERE c.entity = f.entity AND c.old <> c.new)""")
def echo_removal(spark, sf):
    """A customer's new name is told once; orders that repeat it lose that edit."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity"), F.col("c_name").alias("old"), F.when(F.col("c_mktsegment") == "FURNITURE", F.concat("c_name", F.lit(" LTD"))).otherwise(F.col("c_name")).alias("new"))
    edit = lambda f, o, n: F.struct(F.lit(f).alias("field"), o.alias("old"), n.alias("new"))
    base = collapse.event(c.filter("old <> new"), entity=F.col("entity"), source=F.lit("APT_BASE"), kind=F.lit("changed"), priority=F.lit("fyi"), fields=F.array(edit("ARPT_NAME", F.col("old"), F.col("new"))))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"))
    j = o.join(c, "entity", "left")
    named = F.when((F.col("s") == "O") & (F.col("old") != F.col("new")), F.array(edit("FACILITY_NAME", F.col("old"), F.col("new")))).otherwise(F.array().cast(collapse.FIELD))
    rows = collapse.event(j, entity=F.col("entity"), source=F.lit("ATC_BASE"), kind=F.lit("changed"), priority=F.lit("fyi"), key=F.col("k"), fields=F.concat(named, F.array(edit("TWR_HRS", F.lit("1"), F.lit("2")))))
    out = collapse.echo_removed(base.unionByName(rows)).filter(F.col("source") == "ATC_BASE")
    return out.select("entity", F.col("key").alias("k"), F.explode("fields").alias("f")).select("entity", "k", "f.field")


# --- C-11 -------------------------------------------------------------------------------------
@query(f"""
WITH lost AS (SELECT o_custkey AS entity, o_orderpriority AS use, o_orderkey AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'),
gained AS (SELECT o_custkey AS entity, o_orderpriority AS use, o_orderkey AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'),
l AS (SELECT entity, use, min(v) AS old FROM lost GROUP BY ALL HAVING count(*) = 1), g AS (SELECT entity, use, min(v) AS new FROM gained GROUP BY ALL HAVING count(*) = 1)
SELECT entity, use, old, new FROM l JOIN g USING (entity, use)""")
def moved_attribute(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("use"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("rid"), F.lit("fyi").alias("priority"), "o_orderdate")
    ts = lambda d: F.lit(d).cast("timestamp_ntz")
    out = collapse.moved_once(o.filter(F.col("o_orderdate") < ts("1998-01-01")), o.filter(F.col("o_orderdate") >= ts("1998-01-01")), ["entity", "use"])
    return out.select("entity", "use", F.col("old_value").alias("old"), F.col("new_value").alias("new"))


# --- C-14 -------------------------------------------------------------------------------------
@query(f"""
WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, CASE WHEN l_returnflag = 'N' THEN 'added' ELSE 'removed' END AS kind, 'S' || l_suppkey AS orig, 'L' || l_linenumber AS dest,
    'Q' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS string, l_returnflag AS area, l_linestatus AS altitude FROM lineitem),
p AS (SELECT *, count(*) OVER w AS copies, min(area) OVER w <> max(area) OVER w AS da, min(altitude) OVER w <> max(altitude) OVER w AS dl FROM r WINDOW w AS (PARTITION BY entity, kind, orig, dest, string)),
t AS (SELECT *, CASE WHEN copies > 1 THEN CASE WHEN da AND dl THEN ' [area ' || area || ', altitude ' || altitude || ']' WHEN da THEN ' [area ' || area || ']' WHEN dl THEN ' [altitude ' || altitude || ']' ELSE '' END ELSE '' END AS tag FROM p),
l AS (SELECT entity, CASE WHEN kind = 'added' THEN 'new preferred IFR route ' || orig || ' -> ' || dest || tag || ': ' || string
   ELSE 'preferred IFR route ' || orig || ' -> ' || dest || tag || ' via ' || string || ': discontinued' END AS line FROM t)
SELECT entity, line || CASE WHEN count(*) > 1 THEN ' (listed ' || count(*) || ' times)' ELSE '' END AS line FROM l GROUP BY entity, l.line""")
def route_rollup(spark, sf):
    li = table(spark, sf, "lineitem")
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    row = F.create_map(
        F.lit("Orig"), s("S", F.col("l_suppkey")), F.lit("Dest"), s("L", F.col("l_linenumber")), F.lit("Route String"), s("Q", F.col("l_quantity").cast("int")),
        F.lit("Area"), F.col("l_returnflag"), F.lit("Altitude"), F.col("l_linestatus"),
    )
    kind = F.when(F.col("l_returnflag") == "N", "added").otherwise("removed")
    records = collapse.event(li, entity=F.col("l_suppkey").cast("string"), source=F.lit("PFR_RMT_FMT"), kind=kind, priority=F.lit("fyi"), row=row)
    return collapse.route_lines(records)


# --- C-15 -------------------------------------------------------------------------------------
@query("""
WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, 'F' || l_linenumber AS freq, 'P' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS o, l_returnflag AS n FROM lineitem)
SELECT entity, freq, string_agg(DISTINCT o, ', ' ORDER BY o) AS old, string_agg(DISTINCT n, ', ' ORDER BY n) AS new FROM m GROUP BY ALL HAVING count(*) > 1""")
def merged_uses(spark, sf):
    li = table(spark, sf, "lineitem")
    edit = F.array(F.struct(F.lit("FREQ_USE").alias("field"), F.concat(F.lit("P"), F.col("l_quantity").cast("int").cast("string")).alias("old"), F.col("l_returnflag").alias("new")))
    ctx = F.create_map(F.lit("FREQ"), F.concat(F.lit("F"), F.col("l_linenumber").cast("string")))
    records = collapse.event(li, entity=F.col("l_suppkey").cast("string"), source=F.lit("FRQ"), kind=F.lit("changed"), priority=F.lit("fyi"), fields=edit, context=ctx)
    events, _ = collapse.merged_uses(records)
    return events.select("entity", F.col("context")["FREQ"].alias("freq"), F.col("fields")[0]["old"].alias("old"), F.col("fields")[0]["new"].alias("new"))


# --- C-16 -------------------------------------------------------------------------------------
@query("""
WITH p AS (SELECT l_orderkey AS entity, l_suppkey AS chart, CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'N' THEN 'C' ELSE 'A' END AS act, l_linenumber = 1 AS first,
  l_linenumber * 1000000 + l_partkey AS pos, 'AMDT ' || l_partkey AS amdt, 'P' || l_partkey || '.PDF' AS pdf FROM lineitem),
s AS (SELECT *, CASE WHEN first THEN 0 ELSE 1 END * 1000000000 + pos AS ord FROM p)
SELECT entity, chart, CASE WHEN bool_and(act = 'A') THEN 'added' WHEN bool_and(act = 'D') THEN 'removed' ELSE 'changed' END AS verb,
  arg_min(amdt, ord) AS amdt, coalesce(arg_min(pdf, ord) FILTER (act <> 'D'), '') AS pdf FROM s GROUP BY ALL""")
def page_action_fold(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    part = F.col("l_partkey").cast("string")
    pages = li.select(
        F.col("l_orderkey").alias("entity"), F.col("l_suppkey").alias("chart"), F.when(flag == "R", "D").when(flag == "N", "C").otherwise("A").alias("act"),
        (F.col("l_linenumber") == 1).alias("first"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("AMDT "), part).alias("amdt"), F.lit("").alias("amdt_date"), F.concat(F.lit("P"), part, F.lit(".PDF")).alias("pdf"),
    )
    return charts.fold_pages(pages, ["entity", "chart"]).select("entity", "chart", "verb", "amdt", "pdf")


# --- J-10, R-5 --------------------------------------------------------------------------------
@query()
def chart_change_records(spark, sf):
    """Lines as chart pages: supplier = entity, part size = chart; shared procuids link renames."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("l_returnflag")
    log = li.select(
        F.col("l_suppkey").cast("string").alias("entity"), F.when(F.col("p_type") == "ECONOMY", "IAP").when(F.col("p_type") == "SMALL", "APD").otherwise("STAR").alias("chart_code"),
        F.concat("p_brand", F.when(F.col("l_linenumber") > 1, F.concat(F.lit(", CONT."), F.col("l_linenumber").cast("string"))).otherwise("")).alias("chart_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(flag == "R", "D").when(flag == "N", "C").otherwise("A").alias("useraction"),
        F.col("p_size").cast("string").alias("amdtnum"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("amdtdate"), F.concat(F.col("p_partkey").cast("string"), F.lit(".PDF")).alias("pdf_name"), F.col("p_size").cast("string").alias("procuid"),
    )
    return charts.chart_records(log, "0106", F.lit("2001-06-07").cast("date")).select("entity", "kind", "priority", "summary", "link")


# --- T-15, D-12, D-13 -------------------------------------------------------------------------
@query(r"""
WITH w AS (SELECT source AS doc, doc_id < (SELECT max(doc_id) FROM documents) / 2 AS o, unnest(regexp_extract_all(text, '(?:^|[^0-9])([0-9]{2,3})(?:[^0-9])', 1)) AS value FROM documents),
c AS (SELECT doc, value, count(*) FILTER (o) AS a, count(*) FILTER (NOT o) AS b FROM w GROUP BY ALL)
SELECT doc, value, CASE WHEN a > b THEN 'gone' ELSE 'come' END AS change FROM c WHERE a <> b""")
def text_number_diff(spark, sf):
    """Numbers the first half of a source's documents print against the second half."""
    d = table(spark, sf, "documents")
    half = d.agg((F.max("doc_id") / 2).alias("h")).scalar()
    read = lambda df: charts.number_counts(df, "source", "text", r"(?:^|[^0-9])([0-9]{2,3})(?:[^0-9])", None)
    return charts.count_changes(read(d.filter(F.col("doc_id") < half)), read(d.filter(F.col("doc_id") >= half)))


@query("""
WITH w AS (SELECT o_custkey AS doc, o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS o, CAST(dayofyear(o_orderdate) AS VARCHAR) AS value FROM orders),
c AS (SELECT doc, value, CASE WHEN count(*) FILTER (o) > count(*) FILTER (NOT o) THEN 'gone' ELSE 'come' END AS change FROM w GROUP BY ALL HAVING count(*) FILTER (o) <> count(*) FILTER (NOT o)),
near AS (SELECT g.doc, g.value AS g, c.value AS c FROM c g JOIN c ON g.doc = c.doc AND g.change = 'gone' AND c.change = 'come' AND g.value <> c.value
   AND abs(CAST(g.value AS DOUBLE) - CAST(c.value AS DOUBLE)) <= 12),
p AS (SELECT doc, g, c FROM (SELECT *, count(*) OVER (PARTITION BY doc, g) AS ng, count(*) OVER (PARTITION BY doc, c) AS nc FROM near) WHERE ng = 1 AND nc = 1),
k AS (SELECT t.doc FROM (SELECT doc, count(*) AS moves FROM c GROUP BY doc) t JOIN (SELECT doc, count(*) AS paired FROM p GROUP BY doc) q USING (doc) WHERE moves - 2 * paired <= 2 * paired)
SELECT doc, g AS old, c AS new FROM p WHERE doc IN (SELECT doc FROM k)""")
def near_number_pairs(spark, sf):
    """Order days that went and came per customer, each other's only neighbour within 12."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.dayofyear("o_orderdate").cast("string").alias("value"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("o"))
    read = lambda df: df.groupBy("doc", "value").agg(F.count(F.lit(1)).alias("n"))
    changes = charts.count_changes(read(o.filter("o")), read(o.filter("not o")))
    return charts.mutual_pairs(changes, lambda a, b: F.abs(a.cast("double") - b.cast("double")), 12, give_up=2)


# --- F-10 -------------------------------------------------------------------------------------
@query(f"""
WITH {ORDERS_SQL},
m(code, say) AS (VALUES ('O', 'open (O)'), ('F', 'filled (F)'), ('P', 'P'))
SELECT CAST(n.o_orderkey AS VARCHAR) AS order_no, 'status: ' || a.say || ' -> ' || b.say AS phrase
FROM o_old o JOIN o_new n USING (o_orderkey) JOIN m a ON a.code = o.status JOIN m b ON b.code = n.status WHERE o.status <> n.status
UNION ALL SELECT CAST(n.o_orderkey AS VARCHAR), 'total: ' || o.total || ' -> ' || n.total || ' USD' FROM o_old o JOIN o_new n USING (o_orderkey) WHERE abs(o.total - n.total) >= 1
UNION ALL SELECT CAST(n.o_orderkey AS VARCHAR), 'order priority: ' || o.priority || ' -> ' || n.priority FROM o_old o JOIN o_new n USING (o_orderkey) WHERE o.priority <> n.priority""")
def dictionary_decode(spark, sf):
    """Edits worded through a dictionary table (file, column, code, label, unit, kind)."""
    from tidemark.config.dictionary import DICTIONARY_SCHEMA
    from tidemark.operators.decode import decode_fields

    rows = [("", "STATUS", "", "status", "", "column"), ("", "STATUS", "O", "open", "", "code"), ("", "STATUS", "F", "filled", "", "code"), ("ORDERS", "TOTAL", "", "total", "USD", "column"), ("", "PRIORITY", "", "order priority", "", "column")]
    changes = order_changes(spark, sf).filter(F.col("kind") == "changed")
    fields = changes.select("source", F.col("new_row")["ORDER_NO"].alias("order_no"), F.explode("fields").alias("f")).select("source", "order_no", "f.*")
    return decode_fields(fields, spark.createDataFrame(rows, DICTIONARY_SCHEMA)).select("order_no", "phrase")


# --- K-4, K-5, D-15 ---------------------------------------------------------------------------
@query(f"""{LOG_SQL},
fresh AS (SELECT entity, cycle, 'fyi' AS priority, summary, id FROM log WHERE cycle >= DATE '2024-01-25' AND priority <> 'action'),
h AS (SELECT entity, cycle, priority, summary, id FROM log WHERE cycle NOT IN (SELECT cycle FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT CAST(cycle AS VARCHAR) AS cycle, entity, priority, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM h GROUP BY ALL""")
def history_upsert(spark, sf):
    log = change_log(spark, sf).select("entity", "cycle", "priority", "summary", "id")
    fresh = log.filter((F.col("cycle") >= F.lit("2024-01-25").cast("date")) & (F.col("priority") != "action")).withColumn("priority", F.lit("fyi"))
    out = history.upserted(log, fresh)
    return out.groupBy(F.col("cycle").cast("string").alias("cycle"), "entity", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(f"""{LOG_SQL}
SELECT entity, count(*) AS entries, CAST(min(cycle) AS VARCHAR) AS first_cycle, CAST(max(cycle) AS VARCHAR) AS last_cycle, count(*) FILTER (priority = 'action') AS action FROM log GROUP BY entity""")
def history_index(spark, sf):
    out = history.index(change_log(spark, sf))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_cycle", "last_cycle")})


@query(f"""{LOG_SQL},
pr AS (SELECT CASE WHEN priority = 'fyi' THEN id ELSE id + 1000000000 END AS id, entity, cycle, summary, priority || '!' AS priority FROM log WHERE priority <> 'ifr'),
k AS (SELECT entity, cycle, summary, arg_min(priority, id) AS priority FROM pr GROUP BY ALL)
SELECT log.id, coalesce(i.priority, k.priority, log.priority) AS priority, CASE WHEN i.id IS NOT NULL THEN 'id' WHEN k.entity IS NOT NULL THEN 'key' ELSE 'kept' END AS matched
FROM log LEFT JOIN pr i ON i.id = log.id LEFT JOIN k ON k.entity = log.entity AND k.cycle = log.cycle AND k.summary = log.summary""")
def history_rematch(spark, sf):
    log = change_log(spark, sf).select("entity", "cycle", "priority", "summary", "id")
    produced = log.filter(F.col("priority") != "ifr").withColumns(
        {"id": F.when(F.col("priority") == "fyi", F.col("id")).otherwise(F.col("id") + 1000000000), "priority": F.concat("priority", F.lit("!"))}
    )
    return history.rematch(log, produced, ["entity", "cycle", "summary"], ["priority"]).select("id", "priority", "matched")


# --- D-17 -------------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
e AS (SELECT entity, id, summary, priority FROM log WHERE priority <> 'ifr'), g AS (SELECT entity, id, summary, CASE WHEN summary LIKE 'view 1%' THEN 'ifr' ELSE priority END AS priority FROM log WHERE priority <> 'action')
SELECT coalesce(e.entity, g.entity) AS entity, coalesce(e.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'differs' END AS what
FROM e FULL JOIN g ON e.entity = g.entity AND e.id = g.id WHERE g.id IS NULL OR e.id IS NULL OR e.priority <> g.priority OR e.summary <> g.summary""")
def regression_diff(spark, sf):
    from tidemark.operators.quality import regression_diff as compare

    log = change_log(spark, sf)
    got = log.filter(F.col("priority") != "action").withColumn("priority", F.when(F.col("summary").startswith("view 1"), "ifr").otherwise(F.col("priority")))
    return compare(log.filter(F.col("priority") != "ifr"), got, ["summary", "priority"])
