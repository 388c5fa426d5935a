"""Difference, pairing, edits and ranking over the orders and lineitem snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config.rules import RuleSet
from tidemark.functions import ids
from tidemark.operators import diff, pairing, rank
from tidemark.plans import backfill, changes
from workload.pairs import AGED_OUT, ARRIVED, ORDER_RULES, ORDERS_SQL, order_rows, orders_pair, table



def query_set():
    """The registry of one theme module: (queries, oracles, decorator)."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return register

    return queries, oracles, query


QUERIES, ORACLES, query = query_set()


# --- D-1 ------------------------------------------------------------------------------------
@query(f"""
WITH {ORDERS_SQL},
o AS (SELECT DISTINCT * FROM o_old), n AS (SELECT DISTINCT * FROM o_new),
d AS (SELECT 'removed' AS side, * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
      UNION ALL SELECT 'added', * FROM (SELECT * FROM n EXCEPT SELECT * FROM o))
SELECT side, CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS order_no, status, priority,
       CAST(total AS VARCHAR) AS total, CAST(ordered AS VARCHAR) AS ordered
FROM d""")
def snapshot_set_diff(spark, sf):
    old, new = orders_pair(spark, sf)
    d = diff.set_difference(order_rows(old), order_rows(new))
    row = F.map_from_entries("items")
    return d.select(
        "side", "entity",
        *[row[c].alias(c.lower()) for c in ("ORDER_NO", "STATUS", "PRIORITY", "TOTAL", "ORDERED")],
    )


# --- D-1 over all pairs of snapshots ----------------------------------------------------------
FIRST_YEAR, LAST_YEAR = 1996, 2002


@query(f"""
WITH s AS (SELECT k AS cycle, o_custkey, o_orderkey, CASE WHEN year(o_orderdate) = k - 3 THEN 'OLD' ELSE o_orderpriority END AS priority
  FROM orders, range({FIRST_YEAR}, {LAST_YEAR + 1}) r(k) WHERE year(o_orderdate) BETWEEN k - 3 AND k - 1),
d AS (SELECT 'removed' AS side, cycle + 1 AS cycle, o_custkey, o_orderkey, priority FROM s a WHERE cycle < {LAST_YEAR}
        AND NOT EXISTS (SELECT 1 FROM s b WHERE b.cycle = a.cycle + 1 AND b.o_custkey = a.o_custkey AND b.o_orderkey = a.o_orderkey AND b.priority = a.priority)
      UNION ALL SELECT 'added', cycle, o_custkey, o_orderkey, priority FROM s a WHERE cycle > {FIRST_YEAR}
        AND NOT EXISTS (SELECT 1 FROM s b WHERE b.cycle = a.cycle - 1 AND b.o_custkey = a.o_custkey AND b.o_orderkey = a.o_orderkey AND b.priority = a.priority))
SELECT cycle, side, CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS order_no, priority FROM d""")
def backfill_differences(spark, sf):
    """Seven yearly snapshots of three years' orders each; an order's last year is told as OLD."""
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    s = o.withColumn("cycle", F.explode(F.sequence(F.col("year") + 1, F.col("year") + 3))).filter(F.col("cycle").between(FIRST_YEAR, LAST_YEAR))
    told = F.when(F.col("year") == F.col("cycle") - 3, "OLD").otherwise(F.col("o_orderpriority"))
    items = F.array(F.struct(F.lit("ORDER_NO").alias("key"), F.col("o_orderkey").cast("string").alias("value")), F.struct(F.lit("PRIORITY").alias("key"), told.alias("value")))
    rows = s.select("cycle", F.lit("ORDERS").alias("file"), F.col("o_custkey").cast("string").alias("entity"), items.alias("items"))
    row = F.map_from_entries("items")
    return backfill.all_differences(rows).select("cycle", "side", "entity", row["ORDER_NO"].alias("order_no"), row["PRIORITY"].alias("priority"))


# --- D-2: a line that only moved inside its order is no change --------------------------------
LINES_SQL = f"""
l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
             l_returnflag, l_shipdate FROM lineitem),
l_old AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber AS slot, qty, l_returnflag AS flag
          FROM l WHERE l_shipdate < TIMESTAMP '{ARRIVED} 00:00:00'),
l_new AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey,
                 CASE WHEN l_returnflag = 'N' THEN l_linenumber + 1 ELSE l_linenumber END AS slot,
                 CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN CAST(qty + 1 AS DECIMAL(18,2)) ELSE qty END AS qty,
                 l_returnflag AS flag
          FROM l WHERE l_shipdate >= TIMESTAMP '{AGED_OUT} 00:00:00')
"""

LINE_RULES = RuleSet(remark_files=("LINES",), slot_columns=("SLOT",))


def line_rows(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("qty", F.col("l_quantity").cast("decimal(18,2)"))
    flag, slot = F.col("l_returnflag"), F.col("l_linenumber")
    old = li.filter(F.col("l_shipdate") < F.lit(ARRIVED).cast("timestamp_ntz"))
    new = (
        li.filter(F.col("l_shipdate") >= F.lit(AGED_OUT).cast("timestamp_ntz"))
        .withColumn("qty", F.when((flag == "R") & (slot == 1), (F.col("qty") + 1).cast("decimal(18,2)")).otherwise(F.col("qty")))
        .withColumn("l_linenumber", F.when(flag == "N", slot + 1).otherwise(slot))
    )
    rows = lambda df: diff.snapshot(
        df, "LINES", F.col("l_orderkey"),
        {"PART": F.col("l_partkey"), "SUPPLIER": F.col("l_suppkey"), "SLOT": F.col("l_linenumber"), "QTY": F.col("qty"), "FLAG": F.col("l_returnflag")},
    )
    return rows(old), rows(new)


@query(f"""
WITH {LINES_SQL},
r AS (SELECT * FROM l_old EXCEPT SELECT * FROM l_new),
a AS (SELECT * FROM l_new EXCEPT SELECT * FROM l_old),
d AS (
 SELECT 'removed' AS side, r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM l_new x WHERE x.l_orderkey = r.l_orderkey
   AND x.l_partkey = r.l_partkey AND x.l_suppkey = r.l_suppkey AND x.qty = r.qty AND x.flag = r.flag)
 UNION ALL
 SELECT 'added', a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM l_old x WHERE x.l_orderkey = a.l_orderkey
   AND x.l_partkey = a.l_partkey AND x.l_suppkey = a.l_suppkey AND x.qty = a.qty AND x.flag = a.flag))
SELECT side, CAST(l_orderkey AS VARCHAR) AS entity, CAST(l_partkey AS VARCHAR) AS part, CAST(slot AS VARCHAR) AS slot,
       CAST(qty AS VARCHAR) AS qty, flag FROM d""")
def slot_insensitive_diff(spark, sf):
    old, new = line_rows(spark, sf)
    d = diff.slot_insensitive_difference(old, new, LINE_RULES)
    row = F.map_from_entries("items")
    return d.select("side", "entity", *[row[c].alias(c.lower()) for c in ("PART", "SLOT", "QTY", "FLAG")])


# --- D-3, D-6, P-5 ----------------------------------------------------------------------------
FIELDS_SQL = """
j AS (SELECT n.o_custkey, n.o_orderkey, o.status AS os, n.status AS ns, o.priority AS op, n.priority AS np,
             o.total AS ot, n.total AS nt, n.ordered
      FROM o_old o JOIN o_new n USING (o_orderkey)),
f AS (
  SELECT o_custkey, o_orderkey, 'PRIORITY' AS field, op AS old, np AS new, CAST(NULL AS VARCHAR) AS size FROM j WHERE op <> np
  UNION ALL SELECT o_custkey, o_orderkey, 'STATUS', os, ns, NULL FROM j WHERE os <> ns
  UNION ALL SELECT o_custkey, o_orderkey, 'TOTAL', CAST(ot AS VARCHAR), CAST(nt AS VARCHAR),
                   CASE WHEN abs(ot - nt) < 50 THEN 'fyi' END FROM j WHERE abs(ot - nt) >= 1)
"""


@query(f"""
WITH {ORDERS_SQL}, {FIELDS_SQL}
SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderkey AS VARCHAR) AS order_no, field, old, new, size FROM f""")
def snapshot_field_diff(spark, sf):
    old, new = orders_pair(spark, sf)
    pairs = pairing.pair_rows(diff.set_difference(order_rows(old), order_rows(new)), ORDER_RULES)
    both = pairs.filter(F.col("old_items").isNotNull() & F.col("new_items").isNotNull()).select(
        "file", "entity", F.map_from_entries("old_items").alias("o"), F.map_from_entries("new_items").alias("n")
    )
    f = both.select(
        "entity", F.col("n")["ORDER_NO"].alias("order_no"),
        F.explode(diff.edits(F.col("file"), F.col("o"), F.col("n"), ORDER_RULES)).alias("f"),
    )
    return f.select("entity", "order_no", "f.field", "f.old", "f.new", "f.size")


# --- R-1, R-2, R-3, R-4, F-8 ------------------------------------------------------------------
RANKED_SQL = f"""
{FIELDS_SQL},
e AS (SELECT o_custkey, o_orderkey, string_agg(field, ',' ORDER BY field) AS cols,
             string_agg('{{"field":"' || field || '","old":"' || old || '","new":"' || new || '"}}', ',' ORDER BY field) AS fjson
      FROM f GROUP BY ALL),
p AS (SELECT j.*, e.cols, e.fjson FROM j LEFT JOIN e USING (o_orderkey)
      WHERE os <> ns OR op <> np OR ot <> nt),
ed AS (SELECT o_custkey, o_orderkey, 'changed' AS kind, coalesce(cols, '') AS cols,
  CASE WHEN cols IS NULL THEN 'hidden'
       WHEN cols = 'PRIORITY' THEN 'fyi'
       WHEN cols = 'TOTAL' AND abs(ot - nt) < 50 THEN 'fyi'
       ELSE 'action' END AS priority,
  CASE WHEN cols = 'TOTAL' THEN 'money' ELSE 'order' END AS category,
  '{{"context":{{"ORDERED":"' || CAST(ordered AS VARCHAR) || '","STATUS":"' || ns || '"}},' ||
  CASE WHEN cols IS NULL THEN '' ELSE '"fields":[' || fjson || '],' END ||
  '"kind":"changed","source":"ORDERS"}}' AS k
 FROM p),
w AS (
 SELECT o_custkey, o_orderkey, 'removed' AS kind, 'action' AS priority, status, priority AS pr, total, ordered FROM o_old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o_new)
 UNION ALL
 SELECT o_custkey, o_orderkey, 'added', 'fyi', status, priority, total, ordered FROM o_new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o_old)),
wr AS (SELECT o_custkey, o_orderkey, kind, '' AS cols, priority, 'order' AS category,
  '{{"kind":"' || kind || '","row":{{"ORDERED":"' || CAST(ordered AS VARCHAR) || '","PRIORITY":"' || pr || '","STATUS":"' || status ||
  '","TOTAL":"' || CAST(total AS VARCHAR) || '"}},"source":"ORDERS"}}' AS k FROM w),
ranked AS (SELECT * FROM ed UNION ALL SELECT * FROM wr)
"""


def order_changes(spark, sf):
    old, new = orders_pair(spark, sf)
    return changes.ranked_changes(order_rows(old), order_rows(new), ORDER_RULES, text_overrides=False)


@query(f"""
WITH {ORDERS_SQL}, {RANKED_SQL},
u AS (SELECT o_custkey, kind, cols, priority, category, k, count(*) AS copies FROM ranked GROUP BY ALL)
SELECT CAST(o_custkey AS VARCHAR) AS entity, kind, cols, priority, category, copies,
       substr(sha1(CAST(o_custkey AS VARCHAR) || '|2001-08-30|' || k), 1, 12) AS id
FROM u""")
def snapshot_ranked_changes(spark, sf):
    r = order_changes(spark, sf)
    key = ids.change_key(r)
    return (
        r.withColumn("k", key)
        .withColumn("cols", F.array_join(F.transform("fields", lambda f: f["field"]), ","))
        .groupBy("entity", "kind", "cols", "priority", "category", "k")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("id", ids.change_id(F.col("entity"), F.lit("2001-08-30"), F.col("k")))
        .drop("k")
    )


# --- A-1 --------------------------------------------------------------------------------------
@query(f"""
WITH {ORDERS_SQL}, {RANKED_SQL}
SELECT CAST(o_custkey AS VARCHAR) AS entity, count(*) FILTER (priority = 'action') AS action,
       count(*) FILTER (priority = 'ifr') AS ifr, count(*) FILTER (priority = 'fyi') AS fyi,
       count(*) FILTER (priority = 'hidden') AS hidden
FROM ranked GROUP BY 1""")
def change_counts(spark, sf):
    from tidemark.operators.quality import change_counts as counts

    return counts(order_changes(spark, sf))


# --- D-3, D-4 without keys --------------------------------------------------------------------
@query(f"""
WITH {LINES_SQL},
r0 AS (SELECT * FROM l_old EXCEPT SELECT * FROM l_new), a0 AS (SELECT * FROM l_new EXCEPT SELECT * FROM l_old),
r1 AS (SELECT * FROM r0 WHERE NOT EXISTS (SELECT 1 FROM l_new x WHERE x.l_orderkey = r0.l_orderkey
   AND x.l_partkey = r0.l_partkey AND x.l_suppkey = r0.l_suppkey AND x.qty = r0.qty AND x.flag = r0.flag)),
a1 AS (SELECT * FROM a0 WHERE NOT EXISTS (SELECT 1 FROM l_old x WHERE x.l_orderkey = a0.l_orderkey
   AND x.l_partkey = a0.l_partkey AND x.l_suppkey = a0.l_suppkey AND x.qty = a0.qty AND x.flag = a0.flag)),
both_sides AS (SELECT 'removed' AS side, * FROM r1 UNION ALL SELECT 'added', * FROM a1),
told AS (SELECT side, CAST(l_orderkey AS VARCHAR) AS entity, flag, CAST(l_partkey AS VARCHAR) AS part, CAST(qty AS VARCHAR) AS qty,
  CAST(slot AS VARCHAR) AS slot, CAST(l_suppkey AS VARCHAR) AS supplier FROM both_sides),
placed AS (SELECT *, row_number() OVER (PARTITION BY side, entity ORDER BY flag, part, qty, slot, supplier) AS n,
  '{{"FLAG":"' || flag || '","PART":"' || part || '","QTY":"' || qty || '","SLOT":"' || slot || '","SUPPLIER":"' || supplier || '"}}' AS line FROM told),
r AS (SELECT * FROM placed WHERE side = 'removed'), a AS (SELECT * FROM placed WHERE side = 'added'),
edges AS (SELECT r.entity, r.n AS i, 1000000 + a.n AS j,
   (r.flag = a.flag)::INT + (r.part = a.part)::INT + (r.qty = a.qty)::INT + (r.slot = a.slot)::INT + (r.supplier = a.supplier)::INT AS shared
  FROM r JOIN a ON a.entity = r.entity),
chosen AS (SELECT entity, list_reduce(list([i, j] ORDER BY shared DESC, i, j),
    lambda m, e: CASE WHEN list_contains(m, e[1]) OR list_contains(m, e[2]) THEN m ELSE m || e END, []::BIGINT[]) AS m
  FROM edges WHERE shared >= 3 GROUP BY entity),
pairs AS (SELECT entity, unnest(list_transform(range(1, len(m), 2), lambda k: {{'i': m[k], 'j': m[k + 1] - 1000000}})) AS p FROM chosen)
SELECT r.entity, r.line AS old, a.line AS new FROM pairs JOIN r ON r.entity = pairs.entity AND r.n = p.i JOIN a ON a.entity = pairs.entity AND a.n = p.j
UNION ALL SELECT entity, line, NULL FROM r WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.entity = r.entity AND p.i = r.n)
UNION ALL SELECT entity, NULL, line FROM a WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.entity = a.entity AND p.j = a.n)""")
def greedy_pairing(spark, sf):
    """Lines of an order carry no key: removed and added lines pair by shared values."""
    old, new = line_rows(spark, sf)
    d = diff.slot_insensitive_difference(old, new, LINE_RULES)
    pairs = pairing.pair_rows(d, RuleSet())
    text = lambda c: F.to_json(F.map_from_entries(c))
    return pairs.select("entity", text("old_items").alias("old"), text("new_items").alias("new"))


# --- D-5: remarks of a list, all reworded, some gone and some new ------------------------------
# The number of a customer, in letters that no other segment uses: remarks of two segments are unlike.
SCRIPTS = {"AUTOMOBILE": 0x3B1, "BUILDING": 0x430, "FURNITURE": 0x5D0, "MACHINERY": 0x10D0, "HOUSEHOLD": 0x561}
SPELLED_SQL = " ".join(
    f"WHEN '{name}' THEN translate(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '0123456789', '{''.join(chr(first + k) for k in range(10))}')"
    for name, first in SCRIPTS.items()
)
REMARKS_SQL = f"c_mktsegment || ' ' || CASE c_mktsegment {SPELLED_SQL} END"
LIST_RULES = RuleSet(remark_files=("REMARKS",), list_topics=("GENERAL_REMARK",))


@query(f"""
WITH said AS (SELECT CAST(c_nationkey AS VARCHAR) AS entity, c_mktsegment, c_acctbal, {REMARKS_SQL} AS remark FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY entity, c_mktsegment ORDER BY encode(remark)) AS n FROM said WHERE c_acctbal < 9000),
w AS (SELECT *, row_number() OVER (PARTITION BY entity, c_mktsegment ORDER BY encode(remark || ' AGAIN')) AS n FROM said WHERE c_acctbal >= 0)
SELECT coalesce(o.entity, w.entity) AS entity, o.remark AS old, w.remark || ' AGAIN' AS new
FROM o FULL JOIN w ON w.entity = o.entity AND w.c_mktsegment = o.c_mktsegment AND w.n = o.n""")
def list_remark_pairing(spark, sf):
    """Remarks of a nation that share nothing but being remarks: each pairs with one of its own topic."""
    c = table(spark, sf, "customer")
    number, seg = F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.col("c_mktsegment")
    spelled = F.lit(None).cast("string")
    for name, first in SCRIPTS.items():
        spelled = F.when(seg == name, F.translate(number, "0123456789", "".join(chr(first + k) for k in range(10)))).otherwise(spelled)
    c = c.withColumn("remark", F.concat_ws(" ", seg, spelled))
    rows = lambda df, text: diff.snapshot(df, "REMARKS", F.col("c_nationkey"), {"REF_COL_NAME": F.lit("GENERAL_REMARK"), "TAB_NAME": F.lit("T"), "REMARK": text})
    old = rows(c.filter("c_acctbal < 9000"), F.col("remark"))
    new = rows(c.filter("c_acctbal >= 0"), F.concat("remark", F.lit(" AGAIN")))
    pairs = pairing.pair_rows(diff.set_difference(old, new), LIST_RULES, small_pairs=0)
    said = lambda c: F.map_from_entries(c)["REMARK"]
    return pairs.select("entity", said(F.col("old_items")).alias("old"), said(F.col("new_items")).alias("new"))


# --- P-3, P-4 and D-7 -------------------------------------------------------------------------
EDIT_RULES = RuleSet(
    pair_keys={"CUST": ("CUST",)}, id_columns=("CUST",), context_columns=("SEGMENT", "NATION"),
    noise_suffixes=("_DATE",), small_changes={"BALANCE": (10.0, 100.0)}, name_columns=("NAME",),
)
CUST_SQL = """
c_new AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(c_acctbal AS DECIMAL(18,2)) AS bal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'NONE' ELSE '' END AS vip,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'N' ELSE '' END AS hold,
  CAST(c_custkey AS VARCHAR) || '-555-' || CAST(c_nationkey AS VARCHAR) AS phone,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN c_name || ' LTD' ELSE c_name END AS name2,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '(' || CAST(c_custkey AS VARCHAR) || ') 555 ' || CAST(c_nationkey AS VARCHAR)
       ELSE CAST(c_custkey AS VARCHAR) || '-555-' || CAST(c_nationkey AS VARCHAR) END AS phone2,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) + CASE WHEN c_nationkey < 5 THEN 5 WHEN c_nationkey < 10 THEN 50 WHEN c_nationkey < 12 THEN 500 ELSE 0 END AS DECIMAL(18,2)) AS bal2
  FROM customer)
"""


def customer_rows(spark, sf):
    c = table(spark, sf, "customer").withColumn("bal", F.col("c_acctbal").cast("decimal(18,2)"))
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    phone = F.concat_ws("-555-", F.col("c_custkey").cast("string"), nation.cast("string"))
    other = F.concat(F.lit("("), F.col("c_custkey").cast("string"), F.lit(") 555 "), nation.cast("string"))
    bump = F.when(nation < 5, 5).when(nation < 10, 50).when(nation < 12, 500).otherwise(0).cast("decimal(18,2)")
    base = {"CUST": F.col("c_custkey"), "SEGMENT": seg, "NATION": nation}
    old = diff.snapshot(c, "CUST", nation, {**base, "NAME": F.col("c_name"), "VIP": F.lit(""), "HOLD_FLAG": F.lit(""), "PHONE_NO": phone, "BALANCE": F.col("bal"), "SEEN_DATE": F.lit("1")})
    new = diff.snapshot(
        c, "CUST", nation,
        {
            **base,
            "NAME": F.when(seg == "FURNITURE", F.concat("c_name", F.lit(" LTD"))).otherwise(F.col("c_name")),
            "VIP": F.when(seg == "BUILDING", "NONE").otherwise(""),
            "HOLD_FLAG": F.when(seg == "MACHINERY", "N").otherwise(""),
            "PHONE_NO": F.when(seg == "HOUSEHOLD", other).otherwise(phone),
            "BALANCE": (F.col("bal") + bump).cast("decimal(18,2)"),
            "SEEN_DATE": F.lit("2"),
        },
    )
    return old, new


@query(f"""
WITH {CUST_SQL},
f AS (SELECT c_custkey, c_nationkey, c_mktsegment, 'NAME' AS field, c_name AS old, name2 AS new FROM c_new WHERE c_name <> name2
 UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, 'BALANCE', CAST(bal AS VARCHAR), CAST(bal2 AS VARCHAR) FROM c_new WHERE abs(bal2 - bal) >= 10)
SELECT CAST(c_nationkey AS VARCHAR) AS entity, CAST(c_custkey AS VARCHAR) AS cust, field, old, new, c_mktsegment AS segment FROM f""")
def quiet_edit_filters(spark, sf):
    """Blank fills, phone spellings, bookkeeping columns and small changes are no edits."""
    old, new = customer_rows(spark, sf)
    r = changes.ranked_changes(old, new, EDIT_RULES, text_overrides=False)
    e = r.filter(F.col("kind") == "changed").select(
        "entity", F.col("new_row")["CUST"].alias("cust"), F.explode("fields").alias("f"), F.col("context")["SEGMENT"].alias("segment")
    )
    return e.select("entity", "cust", "f.field", "f.old", "f.new", "segment")
