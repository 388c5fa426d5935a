"""Ranked views, digests, feeds and gates over a change log made from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cycles
from tidemark.operators import quality, views
from workload.core import query_set
from workload.pairs import table

QUERIES, ORACLES, query = query_set()

CURRENT = "2024-01-29"
SINCE = "2024-01-15"
ANCHOR = "2024-01-01"


def change_log(spark, sf):
    """Events as changes: the user is the entity, two days are a cycle."""
    e = table(spark, sf, "events")
    pri = F.when(F.col("event_type") == "error", "action").when(F.col("event_type") == "purchase", "ifr").otherwise("fyi")
    return e.select(
        F.col("user_id").alias("entity"),
        cycles.cycle_on_or_before(F.to_date("ts"), ANCHOR, 2).alias("cycle"),
        pri.alias("priority"),
        F.concat_ws(" ", "event_type", F.floor("value").cast("string")).alias("summary"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("ord"),
    )


LOG_SQL = f"""
WITH log AS (SELECT user_id AS entity,
   CAST(DATE '{ANCHOR}' + CAST(2 * floor(datediff('day', DATE '{ANCHOR}', CAST(ts AS DATE)) / 2.0) AS INTEGER) AS DATE) AS cycle,
   CASE event_type WHEN 'error' THEN 'action' WHEN 'purchase' THEN 'ifr' ELSE 'fyi' END AS priority,
   event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS summary, event_id AS id, event_id AS ord
  FROM events),
ranks AS (SELECT *, CASE priority WHEN 'action' THEN 0 WHEN 'ifr' THEN 1 ELSE 2 END AS rk FROM log)
"""


# --- W-1, W-2 ---------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
r AS (SELECT *, priority <> 'action' AS late, string_split(summary, ' ')[1] || '|' || string_split(summary, ' ')[2] AS pair FROM log),
p AS (SELECT entity, id, late, pair, 1 AS pos, string_split(pair, '|')[1] AS phrase FROM r
      UNION ALL SELECT entity, id, late, pair, 2, string_split(pair, '|')[2] FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY entity, phrase ORDER BY late, string_split(pair, '|'), id, pos) AS rn FROM p)
SELECT entity, id, string_agg(phrase, '; ' ORDER BY pos) AS summary FROM f WHERE rn = 1 GROUP BY ALL""")
def phrase_dedupe(spark, sf):
    log = change_log(spark, sf).withColumn("phrases", F.split("summary", " ")).withColumn("rid", F.col("id")).drop("summary")
    return views.phrase_dedupe(log).select("entity", "id", "summary")


@query(f"""{LOG_SQL}
SELECT entity, summary, arg_min(id, ord) AS id FROM log GROUP BY ALL""")
def summary_dedupe(spark, sf):
    return views.summary_dedupe(change_log(spark, sf), [F.col("ord")]).select("entity", "summary", "id")


# --- W-4 --------------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY entity, summary, priority ORDER BY ord) AS k FROM log)
SELECT entity, ord, substr(sha1(CAST(entity AS VARCHAR) || '|{CURRENT}|{{"key":"' || summary || '","kind":"' || priority || '","source":"EVENTS"}}' ||
   CASE WHEN k > 1 THEN '#' || k ELSE '' END), 1, 12) AS id FROM n""")
def numbered_ids(spark, sf):
    from tidemark.functions import ids

    log = change_log(spark, sf).select("entity", "ord", F.col("summary").alias("key"), F.col("priority").alias("kind"), F.lit("events").alias("source"))
    out = ids.numbered_ids(log.withColumn("entity", F.col("entity").cast("string")), F.lit(CURRENT), [F.col("ord")])
    return out.select(F.col("entity").cast("bigint").alias("entity"), "ord", "id")


# --- W-5, W-6, F-7 ----------------------------------------------------------------------------
@query(f"""{LOG_SQL},
d AS (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY cycle DESC) AS nth FROM ranks),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, cycle ORDER BY rk, ord) AS item, count(*) OVER (PARTITION BY entity, cycle) AS n FROM d WHERE nth <= 13)
SELECT entity, CAST(cycle AS VARCHAR) AS cycle, id, CAST(item AS BIGINT) AS item, greatest(n - 3, 0) AS more FROM k WHERE item <= 3""")
def feed_latest_cycles(spark, sf):
    log = change_log(spark, sf)
    current = log.filter(F.col("cycle") == F.lit(CURRENT).cast("date"))
    both = views.latest_cycles(current, log, F.lit(CURRENT).cast("date"))
    items = views.capped_items(both, ["entity", "cycle"], cap=3)
    return items.select("entity", F.col("cycle").cast("string").alias("cycle"), "id", F.col("item").cast("bigint").alias("item"), "more")


# --- F-17, F-18 -------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
n AS (SELECT entity, cycle, count(*) AS total, count(*) FILTER (priority = 'action') AS actions FROM log GROUP BY ALL)
SELECT CAST(cycle AS VARCHAR) AS cycle,
  CAST(entity AS VARCHAR) || ': ' || total || CASE WHEN total = 1 THEN ' change' ELSE ' changes' END || ' (' ||
  CASE WHEN actions = 0 THEN 'no action items' WHEN actions = 1 THEN '1 action item' ELSE actions || ' action items' END || ') on ' || strftime(cycle, '%d %b %Y') AS title,
  strftime(least(CAST(cycle AS TIMESTAMP) + INTERVAL '9 hours 1 minute' - INTERVAL 28 DAYS, TIMESTAMP '2023-12-20 00:00:00'), '%Y-%m-%d %H:%M') AS published FROM n""")
def feed_titles(spark, sf):
    log = change_log(spark, sf).withColumn("entity", F.col("entity").cast("string"))
    f = views.feed_items(log, F.lit("2023-12-20 00:00:00").cast("timestamp"))
    return f.select(F.col("cycle").cast("string").alias("cycle"), "title", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"))


# --- W-7, W-8 ---------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
n AS (SELECT entity, count(*) FILTER (priority = 'action') AS actions, count(*) AS total,
        arg_min(summary, (CASE WHEN priority = 'action' THEN 0 ELSE 1 END) * 1000000000000 + ord) AS summary FROM log GROUP BY entity)
SELECT * FROM n ORDER BY actions DESC, total DESC, entity LIMIT 24""")
def busiest_topk(spark, sf):
    log = change_log(spark, sf)
    return views.busiest(log).join(views.top_change(log), "entity")


# --- W-9, J-14, A-8 ---------------------------------------------------------------------------
def nation_lists(spark, sf):
    """Watchlists: every customer id that is also a user, on its nation's and segment's list."""
    c = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    by_nation = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("slug"), F.col("c_custkey").alias("entity"))
    return by_nation.unionByName(c.select(F.col("c_mktsegment").alias("slug"), F.col("c_custkey").alias("entity")))


LISTS_SQL = """
lists AS (SELECT n_name AS slug, c_custkey AS entity FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION ALL SELECT c_mktsegment, c_custkey FROM customer)
"""


@query(f"""{LOG_SQL}, {LISTS_SQL},
per AS (SELECT entity, count(*) FILTER (priority = 'action') AS a, count(*) FILTER (priority = 'ifr') AS i, count(*) FILTER (priority = 'fyi') AS f FROM log GROUP BY entity)
SELECT slug, count(*) AS members, count(f) AS changed, CAST(coalesce(sum(a), 0) AS BIGINT) AS action, CAST(coalesce(sum(i), 0) AS BIGINT) AS ifr, CAST(coalesce(sum(f), 0) AS BIGINT) AS fyi
FROM lists LEFT JOIN per USING (entity) GROUP BY slug""")
def watchlist_rollup(spark, sf):
    return views.watchlist_totals(change_log(spark, sf), nation_lists(spark, sf))


@query(f"""{LOG_SQL}, {LISTS_SQL},
n AS (SELECT slug, cycle, entity, count(*) FILTER (priority = 'action') AS actions, count(*) AS total FROM lists JOIN log USING (entity) GROUP BY ALL)
SELECT slug, CAST(cycle AS VARCHAR) AS cycle, entity, actions, total, row_number() OVER (PARTITION BY slug, cycle ORDER BY actions DESC, total DESC, entity) AS place FROM n""")
def list_feed_rows(spark, sf):
    out = views.list_rows(change_log(spark, sf), nation_lists(spark, sf))
    return out.select("slug", F.col("cycle").cast("string").alias("cycle"), "entity", "actions", "total", F.col("place").cast("bigint").alias("place"))


# --- W-10 -------------------------------------------------------------------------------------
@query("""
WITH d AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, CASE WHEN c_acctbal > 0 THEN 'K' || c_custkey ELSE '' END AS icao, upper(c_name) AS name, upper(c_mktsegment) AS city,
             CASE WHEN c_nationkey > 20 THEN 4 ELSE 0 END AS other FROM customer),
q AS (SELECT DISTINCT trim(upper(v)) AS q FROM (SELECT CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION SELECT 'K' || s_suppkey FROM supplier
      UNION SELECT substr(s_name, 10) FROM supplier UNION SELECT 'achin' UNION SELECT 'customer#00000001')),
s AS (SELECT q, entity, CASE WHEN entity = q OR icao = q THEN 0 WHEN starts_with(entity, q) OR starts_with(icao, q) THEN 1
        WHEN length(q) >= 3 AND starts_with(name, q) THEN 2 WHEN length(q) >= 3 AND (contains(name, q) OR contains(city, q)) THEN 3 END * 10
        + other + CASE WHEN icao = '' THEN 2 ELSE 0 END AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, length(entity), entity) AS place FROM s WHERE score IS NOT NULL)
SELECT q AS query, entity, CAST(score AS BIGINT) AS score, place FROM r WHERE place <= 30""")
def ranked_search(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    directory = c.select(
        key.alias("entity"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("K"), key)).otherwise("").alias("icao"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"),
        F.when(F.col("c_nationkey") > 20, "heliport").otherwise("airport").alias("type"),
    )
    s = table(spark, sf, "supplier")
    sk = F.col("s_suppkey").cast("string")
    words = F.array(sk, F.concat(F.lit("K"), sk), F.substring("s_name", 10, 100), F.lit("ACHIN"), F.lit("CUSTOMER#00000001"))
    queries = s.select(F.explode(words).alias("query")).distinct()
    out = views.search(directory, queries)
    return out.select("query", "entity", F.col("score").cast("bigint").alias("score"), F.col("place").cast("bigint").alias("place"))


# --- W-11 -------------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
c AS (SELECT cycle, count(*) FILTER (priority = 'action') > count(*) FILTER (priority = 'ifr') AS skipped FROM log GROUP BY cycle)
SELECT CAST(cycle AS VARCHAR) AS cycle, CAST(lag(cycle) OVER (ORDER BY cycle) AS VARCHAR) AS from_cycle FROM c WHERE NOT skipped""")
def previous_cycles(spark, sf):
    c = change_log(spark, sf).groupBy("cycle").agg((F.count_if(F.col("priority") == "action") > F.count_if(F.col("priority") == "ifr")).alias("skipped"))
    return views.previous_cycles(c).select(*[F.col(x).cast("string").alias(x) for x in ("cycle", "from_cycle")])


# --- W-12, W-14 -------------------------------------------------------------------------------
@query(f"""{LOG_SQL}
SELECT entity, CAST(cycle AS VARCHAR) AS cycle, count(*) AS total, count(*) FILTER (priority = 'action') AS actions
FROM log WHERE cycle >= DATE '{CURRENT}' - INTERVAL 1 MONTH AND priority <> 'fyi' AND cycle <> DATE '{CURRENT}' GROUP BY ALL""")
def history_range(spark, sf):
    out = views.history_range(change_log(spark, sf), F.lit(CURRENT).cast("date"), 1, hide_fyi=True, hide_current=True)
    return out.withColumn("cycle", F.col("cycle").cast("string"))


@query(f"""{LOG_SQL},
p AS (SELECT entity, cycle, count(*) AS total, count(*) FILTER (priority = 'action') AS actions FROM log WHERE cycle <> DATE '{CURRENT}' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cycle DESC) AS nth FROM p)
SELECT entity, CAST(cycle AS VARCHAR) AS cycle, total, actions, nth FROM r WHERE nth <= 12""")
def history_pages(spark, sf):
    out = views.history_pages(change_log(spark, sf), F.lit(CURRENT).cast("date"))
    return out.select("entity", F.col("cycle").cast("string").alias("cycle"), "total", "actions", F.col("nth").cast("bigint").alias("nth"))


# --- D-16, X-3, W-13 --------------------------------------------------------------------------
def seen_state(spark, sf):
    """Every nation's reader has opened its customers' pages up to mid-month and read the views."""
    log = change_log(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("reader"))
    return log.filter((F.col("cycle") <= F.lit(SINCE).cast("date")) & (F.col("priority") == "fyi")).join(c, "entity").select("reader", "entity", "cycle", "id")


SEEN_SQL = f"""
seen AS (SELECT c_nationkey AS reader, entity, cycle, id FROM log JOIN customer ON c_custkey = entity WHERE cycle <= DATE '{SINCE}' AND priority = 'fyi'),
base AS (SELECT reader, entity, max(cycle) AS since FROM seen GROUP BY ALL),
fresh AS (SELECT reader, log.* FROM log JOIN base USING (entity) WHERE cycle >= since
          AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.reader = base.reader AND s.entity = log.entity AND s.id = log.id))
"""


@query(f"""{LOG_SQL}, {SEEN_SQL} SELECT reader, entity, id FROM fresh""")
def unseen_changes(spark, sf):
    return views.unseen(change_log(spark, sf), seen_state(spark, sf)).select("reader", "entity", "id")


@query(f"""{LOG_SQL}, {SEEN_SQL},
l AS (SELECT c_nationkey AS reader, c_mktsegment AS slug, c_custkey AS entity FROM customer UNION ALL SELECT c_nationkey, 'nation ' || c_nationkey, c_custkey FROM customer),
fol AS (SELECT reader, entity, string_agg(DISTINCT slug, ', ' ORDER BY slug) AS lists FROM l GROUP BY ALL),
per AS (SELECT entity, count(*) FILTER (priority = 'action') AS actions, count(*) AS total FROM log GROUP BY entity),
nw AS (SELECT reader, entity, count(*) AS new FROM fresh GROUP BY ALL),
row AS (SELECT reader, entity, lists, coalesce(actions, 0) AS actions, coalesce(total, 0) AS total, coalesce(new, 0) AS new FROM fol LEFT JOIN per USING (entity) LEFT JOIN nw USING (reader, entity)),
chg AS (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY actions DESC, new DESC, entity) AS place FROM row WHERE total > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE priority WHEN 'action' THEN 0 WHEN 'ifr' THEN 1 ELSE 2 END, ord) AS nth FROM log),
ln AS (SELECT entity, string_agg(summary, '; ' ORDER BY nth) AS lines FROM o WHERE nth <= 3 GROUP BY entity)
SELECT reader, entity, lists, actions, total, new, place, lines, greatest(total - 3, 0) AS more FROM chg JOIN ln USING (entity) WHERE place <= 60
UNION ALL SELECT reader, entity, lists, actions, total, new, NULL, '', 0 FROM row WHERE total = 0""")
def reader_digest(spark, sf):
    c = table(spark, sf, "customer")
    n = F.col("c_nationkey")
    slugs = F.array(F.col("c_mktsegment"), F.concat(F.lit("nation "), n.cast("string")))
    lists = c.select(n.alias("reader"), F.explode(slugs).alias("slug"), F.col("c_custkey").alias("entity"))
    out = views.digest(change_log(spark, sf), lists, seen_state(spark, sf))
    return out.withColumn("place", F.col("place").cast("bigint"))


# --- A-2, Q-4 ---------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
past AS (SELECT cycle, count(*) FILTER (priority = 'action') AS actions FROM log WHERE cycle <> DATE '{CURRENT}' GROUP BY cycle ORDER BY cycle DESC LIMIT 13),
now AS (SELECT count(DISTINCT entity) AS entities, count(*) FILTER (priority = 'action') AS actions FROM log WHERE cycle = DATE '{CURRENT}'),
b AS (SELECT median(actions) AS median, count(*) AS n FROM past),
j AS (SELECT entities, actions, CAST(median AS DOUBLE) AS median, actions / median AS ratio, n FROM now, b)
SELECT entities, actions, median,
  CASE WHEN entities < 50 OR actions = 0 OR (n >= 3 AND (ratio > 5 OR ratio < 0.2)) THEN 'error' WHEN n >= 3 AND (ratio > 2.5 OR ratio < 0.4) THEN 'warning' ELSE 'ok' END AS level,
  CASE WHEN entities < 50 THEN 'few entities' WHEN actions = 0 THEN 'no actions' WHEN n >= 3 AND (ratio > 5 OR ratio < 0.2) THEN 'far from median'
       WHEN n >= 3 AND (ratio > 2.5 OR ratio < 0.4) THEN 'off median' ELSE '' END AS reason FROM j""")
def cycle_volume_gate(spark, sf):
    log = change_log(spark, sf)
    current = F.lit(CURRENT).cast("date")
    return quality.volume_gate(log.filter(F.col("cycle") == current), quality.past_action_counts(log, current), min_entities=50)


# --- S-7, A-3, Q-2 ----------------------------------------------------------------------------
@query(f"""
WITH f AS (SELECT o_orderpriority || ' ' || o_orderstatus AS file, year(o_orderdate) AS cycle FROM orders),
c AS (SELECT file, cycle, count(*) AS n FROM f GROUP BY ALL),
j AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.cycle + 1, n.cycle) AS cycle, o.n AS a, n.n AS b
  FROM (SELECT * FROM c WHERE cycle < (SELECT max(cycle) FROM c)) o FULL JOIN (SELECT * FROM c WHERE cycle > (SELECT min(cycle) FROM c)) n ON o.file = n.file AND o.cycle + 1 = n.cycle),
v AS (SELECT *, CASE WHEN b IS NULL THEN 'error: missing' WHEN coalesce(a, 0) = 0 THEN CASE WHEN b > 0 THEN 'warning: new table' END WHEN b = 0 THEN 'error: empty'
   WHEN greatest(a, b) < 50 THEN NULL WHEN (b - a) / a < -0.10 THEN 'error: dropped' WHEN (b - a) / a > 0.50 THEN 'error: rose'
   WHEN (b - a) / a < -0.05 THEN 'warning: dropped' WHEN (b - a) / a > 0.15 THEN 'warning: rose' END AS verdict FROM j)
SELECT file, cycle, a AS old_rows, b AS new_rows, string_split(verdict, ': ')[1] AS level, string_split(verdict, ': ')[2] AS reason FROM v WHERE verdict IS NOT NULL""")
def input_row_gate(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("file"), F.year("o_orderdate").alias("cycle"))
    counts = quality.row_counts(rows)
    first, last = counts.agg(F.min("cycle")).scalar(), counts.agg(F.max("cycle")).scalar()
    old, new = counts.filter(F.col("cycle") < last).withColumn("cycle", F.col("cycle") + 1), counts.filter(F.col("cycle") > first)
    return quality.input_gate(old, new, ["file", "cycle"])


# --- Q-3, P-10, P-11 --------------------------------------------------------------------------
@query("""
WITH ch AS (SELECT CAST(user_id AS VARCHAR) AS entity, CASE WHEN event_type = 'view' THEN floor(value) ELSE event_id END AS id,
   CASE WHEN event_type = 'signup' AND value < 1 THEN ' ' WHEN event_type = 'error' AND value < 2 THEN 'got null here ' || event_id
        WHEN event_type = 'click' THEN 'click ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE 'ok ' || event_id END AS summary,
   CASE WHEN event_type = 'purchase' AND value > 90 THEN 'urgent' WHEN event_type = 'error' THEN 'action' ELSE 'fyi' END AS priority,
   CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS new, CAST(floor(value) AS BIGINT) AS v FROM events),
p AS (SELECT entity, 'error' AS level, 'empty summary' AS reason FROM ch WHERE trim(summary) = ''
 UNION ALL SELECT entity, 'error', 'bad priority' FROM ch WHERE trim(summary) <> '' AND priority = 'urgent'
 UNION ALL SELECT entity, 'error', 'junk text' FROM ch WHERE summary LIKE 'got null%'
 UNION ALL SELECT entity, 'warning', 'FREQ ' || new || ' is not a real frequency' FROM ch WHERE priority <> 'fyi' AND trim(summary) <> ''
   AND NOT (v >= 30 AND v < 88 OR v BETWEEN 108 AND 152 OR v BETWEEN 225 AND 400 OR v BETWEEN 190 AND 1750 OR v BETWEEN 2000 AND 30000))
SELECT entity, level, reason, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT entity, 'error', 'duplicate id', count(*) FROM ch GROUP BY entity, id HAVING count(*) > 1
UNION ALL SELECT entity, 'error', 'duplicate summary', count(*) FROM ch GROUP BY entity, summary HAVING count(*) > 1""")
def change_gate(spark, sf):
    e = table(spark, sf, "events")
    v, kind = F.floor("value").cast("string"), F.col("event_type")
    num = F.col("event_id").cast("string")
    ch = e.select(
        F.col("user_id").cast("string").alias("entity"),
        F.when(kind == "view", F.floor("value")).otherwise(F.col("event_id")).alias("id"),
        F.when((kind == "signup") & (F.col("value") < 1), " ").when((kind == "error") & (F.col("value") < 2), F.concat(F.lit("got null here "), num))
        .when(kind == "click", F.concat(F.lit("click "), v)).otherwise(F.concat(F.lit("ok "), num)).alias("summary"),
        F.when((kind == "purchase") & (F.col("value") > 90), "urgent").when(kind == "error", "action").otherwise("fyi").alias("priority"),
        F.array(F.struct(F.lit("FREQ").alias("field"), F.lit("").alias("old"), v.alias("new"))).alias("fields"),
    )
    return quality.change_gate(ch)


# --- Q-1, Q-5, F-7 ----------------------------------------------------------------------------
@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(28 * CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS INTEGER) AS e FROM orders),
e AS (SELECT d, e, 'old cycle is off schedule' AS error FROM d WHERE datediff('day', DATE '2026-09-03', d) % 28 <> 0
 UNION ALL SELECT d, e, 'new cycle is off schedule' FROM d WHERE datediff('day', DATE '2026-09-03', CAST(e AS DATE)) % 28 <> 0
 UNION ALL SELECT d, e, 'not one cycle apart' FROM d WHERE datediff('day', d, CAST(e AS DATE)) <> 28
 UNION ALL SELECT d, e, 'more than one cycle ahead' FROM d WHERE CAST(e AS DATE) > DATE '2001-06-07' + 28)
SELECT CAST(d AS VARCHAR) AS from_cycle, CAST(CAST(e AS DATE) AS VARCHAR) AS to_cycle, error FROM e""")
def cycle_gate(spark, sf):
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    step = F.when(F.col("o_orderstatus") == "O", 28).when(F.col("o_orderstatus") == "F", 56).otherwise(0)
    pairs = o.select(day.alias("from_cycle"), F.date_add(day, step).alias("to_cycle")).distinct()
    out = quality.cycle_gate(pairs, F.lit("2001-06-07").cast("date"))
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("from_cycle", "to_cycle", "error")])


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT day, n, CAST(DATE '2026-09-03' + CAST(28 * floor(datediff('day', DATE '2026-09-03', day) / 28.0) AS INTEGER) AS DATE) AS cycle FROM d)
SELECT CAST(cycle AS VARCHAR) AS cycle, strftime(cycle, '%y') || lpad(CAST(CAST(floor((dayofyear(cycle) - 1) / 28.0) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS edition,
  strftime(CAST(cycle - 28 AS DATE), '%y') || lpad(CAST(CAST(floor((dayofyear(CAST(cycle - 28 AS DATE)) - 1) / 28.0) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS before,
  CAST(sum(n) AS BIGINT) AS orders FROM c GROUP BY ALL""")
def cycle_calendar(spark, sf):
    day = F.to_date("o_orderdate")
    c = table(spark, sf, "orders").groupBy(cycles.cycle_on_or_before(day).alias("cycle")).agg(F.count(F.lit(1)).alias("orders"))
    return c.select(F.col("cycle").cast("string").alias("cycle"), cycles.edition(F.col("cycle")).alias("edition"), cycles.previous_edition(F.col("cycle")).alias("before"), "orders")
