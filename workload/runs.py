"""Run log, archive, review, directory and streaming queries over data derived from the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import attribute, quality
from tidemark.session import checkpoint_folder
from tidemark.sources import documents
from tidemark.streaming import cycles as streaming
from workload.core import query_set
from workload.pairs import table
from workload.views import ANCHOR, LOG_SQL, change_log

QUERIES, ORACLES, query = query_set()


def order_runs(spark, sf):
    """Orders as engine runs: status = outcome, priority = warnings, customer nation = feed."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("c_nationkey").alias("feed"), F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderdate").cast("timestamp").alias("finished_at"), F.year("o_orderdate").alias("cycle"),
        F.when(p == "1-URGENT", "failed").when(p == "2-HIGH", "blocked").when(p == "3-MEDIUM", "skipped").otherwise("built").alias("outcome"),
        F.when(s == "P", False).when(s == "F", True).alias("verified"), (s == "F").alias("published"),
        F.when(p == "5-LOW", 1).otherwise(0).alias("warnings"), F.col("c_mktsegment").alias("engine_hash"),
        F.concat_ws(".", F.lit("1"), F.month("o_orderdate").cast("string"), F.lit("0")).alias("version"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice").cast("bigint")).alias("changes"),
        F.array(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")), s, p, F.lit("z")).alias("errors"),
    )


RUNS_SQL = """
WITH r AS (SELECT o_orderkey AS run_id, c_nationkey AS feed, o_orderdate AS started_at, year(o_orderdate) AS cycle, o_orderstatus AS s, o_orderpriority AS p,
   c_mktsegment AS hash, month(o_orderdate) AS minor, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT *, CASE WHEN p = '2-HIGH' OR s = 'P' THEN 'blocked' WHEN p = '1-URGENT' THEN 'crashed' WHEN p = '3-MEDIUM' THEN 'skipped'
   WHEN s = 'F' AND p = '5-LOW' THEN 'published with warnings' WHEN s = 'F' THEN 'published' ELSE 'waiting' END AS verdict FROM r)
"""


# --- Q-11, A-6 --------------------------------------------------------------------------------
@query(f"""{RUNS_SQL},
w AS (SELECT *, lag(hash) OVER x AS h0, lag(minor) OVER x AS m0 FROM v WINDOW x AS (PARTITION BY feed ORDER BY started_at, run_id))
SELECT verdict, coalesce(h0 <> hash AND m0 = minor, false) AS unbumped, count(*) AS runs FROM w GROUP BY ALL""")
def run_verdicts(spark, sf):
    return quality.run_verdicts(order_runs(spark, sf)).groupBy("verdict", "unbumped").agg(F.count(F.lit(1)).alias("runs"))


@query(f"""{RUNS_SQL}
SELECT verdict, count(*) AS runs, strftime(max(started_at), '%Y-%m-%d') AS latest FROM (SELECT * FROM v ORDER BY started_at DESC, run_id DESC LIMIT 30) GROUP BY verdict""")
def run_tallies(spark, sf):
    return quality.run_tallies(quality.run_verdicts(order_runs(spark, sf))).withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


# --- A-9, A-10 --------------------------------------------------------------------------------
@query(f"""{RUNS_SQL}
SELECT run_id, CAST(price AS DOUBLE) > 100000 AS counted FROM v WHERE s = 'F' AND minor >= 6 AND price > 100000 ORDER BY started_at DESC, run_id DESC LIMIT 1""")
def newest_published_run(spark, sf):
    out = quality.newest_published(quality.run_verdicts(order_runs(spark, sf)), (1, 6, 0))
    return out.select("run_id", F.col("changes").isNotNull().alias("counted"))


@query(f"""{RUNS_SQL},
c AS (SELECT DISTINCT cycle FROM v ORDER BY cycle DESC LIMIT 3), b AS (SELECT *, count(*) OVER () AS incidents FROM v WHERE cycle IN (SELECT cycle FROM c) AND verdict IN ('blocked', 'crashed'))
SELECT run_id, cycle, verdict, 'e' || run_id || ', ' || s || ', ' || p AS errors, incidents FROM b ORDER BY started_at DESC, run_id DESC LIMIT 10""")
def incidents(spark, sf):
    out = quality.incidents(quality.run_verdicts(order_runs(spark, sf)))
    return out.select("run_id", F.col("cycle").cast("bigint").alias("cycle"), "verdict", F.array_join("errors", ", ").alias("errors"), "incidents")


# --- Q-14 -------------------------------------------------------------------------------------
@query(f"""{RUNS_SQL},
l AS (SELECT feed, max(started_at) AS pub, arg_max(p, run_id) AS p FROM v WHERE s = 'F' GROUP BY feed),
x AS (SELECT *, CAST(DATE '2026-09-03' + CAST(28 * floor(datediff('day', DATE '2026-09-03', CAST(pub AS DATE)) / 28.0) AS INTEGER) AS DATE) AS shown, TIMESTAMP '2001-07-31 12:00:00' AS now FROM l),
y AS (SELECT *, CAST(DATE '2026-09-03' + CAST(28 * floor(datediff('day', DATE '2026-09-03', CAST(now - INTERVAL '9 hours 1 minute' AS DATE)) / 28.0) AS INTEGER) AS DATE) AS due, epoch(now) - epoch(pub) > 30 * 3600 AS stale FROM x)
SELECT feed, CASE WHEN shown < due AND NOT stale AND p <> '1-URGENT' THEN 'waiting' WHEN shown < due THEN 'behind' WHEN stale THEN 'stale' ELSE 'current' END AS status FROM y""")
def feed_status(spark, sf):
    from tidemark.functions.cycles import cycle_on_or_before

    r = order_runs(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderpriority"), "run_id").filter("published")
    latest = r.groupBy("feed").agg(F.max("started_at").alias("published_at"), F.max_by("o_orderpriority", "run_id").alias("p"))
    latest = latest.select("feed", "published_at", cycle_on_or_before(F.to_date("published_at")).alias("shown_cycle"), (F.col("p") == "1-URGENT").alias("next_posted"))
    return quality.feed_status(latest, F.lit("2001-07-31 12:00:00").cast("timestamp")).select("feed", "status")


# --- Q-9, Q-10, Q-12 --------------------------------------------------------------------------
@query("""
WITH a AS (SELECT url AS name, length(html) AS size, sha256(html) AS sha FROM pages), m AS (SELECT url AS name, length(html) + CASE WHEN url LIKE '%?%' THEN 0 ELSE 1 END AS size, sha256(html || CASE WHEN html LIKE '%lang="fr"%' THEN 'x' ELSE '' END) AS sha FROM pages WHERE html NOT LIKE '%lang="de"%'),
a1 AS (SELECT name, min(size) AS size, min(sha) AS sha FROM a WHERE NOT name LIKE 'http://%' GROUP BY name), m1 AS (SELECT name, min(size) AS size, min(sha) AS sha FROM m GROUP BY name)
SELECT coalesce(m1.name, a1.name) AS name, CASE WHEN a1.name IS NULL THEN 'listed but absent' WHEN m1.name IS NULL THEN 'present but not listed' WHEN m1.size <> a1.size THEN 'size differs' ELSE 'digest differs' END AS problem
FROM m1 FULL JOIN a1 USING (name) WHERE a1.name IS NULL OR m1.name IS NULL OR m1.size <> a1.size OR m1.sha <> a1.sha""")
def archive_reconciliation(spark, sf):
    """Pages as archived files: the manifest misses German ones and misstates others."""
    p = table(spark, sf, "pages")
    fold = lambda df: df.groupBy("name").agg(F.min("size").alias("size"), F.min("sha256").alias("sha256"))
    actual = p.filter(~F.col("url").startswith("http://")).select(F.col("url").alias("name"), F.length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    wrong = F.when(F.contains("html", F.lit('lang="fr"')), "x").otherwise("")
    manifest = p.filter(~F.contains("html", F.lit('lang="de"'))).select(
        F.col("url").alias("name"), (F.length("html") + F.when(F.contains("url", F.lit("?")), 0).otherwise(1)).alias("size"), F.sha2(F.concat("html", wrong), 256).alias("sha256")
    )
    return quality.reconcile_archive(fold(manifest), fold(actual))


@query("""
SELECT year(o_orderdate) AS cycle, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS BIGINT) AS tables, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS BIGINT) AS charts,
  CAST(sum(CASE WHEN o_orderstatus = 'X' THEN o_custkey END) AS BIGINT) AS areas FROM orders GROUP BY 1""")
def archive_availability(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "tables").when(F.col("o_orderstatus") == "O", "charts").when(F.col("o_orderstatus") == "X", "areas")
    listing = o.select(F.year("o_orderdate").cast("bigint").alias("cycle"), kind.alias("kind"), F.col("o_custkey").alias("size"))
    return quality.availability(listing, ["tables", "charts", "areas"])


# --- A-7, Q-13 --------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
c AS (SELECT id, CASE WHEN summary LIKE '%3' THEN 'action' ELSE priority END AS want, summary LIKE 'view%' AS kf, CASE WHEN summary LIKE 'click%' THEN 'click' END AS contains FROM log),
p AS (SELECT id, priority, summary FROM log WHERE summary NOT LIKE 'signup 1%'),
j AS (SELECT c.*, p.priority, p.summary, coalesce(p.priority = want, false) AND (contains IS NULL OR coalesce(contains(p.summary, contains), false)) AS ok FROM c LEFT JOIN p USING (id))
SELECT count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (priority = 'action' AND want <> 'action') AS false_action, count(*) FILTER (priority <> 'action' AND want = 'action') AS missed_action,
  count(*) FILTER (kf AND NOT ok) AS known_failure, count(*) FILTER (kf AND ok) AS fixed FROM j""")
def gold_score(spark, sf):
    log = change_log(spark, sf).select(F.col("id").alias("case"), "priority", "summary", F.lit(None).cast("string").alias("category"))
    s = F.col("summary")
    cases = log.select(
        "case", F.when(s.endswith("3"), "action").otherwise(F.col("priority")).alias("priority"), "category",
        F.when(s.startswith("click"), "click").alias("contains"), s.startswith("view").alias("known_failure"),
    )
    return quality.gold_score(quality.gold_outcomes(cases, log.filter(~s.startswith("signup 1"))))


@query("""
WITH a AS (SELECT DISTINCT user_id AS "case", event_type AS reviewer FROM events WHERE event_type <> 'view'), k AS (SELECT c_custkey AS "case" FROM customer WHERE c_acctbal > 0)
SELECT "case", reviewer FROM a WHERE "case" IN (SELECT "case" FROM k) AND reviewer <> 'error'""")
def review_recording(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("case"), F.col("event_type").alias("reviewer"))
    answers = e.withColumn("verdict", F.when(F.col("reviewer") == "view", " ").otherwise("right"))
    cases = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("case"))
    fresh, _ = quality.record_reviews(cases, e.filter(F.col("reviewer") == "error"), answers)
    return fresh.select("case", "reviewer")


# --- Q-6, K-7 ---------------------------------------------------------------------------------
@query(f"""{LOG_SQL},
i AS (SELECT DISTINCT entity FROM log), d AS (SELECT DISTINCT entity FROM log WHERE priority = 'action'), dir AS (SELECT c_custkey AS entity FROM customer WHERE c_acctbal > 0)
SELECT 'in index without a document' AS problem, entity FROM i WHERE entity NOT IN (SELECT entity FROM d)
UNION ALL SELECT 'not in directory', entity FROM i WHERE entity NOT IN (SELECT entity FROM dir)
UNION ALL SELECT 'directory too small', NULL FROM (SELECT count(*) AS n FROM dir) WHERE n < 1000""")
def output_completeness(spark, sf):
    log = change_log(spark, sf)
    meta = log.agg(F.count_distinct("entity").alias("changed"))
    directory = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("entity"))
    out = quality.completeness(meta, log, log.filter(F.col("priority") == "action"), directory, min_directory=1000)
    return out.withColumn("entity", F.col("entity").cast("bigint"))


# --- S-11, S-12, S-13, J-5, P-12 --------------------------------------------------------------
@query("""
SELECT upper(c_mktsegment) AS entity FROM customer UNION SELECT upper(n_name) FROM nation""")
def entity_scope(spark, sf):
    return attribute.entity_ids(
        table(spark, sf, "customer").select(F.col("c_mktsegment").alias("id")), table(spark, sf, "nation").select(F.col("n_name").alias("id")), column="id"
    )


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_name FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS entity, CASE WHEN c_acctbal > 0 THEN 'K' || c_custkey END AS icao, CASE c_nationkey WHEN 0 THEN 'heliport' WHEN 1 THEN 'seaplane base' ELSE 'airport' END AS type,
  round(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE), 4) AS lat, regexp_full_match(CAST(c_custkey AS VARCHAR), '[A-Z0-9]{2,4}') AS has_page FROM c""")
def entity_directory(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    row = F.create_map(
        F.lit("ARPT_ID"), k, F.lit("ICAO_ID"), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("K"), k)).otherwise(""), F.lit("ARPT_NAME"), F.col("c_name"),
        F.lit("SITE_TYPE_CODE"), F.when(F.col("c_nationkey") == 0, "H").when(F.col("c_nationkey") == 1, "C").otherwise("A"), F.lit("LAT_DECIMAL"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"),
    )
    out = documents.directory(c.select(row.alias("row")))
    return out.select("entity", "icao", "type", "lat", P.is_entity_id(F.col("entity")).alias("has_page"))


# --- S-16 -------------------------------------------------------------------------------------
@query("""
WITH l AS (SELECT lower(n_name) AS slug0, n_nationkey AS n FROM nation), s AS (SELECT replace(slug0, '_', CASE WHEN n < 20 THEN '-' ELSE '_' END) AS slug, n FROM l),
m AS (SELECT s.slug, CASE WHEN regexp_full_match('K' || upper(substr(c_mktsegment, 1, 3)), 'K[A-Z]{3}') THEN upper(substr(c_mktsegment, 1, 3)) END AS entity FROM s JOIN customer ON c_nationkey = n WHERE n < 20)
SELECT DISTINCT slug, entity FROM m""")
def watchlist_members(spark, sf):
    """Lists named after nations; a slug with an underscore is refused."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    ids = c.groupBy("c_nationkey").agg(F.collect_set(F.concat(F.lit("k"), F.lower(F.substring("c_mktsegment", 1, 3)))).alias("airports"))
    slug = F.when(F.col("n_nationkey") < 20, F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).otherwise(F.lower("n_name"))
    raw = n.join(ids, F.col("n_nationkey") == F.col("c_nationkey")).select(slug.alias("slug"), F.col("n_name").alias("name"), F.lit("").alias("description"), "airports")
    members, _ = documents.watchlists(raw)
    return members.select("slug", "entity")


# --- X-7 --------------------------------------------------------------------------------------
@query("""
SELECT CAST(CAST(DATE '2024-01-01' + CAST(2 * floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 2.0) AS INTEGER) AS DATE) AS VARCHAR) AS cycle, event_type, count(*) AS n FROM events GROUP BY ALL""")
def streaming_cycle_counts(spark, sf):
    """Events as a file stream, all that is there, into two-day cycles; equals the batch."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = streaming.cycle_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 2, "1 day", ANCHOR, ["event_type"])
    folder = f"{checkpoint_folder(spark)}/cycle_counts_{uuid.uuid4().hex}"
    q = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(os.path.join(folder, "counts")))
        .option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(os.path.join(folder, "counts")).withColumn("cycle", F.col("cycle").cast("string"))
