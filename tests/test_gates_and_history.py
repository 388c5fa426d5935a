"""Gates on both sides of their thresholds; history, streams and outputs that survive replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, quality, skew, views
from tidemark.sinks import outputs
from tidemark.streaming import cycles as streaming


def counts(spark, **files):
    return spark.createDataFrame(list(files.items()), "file string, rows bigint")


@pytest.mark.parametrize(
    "old, new, level",
    [(1000, 950, None), (1000, 949, "warning"), (1000, 900, "warning"), (1000, 899, "error"), (1000, 1150, None), (1000, 1151, "warning"), (1000, 1500, "warning"), (1000, 1501, "error"),
     (49, 10, None), (49, 0, "error"), (0, 5, "warning"), (None, 5, "warning"), (5, None, "error")],
)
def test_input_gate(spark, old, new, level):
    o, n = (counts(spark, **({"F": v} if v is not None else {"G": 100})) for v in (old, new))
    got = [r["level"] for r in quality.input_gate(o, n).filter("file = 'F'").collect()]
    assert got == ([level] if level else [])


def test_volume_gate(spark):
    def gate(actions, past, entities=200):
        rows = [(str(k), "action" if k < actions else "fyi") for k in range(max(entities, actions))]
        changes = spark.createDataFrame(rows, "entity string, priority string")
        return quality.volume_gate(changes, spark.createDataFrame([(p,) for p in past], "actions bigint")).first()["level"]

    assert gate(100, [100, 100, 100]) == "ok"
    assert gate(100, [40, 40, 40]) == "ok" and gate(101, [40, 40, 40]) == "warning"
    assert gate(200, [40, 40, 40]) == "warning" and gate(201, [40, 40, 40]) == "error"
    assert gate(10, [51, 51, 51]) == "error" and gate(10, [51, 51]) == "ok"
    assert gate(50, [50, 50, 50], entities=99) == "error" and gate(0, [1, 1, 1]) == "error"


def test_cycle_gate(spark):
    d = dt.date
    pairs = [(d(2026, 8, 6), d(2026, 9, 3)), (d(2026, 7, 9), d(2026, 9, 3)), (d(2026, 9, 3), d(2026, 10, 2)), (d(2026, 10, 1), d(2026, 10, 29))]
    df = spark.createDataFrame(pairs, "from_cycle date, to_cycle date")
    now = F.lit("2026-09-03").cast("date")
    got = {(r["from_cycle"], r["error"]) for r in quality.cycle_gate(df, now).collect()}
    assert got == {(d(2026, 7, 9), "not one cycle apart"), (d(2026, 9, 3), "new cycle is off schedule"), (d(2026, 9, 3), "not one cycle apart"),
                   (d(2026, 9, 3), "more than one cycle ahead"), (d(2026, 10, 1), "more than one cycle ahead")}
    assert d(2026, 7, 9) not in {r["from_cycle"] for r in quality.cycle_gate(df, now, gap_ok=True).collect()}


CHANGES = "entity string, cycle string, id string, priority string, summary string"


def test_history_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "history")
    first = spark.createDataFrame([("A", "c1", "1", "fyi", "x"), ("B", "c1", "2", "action", "y")], CHANGES)
    second = spark.createDataFrame([("A", "c2", "3", "fyi", "z")], CHANGES)
    for batch in (first, second, second, first):
        history.append(batch, path)
    stored = spark.read.parquet(path)
    assert sorted((r["cycle"], r["id"]) for r in stored.collect()) == [("c1", "1"), ("c1", "2"), ("c2", "3")]
    assert {(r["entity"], r["entries"], r["last_cycle"], r["action"]) for r in history.index(stored).collect()} == {("A", 2, "c2", 0), ("B", 1, "c1", 1)}
    history.append(spark.createDataFrame([("A", "c1", "9", "fyi", "new")], CHANGES), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["3", "9"]


def test_scrub_puts_failed_translations_back(spark):
    schema = "entity string, source string, summary string, original string"
    h = spark.createDataFrame([("A", "APT_RMK", "new remark: bad words", "RAW 1"), ("A", "APT_RMK", "new remark: good words", "RAW 2"), ("A", "FRQ", "frequency: x", None)], schema)
    v = spark.createDataFrame([("RAW 1", "bad words", False, "bad words"), ("RAW 2", "good words", True, "better words")], "raw string, plain string, ok boolean, readable string")
    got = {r["original"]: r["summary"] for r in history.scrub(h, v, ("APT_RMK", "FRQ")).collect()}
    assert got == {"RAW 1": "new remark: RAW 1", "RAW 2": "new remark: better words", None: "frequency: x"}


def test_reprocess_keeps_ids_and_drops_noise(spark):
    schema = "entity string, cycle string, id string, priority string, kind string, source string, summary string, fields array<struct<field:string,old:string,new:string>>"
    rows = [
        ("A", "c1", "1", "action", "changed", "APT_RWY", "old words", [("RWY_LEN", "5000", "4000")]),
        ("A", "c1", "2", "action", "changed", "APT_RWY", "noise", [("LAT_DECIMAL", "1", "2")]),
        ("A", "c1", "3", "action", "added", "AWOS", "old station", [("ASOS_AWOS_TYPE", "", "AWOS-3")]),
        ("A", "c1", "4", "ifr", "changed", "STAR/DP", "kept as it is", []),
    ]
    got = {r["id"]: (r["priority"], r["summary"]) for r in history.reprocess(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": ("action", "length: 5000 -> 4000 ft"), "3": ("fyi", "new weather station: AWOS-3"), "4": ("ifr", "kept as it is")}


def test_new_cycles_run_once_and_replays_change_nothing(spark, tmp_path):
    drops, store, hist = (str(tmp_path / n) for n in ("drops", "store", "history"))
    schema = "cycle string, entity string, v string"
    seen = []

    def handle(old, new, was, now):
        seen.append((was, now))
        return new.exceptAll(old).select("entity", F.lit("fyi").alias("priority"), F.col("v").alias("id"))

    def drop(cycle, values):
        spark.createDataFrame([(cycle, "A", v) for v in values], schema).coalesce(1).write.mode("append").parquet(drops)

    def run(name="checkpoint"):
        streaming.on_new_cycles(spark, drops, schema, store, handle, hist, str(tmp_path / name)).awaitTermination()

    drop("2026-08-06", ["1", "2"])
    run()
    drop("2026-09-03", ["2", "3"])
    run()
    run()
    assert seen == [("2026-08-06", "2026-09-03")]
    before = sorted(map(tuple, spark.read.parquet(hist).collect()))
    run("another")  # everything replayed from nothing
    assert sorted(map(tuple, spark.read.parquet(hist).collect())) == before and len(before) == 1


def test_a_cycle_may_arrive_in_parts_and_in_any_order(spark, tmp_path):
    schema = "cycle string, entity string, v string"
    parts = [("2026-08-06", ["1", "2"]), ("2026-09-03", ["2", "3"]), ("2026-09-03", ["4"]), ("2026-08-06", ["3"]), ("2026-10-01", ["2", "3", "4"])]
    handle = lambda old, new, was, now: new.exceptAll(old).select("entity", F.lit("fyi").alias("priority"), F.col("v").alias("id"))

    def outcome(name, batches):
        drops, store, hist = (str(tmp_path / name / n) for n in ("drops", "store", "history"))
        for batch in batches:
            for cycle, values in batch:
                spark.createDataFrame([(cycle, "A", v) for v in values], schema).coalesce(1).write.mode("append").parquet(drops)
            streaming.on_new_cycles(spark, drops, schema, store, handle, hist, str(tmp_path / name / "cp")).awaitTermination()
        stored = sorted((str(r["cycle"]), r["v"]) for r in spark.read.parquet(store).collect())
        return stored, sorted((str(r["cycle"]), r["id"]) for r in spark.read.parquet(hist).collect())

    at_once = outcome("at_once", [parts])
    assert at_once[0] == sorted((c, v) for c, values in parts for v in values)
    assert at_once[1] == [("2026-09-03", "4")]
    assert outcome("in_parts", [[p] for p in parts]) == at_once
    assert outcome("backwards", [[p] for p in reversed(parts)]) == at_once


def test_notifications_are_sent_once(spark, tmp_path):
    src, sent = str(tmp_path / "src"), str(tmp_path / "sent")
    spark.createDataFrame([("A", "c1", "action"), ("B", "c1", "fyi")], "entity string, cycle string, priority string").write.parquet(src)
    readers = spark.createDataFrame([("r", "A", "action", False), ("r", "B", "action", False), ("q", "B", "action", True)], "reader string, entity string, mode string, home boolean")
    stream = lambda: spark.readStream.schema("entity string, cycle string, priority string").parquet(src)
    for n in range(2):
        streaming.notify(stream(), readers, sent, str(tmp_path / f"cp{n}")).awaitTermination()
    assert sorted((r["reader"], r["entities"], r["actions"]) for r in spark.read.parquet(sent).collect()) == [("q", 1, 0), ("r", 1, 1)]


def test_ordinal_numbers_a_hot_key_like_a_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("o")).repartition(7)
    a = {tuple(r) for r in skew.ordinal_within(df, ["k"], ["o"], "n").select("k", "o", "n").collect()}
    b = {tuple(r) for r in skew.ordinal(df, ["k"], ["o"], "n").select("k", "o", "n").collect()}
    assert a == b


def test_limits_per_key_are_pushed_below_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = views.top_k(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_views_do_not_depend_on_layout(spark):
    rows = [(f"e{k % 5}", ["action", "ifr", "fyi"][k % 3], f"s{k % 7}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "entity string, priority string, summary string, ord int")
    run = lambda d: {tuple(r) for r in views.capped_items(d, ["entity"], 4).select("entity", "item", "ord", "more").collect()}
    assert run(df.repartition(1)) == run(df.repartition(7)) == run(df.orderBy(F.rand(3)))


def test_outputs(spark, tmp_path):
    changes = spark.createDataFrame([("B", "fyi", "3", 3), ("A", "fyi", "1", 1), ("A", "action", "2", 2)], "entity string, priority string, id string, ord int")
    assert [r["id"] for r in outputs.ordered_changes(changes).collect()] == ["2", "1", "3"]
    outputs.write_changes(changes, str(tmp_path / "out"), buckets=4)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    schema = "run_id string, cycle string, outcome string"
    ids = {outputs.append_run(spark, {"cycle": "c1", "outcome": "built"}, schema, str(tmp_path / "runs")) for _ in range(2)}
    assert len(ids) == 2 and spark.read.json(str(tmp_path / "runs")).count() == 2
