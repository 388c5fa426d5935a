"""Streams whose state outlives a watermark: restarts, replays, late rows, late companions."""

import datetime as dt

from tidemark.streaming import readers

DAY = dt.datetime(2026, 10, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def drop(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_first_sightings_survive_restarts_and_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "reader string, entity string, id string, at timestamp, shard int"
    batches = [
        [("r", "A", "1", day(10), 7), ("r", "A", "1", day(11), 7), ("q", "A", "1", day(10), 7), (None, "A", "1", day(1), 7), ("r", None, "1", day(1), 7)],
        [("r", "A", "1", day(12), 7), ("r", "A", "2", day(0), 7), ("r", "B", "1", day(12), 7), ("r", None, "1", day(2), 7)],  # 2 is older than all others
        [("r", "A", "2", day(1), 7), ("q", "A", "1", day(60), 7), ("r", "A", None, day(60), 7)],  # q met 1 fifty days ago
    ]
    for rows in batches:
        drop(spark, src, rows, schema)
        found = readers.new_to_reader(spark.readStream.schema(schema).parquet(src), keep_days=30, shards=1)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.reader, r.entity or "", r.id, (r.at - DAY).days) for r in spark.read.parquet(out).collect()))
    assert got == [("q", "A", "1", 10), ("q", "A", "1", 60), ("r", "", "1", 1), ("r", "A", "1", 10), ("r", "A", "2", 0), ("r", "B", "1", 12)]


def test_late_charts_rerun_their_cycle_once(spark, tmp_path):
    snaps, feed, told = (str(tmp_path / n) for n in ("snaps", "feed", "told"))
    of_snap, of_feed = "cycle string, published timestamp", "cycle string, kind string, arrived timestamp"
    batches = [
        ([("c1", day(0)), ("c1", day(0)), ("c2", day(1))], [("c1", "areas", day(0))]),
        ([("c3", day(2))], [("c3", "charts", day(2))]),
        ([("c4", day(4))], [("c1", "charts", day(3)), ("c1", "charts", day(3))]),  # two batches after c1
        ([("c9", day(60))], [("c9", "charts", day(60))]),
        ([("c10", day(61))], [("c10", "charts", day(61))]),
    ]
    again = []

    def stream():
        return readers.companions(spark.readStream.schema(of_snap).parquet(snaps), spark.readStream.schema(of_feed).parquet(feed), "7 days")

    for s, f in batches:
        drop(spark, snaps, s, of_snap)
        drop(spark, feed, f, of_feed)
        readers.rerun_late(stream(), lambda _, cycle: again.append(cycle), str(tmp_path / "cp")).awaitTermination()
        stream().writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r.cycle, r.kind or "", r.status) for r in spark.read.parquet(told).collect())
    assert again == ["c1"]
    assert rows == [
        ("c1", "areas", "on time"), ("c1", "charts", "late"), ("c10", "charts", "on time"), ("c2", "", "missing"),
        ("c3", "charts", "on time"), ("c4", "", "missing"), ("c9", "charts", "on time"),
    ]
