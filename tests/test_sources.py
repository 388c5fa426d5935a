"""Archives and documents, written to a temporary folder and read back."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import charts, places
from tidemark.sources import archive, documents


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return buffer.getvalue()


BASE = '"EFF_DATE","ARPT_ID"," ARPT_NAME "\r"2026/09/03","ABC"," CAFÉ FIELD "\r"2026/09/03","DEF","X"\r'.encode("latin-1")
RWY = "﻿ARPT_ID,RWY_ID\r\nABC,9/27\r\n".encode()


def test_snapshot_round_trip(spark, tmp_path):
    inner = zipped([("APT_RWY.csv", RWY), ("FIX_BASE.csv", b"A\n1\n"), ("APT_CHG_RPT.csv", b"A\n1\n")])
    (tmp_path / "2026-09-03_CSV.zip").write_bytes(zipped([("CSV/APT_BASE.csv", BASE), ("more/inner.zip", inner), ("copy/APT_BASE.csv", BASE)]))
    (tmp_path / "06_Aug_2026_CSV.zip").write_bytes(zipped([("APT_BASE.csv", BASE)]))
    rows = archive.read_snapshots(spark, str(tmp_path))
    got = sorted((str(r["cycle"]), r["file"], tuple(sorted(r["row"].items()))) for r in rows.collect())
    assert got == [
        ("2026-08-06", "APT_BASE", (("ARPT_ID", "ABC"), ("ARPT_NAME", "CAFÉ FIELD"))),
        ("2026-08-06", "APT_BASE", (("ARPT_ID", "DEF"), ("ARPT_NAME", "X"))),
        ("2026-09-03", "APT_BASE", (("ARPT_ID", "ABC"), ("ARPT_NAME", "CAFÉ FIELD"))),
        ("2026-09-03", "APT_BASE", (("ARPT_ID", "DEF"), ("ARPT_NAME", "X"))),
        ("2026-09-03", "APT_RWY", (("ARPT_ID", "ABC"), ("RWY_ID", "09/27"))),
    ]
    found = archive.wanted(archive.members(spark, str(tmp_path)))
    missing = {(str(r["cycle"]), r["file"]) for r in archive.missing_files(found, ("APT_BASE", "APT_RWY")).collect()}
    assert missing == {("2026-08-06", "APT_RWY")}


def test_two_versions_of_a_member_fail(spark, tmp_path):
    (tmp_path / "2026-09-03_CSV.zip").write_bytes(zipped([("a/APT_BASE.csv", BASE), ("b/APT_BASE.csv", BASE + b'"2026/09/03","GHI","Y"\r')]))
    with pytest.raises(Exception, match="two versions of APT_BASE"):
        archive.read_snapshots(spark, str(tmp_path)).collect()


def test_broken_member_fails(spark, tmp_path):
    (tmp_path / "2026-09-03_CSV.zip").write_bytes(zipped([("APT_BASE.csv", b'ARPT_ID,N\nABC,"x" y\nDEF,1\n')]))
    with pytest.raises(Exception, match="does not parse"):
        archive.read_snapshots(spark, str(tmp_path)).collect()


def records(rng, n, end, odd=False):
    """CSV bytes with quoted separators, quotes, line ends and empty fields."""
    pick = lambda: rng.choice(["", "x", '"a,b"', '"say ""hi"""', '"two\nlines"', '""', '"é"', '"' + "long " * 30 + '"', *(['5" pipe', 'a""b'] if odd else [])])
    return end.join(["K,A, B ", *(f"{i},{pick()},{pick()}" for i in range(n)), ""]).encode()


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_members_split_where_records_end(spark, tmp_path, end, odd):
    import csv
    import random

    raw = b"\xef\xbb\xbf" * (end == "\n") + records(random.Random(len(end)), 400, end, odd)
    (tmp_path / "2026-09-03_CSV.zip").write_bytes(zipped([("APT_BASE.csv", raw), ("APT_RWY.csv", b"K"), ("ILS_BASE.csv", b"K,A\n1,2"), ("NAV_BASE.csv", b"")]))
    kept = archive.unique_members(archive.wanted(archive.members(spark, str(tmp_path))))
    text = raw.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
    want = sorted(tuple(r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:])
    parts = {}
    for size in (50, 700, 1 << 20):
        found = archive.pieces(spark, kept, size)
        rows = archive.parse_rows(found).collect()
        assert sorted((r.row["K"], r.row["A"], r.row["B"]) for r in rows if r.file == "APT_BASE") == want
        assert [dict(r.row) for r in rows if r.file == "ILS_BASE"] == [{"K": "1", "A": "2"}] and not [r for r in rows if r.file in ("APT_RWY", "NAV_BASE")]
        parts[size] = found.filter("file = 'APT_BASE'").count()
    assert parts[50] >= parts[700] >= parts[1 << 20] and parts[1 << 20] <= 2
    if not odd:
        assert parts[50] > 100
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few bytes would share a task
        try:
            assert archive.parse_rows(archive.pieces(spark, kept, 700)).select(F.spark_partition_id()).distinct().count() > 1
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_an_error_names_its_file_and_line(spark, tmp_path):
    raw = b"K,A\n" + b"".join(b"%d,x\n" % i for i in range(300)) + b'300,"open\n'
    (tmp_path / "2026-09-03_CSV.zip").write_bytes(zipped([("APT_BASE.csv", raw)]))
    kept = archive.unique_members(archive.wanted(archive.members(spark, str(tmp_path))))
    with pytest.raises(Exception, match=r"APT_BASE \(2026-09-03\) does not parse after line 30[12]"):
        archive.parse_rows(archive.pieces(spark, kept, 100)).collect()


LOG = """<?xml version="1.0"?><digital_tpp cycle="2610" from_edate="0901Z  10/01/26"><state_code ID="X"><city_name>
<airport_name ID="A" apt_ident="abc">{}</airport_name></city_name></state_code></digital_tpp>"""
REC = "<record><chart_code>{}</chart_code><chart_name>{}</chart_name><useraction>{}</useraction><pdf_name>{}</pdf_name><amdtnum>{}</amdtnum><amdtdate>{}</amdtdate><procuid>{}</procuid></record>"


def test_action_log_to_chart_records(spark, tmp_path):
    records = [
        ("IAP", "ILS RWY 28", "C", "1.PDF", "3A", "10/01/2026", "1"), ("IAP", "RNAV RWY 10", "C", "2.PDF", "2", "01/01/2020", "2"), ("IAP", "VOR RWY 5", "A", "3.PDF", "", "", "3"),
        ("STR", "TRISH FIVE", "C", "4.PDF", "", "", "4"), ("STR", "TRISH FIVE, CONT.1", "A", "4C.PDF", "", "", "4"), ("DP", "MSP ONE", "C", "5.PDF", "", "", "9"),
        ("DP", "MSP NINE, CONT.1", "D", "DELETED.PDF", "", "", "9"), ("APD", "AIRPORT DIAGRAM", "C", "6.PDF", "", "", ""), ("MIN", "TAKEOFF MINIMUMS", "D", "7.PDF", "", "", ""), ("IAP", "NDB RWY 1", "", "8.PDF", "", "", ""),
    ]
    path = tmp_path / "log.xml"
    path.write_text(LOG.format("".join(REC.format(*r) for r in records)))
    log, root = documents.action_log(spark, str(path))
    r = root.select("edition", charts.edition_day(F.col("from_edate")).alias("day")).first()
    assert (r["edition"], r["day"]) == ("2610", dt.date(2026, 10, 1))
    got = {x["summary"]: (x["kind"], x["priority"]) for x in charts.chart_records(log, "2610", F.lit("2026-10-01").cast("date")).collect()}
    assert got == {
        "approach ILS RWY 28 amended (amdt 3A)": ("changed", "ifr"), "approach RNAV RWY 10 redrawn (still amdt 2)": ("changed", "ifr"), "approach VOR RWY 5 added": ("added", "ifr"),
        "arrival TRISH FIVE changed": ("changed", "ifr"), "departure MSP ONE replaces MSP NINE": ("changed", "ifr"), "airport diagram changed": ("changed", "fyi"),
        "minimums page (TAKEOFF MINIMUMS) removed": ("removed", "ifr"),
    }


def test_printed_minimums(spark):
    page = "S-ILS 11 680/24 444 (500-½) CIRCLING 780-1 540 (600-1) 072° 254° 190°"
    df = spark.createDataFrame([("a.pdf", page), ("b.pdf", page)], "doc string, text string")
    new = spark.createDataFrame([("a.pdf", page.replace("680/24 444", "700/24 464").replace("072°", "074°")), ("b.pdf", page)], "doc string, text string")
    got = charts.edition_numbers(df, new, "doc", "text").collect()
    assert [(r["pdf"], r["courses"], r["minimums"]) for r in got] == [("a.pdf", ["072° now 074°"], ["minimum 680 now 700"])]


def test_polygons_and_points(spark):
    ring = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    rows = [("ORLANDO CLASS B", "CLASS_B", "KMCO", "0", "SFC", "", "10000", "MSL", "", [ring(-82.0, 28.0, -81.0, 29.0), ring(-81.6, 28.4, -81.4, 28.6)]), ("FAR", "CLASS_E5", "X", "700", "AGL", "", "18000", "MSL", "", [ring(-82.0, 28.0, -81.0, 29.0)])]
    schema = "NAME string, LOCAL_TYPE string, IDENT string, LOWER_VAL string, LOWER_CODE string, LOWER_UOM string, UPPER_VAL string, UPPER_CODE string, UPPER_UOM string, rings array<array<struct<lon:double,lat:double>>>"
    pieces, idents = documents.polygons(spark.createDataFrame(rows, schema))
    assert [(r["layer"], r["cls"], r["s"], r["e"]) for r in pieces.collect()] == [("SFC-10,000 ft MSL", "B", 28.0, -81.0)]
    assert {r["entity"] for r in idents.collect()} == {"KMCO", "MCO"}
    points = spark.createDataFrame([("in", 28.2, -81.8), ("hole", 28.5, -81.5), ("out", 30.0, -81.5)], "entity string, lat double, lon double")
    assert [r["entity"] for r in places.layers_over(points, pieces).collect()] == ["in"]


def test_nearest_ties_poles_and_antimeridian(spark):
    points = spark.createDataFrame([("p", 80.0, 179.95), ("q", 0.0, 0.0)], "point string, lat double, lon double")
    targets = spark.createDataFrame(
        [("W", 80.0, -179.9), ("E", 80.0, 179.5), ("N", 80.1, 179.95)] + [(f"C{k}", 0.05, 0.0) for k in range(9)], "entity string, lat double, lon double"
    )
    got = {}
    for r in places.nearest_within(points, targets).collect():
        got.setdefault(r["point"], []).append((r["rank"], r["entity"]))
    assert [e for _, e in sorted(got["p"])] == ["W", "E", "N"]
    assert [e for _, e in sorted(got["q"])] == ["C0", "C1", "C2", "C3", "C4"]


def test_watchlists_and_gold_cases(spark, tmp_path):
    raw = spark.createDataFrame([("bay-area", "Bay", "", ["kpao", "PAO", "SJC"]), ("x", "", "", []), ("about", "A", "", ["!!"])], "slug string, name string, description string, airports array<string>")
    members, problems = documents.watchlists(raw)
    assert sorted((r["entity"], r["pos"]) for r in members.collect()) == [("PAO", 0), ("SJC", 2)]
    assert {r["slug"] for r in problems.collect()} == {"x", "about"}
    case = {"id": "1", "source": "FRQ", "cycle": "2026-10-01", "airport": "ABC", "kind": "added", "expected": {"priority": "fyi"}}
    (tmp_path / "cases.jsonl").write_text("# note\n" + json.dumps(case) + "\n" + json.dumps({**case, "id": "2", "kind": "moved"}) + "\n")
    good, bad = documents.gold_cases(spark, str(tmp_path / "cases.jsonl"))
    assert [r["id"] for r in good.collect()] == ["1"] and [(r["id"], r["problem"]) for r in bad.collect()] == [("2", "unknown kind")]
