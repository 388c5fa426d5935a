"""Whole-pipeline behaviour on small written-out snapshots."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import publish

SCHEMA = "file string, entity string, row map<string,string>"


@pytest.fixture(scope="module")
def published(spark):
    old, new = [], []

    def both(file, entity, before, after):
        if before is not None:
            old.append((file, entity, before))
        if after is not None:
            new.append((file, entity, after))

    # ABC: renamed (echoed by its tower row), runway renumbered with its ends, hours rewritten
    both("APT_BASE", "ABC", {"ARPT_ID": "ABC", "ARPT_NAME": "OLD FIELD"}, {"ARPT_ID": "ABC", "ARPT_NAME": "NEW FIELD"})
    both("ATC_BASE", "ABC", {"FACILITY_ID": "ABC", "FACILITY_NAME": "OLD FIELD", "TWR_HRS": "0700-2100"}, {"FACILITY_ID": "ABC", "FACILITY_NAME": "NEW FIELD", "TWR_HRS": "0700-2200"})
    rwy = lambda i, l="5000": {"ARPT_ID": "ABC", "RWY_ID": i, "RWY_LEN": l, "RWY_WIDTH": "75", "SURFACE_TYPE_CODE": "ASPH"}
    both("APT_RWY", "ABC", rwy("07/25"), None)
    both("APT_RWY", "ABC", None, rwy("08/26"))
    end = lambda r, e, z: {"ARPT_ID": "ABC", "RWY_ID": r, "RWY_END_ID": e, "TDZ_ELEV": z}
    both("APT_RWY_END", "ABC", end("07/25", "25", "137.3"), None)
    both("APT_RWY_END", "ABC", None, end("08/26", "26", "143.1"))
    # remarks: moved to another slot (nothing), reworded (fyi), refiled closure
    rmk = lambda n, t: {"ARPT_ID": "ABC", "LEGACY_ELEMENT_NUMBER": n, "REF_COL_NAME": "GENERAL_REMARK", "TAB_NAME": "AIRPORT", "REMARK": t}
    both("APT_RMK", "ABC", rmk("A110-2", "DEER ON RWY."), rmk("A110-3", "DEER ON RWY."))
    both("APT_RMK", "ABC", rmk("A110-4", "BIRDS ON AND INVOF ARPT."), rmk("A110-4", "BIRDS ON & INVOF ARPT."))
    both("APT_RMK", "ABC", rmk("A110-9", "RWY 07 CLSD TO JETS."), rmk("A110-9", "RWY 07 OPEN TO JETS."))
    # NEW: a new airport is one line; GON: removed
    both("APT_BASE", "NEW", None, {"ARPT_ID": "NEW", "ARPT_NAME": "FRESH STRIP"})
    both("APT_RWY", "NEW", None, dict(rwy("18/36", "2500"), ARPT_ID="NEW"))
    both("APT_BASE", "GON", {"ARPT_ID": "GON", "ARPT_NAME": "LOST STRIP"}, None)
    # FRQ: CTAF moved to another frequency; a known frequency gains a listing; one loses a use
    frq = lambda f, u: {"SERVICED_FACILITY": "DEF", "FREQ": f, "FREQ_USE": u}
    both("FRQ", "DEF", frq("123.05", "CTAF"), None)
    both("FRQ", "DEF", None, frq("120.425", "CTAF"))
    both("FRQ", "DEF", frq("118.4", "LCL/P"), frq("118.4", "LCL/P"))
    both("FRQ", "DEF", None, frq("118.4", "ALLLN STAR"))
    both("FRQ", "DEF", frq("121.5", "GND/P"), frq("121.5", "GND/P"))
    both("FRQ", "DEF", frq("121.5", "EMERG"), None)
    # ILS with its glideslope; schedule rewritten
    ils = {"ARPT_ID": "DEF", "RWY_END_ID": "28", "ILS_LOC_ID": "NIP", "SYSTEM_TYPE_CODE": "LS", "LOC_FREQ": "109.15"}
    both("ILS_BASE", "DEF", None, ils)
    both("ILS_GS", "DEF", None, {"ARPT_ID": "DEF", "RWY_END_ID": "28", "ILS_LOC_ID": "NIP", "G_S_ANGLE": "3"})
    att = lambda d, h: {"ARPT_ID": "DEF", "SKED_SEQ_NO": "1", "MONTH": "ALL", "DAY": d, "HOUR": h}
    both("APT_ATT", "DEF", att("SAT-SUN", "0700-1900"), att("SAT- SUN", "0700-1900"))
    # procedures and routes
    both("STAR_RTE", "DEF", {"STAR_COMPUTER_CODE": "TTH.TTHOR2", "POINT": "AAA"}, None)
    both("STAR_RTE", "DEF", None, {"STAR_COMPUTER_CODE": "TTH.TTHOR3", "POINT": "BBB", "SEQ_X": "9"})
    pfr = lambda a: {"Orig": "DEF", "Dest": "XYZ", "Type": "L", "Route String": "V1 V2", "Area": a}
    both("PFR_RMT_FMT", "DEF", None, pfr("M"))
    both("PFR_RMT_FMT", "DEF", None, pfr("P"))
    o = spark.createDataFrame(old, SCHEMA).repartition(5)
    n = spark.createDataFrame(new, SCHEMA).repartition(3)
    changes, hidden = publish.publish_pair(o, n, "2026-10-01")
    rows = changes.collect()
    return {(r["entity"], r["summary"]): r for r in rows}, rows


def find(published, entity, start):
    hits = [r for (e, s), r in published[0].items() if e == entity and s.startswith(start)]
    assert len(hits) == 1, (start, [k for k in published[0] if k[0] == entity])
    return hits[0]


def test_new_and_removed_entities_are_one_line(published):
    assert find(published, "NEW", "new airport")["summary"] == "new airport in FAA database: Fresh Strip, runway 18/36 2500x75 ft asph"
    assert find(published, "GON", "airport removed")["priority"] == "action"
    assert sum(r["entity"] == "NEW" for r in published[1]) == 1


def test_runway_renumbering_and_its_ends(published):
    assert find(published, "ABC", "runway 07/25")["summary"] == "runway 07/25 -> 08/26 (renumbered)"
    assert find(published, "ABC", "runway 26")["summary"] == "runway 26: touchdown zone elevation: 137.3 -> 143.1 ft MSL"
    assert not any("07/25 end" in r["summary"] for r in published[1])


def test_rename_is_said_once(published):
    assert find(published, "ABC", "airport name")["priority"] == "fyi"
    hours = find(published, "ABC", "tower hours")
    assert hours["summary"] == "tower hours: 0700-2100 -> 0700-2200 local" and hours["priority"] == "action"


def test_remarks(published):
    assert not any("DEER" in r["summary"] for r in published[1])
    assert find(published, "ABC", "revised remark: BIRDS")["priority"] == "fyi"
    assert find(published, "ABC", "revised remark: RWY 07")["priority"] == "action"


def test_frequencies(published):
    moved = find(published, "DEF", "CTAF frequency")
    assert moved["summary"] == "CTAF frequency: 123.05 -> 120.425"
    assert find(published, "DEF", "frequencies now also listed")["summary"].endswith("arrivals (STARs): 118.4 for ALLLN")
    assert find(published, "DEF", "frequency 121.5 use")["summary"] == "frequency 121.5 use: emergency (EMERG) -> none"


def test_ils_with_parts(published):
    r = find(published, "DEF", "new ILS")
    assert r["summary"] == "new ILS RWY 28 (NIP, 109.15) with glideslope 3°" and r["mismatch"] == []


def test_schedule_spelling_is_fyi(published):
    assert find(published, "DEF", "airport attendance")["priority"] == "fyi"


def test_procedures_and_routes(published):
    p = find(published, "DEF", "arrival/departure procedures")
    assert p["summary"] == "arrival/departure procedures new or updated: TTHOR2 -> TTHOR3"
    r = find(published, "DEF", "preferred IFR routes")
    assert r["summary"] == "preferred IFR routes: 2 added"
    assert r["details"] == ["new preferred IFR route DEF -> XYZ [area M]: V1 V2", "new preferred IFR route DEF -> XYZ [area P]: V1 V2"]


def test_ids_are_unique_and_stable(published):
    ids = [(r["entity"], r["id"]) for r in published[1]]
    assert len(ids) == len(set(ids)) and all(len(i) == 12 for _, i in ids)
