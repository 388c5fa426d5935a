"""Archives through attribution to public changes."""

import zipfile

from tidemark.plans import load, publish

BASE = "ARPT_ID,ICAO_ID,FACILITY_USE_CODE,SITE_TYPE_CODE,ARPT_NAME,LAT_DECIMAL,LONG_DECIMAL\r"


def archive(path, **tables):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in tables.items():
            z.writestr(f"{name}.csv", text)


def write(folder):
    folder.mkdir()
    base = BASE + "ABC,KABC,PU,A,ALPHA,30.0,-90.0\rDEF,KDEF,PU,A,DELTA,40.0,-80.0\r"
    bridge = "ARPT_ID,STAR_COMPUTER_CODE\rABC,AAA.TTHOR2\r"
    point = "STAR_COMPUTER_CODE,POINT_SEQ,POINT\r"
    pfr = "Orig,Dest,Route String,Type\r"
    nav = "NAV_ID,NAV_TYPE,NAME,LAT_DECIMAL,LONG_DECIMAL,FREQ\r"
    frq = "FACILITY,SERVICED_FACILITY,FREQ,FREQ_USE\r"
    archive(
        folder / "2026-09-03_CSV.zip", APT_BASE=base, STAR_APT=bridge, STAR_RTE=point + "AAA.TTHOR2,1,ONE\r", PFR_RMT_FMT=pfr + "ABC,DEF,V1,L\r",
        NAV_BASE=nav + "XYZ,VOR,NEARBY,30.1,-90.0,113.2\r", FRQ=frq + "TWR,ABC,118.4,LCL/P\rFAR,QQQ,119.1,LCL/P\r",
    )
    archive(
        folder / "2026-10-01_CSV.zip", APT_BASE=base.replace("ALPHA", "ALPHA NEW"), STAR_APT=bridge, STAR_RTE=point + "AAA.TTHOR2,1,TWO\r", PFR_RMT_FMT=pfr + "ABC,DEF,V2,L\r",
        NAV_BASE=nav + "XYZ,VOR,NEARBY,30.1,-90.0,114.2\r", FRQ=frq + "TWR,ABC,118.5,LCL/P\rFAR,QQQ,119.2,LCL/P\r",
    )


def test_archives_to_changes(spark, tmp_path):
    write(tmp_path / "in")
    old, new = load.load_pair(spark, str(tmp_path / "in"), "2026-09-03", "2026-10-01")
    got = {(r["file"], r["entity"]) for r in old.collect()}
    assert got == {
        ("APT_BASE", "ABC"), ("APT_BASE", "DEF"), ("STAR_APT", "ABC"), ("STAR_RTE", "ABC"), ("PFR_RMT_FMT", "ABC"), ("PFR_RMT_FMT", "DEF"), ("NAV_BASE", "ABC"), ("FRQ", "ABC"),
    }
    near = [r["row"] for r in old.filter("file = 'NAV_BASE'").collect()]
    assert [r["_NEAR_NM"] for r in near] == ["6"]
    changes, _ = publish.publish_pair(old, new, "2026-10-01")
    told = {(r["entity"], r["source"]) for r in changes.collect()}
    assert {("ABC", "APT_BASE"), ("ABC", "FRQ"), ("ABC", "NAV_BASE"), ("ABC", "STAR/DP"), ("ABC", "PFR"), ("DEF", "PFR")} <= told


def test_strict_rows_name_their_owner(spark):
    ids = spark.createDataFrame([("ABC",)], "entity string")
    rows = spark.createDataFrame([("AWOS", {"ASOS_AWOS_ID": "ABC"}), ("XTRA", {"NOTE": "ABC"})], "file string, row map<string,string>")
    loose, strict = ({(r["file"], r["entity"]) for r in load.attributed(rows, ids, s).collect()} for s in (False, True))
    assert strict <= loose and ("XTRA", "ABC") in loose and ("XTRA", "ABC") not in strict
