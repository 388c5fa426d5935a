"""Work that has to stay in proportion to the input: held against plain versions, and counted."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config.rules import UNRELATED_RATIO
from tidemark.functions import text as T
from tidemark.functions import tokens as K
from tidemark.operators import collapse, glossary, greedy, pairing, places


# --- nearest -----------------------------------------------------------------------------------
def test_dense_targets_are_searched_in_small_rings(spark):
    rnd = random.Random(1)
    around = lambda n, wide: [(i, 40 + rnd.uniform(-wide, wide), -80 + rnd.uniform(-wide, wide)) for i in range(n)]
    points = spark.createDataFrame(around(60, 0.6) + [(100, 40.0, -80.0), (101, 40.0, -80.0)], "p long, lat double, lon double")
    targets = spark.createDataFrame(around(2000, 0.5) + [(5000 + i, 40.0, -80.0) for i in range(9)], "entity long, lat double, lon double")
    from tidemark.functions import geo

    both = points.crossJoin(targets.withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"}))
    nm = both.select("p", "entity", geo.nautical_miles(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("nm")).filter("nm <= 30").collect()
    want = {}
    for r in sorted(nm, key=lambda r: (r.p, r.nm, r.entity)):
        want.setdefault(r.p, []).append(r.entity)
    got = {}
    for r in places.nearest_within(points, targets, 30.0, 5).orderBy("p", "rank").collect():
        got.setdefault(r.p, []).append(r.entity)
    assert got == {p: e[:5] for p, e in want.items()}
    spots, homes = points.select("lat", "lon").distinct(), targets.select("entity", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    rings = places._rings(spots, homes, 30.0)
    assert rings[-1] == 30.0 and len(rings) > 1
    assert places._hits(spots, homes, rings[0]).count() * 4 < len(nm)


# --- strips ------------------------------------------------------------------------------------
def plain_strips(old, new):
    gap = lambda a, b: min(abs(a - b), 36 - abs(a - b))
    edges = []
    for i, (e, n, size) in old.items():
        for j, (f, m, other) in new.items():
            if e == f and (gap(n, m) == 1 or size == other):
                edges.append((gap(n, m) > 1, size != other, i, j))
    left, right, out = set(), set(), set()
    for _, _, i, j in sorted(edges):
        if i not in left and j not in right:
            left.add(i), right.add(j), out.add((i, j))
    return out


@pytest.mark.parametrize("cell", [50_000, 24])
def test_strips_choose_by_labels(spark, monkeypatch, cell):
    rnd = random.Random(5)
    monkeypatch.setattr(pairing.assign_by_labels, "__defaults__", (cell,))
    rows = [(rnd.choice("AB"), rnd.choice(["removed", "added"]), f"{rnd.randrange(1, 37):02d}", str(rnd.randrange(1000, 1008)), k) for k in range(160)]
    df = spark.createDataFrame(rows, "entity string, kind string, rwy string, len string, k int")
    row = F.create_map(*[x for n, c in {"RWY_ID": F.col("rwy"), "RWY_LEN": F.col("len"), "RWY_WIDTH": F.lit("75"), "NOTE": F.col("k").cast("string")}.items() for x in (F.lit(n), c)])
    records = collapse.event(df, entity=F.col("entity"), source=F.lit("APT_RWY"), kind=F.col("kind"), priority=F.lit("action"), row=row).localCheckpoint()
    told = {r.rid: (r.kind, (r.entity, int(r.row["RWY_ID"]), r.row["RWY_LEN"])) for r in records.collect()}
    side = lambda kind: {k: v for k, (s, v) in told.items() if s == kind}
    got = {(r.old_rid, r.new_rid) for r in collapse.runway_pairs(records).filter("renumbered").collect()}
    assert got == plain_strips(side("removed"), side("added"))


# --- remarks -----------------------------------------------------------------------------------
def test_remarks_said_once_meet_their_groups_in_one_join(spark):
    rows = [("X", "APT_RMK", "added", "BIRDS"), ("X", "FRQ", "changed", "BIRDS."), ("X", "FRQ", "changed", "DEER"), ("Y", "FRQ", "changed", "BIRDS"), (None, "FRQ", "changed", "BIRDS"), ("X", "ILS", "added", "BIRDS")]
    df = spark.createDataFrame(rows, "e string, s string, k string, t string")
    edit = F.array(F.struct(F.lit("REMARK").alias("field"), F.lit("").alias("old"), F.col("t").alias("new")))
    records = collapse.event(df, entity=F.col("e"), source=F.col("s"), kind=F.col("k"), priority=F.when(F.col("t").endswith("."), "action").otherwise("fyi"),
        fields=F.when(F.col("k") == "changed", edit).otherwise(F.array().cast(collapse.FIELD)), row=F.when(F.col("k") == "added", F.create_map(F.lit("REMARK"), F.col("t"))))
    out = collapse.said_once(records)
    assert out.columns == records.columns
    assert sorted((r.entity or "", r.source, r.priority) for r in out.collect()) == [("", "FRQ", "fyi"), ("X", "APT_RMK", "action"), ("X", "FRQ", "fyi"), ("X", "ILS", "fyi"), ("Y", "FRQ", "fyi")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_unlike_remarks_are_not_compared_one_by_one(monkeypatch):
    entry = lambda said, stem: greedy.Entry(said, ("C",), False, frozenset(), True, said, frozenset([stem]))
    olds = [entry(f"GGG {chr(0x3B1 + k)}{chr(0x3B2 + k)}", "GGG") for k in range(8)]
    news = [entry(f"BB {chr(0x430 + k)}{chr(0x431 + k)}{chr(0x432 + k)}", "BB") for k in range(12)] + [entry(f"GGG {chr(0x3B1 + k)} AGAIN", "GGG") for k in range(5)]
    cell = greedy.Cell(olds, news, 1, 0.5)
    assert cell.pairs([]) == [(k, 12 + k) for k in range(5)]
    assert len(cell.alike) == 0  # letters alone tell them apart


def test_ratio_is_that_of_difflib():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("ABCDE ", k=rnd.choice([0, 1, 5, 30, 220]))) for _ in range(60)]
    for a in texts:
        for b in texts[::3]:
            for bar in (0.35, 0.6):
                assert T.reaches(a, b, bar) == (difflib.SequenceMatcher(None, a, b).ratio() >= bar)


def test_letters_settle_a_ratio(monkeypatch):
    monkeypatch.setattr(T.difflib, "SequenceMatcher", None)
    assert not T.reaches("ABAB", "CDCDCD", 0.35) and not T.reaches("A", "AAAAAAAAAA", 0.35)


# --- terms -------------------------------------------------------------------------------------
def counted(spark, texts):
    """Texts that count how often they are read."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return read, df.select("id", told.asNondeterministic()(F.col("text")).alias("text"))


LISTED = "term string, expansion string, meanings array<string>, verified boolean, source string, note string, accept array<string>, english boolean"
TEXTS = ["TWY QXZ CLSD 25 X 30", "PCR 5/R/B/W/T RWY 12 QXZ QXZ", "A-B/C RWY4 X9 XX 7", "12 OAK GROVE RD, AKRON, OH 44094", None, ""]


def test_texts_are_cut_into_terms_once(spark):
    rows = [("QXZ", None, [], False, None, None, [], False), ("SS-SR", "x", ["x"], True, "CS", None, [], False)]
    g, names = spark.createDataFrame(rows, LISTED).localCheckpoint(), spark.createDataFrame([("ZZZ",)], "name string")
    read, texts = counted(spark, TEXTS)
    got = {r.term: r.texts for r in glossary.unknown_term_counts(texts, "text", ["id"], g, names).collect()}
    assert read.value == len(TEXTS) and got["QXZ"] == 2 and "TWY" in got
    read, texts = counted(spark, TEXTS)
    got = {(r.id, r.term): r.n for r in glossary.review_terms(texts, "text", ["id"], g, names, ("OH",)).collect()}
    assert read.value == len(TEXTS) and got[1, "QXZ"] == 2 and not {(3, "RD"), (3, "OH")} & set(got)


def test_terms_are_the_alphabetic_parts_of_compounds(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "É-A//B- 4X4 RX2 R/B/W/T/", "x 10\tX\t5", "AX 7 HTTP://A.B/C D@E F"]], "t string")
    plain = F.filter(F.flatten(F.transform(K.compounds(K.masked(F.col("t"))), K.parts_of)), K.alphabetic)
    for r in df.select("t", glossary.term_array(F.col("t")).alias("got"), plain.alias("want")).collect():
        assert r.got == r.want, r.t
