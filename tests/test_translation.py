"""Translation checks on short pairs, and the registry contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import glossary as G
from tidemark.operators import phrases as P
from tidemark.operators import translation as TR

GLOSSARY = [
    ("TWR", "tower", ["tower"], True, False), ("CLSD", "closed", ["closed"], True, False), ("RWY", "runway", ["runway"], True, False),
    ("NA", None, [], False, False), ("PPR", "prior permission required", ["prior permission required"], True, False), ("LGT", "light", ["light or lighting"], True, False),
]
PAIRS = [
    ("RWY 05 CLSD.", "Runway 5 closed.", []),
    ("RWY 05 CLSD.", "Runway 6 closed.", ["lost number 5", "added number 6"]),
    ("RWY 05 CLSD.", "Runway 5 open.", ["CLSD has a verified meaning the translation does not say", "added open"]),
    ("RWY NOT LGTD.", "Runway lighted.", ["dropped a negation"]),
    ("DEER ON RWY.", "Deer on runway.", []),
    ("RWY 09 NA.", "Runway 9 not authorized.", ["NA has no verified meaning; it must stay as written", "added a negation", "added authorized"]),
    ("RWY LGTS 1300Z++.", "Runway lights 1300Z.", ["dropped ++"]),
    ("GATE CODE 12#.", "Gate code 12.", ["dropped #"]),
    ("CALL A OR B.", "Call A, B.", ["dropped OR"]),
]


def test_checks(spark):
    schema = "term string, expansion string, meanings array<string>, verified boolean, english boolean"
    g = spark.createDataFrame(GLOSSARY, schema).withColumns({"accept": F.array().cast("array<string>"), "note": F.lit(None).cast("string"), "source": F.lit("CS")})
    pairs = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(PAIRS)], "pair int, raw string, plain string")
    got = {r["pair"]: r["problems"] for r in TR.problems(pairs, g).collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        assert got[i] == want, PAIRS[i]


LISTED = "term string, expansion string, meanings array<string>, verified boolean, source string, note string, accept array<string>, english boolean"


def listed(spark, *words):
    """A glossary of (term, meaning); no meaning for a term without a verified one."""
    return spark.createDataFrame([(t, m, [m] if m else [], bool(m), "CS", None, [], False) for t, m in words], LISTED)


READINGS = [
    # a unit after a number, a word before one, a zone, a side, the kind of a phone line
    ("99FT TREES.", "99 feet trees.", []), ("99FT TREES.", "99 trees.", ["changed 99FT; a code stays as written"]),
    ("RWY12 CLSD.", "Runway 12 closed.", []), ("TWR 1300Z.", "Tower 1300 UTC.", []), ("RWY 18R CLSD.", "Runway 18 right closed.", []),
    ("RWY 18R CLSD.", "Runway 18 left closed.", ["changed 18R; a code stays as written", "added left"]),
    ("CALL C850-283-4244.", "Call commercial 850-283-4244.", []), ("CALL D523-4244.", "Call 523-4244.", ["changed D523; a code stays as written"]),
    # signs and ranges, marks, two phones
    ("TREES +22 FT.", "Trees 22 feet.", ["dropped the sign of +22"]), ("TREES 125 -150 FT.", "Trees 125 to 150 feet.", []), ("DITCH RY 17 -3 FT.", "Ditch runway 17 3 feet.", ["dropped the sign of -3"]),
    ("CALL 901-368-8453/8449.", "Call 901-368-8453 or 901-368-8449.", []), ("GATE 12#*.", "Gate 12.", ["dropped #", "dropped *"]),
    # initials, a number's NO, contracted negations, a pavement code
    ("US ARMY.", "U.S. army.", []), ("SEE CASE NO. 2024.", "See case no. 2024.", []), ("RWY NOT CLSD.", "Runway isn't closed.", []),
    ("PCR 5/R/B/W/T.", "PCR 5/R/B/W/X.", ["changed the pavement code R/B/W/T", "added x"]),
    # lights that are keyed, a numbered term said in words, nouns in -sion, denied words, an address
    ("ACTVT MIRL - CTAF.", "Activate MIRL contact CTAF.", ["says to contact the frequency; keyed lighting means click the mic", "added contact"]),
    ("FUEL H24 9 GAL.", "Fuel continuous operation 9 gal.", []), ("WHEN TWR EXTN.", "When tower extended.", []), ("FUEL UNAVBL.", "Fuel not available.", []),
    ("SEE WWW.A-B.ORG/X.", "See www.a-b.org/x.", []),
]


def test_readings(spark):
    g = listed(
        spark, ("FT", "feet"), ("RWY", "runway"), ("RY", "runway"), ("CLSD", "closed"), ("TWR", "tower"), ("EXTN", "extension"), ("UNAVBL", "unavailable"), ("ACTVT", "activate"), ("H24", "continuous operation"),
        ("GAL", None), ("MIRL", None), ("CTAF", None), ("PCR", None),
    )
    pairs = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(READINGS)], "pair int, raw string, plain string")
    got = {r["pair"]: r["problems"] for r in TR.problems(pairs, g).collect()}
    for i, (_, _, want) in enumerate(READINGS):
        assert got[i] == want, (READINGS[i], got[i])


def test_runway_sides_in_lists(spark):
    cases = [
        ("RWY 33L AND 33C CLSD", "Runways 33 left and 33c closed", "Runways 33L and 33C closed"),
        ("RY 09L/27R", "runway 9 left / 27 Right", "runway 09L / 27R"),
        ("RWY 6R; RWY 6 RIGHT TFC", "runway 6 right; runway 6 right traffic", "runway 6 right; runway 6 right traffic"),
        ("RWY 33C", "the 33 center", "the 33 center"), ("RWY 33C", None, None),
        ("1300Z++ MON", "1300Z++Monday, 99Z++", "1300Z (one hour earlier during daylight saving time) Monday, 99Z++"),
    ]
    df = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(cases)], "i int, raw string, plain string")
    got = {r.i: r.x for r in df.select("i", TR.readable(F.col("raw"), F.col("plain")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_context_meanings_are_counted(spark):
    g = listed(spark, ("HI", "high"), ("TRAN", "transient"), ("TRANS", None)).unionByName(spark.createDataFrame([("PER", None, [], False, None, None, [], True)], LISTED))
    rules = G.context_rules(
        g, spark.createDataFrame([("PER", ["HI", "LOW"], "performance"), ("HI", ["PER"], "never")], "term string, near array<string>, meaning string"),
        spark.createDataFrame([("TRANS", ["ALERT"], "TRAN"), ("TRANS", ["TAXI"], "TRANS")], "term string, near array<string>, form string"),
    )
    assert {(r.term, r.side, r.near, r.meaning) for r in rules.collect()} == {("PER", "after", "HI", "performance"), ("PER", "after", "LOW", "performance"), ("TRANS", "before", "ALERT", "transient")}
    cases = [
        ("HI PER JET", "high PER jet", "high performance jet"), ("HI PER JET", "high PER jet, high performance", "high PER jet, high performance"),
        ("TRANS ALERT SVC", "TRANS ALERT: service", "Transient alert: service"), ("TRANS ALERT SVC", "Call. Trans alerts", "Call. Transient alerts"), ("15 PER NIGHT", "15 per night", "15 per night"),
    ]
    pairs = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(cases)], "pair int, raw string, plain string")
    got = {r.pair: r.plain for r in TR.in_context(pairs, rules, g).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]
    checked = {r.pair: r.problems for r in TR.problems(pairs.filter("pair in (0, 2)").withColumn("plain", F.when(F.col("pair") == 0, "High performance jet").otherwise("Transition alert svc")), g, rules).collect()}
    assert checked[0] == [] and checked[2][0] == "TRANS is transient there, not what the translation says"


def test_glossary_of_parts_and_spellings(spark):
    g = listed(spark, ("SS", "sunset"), ("SR", "sunrise"), ("APCH", "approach"), ("NA", None))
    g = G.with_parts(g, spark.createDataFrame([("SS-SR", ["SS", "SR"], ["sunset.*sunrise"]), ("SS-NA", ["SS", "NA"], ["x"])], "term string, parts array<string>, accept array<string>"))
    g = G.with_spellings(g, spark.createDataFrame([("APRCH", "APCH"), ("SS", "APCH"), ("NAA", "NA")], "term string, form string"))
    got = {r.term: (r.verified, r.expansion, r.source) for r in g.collect()}
    assert got["SS-SR"] == (True, "sunset to sunrise", "SS (CS) + SR (CS)") and got["SS-NA"][0] is False and got["APRCH"] == (True, "approach", "CS, spelled APCH") and "NAA" not in got and got["SS"][1] == "sunset"
    pairs = spark.createDataFrame([(1, "OPEN SS-SR", "Open sunset to sunrise"), (2, "OPEN SS-SR", "Open sunrise to sunset"), (3, "ARR/DEP APRCH", "ARR/DEP approach")], "pair int, raw string, plain string")
    got = {r.pair: r.problems for r in TR.problems(pairs, g).collect()}
    assert got[1] == [] and got[2] == ["SS-SR has a verified meaning the translation does not say"] and got[3] == []


def test_postal_words_are_no_terms(spark):
    cases = [
        ("ADS: 38550 JET CENTER DR, WILLOUGHBY, OH 44094-8174.", "ADS: 38550 JET CENTER   WILLOUGHBY,   44094-8174."), ("25 FT RD", "25 FT RD"), ("RWY 18 ACCESS RD, X", "RWY 18 ACCESS RD, X"),
        ("7400 E OSBORN RD SCOTTSDALE, OH", "7400 E OSBORN   SCOTTSDALE,  "), ("KODIAK OH 99615", "KODIAK   99615"), ("OH BOY", "OH BOY"), (None, None), ("", ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    from tidemark.functions.text import lit_array

    got = {r.i: r.x for r in df.select("i", G.without_postal_words(F.col("text"), lit_array(["OH"])).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_phrases_are_replaced_once_and_longest_first(spark):
    rules = spark.createDataFrame([("a b", "X", "2"), ("b c", "Y", "1"), ("a b c", "Z", "3"), ("b", "a", "4"), ("a-b", "W", "1"), ("", "no", "0")], "phrase string, say string, rank string")
    cases = [("A b C, b", "Z, a", 2), ("a  b d", "W d", 1), ("xb b1 a-b", "xb b1 W", 1), ("straße b", "straße a", 1), ("b.c", "a.c", 1), ("", "", 0), (None, None, 0), ("!?", "!?", 0)]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, text string")
    got = {r.i: (r.rewritten, r.replaced) for r in P.rewrite(df, ["i"], "text", rules).collect()}
    assert [got[i] for i in range(len(cases))] == [(x, n) for _, x, n in cases]
    assert P.rewrite(df, ["i"], "text", rules.limit(0)).filter("replaced > 0").count() == 0


def test_glossary_senses(spark):
    cs = spark.createDataFrame([("lgt, lgtd", "light, lighted"), ("fm", "Fan Marker, Frequency Modulation"), ("bcn", "beacon")], "abbr string, meaning string")
    jo = spark.createDataFrame([("BCN", "Rotating Light or Beacon", "A"), ("GOV", "governor", "A"), ("WX", "weather", "M")], "abbr string, meaning string, usage string")
    none = spark.createDataFrame([("GOV", "", [], False, "cleared")], "term string, expansion string, accept array<string>, english boolean, note string")
    got = {r["term"]: (r["verified"], r["source"], len(r["meanings"])) for r in G.build(G.senses(cs, jo), none).collect()}
    assert got == {"LGT": (True, "CS", 1), "LGTD": (True, "CS", 1), "FM": (False, None, 0), "BCN": (True, "CS", 2), "GOV": (False, None, 0), "WX": (False, None, 0)}


def test_readable(spark):
    row = spark.range(1).select(
        TR.readable(F.lit("TWR 1300-0500Z++ RWY 33C"), F.lit("Tower 1300-0500Z++, runway 33 Center")).alias("x"), TR.readable(F.lit("RWY 6 RIGHT TFC"), F.lit("runway 6 right traffic")).alias("y"),
    ).first()
    assert row["x"] == "Tower 1300-0500Z (one hour earlier during daylight saving time), runway 33C" and row["y"] == "runway 6 right traffic"


def test_every_oracle_has_its_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
