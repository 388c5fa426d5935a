"""Text comparison, term and translation jobs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import glossary as G
from tidemark.operators import phrases as P
from tidemark.operators import translation as TR
from tidemark.session import spread
from workload.core import query_set
from workload.pairs import table

QUERIES, ORACLES, query = query_set()

PLAIN_SQL = ", ".join(f"'{w}'" for w in G.PLAIN_WORDS + G.NEGATIONS)
# One spelling of letters in both engines: ASCII capitals only, other letters stay.


def ascii_upper(c):
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def words_only(c):
    """Letters, digits and joints; everything else is a space (ASCII in both engines)."""
    return F.regexp_replace(ascii_upper(c), "[^A-Z0-9/-]", " ")


# --- T-7 --------------------------------------------------------------------------------------
TERMS_SQL = """
tok AS (SELECT id, unnest(regexp_extract_all(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9/-]', ' ', 'g'), '[A-Z0-9]+(?:[-/][A-Z0-9]+)*')) AS tok FROM src),
term AS (SELECT id, part AS term FROM (SELECT id, unnest(regexp_split_to_array(regexp_replace(tok, '([0-9T]) +X *([0-9])', '\\1 \\2'), '[-/]')) AS part FROM tok) WHERE regexp_full_match(part, '[A-Z]+'))
"""


@query(f"""
WITH src AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {TERMS_SQL}
SELECT id, term, count(*) AS n FROM term GROUP BY ALL""")
def term_extraction(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words_only(F.col("text")).alias("text"))
    return G.term_rows(c, "text", ["id"])


# --- T-8, J-13, A-4 ---------------------------------------------------------------------------
def word_glossary(spark, sf):
    """A glossary from the data: benchmark words are verified by the first list, part names by
    the second, market segments are everyday words."""
    b = table(spark, sf, "benchmark")
    supplement = b.select(F.explode(F.regexp_extract_all(words_only(F.col("text")), F.lit("[A-Z]+"), F.lit(0))).alias("abbr")).distinct().withColumn("meaning", F.lower("abbr"))
    orders = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("abbr")).distinct().select("abbr", F.col("abbr").alias("meaning"), F.lit("A").alias("usage"))
    seg = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("term")).distinct()
    curated = seg.select("term", F.lit(None).cast("string").alias("expansion"), F.array().cast("array<string>").alias("accept"), F.lit(True).alias("english"), F.lit("everyday word").alias("note"))
    return G.build(G.senses(supplement, orders), curated)


@query("""
WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+')) AS term FROM benchmark),
p AS (SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) AS term FROM part),
s AS (SELECT DISTINCT c_mktsegment AS term FROM customer),
u AS (SELECT term FROM b UNION SELECT term FROM p UNION SELECT term FROM s)
SELECT term, term NOT IN (SELECT term FROM s) AS verified, CASE WHEN term IN (SELECT term FROM s) THEN NULL WHEN term IN (SELECT term FROM b) THEN 'CS' ELSE 'JO' END AS source,
  term IN (SELECT term FROM s) AS english FROM u""")
def glossary_build(spark, sf):
    return word_glossary(spark, sf).select("term", "verified", "source", "english")


@query(f"""
WITH src AS (SELECT doc_id AS id, text FROM documents), {TERMS_SQL},
b AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+')) AS term FROM benchmark
  UNION SELECT DISTINCT upper(unnest(string_split(p_name, ' '))) FROM part UNION SELECT DISTINCT c_mktsegment FROM customer),
v AS (SELECT term FROM b WHERE term NOT IN (SELECT c_mktsegment FROM customer)),
d AS (SELECT DISTINCT id, term FROM term WHERE length(term) > 1 AND NOT regexp_full_match(term, '[IVX]+') AND term NOT IN ({PLAIN_SQL})),
suf(s, least) AS (VALUES ('S', 2), ('D', 3), ('ED', 3), ('ING', 3), ('ER', 3), ('LY', 3)),
t AS (SELECT DISTINCT term FROM d WHERE (length(term) <= 3 OR NOT regexp_matches(substr(term, 2), '[AEIOU]')) AND term NOT IN (SELECT term FROM b)
   AND NOT EXISTS (SELECT 1 FROM suf JOIN v ON v.term = substr(d.term, 1, length(d.term) - length(s)) WHERE ends_with(d.term, s) AND length(d.term) - length(s) >= least)),
nm AS (SELECT DISTINCT upper(lang) AS name FROM documents)
SELECT term, count(DISTINCT id) AS texts FROM d WHERE term IN (SELECT term FROM t) AND term NOT IN (SELECT name FROM nm) GROUP BY term""")
def unknown_terms(spark, sf):
    """Terms no list explains, by the number of documents that use them."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    names = d.select(F.upper("lang").alias("name")).distinct()
    texts = d.select(F.col("doc_id").alias("id"), words_only(F.col("text")).alias("text"))
    return G.unknown_term_counts(texts, "text", ["id"], word_glossary(spark, sf), names)


# --- T-6, T-10: many phrases, one splice ------------------------------------------------------
# Phrases that overlap and begin alike; each is replaced by its number.
PHRASES = ("the the of", "and the of", "to the and", "the the", "of the", "and the", "the and", "the of", "of", "de la")
GAP = r"[\s-]+"


def _pattern(phrase: str) -> str:
    return phrase.replace(" ", GAP)


def _numbered_sql(marked: str) -> str:
    for k, phrase in enumerate(PHRASES):
        marked = f"regexp_replace({marked}, '(?i)' || chr(1) || '{_pattern(phrase)}' || chr(2), '<{k}>', 'g')"
    return marked


@query(f"""
WITH m AS (SELECT conv_id, turn, regexp_replace(text, '(?i)\\b({"|".join(map(_pattern, PHRASES))})\\b', chr(1) || '\\1' || chr(2), 'g') AS marked FROM conversations)
SELECT conv_id, turn, {_numbered_sql("marked")} AS rewritten, length(marked) - length(replace(marked, chr(1), '')) AS replaced FROM m""".replace("\\\\", "\\"))
def phrase_rewriting(spark, sf):
    """Overlapping phrases in all turns: the leftmost longest is replaced, and nothing is replaced twice."""
    rules = spark.createDataFrame([(p, f"<{k}>", f"{k:02d}") for k, p in enumerate(PHRASES)], "phrase string, say string, rank string")
    out = P.rewrite(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", rules)
    return out.select("conv_id", "turn", "rewritten", F.col("replaced").cast("bigint").alias("replaced"))


_COUNT = lambda text, pattern: f"len(regexp_extract_all({text}, '(?i)\\b{pattern}\\b'))".replace("\\\\", "\\")
_AFTER, _BEFORE = f"the{GAP}of", f"and{GAP}the"


@query(f"""
WITH p AS (SELECT conv_id * 1000 + turn AS pair, text AS raw, CASE WHEN role = 'assistant' THEN text || ' ' || text ELSE text END AS plain FROM conversations),
c AS (SELECT *, {_COUNT("plain", _AFTER)} AS a, {_COUNT("plain", f"the{GAP}belonging{GAP}to")} AS a_said, {_COUNT("raw", _AFTER)} AS a_raw,
  {_COUNT("plain", _BEFORE + "s?")} AS b, {_COUNT("plain", f"together{GAP}with{GAP}thes?")} AS b_said, {_COUNT("raw", _BEFORE)} AS b_raw FROM p),
d AS (SELECT *, a > 0 AND a + a_said <= a_raw AS due_a, b > 0 AND b + b_said <= b_raw AS due_b FROM c),
m AS (SELECT pair, CASE WHEN due_a AND due_b THEN regexp_replace(plain, '(?i)\\b({_BEFORE}s?|{_AFTER})\\b', chr(1) || '\\1' || chr(2), 'g')
  WHEN due_a THEN regexp_replace(plain, '(?i)\\b({_AFTER})\\b', chr(1) || '\\1' || chr(2), 'g')
  WHEN due_b THEN regexp_replace(plain, '(?i)\\b({_BEFORE}s?)\\b', chr(1) || '\\1' || chr(2), 'g') ELSE plain END AS t FROM d),
w AS (SELECT pair, regexp_replace(t, '(?i)([.!?]\\s*)' || chr(1) || 'and({GAP})(thes?)' || chr(2), '\\1Together with\\2\\3', 'g') AS t FROM m)
SELECT pair, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^([^A-Za-z0-9]*)' || chr(1) || 'and({GAP})(thes?)' || chr(2), '\\1Together with\\2\\3'),
  '(?i)' || chr(1) || 'and({GAP})(thes?)' || chr(2), 'together with\\1\\2', 'g'), '(?i)' || chr(1) || '(the)({GAP})of' || chr(2), '\\1\\2belonging to', 'g') AS plain FROM w""".replace("\\\\", "\\"))
def context_meanings(spark, sf):
    """Words that mean something by others, said so where a text has them no more often than the raw text does."""
    c = table(spark, sf, "conversations")
    pairs = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), F.col("text").alias("raw"),
        F.when(F.col("role") == "assistant", F.concat_ws(" ", "text", "text")).otherwise(F.col("text")).alias("plain"),
    )
    listed = "term string, expansion string, meanings array<string>, verified boolean, source string, note string, accept array<string>, english boolean"
    glossary = spark.createDataFrame([("OF", None, [], False, None, None, [], True), ("AND", None, [], False, None, None, [], False), ("WITH", "together with", ["together with"], True, "CS", None, [], False)], listed)
    after = spark.createDataFrame([("OF", ["THE"], "belonging to")], "term string, near array<string>, meaning string")
    before = spark.createDataFrame([("AND", ["THE"], "WITH")], "term string, near array<string>, form string")
    return TR.in_context(pairs, G.context_rules(glossary, after, before), glossary).select("pair", "plain")


# --- T-7, T-8: what covers what ---------------------------------------------------------------
# A remark for each customer, and the terms of it that no list settles.
REMARKS = {
    "AUTOMOBILE": ("'PHYS ADS ' || k || ' E OSBORN GROVE RD, AKRON, OH 44094-8174. SS-SR'", ("PHYS", "ADS")),
    "BUILDING": ("'RWY ' || k || ' ACCESS RD, 25 FT X 30 FT RD; SR-SS'", ("RWY", "RD", "RD", "FT", "FT", "SR", "SS")),
    "FURNITURE": ("'SEE WWW.X.ORG/RD OR OPS' || k || '@X.ORG PCR 5/R/B/W/T, TX'", ("SEE", "PCR")),
    "MACHINERY": ("'FUEL H24 GTE-' || k || '-A KODIAK AK 99615, BLDG ' || k", ("GTE", "BLDG")),
    "HOUSEHOLD": ("'TRANS ALERT NR LK ' || k || ' NW CIR, QTRS ON OAK BLVD'", ("NR", "LK", "NW", "QTRS", "OAK", "BLVD")),
}
_TERMS_SQL = " UNION ALL ".join(f"SELECT '{seg}' AS seg, '{t}' AS term, {ts.count(t)} AS n" for seg, (_, ts) in REMARKS.items() for t in sorted(set(ts)))


@query(f"""
WITH t AS ({_TERMS_SQL}) SELECT c_custkey AS id, term, CAST(n AS BIGINT) AS n FROM customer JOIN t ON seg = c_mktsegment""")
def term_masks(spark, sf):
    """Hyphenated and numbered terms, addresses, state codes, streets, measurements and a term with a rule."""
    listed = "term string, expansion string, meanings array<string>, verified boolean, source string, note string, accept array<string>, english boolean"
    word = lambda term, meaning: (term, meaning, [meaning], True, "CS", None, [], False)
    base = spark.createDataFrame([word("SUNS", "sunset"), word("SUNR", "sunrise"), word("H24", "continuous operation"), word("TRAN", "transient"), ("TRANS", None, [], False, None, None, [], False)], listed)
    joint = spark.createDataFrame([("SS-SR", ["SUNS", "SUNR"], [r"\bsunset\b.*\bsunrise\b"])], "term string, parts array<string>, accept array<string>")
    glossary = G.with_parts(base, joint)
    before = spark.createDataFrame([("TRANS", ["ALERT"], "TRAN")], "term string, near array<string>, form string")
    rules = G.context_rules(glossary, spark.createDataFrame([], "term string, near array<string>, meaning string"), before)
    c = table(spark, sf, "customer")
    text = F.lit(None).cast("string")
    for seg, (said, _) in REMARKS.items():
        parts = [F.col("c_custkey").cast("string") if x.strip() == "k" else F.lit(x.strip()[1:-1]) for x in said.split("||")]
        text = F.when(F.col("c_mktsegment") == seg, F.concat(*parts)).otherwise(text)
    names = spark.createDataFrame([("ZZZ",)], "name string")
    return G.review_terms(c.select(F.col("c_custkey").alias("id"), text.alias("text")), "text", ["id"], glossary, names, ("OH", "AK", "TX"), rules)


# --- T-9, terms ---------------------------------------------------------------------------------
# What a translation says of a segment's code, by the customer's balance, and what is wrong with it.
SAID = {
    "AUTOMOBILE": ("lane for automobiles", "automobiles wait"), "BUILDING": ("building extended", "builder seen"), "FURNITURE": ("not available", "available"),
    "MACHINERY": ("firefighting hall", "fire seen"), "HOUSEHOLD": ("permitted", "perhaps"),
}
CODES = {"AUTOMOBILE": ("AULN", "automobile lane"), "BUILDING": ("BLDX", "building extension"), "FURNITURE": ("UNAV", "unavailable"), "MACHINERY": ("FRFT", "fire fighting"), "HOUSEHOLD": ("PRMS", "permission")}
_SAID_SQL = " ".join(f"WHEN '{seg}' THEN '{CODES[seg][0]}'" for seg in CODES)


@query(f"""
WITH c AS (SELECT c_custkey AS pair, c_acctbal, CASE c_mktsegment {_SAID_SQL} END AS term FROM customer)
SELECT pair, CASE WHEN c_acctbal >= 3000 AND c_acctbal < 6000 THEN term || ' has a verified meaning the translation does not say' ELSE 'QXZ has no verified meaning; it must stay as written' END AS problem
FROM c WHERE c_acctbal >= 3000
UNION ALL SELECT pair, 'dropped WINDOW' FROM c WHERE c_acctbal >= 8000""")
def translation_term_problems(spark, sf):
    """Codes said with their meaning (as one word, with another ending, denied, as the verb of a noun), not said, or
    copied; an unclear term reworded; a plain word dropped."""
    c = table(spark, sf, "customer")
    seg, bal, number = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey").cast("string")
    choose = lambda values: F.coalesce(*[F.when(seg == s, F.lit(v)) for s, v in values.items()])
    code = choose({s: v[0] for s, v in CODES.items()})
    said = F.when(bal < 3000, choose({s: v[0] for s, v in SAID.items()})).when(bal < 6000, choose({s: v[1] for s, v in SAID.items()})).otherwise(code)
    raw = F.concat(code, F.lit(" GATE "), number, F.lit(" QXZ WINDOW"))
    plain = F.concat(said, F.lit(" gate "), number, F.when(bal < 6000, " QXZ").otherwise(" quartz"), F.when(bal < 8000, " windows").otherwise(""))
    listed = "term string, expansion string, meanings array<string>, verified boolean, source string, note string, accept array<string>, english boolean"
    rows = [(t, m, [m], True, "CS", None, [], False) for t, m in CODES.values()] + [("QXZ", None, [], False, None, "two meanings", [], False)]
    pairs = TR.with_terms(spread(c.select(F.col("c_custkey").alias("pair"), raw.alias("raw"), plain.alias("plain"))), spark.createDataFrame(rows, listed))
    found = TR.term_problems(F.filter("terms", lambda t: ~t["of_code"]), F.col("plain"), TR.plain_words(F.col("plain")), F.lower("plain"))
    return TR.problem_rows(pairs.withColumn("problems", found))


# --- T-9, number part -------------------------------------------------------------------------
def turn_pairs(spark, sf):
    """A user turn and the assistant turn that answers it."""
    c = table(spark, sf, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("raw"))
    answer = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("plain"))
    return user.join(answer, ["conv_id", "turn"]).withColumn("pair", F.col("conv_id") * 1000 + F.col("turn"))


@query(r"""
WITH p AS (SELECT doc_id AS pair, text AS raw, CASE lang WHEN 'en' THEN replace(text, '7', '') WHEN 'de' THEN text || ' 12' ELSE text END AS plain FROM documents),
k AS (SELECT pair, regexp_replace(regexp_replace(regexp_replace(raw, '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g') AS raw,
   regexp_replace(regexp_replace(regexp_replace(plain, '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g'), '([0-9]),([0-9]{3})($|[^0-9])', '\1\2\3', 'g') AS plain FROM p),
n AS (SELECT pair, list_transform(regexp_extract_all(raw, '[0-9]*\.[0-9]+|[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS a,
   list_transform(regexp_extract_all(plain, '[0-9]*\.[0-9]+|[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS b FROM k),
l AS (SELECT pair, unnest(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS v FROM n),
g AS (SELECT pair, unnest(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS v FROM n)
SELECT pair, 'lost number ' || v AS problem FROM l UNION ALL SELECT pair, 'added number ' || v FROM g
UNION ALL SELECT pair, 'numbers moved, dropped or repeated' FROM n WHERE pair NOT IN (SELECT pair FROM l) AND pair NOT IN (SELECT pair FROM g) AND a <> b""")
def translation_numbers(spark, sf):
    """Documents against a copy that lost a digit (English) or gained a number (German)."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    text, lang = F.col("text"), F.col("lang")
    plain = F.when(lang == "en", F.replace(text, F.lit("7"), F.lit(""))).when(lang == "de", F.concat(text, F.lit(" 12"))).otherwise(text)
    return d.select(F.col("doc_id").alias("pair"), F.explode(TR.number_problems(text, plain)).alias("problem"))


@query()
def translation_qa(spark, sf):
    """All checks over every user -> assistant pair."""
    checked = TR.problems(turn_pairs(spark, sf).select("pair", "raw", "plain"), word_glossary(spark, sf))
    return TR.problem_rows(checked)


# --- T-1, T-2, T-4 ----------------------------------------------------------------------------
def line_pairs(spark, sf):
    """Every pair of neighbouring lines of every document, as old and new text."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.size("lines") - 1
    pairs = F.arrays_zip(F.slice("lines", F.lit(1), n).alias("old"), F.slice("lines", F.lit(2), n).alias("new"))
    return d.filter(F.size("lines") > 1).select("doc_id", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "pos", "p.old", "p.new")


@query()
def reworded_pairs(spark, sf):
    """Neighbouring lines: reworded, only a phone changed, or unrelated."""
    old, new = F.col("old"), F.col("new")
    return line_pairs(spark, sf).select(
        "doc_id", "pos", T.reworded(old, new).alias("reworded"), T.phones_only(old, new).alias("phones_only"), T.unrelated(old, new).alias("unrelated")
    )


@query("""
WITH w AS (SELECT source, lang, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z]+'),
   lambda x: CASE x WHEN 'SATURDAY' THEN 'SAT' WHEN 'AFT' THEN 'AFTER' ELSE x END))) AS word FROM documents),
m(word) AS (VALUES ('NOT'), ('NO'), ('NON'), ('ONLY'), ('DAY'), ('SAT'), ('AFTER'), ('DEC'))
SELECT source, lang, word, count(*) AS documents FROM w JOIN m USING (word) GROUP BY ALL""")
def meaning_words(spark, sf):
    """How many documents of a source use a word that changes a meaning."""
    docs = spread(table(spark, sf, "documents").select("source", "lang", "text"))
    words = docs.select("source", "lang", F.explode(T.word_set(ascii_upper(F.col("text")))).alias("word"))
    return words.filter(F.col("word").isin("NOT", "NO", "NON", "ONLY", "DAY", "SAT", "AFTER", "DEC")).groupBy("source", "lang", "word").agg(F.count(F.lit(1)).alias("documents"))


# --- T-14 -------------------------------------------------------------------------------------
@query("""
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS t, o_orderstatus AS s FROM orders),
shown AS (SELECT k, CASE s WHEN 'O' THEN 'order ' || k || ' of ' || c || ' at ' || t WHEN 'F' THEN 'order ' || k || ' at ' || CAST(CAST(round(CAST(t AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE 'order ' || k || ' part 7X' END AS line FROM o)
SELECT CAST(k AS BIGINT) AS order_no, '7X' AS token FROM shown JOIN o USING (k) WHERE s = 'P'""")
def summary_value_check(spark, sf):
    """Summaries may round a value or quote part of it; a token no value has is caught."""
    from tidemark.functions import words as W

    o = table(spark, sf, "orders")
    k, c, t = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    whole = F.round(t.cast("double")).cast("bigint").cast("string")
    line = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("order "), k, F.lit(" of "), c, F.lit(" at "), t))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("order "), k, F.lit(" at "), whole))
        .otherwise(F.concat(F.lit("order "), k, F.lit(" part 7X")))
    )
    rows = o.select(F.col("o_orderkey").alias("order_no"), line.alias("summary"), F.array(k, c, t, whole).alias("values"))
    return rows.select("order_no", F.explode(W.unsupported_tokens(F.col("summary"), F.col("values"))).alias("token"))
