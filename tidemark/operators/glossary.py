"""The glossary: building it, looking terms up, and finding what it lacks
(T-6, T-7, T-8, J-13, A-4, A-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tokens as K
from tidemark.functions.text import let, lit_array
from tidemark.operators import phrases as P
from tidemark.operators.skew import first_per_key
from tidemark.session import broadcast_if_bounded, cut_lineage

# --- Fixed values ---------------------------------------------------------------------------
PLAIN_WORDS = (
    "A", "AN", "THE", "OF", "TO", "IN", "ON", "AT", "BY", "FOR", "WITH", "FROM", "INTO", "ONTO", "AND", "OR", "AS",
    "IS", "ARE", "BE", "BEEN", "BEING", "WAS", "WERE", "IT", "ITS", "THIS", "THAT", "THESE", "THOSE", "THEN", "THAN",
    "THERE", "WHICH", "WHO", "IF", "SO", "HAS", "HAVE", "HAD", "DO", "DOES", "WILL", "SHALL", "ALSO", "PLEASE", "MISC",
)
NEGATIONS = ("NOT", "NO", "NON", "NONE", "NEVER", "CANNOT", "WITHOUT", "NOR", "UNLESS")
FILLER = ("and", "the", "for", "with", "from", "into", "not")
SUFFIXES = ("S", "D", "ED", "ING", "ER", "LY")
STREET_WORDS = ("AVE", "BLVD", "CIR", "CT", "DR", "HWY", "LN", "PKWY", "PL", "RD", "ST", "TER", "TRL", "WAY")
MEASURES = (
    "FT", "FEET", "FOOT", "NM", "SM", "MI", "MILE", "MILES", "IN", "LB", "LBS", "KT", "KTS", "DEG", "DEGS", "MIN", "MINS", "HR", "HRS", "M", "YD", "YDS",
    "AGL", "MSL", "X", "OF", "AND", "TO", "FM", "FROM", "ON", "AT",
)
PAVED = ("RWY", "RY", "TWY")
# --------------------------------------------------------------------------------------------


def tidy(text: Column) -> Column:
    """List text with plain hyphens and no soft hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "­", ""), "[‐-—]", "-"))


def meaning_words(meaning: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(meaning), "-", ""), r"\(.*?\)", " ")
    t = F.replace(F.replace(t, F.lit("centre"), F.lit("center")), F.lit("metre"), F.lit("meter"))
    return F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))


def related(a: Column, b: Column) -> Column:
    """Two meanings share a word, give or take its ending."""
    content = lambda m: F.filter(meaning_words(m), lambda w: (F.length(w) > 2) & ~F.array_contains(lit_array(FILLER), w))
    shortest = lambda x, y: F.least(F.length(x), F.length(y))
    # long words share five letters, or all but the last of either
    need = lambda x, y: F.greatest(F.lit(1), F.least(F.lit(5), shortest(x, y) - 1))
    long_share = lambda x, y: (shortest(x, y) >= 4) & (F.substring(x, F.lit(1), need(x, y)) == F.substring(y, F.lit(1), need(x, y)))
    touch = lambda x, y: x.startswith(y) | y.startswith(x) | long_share(x, y)
    return F.exists(content(a), lambda x: F.exists(content(b), lambda y: touch(x, y)))


def senses(supplement: DataFrame, orders: DataFrame) -> DataFrame:
    """T-6: ``term, meaning, source, usage`` from two lists ``(abbr, meaning[, usage])``. Paired
    abbreviations ('lgt, lgtd' = 'light, lighted') are split side by side."""
    keys = F.transform(F.split(tidy(F.col("abbr")), r",\s*|\s+or\s+"), F.upper)
    parts = F.transform(F.split(tidy(F.col("meaning")), ","), F.trim)
    both = (F.size(keys) > 1) & (F.size(parts) == F.size(keys))
    whole = F.transform(keys, lambda k: F.struct(k.alias("term"), tidy(F.col("meaning")).alias("meaning")))
    split = F.zip_with(keys, parts, lambda k, p: F.struct(k.alias("term"), p.alias("meaning")))
    cs = supplement.select(F.explode(F.when(both, split).otherwise(whole)).alias("s")).select("s.term", "s.meaning", F.lit("CS").alias("source"), F.lit(None).cast("string").alias("usage"))
    jo = orders.select(F.upper(tidy(F.col("abbr"))).alias("term"), tidy(F.col("meaning")).alias("meaning"), F.lit("JO").alias("source"), "usage")
    return cs.unionByName(jo)


def build(found: DataFrame, curated: DataFrame, used: tuple[str, ...] = ("A", "N")) -> DataFrame:
    """T-6: ``term, expansion, meanings, verified, source, note, english``.

    A term is verified when the first list gives it one sense (else when the second does, in a
    used field). ``curated(term, expansion, accept, english, note)`` overrides; provenance stays
    as columns. The lists are glossaries, a few thousand rows, so a term's senses are few.
    """
    own = F.when(F.col("source") == "CS", F.struct(F.col("meaning").alias("m")))
    also = F.when((F.col("source") == "JO") & F.col("usage").isin(*used), F.struct(F.col("meaning").alias("m")))
    per = found.groupBy("term").agg(
        F.transform(F.array_sort(F.collect_set(own)), lambda s: s["m"]).alias("cs"),
        F.transform(F.array_sort(F.collect_set(also)), lambda s: s["m"]).alias("jo"),
    )
    base = F.when(F.size("cs") > 0, F.col("cs")).otherwise(F.col("jo"))
    per = per.withColumn("base", base)
    parts = F.filter(F.flatten(F.transform("base", lambda m: F.split(m, r",(?![^()]*\))\s*"))), lambda p: F.trim(p) != "")
    one = let(parts, lambda p: F.forall(p, lambda q: (q == p[0]) | related(p[0], q)))
    agreeing = F.filter("jo", lambda m: related(m, F.col("base")[0]))
    per = per.select(
        "term", F.try_element_at("base", F.lit(1)).alias("first"),
        ((F.size("base") > 0) & F.coalesce(one, F.lit(False))).alias("single"),
        F.array_distinct(F.concat("base", F.when(F.size("cs") > 0, agreeing).otherwise(F.array().cast("array<string>")))).alias("all"),
        F.when(F.size("cs") > 0, "CS").when(F.size("jo") > 0, "JO").alias("source"), (F.size("base") == 0).alias("none"),
    )
    c = curated.select("term", F.lit(True).alias("is_curated"), *[F.col(x).alias(f"c_{x}") for x in ("expansion", "accept", "english", "note")])
    j = per.join(c, "term", "full_outer")
    chosen, english = F.col("c_expansion"), F.coalesce("c_english", F.lit(False))
    cleared = F.col("is_curated") & (chosen == "")
    verified = ~english & ~F.coalesce(cleared, F.lit(False)) & (F.coalesce(chosen != "", F.lit(False)) | F.coalesce("single", F.lit(False)))
    return j.select(
        "term",
        F.when(verified, F.coalesce(F.nullif(chosen, F.lit("")), F.col("first"))).alias("expansion"),
        F.when(verified, F.when(F.coalesce(chosen != "", F.lit(False)), F.array(chosen)).otherwise(F.col("all"))).otherwise(F.array().cast("array<string>")).alias("meanings"),
        verified.alias("verified"), F.when(verified, F.coalesce("source", F.lit("curated"))).alias("source"),
        F.coalesce("c_note", F.when(F.col("none"), "only a meaning from another field").when(~F.coalesce("single", F.lit(True)), "more than one meaning listed")).alias("note"),
        F.coalesce("c_accept", F.array().cast("array<string>")).alias("accept"), english.alias("english"),
    )


def with_parts(glossary: DataFrame, joint: DataFrame) -> DataFrame:
    """T-6: ``glossary`` with terms made of others, ``joint(term, parts, accept)``: verified if all their parts
    are, said as 'one to the other'; a translation says them only by their accepted patterns."""
    told = glossary.select(F.col("term").alias("part"), F.col("verified").alias("sure"), F.col("expansion").alias("says"), F.col("source").alias("of"))
    per = joint.select("term", "accept", F.posexplode("parts").alias("k", "part")).join(told, "part", "left")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"])
    own = per.groupBy("term").agg(
        F.bool_and(F.coalesce("sure", F.lit(False))).alias("verified"), F.array_join(ordered(F.col("says")), " to ").alias("expansion"),
        F.array_join(ordered(F.concat(F.col("part"), F.lit(" ("), F.col("of"), F.lit(")"))), " + ").alias("source"), F.any_value("accept").alias("accept"),
    )
    none = F.array().cast("array<string>")
    new = own.select(
        "term", F.when(F.col("verified"), F.col("expansion")).alias("expansion"), none.alias("meanings"), "verified", F.when(F.col("verified"), F.col("source")).alias("source"),
        F.when(~F.col("verified"), "a part has no verified meaning").alias("note"), F.when(F.col("verified"), F.coalesce("accept", none)).otherwise(none).alias("accept"), F.lit(False).alias("english"),
    )
    return glossary.join(new, "term", "left_anti").unionByName(new)


def with_spellings(glossary: DataFrame, spellings: DataFrame) -> DataFrame:
    """T-6: ``glossary`` with ``spellings(term, form)`` of verified terms; a spelling takes the form's meaning
    and says so. One of a term that is listed itself, or of a form that is not verified, is not taken."""
    base = glossary.filter(F.col("verified") & (F.size("meanings") > 0)).withColumnRenamed("term", "form")
    new = spellings.select("term", "form").join(base, "form").join(glossary.select("term"), "term", "left_anti")
    new = new.withColumns({"source": F.concat("source", F.lit(", spelled "), F.col("form")), "note": F.concat(F.lit("the list writes "), F.col("form"))})
    return glossary.unionByName(new.select(*glossary.columns))


def context_rules(glossary: DataFrame, after: DataFrame, before: DataFrame) -> DataFrame:
    """T-6: ``rule, term, side, near, meaning`` of the rules that hold, a row for each near word.

    ``after(term, near, meaning)``: an everyday word that means something right after some words; it has to be
    listed as one. ``before(term, near, form)``: a term without a verified meaning that takes a verified
    form's right before some words.
    """
    english = glossary.filter("english").select("term")
    right_after = after.join(english, "term", "left_semi").select("term", F.lit("after").alias("side"), "near", "meaning")
    forms = glossary.filter(F.col("verified") & (F.size("meanings") > 0)).select(F.col("term").alias("form"), F.col("expansion").alias("meaning"))
    opens = glossary.filter(~F.col("verified") & ~F.col("english")).select("term")
    right_before = before.join(forms, "form").join(opens, "term", "left_semi").select("term", F.lit("before").alias("side"), "near", "meaning")
    both = right_after.unionByName(right_before)
    return both.select(F.md5(F.to_json(F.struct("term", "side", "meaning"))).alias("rule"), "term", "side", F.explode("near").alias("near"), "meaning").distinct()


def context_counts(texts: DataFrame, text: str, key: list[str], rules: DataFrame) -> DataFrame:
    """``key.., rule, term, n_raw``: how often a text has a rule's term right by one of its words."""
    there = F.when(F.col("side") == "after", F.concat_ws(" ", "near", "term")).otherwise(F.concat_ws(" ", "term", "near"))
    phrases = rules.select(P.spelled(there).alias("phrase"), "rule", "term").distinct()
    return P.matches(texts, key, text, phrases).groupBy(*key, "rule", "term").agg(F.count(F.lit(1)).alias("n_raw"))


def term_array(text: Column) -> Column:
    """T-7 without a glossary: the words of a text, numbers aside: whole alphabetic tokens, and the alphabetic
    parts of tokens joined by '-' or '/'. Those are the runs of letters that no digit touches."""
    return F.regexp_extract_all(K.masked(text), F.lit("(?<![A-Z0-9])[A-Z]++(?![0-9])"), F.lit(0))


def term_rows(texts: DataFrame, text: str, key: list[str], glossary: DataFrame | None = None) -> DataFrame:
    """T-7 as rows: ``key.., term, n``; counts combine map-side.

    With a ``glossary``, a joined or numbered token that it knows (SS-SR, H24) is a term as a whole: the
    token covers its parts. What a mask covers (addresses, pavement codes, dimensions) is no term.
    """
    if glossary is None:
        found = texts.select(*key, F.explode(term_array(F.col(text))).alias("term"))
    else:
        # Read twice below; texts are cut into tokens once.
        tokens = cut_lineage(texts.select(*key, F.explode(K.compounds(K.masked(F.col(text)))).alias("token")))
        joint = glossary.filter(~K.alphabetic(F.col("term"))).select("term")
        forms = tokens.filter(~K.alphabetic(F.col("token"))).select(F.col("token").alias("term")).distinct()
        whole = lookup(forms, glossary.join(joint, "term", "left_semi")).filter("entry is not null").select(F.col("term").alias("token"), F.lit(True).alias("whole"))
        cover = F.when(F.col("whole"), F.array("token")).otherwise(F.filter(K.parts_of(F.col("token")), K.alphabetic))
        found = tokens.join(broadcast_if_bounded(whole), "token", "left").select(*key, F.explode(cover).alias("term"))
    return found.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


# --- T-8: what is a name and no contraction -----------------------------------------------------
def without_postal_words(text: Column, states: Column) -> Column:
    """A text in capitals less the street words and states of postal addresses.

    A street word counts behind a house number and one to three names, before a comma, the end or a city and
    its state; a measurement or a runway's number is no house. A state counts after a city and a comma
    before a ZIP code or the end, or between a city and a ZIP code.
    """
    bare = lambda w: F.rtrim(w, F.lit(".,;"))

    def postal(v: Column) -> Column:
        said = lambda k: F.when(k >= 0, F.coalesce(F.get(v["bare"], k), F.lit(""))).otherwise("")
        whole = lambda k: F.when(k >= 0, F.coalesce(F.get(v["words"], k), F.lit(""))).otherwise("")
        last = lambda k: k == F.size(v["words"]) - 1
        stops = lambda k: whole(k).endswith(",") | whole(k).endswith(";")
        state = lambda k: F.array_contains(states, said(k))
        zip_code = lambda k: said(k).rlike("^[0-9]{5}(-[0-9]{4})?$")
        city = lambda k: said(k).rlike("[A-Z]$")
        of_state = lambda k: state(k) & (k > 0) & ((whole(k - 1).endswith(",") & (zip_code(k + 1) | last(k))) | (city(k - 1) & ~stops(k - 1) & zip_code(k + 1)))
        house = lambda k: said(k).rlike("^[NSEW]?[0-9]{1,6}[A-Z]?$") & ~said(k - 1).isin(*PAVED) & ~stops(k)
        name = lambda k: (said(k).rlike("^[A-Z][A-Z'.-]+$") & ~said(k).isin(*MEASURES) | said(k).rlike("^[0-9]+(?:ST|ND|RD|TH)$")) & ~stops(k)
        side = lambda k: said(k).isin("N", "S", "E", "W")
        # The names between the house and its street word, one to three, after a side or none.
        behind = lambda k, n: F.when(house(k - n - 1), True).otherwise(side(k - n - 1) & house(k - n - 2))
        named = lambda k: (name(k - 1) & behind(k, 1)) | (name(k - 1) & name(k - 2) & behind(k, 2)) | (name(k - 1) & name(k - 2) & name(k - 3) & behind(k, 3))
        before_city = lambda k: state(k + 2) | state(k + 3) | state(k + 4)
        street = lambda k: said(k).isin(*STREET_WORDS) & (stops(k) | last(k) | before_city(k)) & named(k)
        return F.array_join(F.transform(v["words"], lambda w, k: F.when(street(k) | of_state(k), " ").otherwise(w)), " ")

    # Only these stretches can be a house and its street, or a state: other texts stay as they are.
    house = "(?:^| )[NSEW]?[0-9]{1,6}[A-Z]?[.,;]* (?:[^ ]+ ){1,4}(?:" + "|".join(STREET_WORDS) + ")[.,;]*(?: |$)"
    place = " [^ ]+ [0-9]{5}(?:-[0-9]{4})?[.,;]*(?: |$)|, [^ ]+$"
    judged = lambda t: let(F.split(t, " "), lambda w: let(F.struct(w.alias("words"), F.transform(w, bare).alias("bare")), postal))
    flat = F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))
    return let(flat, lambda t: F.when(t.rlike(house) | ((F.size(states) > 0) & t.rlike(place)), judged(t)).otherwise(t))


def looks_contracted(term: Column) -> Column:
    """No vowel after the first letter, or a short code."""
    return (F.length(term) <= 3) | ~F.substring(term, F.lit(2), F.length(term)).rlike("[AEIOU]")


def lookup(terms: DataFrame, glossary: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """J-13: each row's glossary entry, of the term itself or of a verified root plus suffix
    (the longest root first). The glossary is broadcast after its size is checked."""
    t = F.col("term")
    forms = [F.struct(F.lit(0).alias("cut"), t.alias("root"))]
    for s in suffixes:
        forms.append(F.when(t.endswith(s) & (F.length(t) >= len(s) + (2 if s == "S" else 3)), F.struct(F.lit(len(s)).alias("cut"), F.substring(t, F.lit(1), F.length(t) - len(s)).alias("root"))))
    distinct = terms.select("term").distinct().select("term", F.explode(F.filter(F.array(*forms), lambda f: f.isNotNull())).alias("f"))
    entries = broadcast_if_bounded(glossary.withColumnRenamed("term", "root"))
    hits = distinct.select("term", "f.cut", "f.root").join(entries, "root").filter((F.col("cut") == 0) | F.col("verified"))
    best = first_per_key(hits, ["term"], [F.col("cut")]).withColumnRenamed("root", "entry").drop("cut")
    return terms.join(best, "term", "left")


def review_terms(texts: DataFrame, text: str, key: list[str], glossary: DataFrame, names: DataFrame, states: tuple[str, ...] = (), rules: DataFrame | None = None) -> DataFrame:
    """T-8: terms a translation must leave as written, less known names and the words of postal
    addresses. ``names(name)`` is a list of ids, ``states`` the state codes, ``rules`` as of
    :func:`context_rules`: a term that has a meaning wherever the text has it is settled."""
    left = _left_open(cut_lineage(open_terms(texts, text, key, states, glossary)), glossary, names).select(*key, "term", "n")
    if rules is None:
        return left
    told = context_counts(texts, text, key, rules).groupBy(*key, "term").agg(F.sum("n_raw").alias("told"))
    return left.join(told, [*key, "term"], "left").filter(F.coalesce("told", F.lit(0)) < F.col("n")).drop("told")


def open_terms(texts: DataFrame, text: str, key: list[str], states: tuple[str, ...] = (), glossary: DataFrame | None = None) -> DataFrame:
    """T-8's candidates, ``key.., term, n``: no plain words, single letters or Roman numbers, and nothing
    out of an address."""
    open_text = texts.withColumn("__t", without_postal_words(F.col(text), lit_array(states)))
    return term_rows(open_text, "__t", key, glossary).filter(_may_be_open(F.col("term")))


def _may_be_open(term: Column) -> Column:
    return ~term.isin(*PLAIN_WORDS, *NEGATIONS) & (F.length(term) > 1) & ~term.rlike("^[IVX]+$")


def _left_open(rows: DataFrame, glossary: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose term the glossary does not settle and the names do not list."""
    known = lookup(rows, glossary)
    unsettled = known.filter(F.when(F.col("entry").isNotNull(), ~F.col("verified") & ~F.col("english")).otherwise(looks_contracted(F.col("term"))))
    unlisted = unsettled.join(broadcast_if_bounded(names.select(F.col("name").alias("term"), F.lit(True).alias("named")).distinct()), "term", "left")
    return unlisted.filter(F.col("named").isNull() | F.col("entry").isNotNull())


def unknown_term_counts(texts: DataFrame, text: str, key: list[str], glossary: DataFrame, names: DataFrame, states: tuple[str, ...] = ()) -> DataFrame:
    """A-4 over T-8: ``term, texts``: in how many texts each term occurs that a translation must leave
    as written. Texts are cut into terms once and counted before the glossary is asked, so only distinct
    terms meet it. Terms that cannot be left open, neither contracted nor an open entry, are not counted."""
    open_text = texts.withColumn("__t", without_postal_words(F.col(text), lit_array(states)))
    found = open_text.select(*key, F.explode(F.array_distinct(term_array(F.col("__t")))).alias("term")).filter(_may_be_open(F.col("term")))
    entries = glossary.filter(~F.col("verified") & ~F.col("english")).select("term", F.lit(True).alias("listed")).distinct()
    found = found.join(broadcast_if_bounded(entries), "term", "left").filter(looks_contracted(F.col("term")) | F.col("listed"))
    counted = cut_lineage(found.select(*key, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("texts")))
    return _left_open(counted, glossary, names).select("term", "texts")


def most_common(terms: DataFrame, texts_key: str) -> DataFrame:
    """A-4: in how many distinct texts a term occurs, most common first."""
    return terms.groupBy("term").agg(F.count_distinct(texts_key).alias("texts")).orderBy(F.desc("texts"), F.asc("term"))


def translation_totals(shown: DataFrame) -> DataFrame:
    """A-5: distinct texts shown, how many in plain words, how many as written."""
    per = shown.filter(F.col("original").isNotNull()).groupBy("original").agg(F.bool_or(F.col("plain").isNotNull() & (F.col("plain") != F.col("original"))).alias("plain"))
    return per.agg(F.count(F.lit(1)).alias("texts"), F.count_if("plain").alias("translated"), F.count_if(~F.col("plain")).alias("fallback"))
