"""License scans: keyword-gated signatures, with overlaps settled by priority and containment.

DataFrame functions only. One pass turns each text into words parted by single blanks, counts its
base phrases and keeps the words only where the gate finds something. Of those few texts, each rule
whose keyword occurs is run; its places are found by splitting the text at its matches. A detection
inside the interval of another of the same or a more important priority is suppressed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, text_of
from tidemark.llm.license_rules import GATE, PHRASES, Signature, signatures
from tidemark.session import cut_lineage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How sure a detection of each priority is; a bare base phrase counts as the last.
SURE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}


def padded_words(text: Column) -> Column:
    """Lower-case (ASCII) words with one blank around each; a text without words is one blank."""
    words = F.regexp_replace(lower_ascii(text), NOT_WORD, " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(padded: Column, n_words: Column) -> list[Column]:
    """Count, first and last place and labels of the base phrases."""
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        spaced = f" {phrase} "
        there = padded.contains(spaced)
        # Doubled blanks let phrases follow each other; only texts that have the phrase pay for it.
        doubled = F.replace(padded, F.lit(" "), F.lit("  "))
        wide = spaced.replace(" ", "  ")[1:-1]
        lost = F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))
        count.append(F.when(there, lost / len(wide)).otherwise(0).cast("long"))
        first.append(F.when(there, blanks(F.substring_index(padded, spaced, 1)).cast("long")))
        after = blanks(F.substring_index(padded, spaced, -1)).cast("long")
        last.append(F.when(there, n_words - after - phrase.count(" ") - 1))
        labels.append(F.when(there, F.lit(label)))
    return [
        reduce(lambda a, b: a + b, count).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("__base"),
    ]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[Signature] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, detections).

    texts: one row per input row - __row (its number), key, n_words, n_base, first_word, last_word,
    __base (labels of base phrases) and __words (only where the gate found something).
    detections: __row, label, priority, start_word, end_word (exclusive) of what was not suppressed.
    Null and empty texts have no words and no detections. Repeated rows are separate texts.
    """
    rules = signatures() if rules is None else rules
    rows = docs.select(F.col(key).alias("__key"), padded_words(text_of(text)).alias("__padded"), F.monotonically_increasing_id().alias("__row"))
    n_words = F.when(F.length("__padded") <= 2, 0).otherwise(blanks(F.col("__padded")) - 1).cast("long")
    gate = reduce(lambda a, b: a | b, [F.col("__padded").contains(word) for word in GATE])
    rows = rows.select("__row", "__key", n_words.alias("n_words"), "__padded", F.when(gate, F.col("__padded")).alias("__words"))
    texts = cut_lineage(rows.select("__row", "__key", "n_words", *_base(F.col("__padded"), F.col("n_words")), "__words"))

    listed = F.array(*[F.struct(F.lit(s.keyword).alias("keyword"), F.lit(s.priority).alias("priority"), F.lit(s.label).alias("label"), F.lit(f"(?<= )(?:{s.regex})(?= )").alias("regex")) for s in rules])
    keywords = F.array(*[F.lit(w) for w in sorted({s.keyword for s in rules})])
    gated = texts.filter("__words is not null")
    met = gated.withColumn("__met", F.array_intersect(F.split("__words", " "), keywords)).filter(F.size("__met") > 0)
    runs = met.select("__row", "__words", F.explode(F.filter(listed, lambda r: F.array_contains(F.col("__met"), r["keyword"]))).alias("rule"))
    runs = runs.withColumn("__pieces", F.split("__words", F.col("rule.regex"), -1)).filter(F.size("__pieces") > 1)
    runs = runs.withColumn("__matches", F.regexp_extract_all("__words", F.col("rule.regex"), F.lit(0)))
    parts = F.transform(F.arrays_zip("__pieces", "__matches"), lambda x: F.struct(blanks(x["__pieces"]).alias("before"), blanks(x["__matches"]).alias("inside")))
    places = runs.select("__row", "rule.priority", "rule.label", F.col("rule.regex").alias("regex"), F.posexplode(parts).alias("nth", "part"))
    places = places.select("__row", "priority", "label", "regex", "nth", "part.before", "part.inside").repartition("__row")

    # Blanks up to a match, less the leading one, are the words before it.
    upto = Window.partitionBy("__row", "priority", "label", "regex").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("before").over(upto) + F.sum(F.coalesce("inside", F.lit(0))).over(upto) - F.coalesce("inside", F.lit(0)) - 1
    found = places.withColumn("start_word", start.cast("long")).filter("inside is not null")
    found = found.withColumn("end_word", F.col("start_word") + F.col("inside") + 1)

    earlier = Window.partitionBy("__row").orderBy("start_word", F.desc("end_word"), "priority", "label", "regex").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for p in sorted(SURE):
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("end_word"))).over(earlier)).otherwise(reach)
    kept = found.withColumn("__reach", reach).filter("__reach is null or __reach < end_word")
    return texts, kept.select("__row", "label", "priority", "start_word", "end_word")


def license_labels(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[Signature] | None = None) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places are words from 0, null where no base phrase stands. Labels are distinct, sorted and
    comma-joined, those of base phrases always among them. score: of the surest detection, 0 without.
    """
    texts, found = scan(docs, text, key, rules)
    sure = reduce(lambda rest, p: F.when(F.col("priority") == p, SURE[p]).otherwise(rest), SURE, F.lit(0.0))
    told = found.groupBy("__row").agg(F.collect_set("label").alias("__found"), F.max(sure).alias("__sure"))  # as many labels as rules at most
    out = texts.drop("__words").join(told, "__row", "left")
    every = F.array_sort(F.array_union("__base", F.coalesce("__found", F.array().cast("array<string>"))))
    bare = F.when(F.size("__base") > 0, SURE[4]).otherwise(0.0)
    return out.select(
        F.col("__key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.greatest(F.coalesce("__sure", F.lit(0.0)), bare).alias("score"),
    )
