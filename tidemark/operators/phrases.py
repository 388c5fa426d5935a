"""Many phrases over many texts at once: matching by word sequences, and rewriting without overlap.

A phrase is a sequence of words. Texts are cut into runs of one to as many words as the longest phrase has,
and those meet the phrases in one equality join: the phrases may be any number, and no pattern is made
from them. Of the matches of a text the leftmost wins, of those that start together the longest, then the
first in ``rank``; matches that overlap a winner are gone. All winners are replaced in one splice, so
no replacement is read again by another rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tokens as K
from tidemark.functions.text import let
from tidemark.session import broadcast_if_bounded


def spelled(phrase: Column) -> Column:
    """A phrase as the join sees it: its words and numbers in capitals, by single blanks."""
    return F.array_join(K.parsed(K.capitals(phrase))["w"], " ")


def _grams(t: Column, n: int) -> Column:
    """struct<start, n, gram> of every ``n`` runs that only blanks and hyphens part."""
    starts = F.when(F.size(t["w"]) >= n, F.sequence(F.lit(0), F.size(t["w"]) - n)).otherwise(F.array().cast("array<int>"))
    if n > 1:
        starts = F.filter(starts, lambda k: F.forall(F.slice(t["sep"], k + 1, n - 1), lambda s: s.rlike(K.APART)))
    # A run that goes on without a mark is part of a longer word.
    bare = lambda k: (K.after(t, k - 1) != "") | (k == 0)
    ends = lambda k: (K.after(t, k + n - 1) != "") | (k + n == F.size(t["w"]))
    starts = F.filter(starts, lambda k: bare(k) & ends(k))
    return F.transform(starts, lambda k: F.struct(k.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(t["w"], k + 1, n), " ").alias("gram")))


def matches(texts: DataFrame, key: Sequence[str], text: str, phrases: DataFrame) -> DataFrame:
    """``key.., start, n`` and the columns of ``phrases`` (``phrase``, see :func:`spelled`, and any others), a
    row for each place a phrase stands in a text; places count runs. Repeated phrases match as often."""
    lengths = [r[0] for r in phrases.select(F.size(F.split("phrase", " "))).distinct().collect()]  # a few small numbers
    if not lengths:
        lengths = [1]
    every = let(K.parsed(K.capitals(F.col(text))), lambda t: F.concat(*[_grams(t, n) for n in sorted(lengths)]))
    found = texts.select(*key, F.explode(every).alias("__g")).select(*key, "__g.start", "__g.n", F.col("__g.gram").alias("phrase"))
    return found.join(broadcast_if_bounded(phrases), "phrase")


def leftmost_longest(found: Column) -> Column:
    """The winners among array<struct<start, upto, rank, ..>>, in order."""
    order = lambda a, b: (
        F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["upto"] != b["upto"], b["upto"] - a["upto"]).when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)
    )
    ordered = F.array_sort(found, order)
    empty = F.filter(found, lambda m: F.lit(False))
    free = lambda acc, m: m["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["upto"], F.lit(0))
    return F.aggregate(ordered, empty, lambda acc, m: F.when(free(acc, m), F.array_append(acc, m)).otherwise(acc))


def rewrite(texts: DataFrame, key: Sequence[str], text: str, rules: DataFrame, out: str = "rewritten", counted: str = "replaced") -> DataFrame:
    """``texts`` with every rule of ``rules(phrase, say, rank)`` applied at once: the new text in ``out`` and the
    number of replacements in ``counted``. ``key`` is unique. Null texts stay null; a text keeps every
    character that no rule replaces."""
    found = matches(texts, key, text, rules.select(spelled(F.col("phrase")).alias("phrase"), "say", "rank").filter("phrase != ''"))
    match = F.struct("start", (F.col("start") + F.col("n")).alias("upto"), F.col("rank").cast("string").alias("rank"), "say")
    # What is gathered per text is bounded by the text.
    won = found.groupBy(*key).agg(leftmost_longest(F.collect_list(match)).alias("__won"))
    rows = texts.join(won, list(key), "left")
    new = let(K.parsed(F.col(text)), lambda t: K.spliced(t, F.col("__won")))
    return rows.withColumns({out: F.when(F.col("__won").isNull(), F.col(text)).otherwise(new), counted: F.coalesce(F.size("__won"), F.lit(0))}).drop("__won")
