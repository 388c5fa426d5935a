"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (``freqItems``, the counters of Karp, Schenker and Papadimitriou) names
every digest that holds more than ``support`` of the rows. There are at most 1 / support of
them, so their verified winners - exact counts and the row that stays - fit a broadcast whatever
the input is, and their rows are settled map-side. The other digests go through an ordinary
shuffle, where no key can be large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import cut_lineage

#: Share of the rows above which a digest counts as heavy; bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 0.001


def _digest(text: str):
    return F.unhex(F.sha2(text_of(text).cast("binary"), 256))


def _settled(docs: DataFrame, text: str, key: str, support: float) -> DataFrame:
    """One row per input row: __key, __digest, __row, __best (key and row that stay), __size."""
    digests = cut_lineage(
        docs.select(F.col(key).alias("__key"), _digest(text).alias("__digest"), F.monotonically_increasing_id().alias("__row"))
    )
    member = F.struct(F.col("__key").isNotNull().alias("known"), F.col("__key").alias("key"), F.col("__row").alias("row"))
    best = [F.max(member).alias("__best"), F.count(F.lit(1)).alias("__size")]

    frequent = digests.stat.freqItems(["__digest"], support).select(F.explode("__digest_freqItems").alias("__digest"))
    winners = digests.join(F.broadcast(frequent), "__digest", "left_semi").groupBy("__digest").agg(*best)
    winners = cut_lineage(winners)  # at most 1 / support rows
    split = digests.join(F.broadcast(winners), "__digest", "left")
    heavy = split.filter("__size is not null")
    light = split.filter("__size is null").select("__digest", "__key", "__row")
    return heavy.unionByName(light.join(light.groupBy("__digest").agg(*best), "__digest"))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. The row with the largest
    key stays; among repeated rows with the same key one of them stays. A null key is smaller than
    any other. An empty table gives an empty result. Extra columns are not looked at.
    """
    return _settled(docs, text, key, support).select(
        F.col("__key").alias(key),
        F.col("__best.key").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__row") == F.col("__best.row")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """``docs`` without copies, all columns kept: the rows :func:`exact_groups` marks as kept.

    Texts are not shuffled: a row goes when its (key, digest) is among the settled losers. Only
    rows that repeat a winner's key and text, if there are any, are shuffled to leave one.
    """
    settled = cut_lineage(_settled(docs, text, key, support).filter(F.col("__row") != F.col("__best.row")))
    same = F.col("__key").eqNullSafe(F.col("__best.key"))
    gone = settled.filter(~same).select("__key", "__digest").distinct()
    repeated = settled.filter(same).select("__key", "__digest").distinct()

    rows = docs.withColumn("__text_digest", _digest(text))
    found = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_digest") == F.col("__digest"))
    rows = rows.join(gone, found, "left_anti")
    if not repeated.isEmpty():
        once = rows.join(repeated, found, "left_semi").dropDuplicates([key, "__text_digest"])
        rows = rows.join(repeated, found, "left_anti").unionByName(once)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
