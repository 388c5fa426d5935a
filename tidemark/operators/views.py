"""Ranked and deduplicated views over changes and history (W-1 .. W-14, D-16, J-14, A-8).

A change row carries ``entity, cycle, priority, summary, id`` and an ``ord`` that fixes its
place among the entity's changes. Limits per key use WindowGroupLimit plans; everything else
about a group is an aggregate, so a hot entity never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rank import priority_order
from tidemark.operators.skew import first_per_key, ordinal_within, top_k

# --- Fixed values ---------------------------------------------------------------------------
KEEP_CYCLES = 13
INDEX_CYCLES = 12
MAX_ITEMS = 60
BUSIEST = 24
SEARCH_LIMIT = 30
DIGEST_CHANGES = 3
# --------------------------------------------------------------------------------------------


def phrase_dedupe(records: DataFrame) -> DataFrame:
    """W-1: inside an entity a phrase is said once, by the first record in (action first,
    phrases) order; a record left with no phrase is dropped. Needs ``rid`` and ``phrases``."""
    said = records.select(
        "entity", "rid", (F.col("priority") != "action").alias("late"), F.col("phrases").alias("all"),
        F.posexplode("phrases").alias("pos", "phrase"),
    )
    order = [F.col("late"), F.col("all"), F.col("rid"), F.col("pos")]
    first = first_per_key(said, ["entity", "phrase"], order)
    kept = first.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "phrase"))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda k: k["phrase"]), "; ")
    return records.join(kept.select("rid", text.alias("summary")), "rid")


def summary_dedupe(changes: DataFrame, order: list[Column]) -> DataFrame:
    """W-2: one change per (entity, summary), the first in input order."""
    return first_per_key(changes, ["entity", "summary"], order)


def reading_order(changes: DataFrame) -> DataFrame:
    """W-3: ``rank_ord`` = action, ifr, fyi, then input order (Spark sorts are not stable, so
    the order is carried as columns)."""
    return changes.withColumn("rank_ord", F.struct(priority_order(F.col("priority")).alias("rank"), F.col("ord").alias("ord")))


def latest_cycles(current: DataFrame, history: DataFrame, cycle: str | Column, keep: int = KEEP_CYCLES) -> DataFrame:
    """W-5: each entity's newest ``keep`` cycles; the shown cycle comes from ``current``, the
    others from history. Cycles are ranked on distinct (entity, cycle) pairs only."""
    shown = current.select("entity").distinct().withColumn("__shown", F.lit(True))
    past = history.join(shown, "entity", "left").filter(
        ~((F.col("cycle") == cycle) & F.coalesce("__shown", F.lit(False)))
    ).drop("__shown")
    both = current.unionByName(past)
    pairs = top_k(both.select("entity", "cycle").distinct(), ["entity"], [F.col("cycle").desc()], keep, rank="nth")
    return both.join(pairs, ["entity", "cycle"])


def capped_items(changes: DataFrame, keys: list[str], cap: int = MAX_ITEMS) -> DataFrame:
    """W-6: the first ``cap`` items per key in reading order, with how many were left out."""
    order = [priority_order(F.col("priority")), F.col("ord")]
    kept = top_k(changes, keys, order, cap, rank="item")
    totals = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return kept.join(totals, keys).withColumn("more", F.greatest(F.col("__n") - cap, F.lit(0))).drop("__n")


def busiest(changes: DataFrame, limit: int = BUSIEST) -> DataFrame:
    """W-7: entities by actions, then changes, then id."""
    n = changes.groupBy("entity").agg(
        F.count_if(F.col("priority") == "action").alias("actions"), F.count(F.lit(1)).alias("total")
    )
    return n.orderBy(F.desc("actions"), F.desc("total"), F.asc("entity")).limit(limit)


def top_change(changes: DataFrame) -> DataFrame:
    """W-8: per entity its first action, else its first change."""
    late = F.col("priority") != "action"
    return changes.groupBy("entity").agg(F.min_by("summary", F.struct(late, F.col("ord"))).alias("summary"))


def list_rows(changes: DataFrame, members: DataFrame) -> DataFrame:
    """W-9: per (list, cycle) its entities by actions, then changes, then id. A list may hold any number
    of entities: they are numbered without a task per list."""
    n = members.select("slug", "entity").distinct().join(changes, "entity").groupBy("slug", "cycle", "entity").agg(
        F.count_if(F.col("priority") == "action").alias("actions"), F.count(F.lit(1)).alias("total")
    )
    n = n.withColumns({"__a": -F.col("actions"), "__t": -F.col("total")})
    return ordinal_within(n, ["slug", "cycle"], ["__a", "__t", "entity"], "place").drop("__a", "__t")


def watchlist_totals(changes: DataFrame, members: DataFrame) -> DataFrame:
    """J-14 + A-8: per list its members, how many changed, and changes per priority. Changes
    are counted per entity before they meet the lists; quiet entities stay."""
    is_ = lambda p: F.count_if(F.col("priority") == p).alias(p)
    per = changes.groupBy("entity").agg(is_("action"), is_("ifr"), is_("fyi"))
    joined = members.select("slug", "entity").distinct().join(per, "entity", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return joined.groupBy("slug").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("fyi").isNotNull()).alias("changed"),
        total("action"), total("ifr"), total("fyi"),
    )


def search(directory: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """W-10: ranked search for many queries at once.

    ``directory(entity, icao, name, city, type)`` and ``queries(query)``. A match is, best
    first: an exact id, an id prefix, a name prefix, a part of name or city (the last two for
    three letters or more); entries that are no airport or have no ICAO id come later within
    their class. Queries meet entries through an index of three-letter pieces (and short id
    prefixes): a query looks up only its rarest piece, which every match must contain.
    """
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    entry = directory.select(
        "entity", "name", up("entity").alias("uid"), up("icao").alias("uicao"), up("name").alias("uname"), up("city").alias("ucity"),
        (F.coalesce("type", F.lit("airport")) != "airport").alias("other"),
    )
    pieces = lambda c: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))
    )
    short = F.array(*[F.substring(c, 1, k) for c in ("uid", "uicao") for k in (1, 2)])
    keys = F.array_distinct(F.concat(*[pieces(F.col(c)) for c in ("uid", "uicao", "uname", "ucity")], short))
    index = entry.withColumn("piece", F.explode(keys)).filter(F.col("piece") != "")
    asked = queries.select("query", F.upper(F.trim("query")).alias("q")).distinct().filter(F.col("q") != "")
    asked = asked.withColumn("piece", F.explode(F.array_distinct(pieces(F.col("q")))))
    weight = index.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.join(weight, "piece", "left").fillna(0, ["n"])
    rarest = asked.groupBy("query", "q").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    hits = rarest.join(index, "piece").drop("piece")
    q, uid, icao, name, city = (F.col(c) for c in ("q", "uid", "uicao", "uname", "ucity"))
    long = F.length(q) >= 3
    match = (
        F.when((uid == q) | (icao == q), 0)
        .when(uid.startswith(q) | icao.startswith(q), 1)
        .when(long & name.startswith(q), 2)
        .when(long & (F.contains(name, q) | F.contains(city, q)), 3)
    )
    score = match * 10 + F.when(F.col("other"), 4).otherwise(0) + F.when(icao == "", 2).otherwise(0)
    hits = hits.withColumn("score", score).filter(F.col("score").isNotNull())
    return top_k(hits, ["query"], [F.col("score"), F.length("entity"), F.col("entity")], limit, rank="place").select(
        "query", "entity", "name", "score", "place"
    )


def previous_cycles(cycles: DataFrame) -> DataFrame:
    """W-11: each usable cycle with the newest usable one before it. The input is the list of
    cycles (one row per 28 days), so the window is a few hundred rows."""
    usable = cycles.filter(~F.col("skipped")).select("cycle")
    return usable.withColumn("from_cycle", F.lag("cycle").over(Window.orderBy("cycle")))


def history_range(history: DataFrame, current: Column, months: int, hide_fyi: bool = False, hide_current: bool = False) -> DataFrame:
    """W-12: counts per (entity, cycle) within the last months."""
    h = history.filter(F.col("cycle") >= F.add_months(current, -months))
    if hide_fyi:
        h = h.filter(F.col("priority") != "fyi")
    if hide_current:
        h = h.filter(F.col("cycle") != current)
    return h.groupBy("entity", "cycle").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") == "action").alias("actions")
    )


def unseen(changes: DataFrame, seen: DataFrame) -> DataFrame:
    """D-16: changes a reader has not seen. ``seen(reader, entity, cycle, id)`` holds one row
    per seen id; an entity the reader never opened has no baseline and shows nothing as new."""
    baseline = seen.groupBy("reader", "entity").agg(F.max("cycle").alias("since"))
    fresh = changes.join(baseline, "entity").filter(F.col("cycle") >= F.col("since"))
    return fresh.join(seen.select("reader", "entity", "id").distinct(), ["reader", "entity", "id"], "left_anti").drop("since")


def digest(changes: DataFrame, lists: DataFrame, seen: DataFrame, cap: int = MAX_ITEMS, shown: int = DIGEST_CHANGES) -> DataFrame:
    """W-13: a reader's lists merged into one ranked digest.

    ``lists(reader, slug, entity)``. Per reader at most ``cap`` changed entities by actions,
    new changes, id; each with its first changes, how many more there are, and the lists it is
    on. Quiet entities follow with no changes.
    """
    followed = lists.groupBy("reader", "entity").agg(F.array_join(F.array_sort(F.collect_set("slug")), ", ").alias("lists"))
    new = unseen(changes, seen).groupBy("reader", "entity").agg(F.count(F.lit(1)).alias("new"))
    per = changes.groupBy("entity").agg(
        F.count_if(F.col("priority") == "action").alias("actions"), F.count(F.lit(1)).alias("total")
    )
    rows = followed.join(per, "entity", "left").join(new, ["reader", "entity"], "left").fillna(0, ["actions", "total", "new"])
    order = [F.desc("actions"), F.desc("new"), F.asc("entity")]
    changed = top_k(rows.filter(F.col("total") > 0), ["reader"], order, cap, rank="place")
    first = top_k(changes, ["entity"], [priority_order(F.col("priority")), F.col("ord")], shown, rank="nth")
    lines = first.groupBy("entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda s: s["summary"]), "; ").alias("lines")
    )
    changed = changed.join(lines, "entity").withColumn("more", F.greatest(F.col("total") - shown, F.lit(0)))
    quiet = rows.filter(F.col("total") == 0).withColumns({"place": F.lit(None).cast("int"), "lines": F.lit(""), "more": F.lit(0).cast("bigint")})
    columns = ["reader", "entity", "lists", "actions", "total", "new", "place", "lines", "more"]
    return changed.select(*columns).unionByName(quiet.select(*columns))


def history_pages(history: DataFrame, current: Column, keep: int = INDEX_CYCLES) -> DataFrame:
    """W-14: per entity its newest cycles other than the one on top, with counts."""
    per = history.filter(F.col("cycle") != current).groupBy("entity", "cycle").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") == "action").alias("actions")
    )
    return top_k(per, ["entity"], [F.col("cycle").desc()], keep, rank="nth")


def headline(total: Column, actions: Column) -> Column:
    """F-17: '3 changes (1 action item)'."""
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    tail = F.when(actions > 0, plural(actions, "action item")).otherwise("no action items")
    return F.concat(plural(total, "change"), F.lit(" ("), tail, F.lit(")"))


def feed_items(items: DataFrame, now: Column) -> DataFrame:
    """F-17 + F-18: per (entity, cycle) the title and publish time of its feed entry."""
    from tidemark.functions.cycles import published_at

    per = items.groupBy("entity", "cycle").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("priority") == "action").alias("actions")
    )
    title = F.concat(F.col("entity"), F.lit(": "), headline(F.col("total"), F.col("actions")), F.lit(" on "), F.date_format("cycle", "dd MMM yyyy"))
    return per.withColumns({"title": title, "published": published_at(F.col("cycle"), now)})
