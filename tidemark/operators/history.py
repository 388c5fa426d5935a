"""The per-entity history: append, index, re-match, reprocess (K-4, K-5, D-15, T-13, T-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config.rules import AERO, RuleSet
from tidemark.operators.skew import first_per_key
from tidemark.session import cut_lineage


def upserted(history: DataFrame, changes: DataFrame) -> DataFrame:
    """K-4 as a table: the new result replaces its cycles. An entity that no longer changes in
    a replayed cycle loses its stale entry, because a cycle is replaced whole."""
    replaced = changes.select("cycle").distinct()
    return history.join(replaced, "cycle", "left_anti").unionByName(changes, allowMissingColumns=True)


def append(changes: DataFrame, path: str) -> None:
    """K-4 as a sink: dynamic overwrite of the cycles in the result; replays change nothing.

    Rows are laid out by cycle and entity range, so a hot entity spreads over several files.
    """
    (
        changes.repartitionByRange("cycle", "entity", "id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cycle")
        .parquet(path)
    )


def replace_cycle(changes: DataFrame, cycle: str, path: str) -> None:
    """K-4 for one cycle: its changes, none included, become all that the history has of it."""
    rows = changes.drop("cycle").repartitionByRange("entity", "id")
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/cycle={cycle}")


def index(history: DataFrame) -> DataFrame:
    """K-5: entries, first and last cycle and actions per entity."""
    return history.groupBy("entity").agg(
        F.count(F.lit(1)).alias("entries"), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"),
        F.count_if(F.col("priority") == "action").alias("action"),
    )


def rematch(history: DataFrame, produced: DataFrame, natural_key: list[str], columns: list[str]) -> DataFrame:
    """D-15: rewrite stored entries with new output, by id, else by natural key; an entry with
    no match keeps what it has. Ids stay as stored."""
    new = produced.select("id", *[F.col(c).alias(f"i_{c}") for c in columns])
    by_id = first_per_key(new, ["id"], [F.col(f"i_{c}") for c in columns])
    keyed = produced.select(*natural_key, F.col("id").alias("__id"), *[F.col(c).alias(f"k_{c}") for c in columns])
    by_key = first_per_key(keyed, natural_key, [F.col("__id")]).drop("__id").withColumn("by_key", F.lit(True))
    out = history.join(by_id.withColumn("by_id", F.lit(True)), "id", "left").join(by_key, natural_key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("by_id"), F.col(f"i_{c}")).when(F.col("by_key"), F.col(f"k_{c}")).otherwise(F.col(c)))
    matched = F.when(F.col("by_id"), "id").when(F.col("by_key"), "key").otherwise("kept")
    return out.withColumn("matched", matched).drop("by_id", "by_key", *[f"{p}_{c}" for p in "ik" for c in columns])


def reprocess(history: DataFrame, rules: RuleSet = AERO) -> DataFrame:
    """T-16: rank and word stored entries again from the values they keep.

    Noise columns are dropped from kept edits, ranks come from the current ladder, parts fold
    into their whole, hidden entries and repeated lines go, and every id stays.
    """
    from tidemark.functions import predicates as P
    from tidemark.functions import words as W
    from tidemark.operators import collapse as C
    from tidemark.operators import rank

    sized = F.transform(
        F.filter("fields", lambda f: ~P.is_noise(f["field"], rules)),
        lambda f: F.struct(
            f["field"].alias("field"), f["old"].alias("old"), f["new"].alias("new"),
            P.change_size(f["field"], f["old"], f["new"], rules).alias("size"),
        ),
    )
    sized = F.filter(sized, lambda f: F.coalesce(f["size"], F.lit("")) != "drop")
    side = lambda which: F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f[which])))
    changed = F.col("kind") == "changed"
    kept = history.withColumn("row", F.when(~changed, F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], F.when(F.col("kind") == "added", f["new"]).otherwise(f["old"]))))))
    edits = kept.filter(changed & (F.size("fields") > 0)).withColumns({"file": F.col("source"), "old_row": side("old"), "new_row": side("new")}).withColumn("fields", sized)
    edits = rank.edit_priority(edits.withColumn("__stored", F.col("priority")), rules)
    rows = kept.filter(~changed & (F.size("fields") > 0)).withColumns({"file": F.col("source"), "existed": F.lit(False), "__stored": F.col("priority")})
    rows = rank.row_priority(rows, rules)
    bare = kept.filter(F.size("fields") == 0).withColumn("__stored", F.col("priority"))
    columns = [*history.columns, "row", "__stored"]
    plain = F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["old"].alias("old"), f["new"].alias("new")))
    both = edits.withColumn("fields", plain).select(*columns).unionByName(rows.select(*columns)).unionByName(bare.select(*columns))
    both = cut_lineage(both).withColumns({"context": F.create_map().cast("map<string,string>"), "__said": F.col("summary"), "new_row": F.lit(None).cast("map<string,string>")})
    worded = W.describe(both.withColumn("summary", F.when((F.size("fields") == 0) | F.col("source").isin(*rules.remark_files), F.col("__said"))))
    line = F.when(F.col("no_template"), F.col("__said")).otherwise(F.array_join("phrases", "; "))
    worded = worded.withColumn("summary", line).filter(F.col("priority") != "hidden")
    if "category" not in worded.columns:
        worded = worded.withColumn("category", F.lit(None).cast("string"))
    events = cut_lineage(C.as_events(worded))
    folded, used = C.whole_and_parts(events)
    whole = folded.select("entity", F.to_json("row").alias("__k"), F.col("summary").alias("__line"), F.col("priority").alias("__rank"))
    parts_gone = events.join(used, "rid", "left_semi").filter(F.col("source") != "ILS_BASE").select("rid")
    out = C.without(events, parts_gone).withColumn("__k", F.when(F.col("source") == "ILS_BASE", F.to_json("row")))
    out = out.join(whole, ["entity", "__k"], "left")
    out = out.withColumns({"summary": F.coalesce("__line", "summary"), "priority": F.coalesce("__rank", "priority")})
    unique = first_per_key(out, ["entity", "cycle", "summary"], [F.col("id")])
    return unique.select(*history.columns)


def scrub(history: DataFrame, verdicts: DataFrame, remark_sources: tuple[str, ...]) -> DataFrame:
    """T-13: stored translations that fail today's checks go back to the raw text, those that
    pass read as they are worded now. ``verdicts(raw, plain, ok, readable)``."""
    said = F.substring_index("summary", ": ", 1)
    plain = F.when(F.locate(": ", F.col("summary")) > 0, F.expr("substr(summary, instr(summary, ': ') + 2)"))
    checked = F.col("source").isin(*remark_sources) & F.col("original").isNotNull() & plain.isNotNull() & (plain != F.col("original"))
    judged = verdicts.select(F.col("raw").alias("__raw"), F.col("plain").alias("__plain"), "ok", "readable").dropDuplicates(["__raw", "__plain"])
    out = history.withColumn("__p", F.when(checked, plain)).join(judged, (F.col("original") == F.col("__raw")) & (F.col("__p") == F.col("__plain")), "left")
    text = F.when(F.col("__raw").isNull(), F.col("summary")).when(F.col("ok"), F.concat_ws(": ", said, "readable")).otherwise(F.concat_ws(": ", said, "original"))
    return out.withColumn("restored", F.coalesce(~F.col("ok"), F.lit(False))).withColumn("summary", text).drop("__p", "__raw", "__plain", "ok", "readable")
