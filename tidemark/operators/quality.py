"""Counts, tallies and gates (A-*, Q-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cycles
from tidemark.functions import predicates as P
from tidemark.operators.skew import ordinal_within

# --- Fixed values: thresholds ---------------------------------------------------------------
DROP_ERROR, DROP_WARNING = 0.10, 0.05
RISE_ERROR, RISE_WARNING = 0.50, 0.15
MIN_ROWS = 50
MIN_ENTITIES = 100
RATIO_ERROR, RATIO_WARNING = 5.0, 2.5
BASELINE_CYCLES = 13
MIN_PAST_CYCLES = 3
MIN_DIRECTORY = 5000
STALE_HOURS = 30
# --------------------------------------------------------------------------------------------


def change_counts(changes: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """A-1/K-2: changes per priority for every key."""
    is_ = lambda p: F.count_if(F.col("priority") == p).alias(p)
    return changes.groupBy(*keys).agg(is_("action"), is_("ifr"), is_("fyi"), is_("hidden"))


def past_action_counts(history: DataFrame, exclude: Column, last: int = BASELINE_CYCLES) -> DataFrame:
    """A-2: actions per cycle over the newest cycles other than one."""
    return (
        history.filter(F.col("cycle") != exclude)
        .groupBy("cycle")
        .agg(F.count_if(F.col("priority") == "action").alias("actions"))
        .orderBy(F.desc("cycle"))
        .limit(last)
    )


def volume_gate(changes: DataFrame, past: DataFrame, min_entities: int = MIN_ENTITIES) -> DataFrame:
    """Q-4: one row ``entities, actions, median, level, reason``; the baseline is a scalar
    subquery."""
    now = changes.agg(F.count_distinct("entity").alias("entities"), F.count_if(F.col("priority") == "action").alias("actions"))
    base = past.agg(F.struct(F.median("actions").alias("median"), F.count(F.lit(1)).alias("cycles")).alias("b")).scalar()
    one = now.withColumn("b", base).select("entities", "actions", "b.median", "b.cycles")
    ratio = F.col("actions") / F.nullif(F.col("median"), F.lit(0.0))
    judged = (F.col("cycles") >= MIN_PAST_CYCLES) & (F.col("actions") > 0)
    far = judged & ((ratio > RATIO_ERROR) | (ratio < 1 / RATIO_ERROR))
    off = judged & ((ratio > RATIO_WARNING) | (ratio < 1 / RATIO_WARNING))
    reason = (
        F.when(F.col("entities") < min_entities, "few entities").when(F.col("actions") == 0, "no actions").when(far, "far from median").when(off, "off median")
    )
    level = F.when(reason.isin("few entities", "no actions", "far from median"), "error").when(reason == "off median", "warning").otherwise("ok")
    return one.select("entities", "actions", "median", level.alias("level"), F.coalesce(reason, F.lit("")).alias("reason"))


def row_counts(rows: DataFrame, cycle: str = "cycle", file: str = "file") -> DataFrame:
    """S-7: rows read per table and cycle."""
    return rows.groupBy(cycle, file).agg(F.count(F.lit(1)).alias("rows"))


def input_gate(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """A-3 + Q-2: tables whose row count moved too much. Inputs ``file, rows``; with the cycle among the
    keys, many pairs of snapshots are judged at once."""
    keys = list(keys)
    j = old.select(*keys, F.col("rows").alias("old_rows")).join(new.select(*keys, F.col("rows").alias("new_rows")), keys, "full_outer")
    a, b = F.col("old_rows"), F.col("new_rows")
    change = (b - a) / F.nullif(a, F.lit(0))
    fresh = a.isNull() | (a == 0)
    verdict = (
        F.when(b.isNull(), "error: missing")
        .when(fresh, F.when(b > 0, "warning: new table"))
        .when(b == 0, "error: empty")
        .when(F.greatest(a, b) < MIN_ROWS, F.lit(None))
        .when(change < -DROP_ERROR, "error: dropped")
        .when(change > RISE_ERROR, "error: rose")
        .when(change < -DROP_WARNING, "warning: dropped")
        .when(change > RISE_WARNING, "warning: rose")
    )
    return j.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull()).select(
        *keys, "old_rows", "new_rows", F.substring_index("verdict", ": ", 1).alias("level"), F.substring_index("verdict", ": ", -1).alias("reason")
    )


def cycle_gate(pairs: DataFrame, current: Column, gap_ok: bool = False, anchor: str = cycles.ANCHOR, days: int = cycles.CYCLE_DAYS) -> DataFrame:
    """Q-1: why a (from_cycle, to_cycle) pair may not be published."""
    old, new = F.col("from_cycle"), F.col("to_cycle")
    gap = F.datediff(new, old)
    wrong_gap = (gap <= 0) | (gap % days != 0) | (F.lit(not gap_ok) & (gap != days))
    checks = F.array(
        F.when(cycles.is_off_schedule(old, anchor, days), "old cycle is off schedule"),
        F.when(cycles.is_off_schedule(new, anchor, days), "new cycle is off schedule"),
        F.when(wrong_gap, "not one cycle apart"),
        F.when(new > F.date_add(current, days), "more than one cycle ahead"),
    )
    return pairs.select("from_cycle", "to_cycle", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("error"))


def change_gate(changes: DataFrame, edition: Column | None = None) -> DataFrame:
    """Q-3: every reason a set of changes may not be published, as ``entity, level, reason, n``.

    Needs ``entity, id, summary, priority, fields``; ``original`` and ``link`` when present.
    """
    has = set(changes.columns)
    copies = lambda column, reason: (
        changes.groupBy("entity", column)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("entity", F.lit("error").alias("level"), F.lit(reason).alias("reason"), "n")
    )
    summary = F.col("summary")
    blank = summary.isNull() | (F.trim(summary) == "")
    quoted = F.flatten(F.transform("fields", lambda f: F.array(f["old"], f["new"])))
    if "original" in has:
        quoted = F.concat(quoted, F.array("original"))
    problems = F.transform("fields", lambda f: P.value_problem(f["field"], f["new"]))
    said = F.transform(F.regexp_extract_all(summary, F.lit(r"\bfrequency (\d+\.?\d*)"), F.lit(1)), lambda v: F.when(~P.is_real_frequency(v), F.concat(F.lit("frequency "), v, F.lit(" is not a real frequency"))))
    implausible = F.filter(F.concat(problems, said), lambda p: p.isNotNull())
    reasons = [
        F.when(blank, F.array(F.lit("error: empty summary"))),
        F.when(~blank & ~F.coalesce(F.col("priority").isin("action", "ifr", "fyi"), F.lit(False)), F.array(F.lit("error: bad priority"))),
        F.when(~blank & P.has_junk(summary, quoted), F.array(F.lit("error: junk text"))),
        F.when(~blank & (F.col("priority") != "fyi"), F.transform(implausible, lambda p: F.concat(F.lit("warning: "), p))),
    ]
    if edition is not None and "link" in has:
        wrong = F.col("link").isNotNull() & ~F.contains(F.col("link"), F.concat(F.lit("/d-tpp/"), edition, F.lit("/")))
        reasons.append(F.when(wrong, F.array(F.lit("error: link to another edition"))))
    if "translation_problems" in has:
        reasons.append(F.transform("translation_problems", lambda p: F.concat(F.lit("error: translation: "), p)))
    empty = F.array().cast("array<string>")
    found = changes.select("entity", F.explode(F.concat(*[F.coalesce(r, empty) for r in reasons])).alias("r"))
    rows = found.groupBy("entity", "r").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("entity", F.substring_index("r", ": ", 1).alias("level"), F.regexp_replace("r", "^[a-z]+: ", "").alias("reason"), "n")
    return rows.unionByName(copies("id", "duplicate id")).unionByName(copies("summary", "duplicate summary"))


def combine_gates(cycle_errors: DataFrame, *others: DataFrame) -> DataFrame:
    """Q-5: errors and warnings of all gates; when the cycle gate fails nothing else counts.
    Inputs carry ``level, reason``."""
    out = cycle_errors.select(F.lit("error").alias("level"), F.col("error").alias("reason")) if "error" in cycle_errors.columns else cycle_errors.select("level", "reason")
    failed = out.agg(F.count_if(F.col("level") == "error").alias("n")).scalar()
    for gate in others:
        rows = gate.filter(F.col("level") != "ok").select("level", "reason")
        out = out.unionByName(rows.filter(failed == 0))
    return out


def may_publish(gates: DataFrame) -> bool:
    """Q-5: the driver's decision: no error row."""
    return gates.filter(F.col("level") == "error").isEmpty()


def completeness(meta: DataFrame, index: DataFrame, documents: DataFrame, directory: DataFrame, min_directory: int = MIN_DIRECTORY) -> DataFrame:
    """Q-6: what is missing between the outputs of one cycle, as ``problem, entity``."""
    ids = lambda df: df.select("entity").distinct()
    gone = lambda a, b, text: ids(a).join(ids(b), "entity", "left_anti").select(F.lit(text).alias("problem"), "entity")
    none = F.lit(None).cast("string")
    small = directory.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_directory).select(F.lit("directory too small").alias("problem"), none.alias("entity"))
    listed = ids(index).agg(F.count(F.lit(1)).alias("n")).scalar()
    count = meta.filter(F.col("changed") != listed).select(F.lit("changed count differs from index").alias("problem"), none.alias("entity"))
    return (
        gone(index, documents, "in index without a document")
        .unionByName(gone(documents, index, "document not in index"))
        .unionByName(gone(index, directory, "not in directory"))
        .unionByName(small)
        .unionByName(count)
    )


def provenance(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Q-9: recorded file digests and urls against what is there. Inputs ``path, sha256, url``."""
    j = manifest.select("path", F.col("sha256").alias("want"), F.col("url").alias("want_url")).join(
        actual.select("path", F.col("sha256").alias("have"), F.col("url").alias("have_url")), "path", "left"
    )
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("want"), "digest differs").when(F.col("have_url") != F.col("want_url"), "url differs")
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def reconcile_archive(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Q-10: an archive's manifest against its listing. Inputs ``name, size, sha256``."""
    j = manifest.select("name", F.col("size").alias("want"), F.col("sha256").alias("want_sha")).join(
        listing.select("name", F.col("size").alias("have"), F.col("sha256").alias("have_sha")), "name", "full_outer"
    )
    problem = (
        F.when(F.col("have").isNull(), "listed but absent").when(F.col("want").isNull(), "present but not listed")
        .when(F.col("want") != F.col("have"), "size differs").when(F.col("want_sha") != F.col("have_sha"), "digest differs")
    )
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("name", "problem")


def availability(listing: DataFrame, kinds: list[str]) -> DataFrame:
    """Q-12: bytes per cycle and kind of file, null where a kind is missing."""
    return listing.groupBy("cycle").pivot("kind", kinds).agg(F.sum("size").cast("bigint"))


def run_verdicts(runs: DataFrame) -> DataFrame:
    """Q-11: each run's verdict; and whether its engine changed without a version bump.

    The bump check compares a run with the one before it in the same feed, over the run log
    (one row per run).
    """
    held = (F.col("outcome") == "blocked") | (F.col("verified") == F.lit(False))
    verdict = (
        F.when(F.coalesce(held, F.lit(False)), "blocked")
        .when(F.col("outcome") == "failed", "crashed")
        .when(F.col("outcome") == "skipped", "skipped")
        .when(F.col("published") & (F.col("warnings") > 0), "published with warnings")
        .when(F.col("published"), "published")
        .when(F.col("outcome") == "built", "waiting")
        .otherwise("unknown")
    )
    numbered = ordinal_within(runs, ["feed"], ["started_at", "run_id"], "__n")
    before = numbered.select("feed", (F.col("__n") + 1).alias("__n"), F.col("engine_hash").alias("__hash"), F.col("version").alias("__version"))
    silent = (F.col("__hash") != F.col("engine_hash")) & (F.col("__version") == F.col("version"))
    out = numbered.join(before, ["feed", "__n"], "left").withColumn("verdict", verdict)
    return out.withColumn("unbumped", F.coalesce(silent, F.lit(False))).select(*runs.columns, "verdict", "unbumped")


def run_tallies(judged: DataFrame, last: int = 30) -> DataFrame:
    """A-6: verdict counts over the newest runs."""
    newest = judged.orderBy(F.desc("started_at"), F.desc("run_id")).limit(last)
    return newest.groupBy("verdict").agg(F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("latest"))


def newest_published(judged: DataFrame, at_least: tuple[int, int, int]) -> DataFrame:
    """A-9: the newest published run at or above an engine version that has its counts."""
    v = F.split("version", r"\.")
    number = lambda k: F.coalesce(F.try_element_at(v, F.lit(k)).try_cast("int"), F.lit(0))
    high = F.struct(number(1).alias("a"), number(2).alias("b"), number(3).alias("c")) >= F.struct(*[F.lit(x).alias(n) for x, n in zip(at_least, "abc")])
    ok = judged.filter(F.col("published") & high & F.col("changes").isNotNull())
    return ok.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1)


def incidents(judged: DataFrame, cycles_back: int = 3, most: int = 10, errors_each: int = 3) -> DataFrame:
    """A-10: blocked, crashed or unverified runs of the newest cycles, newest first, with their
    first errors and the total count."""
    recent = judged.select("cycle").distinct().orderBy(F.desc("cycle")).limit(cycles_back)
    bad = judged.join(F.broadcast(recent), "cycle", "left_semi").filter(F.col("verdict").isin("blocked", "crashed"))
    total = bad.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = bad.orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)
    return top.select(
        "run_id", "cycle", "verdict", "started_at", F.slice("errors", 1, errors_each).alias("errors"), total.alias("incidents")
    )


def feed_status(latest: DataFrame, now: Column) -> DataFrame:
    """Q-14: behind, stale, waiting or current, from each feed's newest published run:
    ``feed, shown_cycle, published_at`` and whether it saw the next cycle posted."""
    stale = F.unix_timestamp(now) - F.unix_timestamp("published_at") > STALE_HOURS * 3600
    overdue = F.col("shown_cycle") < cycles.in_effect(now)
    status = (
        F.when(overdue & ~stale & ~F.col("next_posted"), "waiting")
        .when(overdue, "behind")
        .when(stale, "stale")
        .otherwise("current")
    )
    return latest.withColumn("status", status)


# --- gold cases -----------------------------------------------------------------------------


def gold_outcomes(cases: DataFrame, produced: DataFrame) -> DataFrame:
    """A-7, per case: expected against produced. Inputs share ``case``; cases carry the expected
    ``priority, category, contains, known_failure``, produced the actual ones and ``summary``."""
    j = cases.select("case", F.col("priority").alias("want"), F.col("category").alias("want_category"), "contains", "known_failure").join(
        produced.select("case", "priority", "category", "summary"), "case", "left"
    )
    right = (
        F.col("priority").eqNullSafe(F.col("want"))
        & (F.col("want_category").isNull() | F.col("category").eqNullSafe(F.col("want_category")))
        & (F.col("contains").isNull() | F.coalesce(F.contains(F.col("summary"), F.col("contains")), F.lit(False)))
    )
    acts = F.col("priority") == "action"
    return j.select(
        "case",
        right.alias("passed"),
        (F.coalesce(acts, F.lit(False)) & (F.col("want") != "action")).alias("false_action"),
        (F.coalesce(~acts, F.lit(False)) & (F.col("want") == "action")).alias("missed_action"),
        (F.col("known_failure") & ~right).alias("known_failure"),
        (F.col("known_failure") & right).alias("fixed"),
    )


def gold_score(outcomes: DataFrame) -> DataFrame:
    """A-7: totals over all cases."""
    flags = ("passed", "false_action", "missed_action", "known_failure", "fixed")
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def record_reviews(cases: DataFrame, recorded: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q-13: (new review rows, unknown case ids). Blank verdicts and answers the reviewer
    already gave for a case are skipped."""
    given = answers.filter(F.coalesce(F.trim("verdict"), F.lit("")) != "")
    known = cases.select("case").distinct()
    fresh = given.join(known, "case", "left_semi").join(recorded.select("case", "reviewer").distinct(), ["case", "reviewer"], "left_anti")
    fresh = fresh.dropDuplicates(["case", "reviewer"])
    return fresh, given.join(known, "case", "left_anti").select("case").distinct()


def regression_diff(expected: DataFrame, got: DataFrame, columns: list[str]) -> DataFrame:
    """D-17: documents expected against documents produced, per (entity, id)."""
    e = expected.select("entity", "id", F.struct(*columns).alias("want"))
    g = got.select("entity", "id", F.struct(*columns).alias("have"))
    j = e.join(g, ["entity", "id"], "full_outer")
    what = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "differs")
    return j.withColumn("what", what).filter(F.col("what").isNotNull()).select("entity", "id", "what")
