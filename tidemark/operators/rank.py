"""The ranking ladder (R-1 .. R-4): one CASE per stage, in a fixed order.

Inputs are columns of a change: ``file``, ``fields`` (edits) or ``row`` (whole rows). The order
of the branches is the meaning; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import rules as R
from tidemark.config.rules import RuleSet
from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.functions.text import any_word, lit_array


def _pair_in(file: Column, kind: Column, pairs) -> Column:
    out = F.lit(False)
    for f, k in pairs:
        out = out | ((file == f) & (kind == k))
    return out


def base_priority(file: Column, kind: Column, columns: Column, values: Column, soft: Column, rules: RuleSet) -> Column:
    """R-1."""
    named = F.filter(columns, lambda c: ~P.is_in(c, rules.id_columns))
    quiet = lambda c: P.is_fyi_column(c, rules) | P.is_in(c, rules.hidden_columns) | F.array_contains(soft, c)
    loud = lambda c: (
        ~P.is_fyi_column(c, rules)
        & ~F.array_contains(soft, c)
        & F.arrays_overlap(F.split(F.upper(c), "_"), lit_array(rules.action_column_words))
    )
    said = lambda v: F.upper(v).rlike(any_word(rules.action_text_words))
    some = F.size(named) > 0
    case = (
        F.when(P.starts_with_any(file, rules.hidden_files), "hidden")
        .when((kind == "changed") & ~some, "hidden")
        .when(some & F.forall(named, lambda c: P.is_in(c, rules.hidden_columns)), "hidden")
        .when(F.exists(values, lambda v: F.upper(v).contains(rules.hidden_value_mark)), "hidden")
        .when(some & F.forall(named, quiet), "fyi")
        .when(_pair_in(file, kind, rules.row_fyi), "fyi")
        .when(P.starts_with_any(file, rules.action_prefixes), "action")
        .when(_pair_in(file, kind, rules.row_action), "action")
    )
    if rules.action_column_words:
        case = case.when((kind == "changed") & F.exists(named, loud), "action")
    case = case.when(P.starts_with_any(file, rules.route_prefixes), "fyi")
    if rules.action_text_words:
        case = case.when(F.exists(values, said), "action")
    return case.otherwise("fyi")


def edit_base_priority(file: Column, fields: Column, rules: RuleSet) -> Column:
    """R-1 for a changed row, from its edits."""
    return base_priority(
        file,
        F.lit("changed"),
        F.transform(fields, lambda f: f["field"]),
        F.concat(F.transform(fields, lambda f: f["old"]), F.transform(fields, lambda f: f["new"])),
        F.transform(F.filter(fields, lambda f: f["size"] == "fyi"), lambda f: f["field"]),
        rules,
    )


def edit_priority(df, rules: RuleSet, text_overrides: bool = True):
    """R-1 then R-2 over a table with ``file, fields, old_row, new_row``: one column step per
    override, in order."""
    file, fields = F.col("file"), F.col("fields")
    columns = F.transform(fields, lambda f: f["field"])
    out = df.withColumn("priority", edit_base_priority(file, fields, rules))
    pri = F.col("priority")
    step = lambda cond, value: out.withColumn("priority", F.when(F.coalesce(cond, F.lit(False)), value).otherwise(pri))
    if text_overrides:
        only_remark = columns == F.array(F.lit("REMARK"))
        first = F.try_element_at(fields, F.lit(1))
        old, new = F.when(only_remark, first["old"]), F.when(only_remark, first["new"])
        out = step(T.reworded(old, new) | T.phones_only(old, new), F.lit("fyi"))
        out = out.withColumn("priority", F.coalesce(T.lighting_rank(old, new), pri))
    out = step(file.isin(*R.IFR_REMARK_FILES) & (pri == "action"), F.lit("ifr"))
    some = F.size(fields) > 0
    out = step(
        some & F.forall(columns, lambda c: c.isin(*R.DECLARED_DISTANCES)),
        F.when(P.distance_was_cut(fields), F.lit("action")).otherwise(F.lit("fyi")),
    )
    if text_overrides:
        hours = (pri == "action") & some & F.forall(columns, P.is_hours_column)
        judged = F.when(hours, fields).otherwise(F.array().cast(R_EDITS))
        out = step(hours & F.forall(judged, lambda f: F.coalesce(T.same_schedule(f["old"], f["new"]), F.lit(False))), F.lit("fyi"))
    out = step(F.arrays_overlap(P.kept_declination(file, F.col("old_row"), F.col("new_row")), columns), F.lit("action"))
    out = step(
        (pri == "action") & file.isin("APT_RWY", "APT_RWY_END") & P.is_helipad(P.cell(F.col("new_row"), "RWY_ID")), F.lit("fyi")
    )
    return out


R_EDITS = "array<struct<field:string,old:string,new:string,size:string>>"


def row_priority(df, rules: RuleSet):
    """R-1 then R-3 over whole rows: ``file, kind, row`` and ``existed`` (an added row's sub-key
    already existed at the entity)."""
    file, kind, row = F.col("file"), F.col("kind"), F.col("row")
    columns = F.filter(F.map_keys(row), lambda c: ~c.startswith("_"))
    none = F.array().cast("array<string>")
    out = df.withColumn("priority", base_priority(file, kind, columns, F.map_values(row), none, rules))
    pri = F.col("priority")
    step = lambda cond, value: out.withColumn("priority", F.when(F.coalesce(cond, F.lit(False)), value).otherwise(pri))
    known = (kind == "added") & F.col("existed")
    out = step((file == "FRQ") & (known | F.upper(P.cell(row, "FREQ_USE")).rlike(any_word(R.LISTED_USES))), F.lit("fyi"))
    words = any_word(R.ACTION_TEXT_WORDS)
    out = step((pri == "action") & (P.is_empty_facility(file, row) | P.is_outlet_note(file, row, words)), F.lit("fyi"))
    shown = pri != "hidden"
    survey = file.isin(*R.SURVEY_REMARK_FILES) & P.cell(row, "REF_COL_NAME").endswith("_SOURCE_CODE")
    pad = file.isin("APT_RWY", "APT_RWY_END") & P.is_helipad(P.cell(row, "RWY_ID"))
    listing = (file == "ATC_BASE") & (F.upper(P.cell(row, "FACILITY_TYPE")) == "NON-ATCT") & ~P.is_empty_facility(file, row)
    tier = F.lit(None).cast("string")
    for (f, k), value in rules.row_tiers.items():
        tier = F.when((file == f) & (kind == k), F.lit(value)).otherwise(tier)
    out = out.withColumn(
        "priority",
        F.when(~shown, pri).when(survey, "hidden").when(pad, "fyi").when(listing, "ifr").otherwise(F.coalesce(tier, pri)),
    )
    return step(file.isin(*R.IFR_REMARK_FILES) & (pri == "action"), F.lit("ifr"))


def is_remark_edit(file: Column, kind: Column, fields: Column) -> Column:
    """A frequency row whose only edit is its remark."""
    return (file == "FRQ") & (kind == "changed") & (F.transform(fields, lambda f: f["field"]) == F.array(F.lit("REMARK")))


def category(source: Column, kind: Column, fields: Column, rules: RuleSet) -> Column:
    """R-4: the first rule that names a category."""
    s = F.upper(source)
    columns = F.coalesce(F.transform(fields, lambda f: f["field"]), F.array().cast("array<string>"))
    case = F.when(F.coalesce(is_remark_edit(s, kind, fields), F.lit(False)), "remark")
    for target in sorted(set(rules.column_category.values())):
        mine = [c for c, v in rules.column_category.items() if v == target]
        case = case.when((F.size(columns) > 0) & F.forall(columns, lambda c: c.isin(*mine)), target)
    case = case.when(P.is_in(P.file_base(s), rules.remark_files), "remark")
    for prefix, name in rules.category_prefixes:
        case = case.when(s.startswith(prefix), name)
    return case.otherwise("other")


def priority_order(priority: Column) -> Column:
    """W-3: action, ifr, fyi."""
    return F.when(priority == "action", 0).when(priority == "ifr", 1).when(priority == "fyi", 2).otherwise(3)
