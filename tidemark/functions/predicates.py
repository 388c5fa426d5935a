"""Rule predicates (P-1 .. P-12) as column expressions built from a RuleSet."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import rules as R
from tidemark.config.rules import RuleSet
from tidemark.functions.text import any_word, lit_array, lit_map

# --- Fixed values: plausible values ---------------------------------------------------------
JUNK_WORDS = ("None", "nan", "NaN", "null", "undefined")
JUNK_MARKS = ("Traceback", "{", "}", "�", "??")
FREQUENCY_BANDS = ((30, 88, False), (108, 152, True), (225, 400, True), (190, 1750, True), (2000, 30000, True))
SIZE_RANGE = (1, 25000)
GLIDE_RANGE = (2, 7)
ELEVATION_RANGE = (-300, 15000)
ENTITY_ID_FORM = r"^[A-Z0-9]{2,4}$"
RESERVED_NAMES = (
    "latest", "history", "assets", "watch", "list", "about", "guide", "docs", "changelog",
    "privacy", "terms", "status",
)
# --------------------------------------------------------------------------------------------


def starts_with_any(column: Column, prefixes) -> Column:
    prefixes = tuple(prefixes)
    if not prefixes:
        return F.lit(False)
    return column.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def is_in(column: Column, values) -> Column:
    values = tuple(values)
    return column.isin(*values) if values else F.lit(False)


def file_base(name: Column) -> Column:
    """P-1: table name without its extension, upper-cased."""
    return F.regexp_replace(F.upper(name), r"\.CSV", "")


def is_noise(column: Column, rules: RuleSet) -> Column:
    """P-2: survey and bookkeeping columns."""
    c = F.upper(column)
    tests = [is_in(column, rules.hidden_columns), is_in(c, rules.noise_columns), starts_with_any(c, rules.noise_prefixes)]
    tests += [c.contains(x) for x in rules.noise_infixes] + [c.endswith(x) for x in rules.noise_suffixes]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_blank_fill(column: Column, old: Column, new: Column) -> Column:
    """P-3: a blank written as an explicit none (or as N on a flag column)."""
    o, n = F.upper(F.trim(old)), F.upper(F.trim(new))
    flag = F.upper(column).endswith("_FLAG")
    plain = o.isin(*R.BLANK_VALUES) & n.isin(*R.BLANK_VALUES)
    return plain | (flag & o.isin(*R.BLANK_FLAG_VALUES) & n.isin(*R.BLANK_FLAG_VALUES))


def is_phone_format(column: Column, old: Column, new: Column) -> Column:
    """P-4: the same digits, written differently, in a phone column."""
    digits = lambda v: F.regexp_replace(v, r"\D", "")
    return F.upper(column).contains("PHONE") & (digits(old) != "") & (digits(old) == digits(new))


def change_size(column: Column, old: Column, new: Column, rules: RuleSet) -> Column:
    """P-5: 'drop', 'fyi' or null for a numeric column with thresholds."""
    if not rules.small_changes:
        return F.lit(None).cast("string")
    moved = F.abs(old.try_cast("double") - new.try_cast("double"))
    below = F.try_element_at(lit_map({c: a for c, (a, _) in rules.small_changes.items()}), column)
    soft = F.try_element_at(lit_map({c: b for c, (_, b) in rules.small_changes.items()}), column)
    return F.when(moved < below, F.lit("drop")).when(moved < soft, F.lit("fyi"))


def is_hours_column(column: Column) -> Column:
    """P-6."""
    return F.arrays_overlap(F.split(F.upper(column), "_"), lit_array(R.HOURS_WORDS))


def is_fyi_column(column: Column, rules: RuleSet) -> Column:
    """P-6: worth showing, never a reason to act."""
    out = is_in(column, rules.name_columns) | is_in(column, rules.fyi_columns)
    for suffix in rules.fyi_suffixes:
        out = out | column.endswith(suffix)
    return out


def is_helipad(runway: Column) -> Column:
    """P-6: H alone, with a number (and a letter), or with one letter, hyphenated or not."""
    name = F.coalesce(runway, F.lit(""))
    rest = F.substring(name, 2, 100)
    lettered = F.regexp_replace(rest, "^-", "").rlike("^[A-Z]$")
    return name.startswith("H") & ((rest == "") | lettered | rest.rlike("^[0-9]+[A-Z]?$"))


def cell(row: Column, column: str) -> Column:
    """A row's value, blank when the column is missing."""
    return F.coalesce(F.try_element_at(row, F.lit(column)), F.lit(""))


def kept_declination(file: Column, old_row: Column, new_row: Column) -> Column:
    """P-7: the noise columns that count because a device's alignment changed."""
    changed = F.lit(False)
    for c in R.DECLINATION_COLUMNS:
        changed = changed | (cell(old_row, c) != cell(new_row, c))
    aligned = (file == "NAV_BASE") & cell(new_row, "NAV_TYPE").isin(*R.DECLINATION_TYPES) & changed
    present = F.filter(lit_array(R.DECLINATION_COLUMNS), lambda c: F.map_contains_key(new_row, c))
    return F.when(aligned, present).otherwise(F.array().cast("array<string>"))


def distance_was_cut(fields: Column) -> Column:
    """P-8: a declared distance shrank by 500 or by a tenth."""

    def cut(f: Column) -> Column:
        was = F.when(f["old"] == "", F.lit(0.0)).otherwise(f["old"].try_cast("double"))
        now = f["new"].try_cast("double")
        loss = was - now
        shorter = (was > 0) & (now < was) & ((loss >= R.DECLARED_CUT_FEET) | (loss / F.nullif(was, F.lit(0.0)) >= R.DECLARED_CUT_SHARE))
        return F.coalesce(f["field"].isin(*R.DECLARED_DISTANCES) & (f["new"] != "") & shorter, F.lit(False))

    return F.exists(fields, cut)


def is_empty_facility(file: Column, row: Column) -> Column:
    """P-9: a non-tower facility row that names no service."""
    named = F.exists(
        F.map_entries(row),
        lambda e: (e["value"] != "") & F.arrays_overlap(F.split(F.upper(e["key"]), "_"), lit_array(R.SERVICE_WORDS)),
    )
    return (file == "ATC_BASE") & (F.upper(cell(row, "FACILITY_TYPE")) == "NON-ATCT") & ~named


def is_outlet_note(file: Column, row: Column, action_words: str) -> Column:
    """P-9: a remark that only names an outlet's operator."""
    t = F.upper(cell(row, "REMARK"))
    # What provides it: the words after the first 'PRVDD BY', at least one of them a name.
    provider = F.when(t.rlike(any_word(["PRVDD BY"])), F.substring_index(F.substring_index(t, "PRVDD BY ", -1), ",", 1))
    operated = F.coalesce(provider, F.lit("")).rlike("^[A-Z. ]+ (?:" + "|".join(R.OUTLET_OPERATORS) + r")\b")
    return (file == "ATC_RMK") & operated & ~t.rlike(any_word(R.CLEARANCE_WORDS)) & ~t.rlike(action_words)


def number(value: Column) -> Column:
    return F.regexp_replace(value, ",", "").try_cast("double")


def is_real_frequency(value: Column) -> Column:
    """P-10: inside one of the aviation bands; text that is no number passes."""
    f = number(value)
    ok = f.isNull()
    for low, high, closed in FREQUENCY_BANDS:
        ok = ok | ((f >= low) & ((f <= high) if closed else (f < high)))
    return ok


def is_real_runway(value: Column) -> Column:
    """P-10: every end has a known form, and two numbered ends are 17 to 19 apart."""
    ends = F.split(value, "/")
    numbers = F.filter(
        F.transform(ends, lambda e: F.regexp_extract(e, r"^(\d+)", 1).try_cast("int")), lambda n: n.isNotNull()
    )
    gap = F.abs(F.try_element_at(numbers, F.lit(1)) - F.try_element_at(numbers, F.lit(2)))
    reciprocal = F.when((F.size(ends) == 2) & (F.size(numbers) == 2), gap.between(17, 19)).otherwise(F.lit(True))
    return F.forall(ends, is_runway_end) & reciprocal


def is_runway_end(end: Column) -> Column:
    """A number from 1 to 36 with a side and a kind, a direction, a helipad or a lettered strip."""
    number = F.regexp_extract(end, "^([0-9]{1,2})[LRC]?[WUT]?$", 1).try_cast("int")
    numbered = F.coalesce((number >= 1) & (number <= 36), F.lit(False))
    direction = end.rlike("^[NSEW]{1,2}$")
    pad = end.startswith("H") & F.substring(end, 2, 100).rlike("^[0-9]+[A-Z]?$")
    return numbered | direction | pad | end.rlike("^[A-Z][0-9]{0,2}$")


def is_frequency_field(field: Column) -> Column:
    """The column's name begins or ends with the part FREQ."""
    parts = F.split(field, "_")
    return (F.get(parts, 0) == "FREQ") | (F.element_at(parts, -1) == "FREQ")


def value_problem(field: Column, new: Column) -> Column:
    """P-10: why a new value looks impossible, or null."""
    n = number(new)
    bad_size = n.isNull() | ~n.between(*SIZE_RANGE)
    bad_glide = n.isNull() | ~n.between(*GLIDE_RANGE)
    return (
        F.when(new == "", F.lit(None).cast("string"))
        .when(is_frequency_field(field), F.when(~is_real_frequency(new), F.concat(field, F.lit(" "), new, F.lit(" is not a real frequency"))))
        .when(field == "RWY_ID", F.when(~is_real_runway(new), F.concat(F.lit("runway id "), new, F.lit(" is not a real runway"))))
        .when(field == "RWY_END_ID", F.when(~is_real_runway(new), F.concat(F.lit("runway end "), new, F.lit(" is not a real runway end"))))
        .when(field.isin("RWY_LEN", "RWY_WIDTH"), F.when(bad_size, F.concat(field, F.lit(" "), new, F.lit(" ft is impossible"))))
        .when(field == "G_S_ANGLE", F.when(bad_glide, F.concat(F.lit("glide slope "), new, F.lit(" degrees is impossible"))))
        .when(
            field.endswith("ELEV"),
            F.when(n.isNotNull() & ~n.between(*ELEVATION_RANGE), F.concat(field, F.lit(" "), new, F.lit(" ft is impossible"))),
        )
    )


def has_junk(summary: Column, quoted: Column) -> Column:
    """P-11: junk in the generated part of a line, once the values it quotes are taken out."""
    longest_first = F.array_sort(
        F.filter(quoted, lambda v: v.isNotNull() & (v != "")),
        lambda a, b: F.length(b) - F.length(a),
    )
    rest = F.aggregate(
        longest_first, summary, lambda s, v: F.replace(F.replace(s, v, F.lit("")), F.initcap(v), F.lit(""))
    )
    marked = reduce(lambda a, b: a | b, [F.contains(rest, F.lit(mark)) for mark in JUNK_MARKS])
    return marked | rest.rlike(any_word(JUNK_WORDS))


def is_entity_id(value: Column) -> Column:
    """P-12: an id that may have its own page."""
    return value.rlike(ENTITY_ID_FORM) & ~F.lower(value).isin(*RESERVED_NAMES)
