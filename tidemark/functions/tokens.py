"""Texts as runs: what word rules are written over.

A text is its leading marks, and then runs of letters or of digits, each with the marks and blanks that
follow it. Rules look at runs and their neighbours by position, in arrays, and never at patterns made from
data; a changed text is put together from the same parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, lit_array

RUN = "([A-Za-z]+|[0-9]+)([^A-Za-z0-9]*)"
BLANKS = " \t\r\n\f"
#: What may stand between the words of a phrase.
APART = r"^[\s-]+$"


def capitals(text: Column) -> Column:
    """a-z as A-Z and nothing else, so that places in the text stay the same."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def parsed(text: Column) -> Column:
    """struct<lead, w, sep>: the runs ``w`` and what follows each, ``sep``."""
    return F.struct(
        F.regexp_extract(text, "^[^A-Za-z0-9]*", 0).alias("lead"),
        F.regexp_extract_all(text, F.lit(RUN), F.lit(1)).alias("w"),
        F.regexp_extract_all(text, F.lit(RUN), F.lit(2)).alias("sep"),
    )


def at(t: Column, k: Column) -> Column:
    """The run at a place, empty outside the text."""
    return F.coalesce(F.get(t["w"], k), F.lit(""))


def after(t: Column, k: Column) -> Column:
    """What follows the run at a place; what leads the text for place -1."""
    return F.coalesce(F.get(t["sep"], k), F.when(k == -1, t["lead"]), F.lit(""))


def places(t: Column, test: Callable[[Column], Column]) -> Column:
    """The places (from 0) whose test holds."""
    every = F.when(F.size(t["w"]) > 0, F.sequence(F.lit(0), F.size(t["w"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, test)


def is_number(w: Column) -> Column:
    return F.substring(w, 1, 1).between("0", "9")


def is_word(w: Column) -> Column:
    return (w != "") & ~is_number(w)


def blank(sep: Column) -> Column:
    """Nothing but blanks, one at least."""
    return (sep != "") & (F.trim(F.translate(sep, BLANKS, "     ")) == "")


def holds(c: Column, mark: str) -> Column:
    return F.contains(c, F.lit(mark))


def joined(t: Column, first: Column, n: Column) -> Column:
    """The text of ``n`` runs from a place on, each with what follows it."""
    both = F.zip_with(F.slice(t["w"], first + 1, n), F.slice(t["sep"], first + 1, n), lambda w, s: F.concat(w, s))
    return F.array_join(both, "")


def spliced(t: Column, chosen: Column) -> Column:
    """The text with runs replaced: ``chosen`` are struct<start, upto, say> in order, without overlap. What
    follows the last replaced run stays."""

    def segment(c: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get(chosen, i - 1)["upto"]).otherwise(0)
        return F.concat(after(t, done - 1), joined(t, done, c["start"] - done), c["say"])

    last = F.coalesce(F.get(chosen, F.size(chosen) - 1)["upto"], F.lit(0))
    return F.concat(F.array_join(F.transform(chosen, segment), ""), after(t, last - 1), joined(t, last, F.greatest(F.size(t["w"]) - last, F.lit(0))))


def words_of(t: Column) -> Column:
    """The words of a parsed text; the letters of initials, two or three with points, are one."""
    initial = lambda k: is_word(at(t, k)) & (F.length(at(t, k)) == 1)
    tied = lambda k: initial(k) & (after(t, k) == ".") & initial(k + 1) & after(t, k + 1).startswith(".")
    alone = F.transform(places(t, lambda k: is_word(at(t, k)) & ~tied(k) & ~tied(k - 1)), lambda k: at(t, k))
    third = lambda k: F.when(tied(k + 1), at(t, k + 2)).otherwise("")
    return F.concat(alone, F.transform(places(t, lambda k: tied(k) & ~tied(k - 1)), lambda k: F.concat(at(t, k), at(t, k + 1), third(k))))


# --- what is no word ----------------------------------------------------------------------------
def without_addresses(text: Column) -> Column:
    """A text in which no blank-free stretch is a mail or web address; blanks become one."""
    stretches = F.split(F.trim(F.translate(text, BLANKS, "     ")), " +")
    web = lambda c: F.substring_index(F.substring_index(F.substring_index(c, "HTTP://", 1), "HTTPS://", 1), "WWW.", 1)
    mail = lambda c: (F.instr(c, "@") > 1) & ~c.endswith("@")
    kept = F.transform(stretches, lambda c: F.when(mail(c), "").when(web(capitals(c)) != capitals(c), F.substring(c, F.lit(1), F.length(web(capitals(c))))).otherwise(c))
    return F.when(F.contains(text, F.lit("@")) | F.contains(capitals(text), F.lit("WWW.")) | F.contains(capitals(text), F.lit("://")), F.array_join(kept, " ")).otherwise(text)


def pavement_codes(t: Column) -> Column:
    """Where four single letters stand joined by slashes and by nothing else: a code's first places."""
    letter = lambda k: is_word(at(t, k)) & (F.length(at(t, k)) == 1)
    inner = lambda k: letter(k) & (after(t, k) == "/")
    opens = lambda k: (after(t, k - 1) != "") | (k == 0)
    closes = lambda k: (after(t, k) != "") | (k == F.size(t["w"]) - 1)
    found = places(t, lambda k: inner(k) & inner(k + 1) & inner(k + 2) & letter(k + 3) & opens(k) & closes(k + 3))
    return F.when(F.size(F.filter(t["sep"], lambda s: s == "/")) >= 3, found).otherwise(F.array().cast("array<int>"))


def measures_by(t: Column, k: Column) -> Column:
    """An X between a number (or its unit) and a number: a dimension."""
    left, right = at(t, k - 1), at(t, k + 1)
    tight = lambda s: (s == "") | blank(s)
    return (at(t, k) == "X") & tight(after(t, k - 1)) & tight(after(t, k)) & is_number(right) & (is_number(left) | (left.endswith("T") & blank(after(t, k - 1))))


def masked(text: Column) -> Column:
    """A text in capitals without addresses, pavement codes and the X of dimensions: blanks are in their place."""

    def hide(t: Column) -> Column:
        body = lambda codes: F.concat(
            t["lead"],
            F.array_join(
                F.transform(
                    F.arrays_zip(t["w"].alias("w"), t["sep"].alias("sep")),
                    lambda r, k: F.when(F.exists(codes, lambda c: k.between(c, c + 3)) | measures_by(t, k), " ").otherwise(F.concat(r["w"], r["sep"])),
                ),
                "",
            ),
        )
        return let(pavement_codes(t), body)

    # Only texts with four single letters between slashes, or an X before a number, have anything to hide.
    some = f"[A-Z]/[A-Z]/[A-Z]/[A-Z]|(?:^|[^A-Z])X[{BLANKS}]*[0-9]"
    return let(without_addresses_of(capitals(text)), lambda x: F.when(x.rlike(some), let(parsed(x), hide)).otherwise(x))


def without_addresses_of(upper: Column) -> Column:
    """:func:`without_addresses` of an expression, which is evaluated once."""
    return let(upper, without_addresses)


def compounds(text: Column) -> Column:
    """Letters and digits that stand together, by nothing, hyphens or slashes, as written."""
    return F.filter(F.transform(F.split(text, "[^A-Z0-9/-]+"), lambda c: F.btrim(c, F.lit("-/"))), lambda c: c != "")


def parts_of(compound: Column) -> Column:
    return F.filter(F.split(compound, "[-/]+"), lambda c: c != "")


def alphabetic(part: Column) -> Column:
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") == ""


def mixed(part: Column) -> Column:
    """Letters and digits both: a code."""
    letters = F.translate(part, "0123456789", "")
    return (letters != "") & (letters != part)


def any_of(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda w: F.array_contains(lit_array(words), w)
