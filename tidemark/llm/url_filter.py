"""URL verdicts by pattern rules that only run where their rarest token occurs.

Every rule has literal tokens that a matching URL must contain whole. How often they occur is counted
over all URLs, and the rule is filed under the rarest. A URL looks its own tokens up in that
index and runs the regular expressions of the rules it finds, no others. All of it happens within a
row, in DataFrame functions: no shuffle but that of the token counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.llm.url_rules import PATTERNS

TOKEN = "[a-z0-9]+"
#: Rules one index holds; the literal sent with the plan stays below a few MB.
MOST_RULES = 10_000

#: (host and path prefix, verdict) of the base list; fixed values.
BASE = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    #: Matched against host and path (base) or against the lower-cased URL.
    base: bool


def base_rule(text: str, verdict: str) -> Rule:
    """A host with all its subdomains and the start of a path, as host/path."""
    host, slash, path = text.partition("/")
    # The last token of the path may go on in the URL unless a separator closes it.
    closed = re.findall(f"{TOKEN}(?=[^A-Za-z0-9])", slash + path)
    tokens = tuple(re.findall(TOKEN, host)) + tuple(t for t in closed if t == t.lower())
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens, True)


def pattern_rule(text: str, verdict: str) -> Rule:
    """A pattern of :mod:`tidemark.llm.url_rules`."""
    body = text.removeprefix("||")
    regex = "".join({"*": "(?s:.*)", "^": "(?:[^a-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body)
    if body != text:
        regex = r"^[^/?#]*://(?:[^/?#]*\.)?" + regex
    # A token counts only if the pattern itself bounds it on both sides.
    framed = ("^" if body != text else "*") + body + "*"
    tokens = tuple(m[1] for m in re.finditer(rf"(?<=[^a-z0-9*])({TOKEN})(?=[^a-z0-9*])", framed))
    return Rule(text, verdict, regex, tokens, False)


def default_rules() -> list[Rule]:
    return [base_rule(*r) for r in BASE] + [pattern_rule(*r) for r in PATTERNS]


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def token_counts(urls: DataFrame, column: str, wanted: list[str]) -> dict[str, int]:
    """In how many URLs each wanted token occurs; at most as many rows as wanted tokens arrive."""
    if not wanted:
        return {}
    own = F.array_intersect(tokens_of(F.col(column)), F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(own).alias("token")).groupBy("token").count().collect()
    return {r[0]: r[1] for r in rows}


def rarest_token_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Token to numbers of the rules filed under it; under the empty token those without tokens."""
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(rarest, []).append(k)
    return index


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict, method_rule.

    ``rule``: of the base rules that fit host and path the longest, else null; it decides. Else the
    longest of the patterns that match (``method_rule``) decides, else the verdict is allow. Equal
    lengths: the alphabetically first. A null URL, or one without ``://``, has an empty host and path.
    More than ``MOST_RULES`` rules are refused.
    """
    rules = default_rules() if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; an index holds {MOST_RULES}")
    rules = sorted(rules, key=lambda r: (-len(r.text), r.text))  # the first match wins
    index = rarest_token_index(rules, token_counts(pages, url, sorted({t for r in rules for t in r.tokens})))
    always = F.array(*[F.lit(k) for k in index.pop("", [])]).cast("array<int>")
    table = F.array(*[F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.base).alias("base")) for r in rules])
    filed = F.create_map(*[x for token, ks in sorted(index.items()) for x in (F.lit(token), F.array(*[F.lit(k) for k in ks]))]) if index else None
    listed = F.array(*[F.lit(t) for t in sorted(index)]).cast("array<string>")

    rows = pages.select(F.col(key).alias("__key"), F.coalesce(F.col(url), F.lit("")).alias("__url"))
    rows = rows.select("__key", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path"), lower_ascii(F.col("__url")).alias("__plain"))
    found = F.array_intersect(tokens_of(F.col("__plain")), listed)
    fetched = F.concat(always, F.flatten(F.transform(found, lambda t: F.element_at(filed, t)))) if index else always
    rows = rows.withColumn("__fetched", F.array_sort(fetched))
    place = F.concat("__host", "__path")

    def fits(k: Column) -> Column:
        rule = F.get(table, k)
        return F.when(rule["base"], F.rlike(place, rule["regex"])).otherwise(F.rlike(F.col("__plain"), rule["regex"]))

    matched = rows.withColumn("__matched", F.transform(F.filter("__fetched", fits), lambda k: F.get(table, k)))
    first = lambda base: F.get(F.filter("__matched", lambda r: r["base"] == F.lit(base)), F.lit(0))
    out = matched.withColumn("__base", first(True)).withColumn("__method", first(False))
    return out.select(
        F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__base.text").alias("rule"),
        F.coalesce("__base.verdict", "__method.verdict", F.lit("allow")).alias("verdict"), F.col("__method.text").alias("method_rule"),
    )


def oracle() -> str:
    """The same rows as plain SQL: every rule tried on every URL."""
    rules = sorted(default_rules(), key=lambda r: (-len(r.text), r.text))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    case = lambda base, what: " ".join(f"WHEN regexp_matches({'host || path' if base else 'plain'}, {quote(r.regex)}, 's') THEN {quote(what(r))}" for r in rules if r.base == base)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(url, {letters}) AS plain, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), {letters}) AS host, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, CASE {case(True, lambda r: r.text)} END AS rule, CASE {case(True, lambda r: r.verdict)} END AS ruled,
  CASE {case(False, lambda r: r.text)} END AS method_rule, CASE {case(False, lambda r: r.verdict)} END AS method FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, method, 'allow') AS verdict, method_rule FROM m"""
