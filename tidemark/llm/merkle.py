"""Merkle manifest of a dataset: a tree of digests per source, and one tree over the sources.

Rows are the leaves, in the order of their keys. At every level sixteen consecutive nodes are a run.
Each node computes the indices of its siblings by slot offsets and meets them in a self-join; rows in
slot zero then hold a whole run and emit its parent. Siblings come in two parts, those left and those
right of the node, so that a proof can be folded again from any claimed leaf.

A level is a sixteenth of the one below, a run is all that is gathered, and the nodes of a run share a
partition, so only nodes are shuffled, never the exploded indices. Digests travel as 32 bytes and are
hashed as hex text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii
from tidemark.operators.skew import ordinal_within
from tidemark.session import broadcast_if_bounded, cut_lineage

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def coded(c: Column) -> Column:
    """A value with its length in bytes, so that no two rows read alike; null is a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row's values, in hex."""
    return F.sha2(F.concat(*[coded(v) for v in values]), 256)


def _members(level: DataFrame, fanout: int) -> DataFrame:
    """(tree, idx, run, n, digest, left, right) of each node whose tree has more than one node here."""
    nodes = level.filter("n > 1").withColumn("run", F.floor(F.col("idx") / fanout)).repartition("tree", "run")
    offset = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1)))
    asked = nodes.select("tree", "run", "idx", "n", "digest", offset.alias("offset"))
    asked = asked.withColumn("sibling", F.col("run") * fanout + F.pmod(F.col("idx") + F.col("offset"), F.lit(fanout)))
    asked = asked.filter("sibling < n")
    held = nodes.select("tree", "run", F.col("idx").alias("at"), F.col("digest").alias("of_sibling"))
    # The difference keeps the index out of the join's keys: both sides stay where their runs are.
    met = asked.join(held, ["tree", "run"]).filter(F.col("at") - F.col("sibling") == 0)
    run = F.sort_array(F.collect_list(F.struct("at", hex_text(F.col("of_sibling")).alias("digest"))))
    whole = met.groupBy("tree", "run", "idx").agg(F.first("n").alias("n"), F.first("digest").alias("digest"), run.alias("nodes"))

    def side(keep) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["digest"]), ""))

    left, right = side(lambda x: x["at"] < F.col("idx")), side(lambda x: x["at"] > F.col("idx"))
    return whole.select("tree", "idx", "run", "n", "digest", left.alias("left"), right.alias("right"))


def grow(nodes: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The trees over ``nodes`` (tree, idx from 0, n nodes of the tree, digest).

    Returns (tree, idx, path): the siblings of each node and of its ancestors, lowest first, and (tree,
    digest): the tops. A tree of one node is its own top and has no path.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    level, tops, levels = nodes, nodes.filter("n = 1").select("tree", "digest"), []
    while most > 1:
        members = cut_lineage(_members(level, fanout))
        levels.append(members)
        level = members.filter(F.col("idx") % fanout == 0).select(
            "tree",
            F.col("run").alias("idx"),
            F.ceil(F.col("n") / fanout).alias("n"),
            F.unhex(F.sha2(hex_text(F.concat("digest", "right")), 256)).alias("digest"),
        )
        tops = tops.unionByName(level.filter("n = 1").select("tree", "digest"))
        most = -(-most // fanout)
    own = F.array(F.struct("left", "right"))
    paths = nodes.select("tree", "idx", F.expr(NO_PATH).alias("path")).limit(0)
    for k, members in enumerate(reversed(levels)):
        above = paths.select("tree", F.col("idx").alias("run"), F.col("path").alias("above"))
        paths = members.join(above, ["tree", "run"], "left") if k else members.withColumn("above", F.expr(NO_PATH))
        paths = paths.select("tree", "idx", F.concat(own, F.coalesce("above", F.expr(NO_PATH))).alias("path"))
    return paths, tops


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(hex_text(s["left"]), h, hex_text(s["right"])), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, left to right, lowest level first."""
    return F.sha2(F.array_join(F.transform(path, lambda s: hex_text(F.concat(s["left"], s["right"]))), ""), 256)


def lower_cased_fifth(key: Column, text: Column) -> Column:
    """The text a fifth of the rows claim: those whose key's CRC-32 is divisible by 5 lost their A-Z."""
    return F.when(F.crc32(key.cast("string")) % 5 == 0, lower_ascii(text)).otherwise(text)


def proofs(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", fields: Sequence[str] = FIELDS, claimed=None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: key, leaf, claimed (the leaf of the claimed text), subroot, root and path.

    Leaves are ordered by key inside a source, sources by their bytes; nulls come first and are a source
    and a key like any other. Rows of one key are ordered by digest, so repeated rows change nothing but
    their number. Null, empty and very long values have their own leaves. ``claimed`` gives, of the
    key's and the text's column, the text that is to be checked; the text itself if it is left out. An
    empty table gives an empty result. Columns outside ``fields`` are not looked at.
    """
    values = [F.col(c) for c in fields]
    told = [claimed(F.col(key), F.col(c)) if c == text and claimed else F.col(c) for c in fields]
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), coded(F.col(source)).alias("tree"),
        F.unhex(leaf_of(values)).alias("digest"), F.unhex(leaf_of(told)).alias("claimed"),
    )
    rows = cut_lineage(ordinal_within(rows, ["tree"], ["key", "digest"], "idx").withColumn("idx", F.col("idx") - 1))
    sizes = rows.groupBy("tree", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    nodes = cut_lineage(rows.select("tree", "idx", "digest").join(broadcast_if_bounded(sizes.select("tree", "n")), "tree"))
    paths, tops = grow(nodes, fanout)

    found = sizes.select("tree", "source").join(tops, "tree")
    found = ordinal_within(found.withColumn("all", F.lit("all")), ["all"], ["source"], "place")
    found = cut_lineage(found.withColumn("place", F.col("place") - 1))
    every = found.count()
    upper, root = grow(found.select(F.col("all").alias("tree"), F.col("place").alias("idx"), F.lit(every).cast("long").alias("n"), "digest"), fanout)
    root = root.first()
    upper = upper.select(F.col("idx").alias("place"), F.col("path").alias("above"))
    trees = found.join(upper, "place", "left").select("tree", F.col("digest").alias("subroot"), F.coalesce("above", F.expr(NO_PATH)).alias("above"))

    whole = rows.drop("source").join(paths, ["tree", "idx"], "left").join(broadcast_if_bounded(cut_lineage(trees)), "tree")
    return whole.select(
        F.col("key").alias(key),
        hex_text(F.col("digest")).alias("leaf"),
        hex_text(F.col("claimed")).alias("claimed"),
        hex_text(F.col("subroot")).alias("subroot"),
        F.lit(bytes(root.digest).hex() if root else None).cast("string").alias("root"),
        F.concat(F.coalesce("path", F.expr(NO_PATH)), F.col("above")).alias("path"),
    )


def verified_rows(proved: DataFrame, key: str = "doc_id") -> DataFrame:
    """The proofs of :func:`proofs`, checked: the folded root of each claimed leaf and whether it is the root."""
    checked = proved.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("claimed"), F.col("path"))})
    return checked.select(
        key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


# --- SQL for the same rows ---------------------------------------------------------------------
def _sql_levels(name: str, nodes: str, levels: int) -> str:
    """Tables ``name``_0.. of nodes (tree, idx, n, digest) and ``name``_runs0.. of runs (tree, run, nodes)."""
    parts = [f"{name}_0 AS ({nodes})"]
    for k in range(levels):
        parts.append(f"""{name}_runs{k} AS (SELECT tree, idx // 16 AS run, any_value(n) AS n, list(digest ORDER BY idx) AS nodes
            FROM {name}_{k} WHERE n > 1 GROUP BY ALL)""")
        parts.append(f"""{name}_{k + 1} AS (SELECT tree, run AS idx, (n + 15) // 16 AS n, sha256(array_to_string(nodes, '')) AS digest
            FROM {name}_runs{k})""")
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}_{k} WHERE n = 1" for k in range(levels + 1))
    return ", ".join([*parts, f"{name}_tops AS ({tops})"])


def _sql_folds(name: str, trees: str, place: str, levels: int) -> str:
    """Tables of the rows with their fold and proof after each level of ``trees``; ``place`` is their index."""
    parts = []
    for k in range(levels):
        slot = f"(d.{place} // {16**k}) % 16"
        left, right = f"array_to_string(r.nodes[1:{slot}], '')", f"array_to_string(r.nodes[{slot} + 2:], '')"
        parts.append(f"""{name}_{k + 1} AS (SELECT d.* REPLACE (
              CASE WHEN r.nodes IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
              CASE WHEN r.nodes IS NULL THEN proof ELSE proof || {left} || {right} END AS proof)
            FROM {name}_{k} d LEFT JOIN {trees}_runs{k} r ON r.tree IS NOT DISTINCT FROM d.tree AND r.run = d.{place} // {16 ** (k + 1)})""")
    return ", ".join(parts)


def oracle(levels: int = 6) -> str:
    """DuckDB SQL for :func:`verified_rows` of the documents, for up to 16 ** ``levels`` rows a source."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(value, FIELDS[:-1]), value(text)]) + ")"
    bits = ", ".join(["-1"] * 8)
    crc = f"""xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, {bits}])),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295)"""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH told AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN {lowered} ELSE text END AS claimed_text FROM documents),
      leaves AS (SELECT doc_id, source AS tree, {leaf("text")} AS leaf, {leaf("claimed_text")} AS claimed FROM told),
      placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
      {_sql_levels("low", "SELECT tree, idx, n, leaf AS digest FROM placed", levels)},
      ranked AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low_tops),
      {_sql_levels("high", "SELECT 0 AS tree, place AS idx, n, digest FROM ranked", levels)},
      doc_0 AS (SELECT p.*, r.place, r.digest AS subroot, claimed AS fold, '' AS proof FROM placed p JOIN ranked r ON r.tree IS NOT DISTINCT FROM p.tree),
      {_sql_folds("doc", "low", "idx", levels)},
      top_0 AS (SELECT * REPLACE (0 AS tree) FROM doc_{levels}),
      {_sql_folds("top", "high", "place", levels)}
      SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.digest AS verified
      FROM top_{levels}, high_tops AS root"""
