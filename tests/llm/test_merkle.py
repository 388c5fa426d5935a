import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import FIELDS, lower_cased_fifth, proofs, verified_rows

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_paths(digests, fanout):
    """The siblings (left, right) of each node up to the top, and the top."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for leaf, i in enumerate(at):
            run, slot = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at, digests = [i // fanout for i in at], [sha("".join(run)) for run in runs]
    return paths, digests[0]


def plain(rows, fanout=16):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: [r for r in order if r[1] == s] for s in sources}
    lower = {s: plain_paths([plain_leaf(r) for r in trees[s]], fanout) for s in sources}
    upper, root = plain_paths([lower[s][1] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        for r, path in zip(trees[s], lower[s][0]):
            path = path + upper[k]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            h = plain_leaf((*r[:4], text))
            for left, right in path:
                h = sha(left + h + right)
            out.append((r[0], plain_leaf(r), lower[s][1], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def found(docs, **how):
    return [tuple(r) for r in verified_rows(proofs(docs, claimed=lower_cased_fifth, **how)).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def drawn(n, sources, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-50, 10 * n), n)
    words = ["", "a", "AbC", "Ünï Ö", "x\ny", "Z" * 300, "\U0001f600 Q"]
    pick = lambda options: rnd.choice(options)
    return [(ids[i], pick(sources), pick(["en", None, ""]), pick([None, 0, 5, 123456]), pick([None, *words])) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(700, ["hot"] * 12 + ["b", "a", None, "", "ü"]), (257, ["only"]), (16, ["x"]), (17, ["x"]), (1, ["x"]), (2, ["x", "y"])])
def test_proofs_equal_plain_trees(spark, n, sources):
    rows = drawn(n, sources, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(found(docs), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("fanout", [2, 3])
def test_other_fanouts(spark, fanout):
    rows = drawn(90, ["a", "a", "a", "b", None], 7)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(found(docs, fanout=fanout), key=key) == sorted(plain(rows, fanout), key=key)


def test_more_sources_than_a_run(spark):
    rows = drawn(120, [f"s{i}" for i in range(40)] + ["é", "z", None], 3)
    assert sorted(found(spark.createDataFrame(rows, SCHEMA)), key=key) == sorted(plain(rows), key=key)


def test_null_keys_repeated_rows_and_long_texts(spark):
    rows = [(None, "a", "en", 1, "T"), (None, "a", "en", 1, "T"), (None, None, None, None, None), (5, "a", "en", 1, "same"), (5, "a", "en", 1, "same"), (5, "a", "en", 2, "same"), (6, "b", "en", 9, "Q" * 2_000_000)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA)), key=key) == sorted(plain(rows), key=key)


def test_layout_empty_table_and_clashing_columns(spark):
    rows = drawn(200, ["a", "a", "b"], 11)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "idx", "digest", "n", "run", "path", "key", "claimed", "all", "place"):
        docs = docs.withColumn(name, F.lit("other"))
    once = sorted(found(docs.coalesce(1)), key=key)
    assert once == sorted(found(docs.repartition(9)), key=key) == sorted(plain(rows), key=key)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert FIELDS == ("doc_id", "source", "lang", "n_chars", "text")
