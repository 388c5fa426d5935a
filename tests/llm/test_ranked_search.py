import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ranked_search
from tidemark.llm.ranked_search import PATTERN, Block, bounds, impact, index, item_blocks, search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(PATTERN, lowered)


def plain_search(docs, items, k=10):
    counts = [(key, Counter(plain_terms(text))) for key, text in docs]
    counts = [(key, tf) for key, tf in counts if tf]
    documents, all_terms = len(counts), sum(tf.total() for _, tf in counts)
    df = Counter(t for _, tf in counts for t in tf)
    out = []
    for item, text in items:
        scored = []
        for key, tf in counts:
            m = 10 + (90 * tf.total() * documents) // all_terms
            w = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text)) if t in tf}
            score = sum(w[t] * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in w)
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, r, None if missing else key, -s) for r, (s, missing, key) in enumerate(sorted(scored)[:k], 1)]
    return out


def words(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) if rnd.random() < 0.5 else vocabulary[min(int(rnd.expovariate(0.2)), len(vocabulary) - 1)] for _ in range(n))


def order(rows):
    return sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("width, seed", [(8, 1), (64, 2), (16384, 3)])
def test_search_equals_plain_scores(spark, width, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["Ünï", "東京", "x1"]
    docs = [(i, words(rnd, rnd.choice([1, 3, 20, 200]), vocabulary)) for i in range(400)]
    items = [(i, words(rnd, rnd.choice([1, 5, 30]), vocabulary)) for i in range(25)]
    indexed = index(spark.createDataFrame(docs, DOCS).repartition(5), width=width)
    got = search(indexed, spark.createDataFrame(items, ITEMS), width=width).collect()
    assert order(got) == order(plain_search(docs, items))


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [(7, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (1, None), (2, ""), (4, "... ,"), (5, "gamma " * 300_000), (6, "ALPHA-alpha_Alpha")]
    items = [(1, "Alpha, beta!"), (1, "Alpha, beta!"), (None, "gamma"), (2, None), (3, ""), (4, "nowhere"), (5, "alpha alpha")]
    got = search(index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(items, ITEMS)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items), key=key)
    assert {r.doc_id for r in got if r.item_id is None} == {5}


def test_more_equal_scores_than_places(spark):
    docs = [(i, "same words here") for i in random.Random(4).sample(range(1000), 60)] + [(2000 + i, "other text") for i in range(60)]
    got = search(index(spark.createDataFrame(docs, DOCS).repartition(7)), spark.createDataFrame([(1, "words")], ITEMS)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == sorted(i for i, t in docs if "words" in t)[:10]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, "four")], DOCS)
    items = spark.createDataFrame([(9, "two")], ITEMS)
    none = search(index(docs.limit(0)), items)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
    assert search(index(docs), items.limit(0)).count() == 0
    clash = docs
    for name in ("key", "n", "places", "most", "terms", "counts", "item", "rank", "score", "term"):
        clash = clash.withColumn(name, F.lit("two two two"))
    again = items.withColumn("key", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("doc_id", F.lit(5))
    assert order(search(index(clash), again).collect()) == order(search(index(docs), items).collect())


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    docs = [(i, words(rnd, 12, vocabulary)) for i in range(80)]
    items = [(i, words(rnd, 6, vocabulary)) for i in range(9)]
    df = spark.createDataFrame(items, ITEMS)
    indexed = index(spark.createDataFrame(docs, DOCS))
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 4)
    assert len(list(item_blocks(df, "text", "item_id"))) == 3
    assert order(search(indexed, df).collect()) == order(plain_search(docs, items))


def test_bounds_are_never_below_scores():
    rnd = random.Random(6)
    vocabulary = [f"t{i}".encode() for i in range(60)]
    weight = {t: rnd.randint(0, 9000) for t in vocabulary}
    items = [[(t, weight[t]) for t in rnd.sample(vocabulary, 8)] for _ in range(10)]
    block, place = Block(list(range(10)), items, 100, 5000, 16, 10), ranked_search.Coordinates(16)
    docs = [Counter({t: rnd.choice([1, 2, 40, 254, 255, 4000]) for t in rnd.sample(vocabulary, 20)}) for _ in range(40)]
    sketches, m = np.zeros((40, 16), np.uint8), np.array([rnd.randint(10, 900) for _ in docs])
    for i, tf in enumerate(docs):
        for t, c in tf.items():
            sketches[i, place[t]] = max(sketches[i, place[t]], min(c, 255))
    rows, places = np.nonzero(sketches)
    most = bounds(places, sketches[rows, places], np.searchsorted(rows, np.arange(41)), m, block.weights())
    for i, tf in enumerate(docs):
        for j, terms in enumerate(items):
            assert most[i, j] >= sum(w * impact(tf[t], int(m[i])) for t, w in terms if t in tf)
