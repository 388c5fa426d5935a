import random

import numpy as np

from tidemark.llm.decontaminate import Index, Limits, characters, drop_leaks, leaks

LETTERS = "abcdefgh ijé "


def text(rnd, n):
    return "".join(rnd.choice(LETTERS) for _ in range(n))


def edited(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        k = rnd.randrange(len(s))
        what = rnd.randrange(3)
        if what == 0:
            s[k] = "z"
        elif what == 1:
            s.insert(k, "y")
        elif len(s) > 1:
            del s[k]
    return "".join(s)


def distance(pattern, codes):
    """Fewest edits between the pattern and any stretch of the text."""
    row = np.zeros(len(codes) + 1, np.int64)
    slide = np.arange(len(codes) + 1)
    for c in pattern:
        put = row + 1
        put[1:] = np.minimum(put[1:], row[:-1] + (codes != c))
        row = np.minimum.accumulate(put - slide) + slide
    return int(row.min())


def expected(docs, items, limits):
    index = Index(tuple(items), limits)
    out = set()
    for key, t in docs:
        codes = characters((t or "").encode())
        for w, pattern in enumerate(index.codes):
            if len(codes) and distance(pattern, codes) <= index.budget[w]:
                out.add((key, index.ids[index.item[w]]))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(11)
    items = [(i, text(rnd, rnd.choice([41, 60, 119, 120, 121, 200, 333]))) for i in range(12)]
    items += [(50, items[4][1]), (51, "too short to tell"), (52, " " * 60 + "é" * 45)]
    docs = []
    for k in range(120):
        body = text(rnd, rnd.randrange(0, 400))
        if k % 2:
            item = rnd.choice(items)[1]
            part = item if k % 4 == 1 else item[: rnd.randrange(30, 1 + max(31, len(item)))]
            body += edited(rnd, part.upper() if k % 6 == 1 else part.replace(" ", "\n"), rnd.randrange(0, 14)) + text(rnd, rnd.randrange(0, 200))
        docs.append((k, body))
    docs += [(900, None), (901, ""), (902, text(rnd, 60_000) + items[3][1] + text(rnd, 60_000)), (7, docs[7][1]), (None, items[5][1])]
    limits = Limits()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as key").repartition(3)
    bm = spark.createDataFrame([*items, (77, None), (None, "no key " * 20)], "item_id long, text string").selectExpr("*", "3 as doc_id")
    want = expected(docs, items, limits)
    assert want and len(want) < len(docs)
    for part_chars in (2_000_000, 700):
        got = leaks(df, bm, part_chars=part_chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    kept = drop_leaks(df, bm)
    assert kept.columns == df.columns
    gone = {k for k, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in docs if k not in gone)


def test_short_items_and_items_without_ids(spark):
    quote = "the quick brown fox jumps over the lazy dog while seven wizards watch " * 2
    items = [(1, "Forty-two is the answer"), (2, "ab"), (3, "?"), (None, quote), (None, "never said anywhere at all by anyone"), (4, "\n "), (5, "forty-two  is")]
    docs = [
        (1, "They say FORTY-TWO is\tthe answer, no less"), (2, "forty-two is the answers"), (3, "cab abc"), (4, "an ab."), (5, "ab"),
        (6, "why?"), (7, "x " + quote.upper() + " y"), (8, None), (9, ""), (10, "Forty-two  is odd"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bm = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (4, 2), (5, 2), (6, 3), (7, None), (10, 5)}
    for part_chars in (2_000_000, 60):
        assert {(r.doc_id, r.item_id) for r in leaks(df, bm, part_chars=part_chars).collect()} == want
    assert {r.doc_id for r in drop_leaks(df, bm).collect()} == {2, 3, 8, 9}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    bm = spark.createDataFrame([(1, "some item " * 9)], "item_id long, text string")
    assert leaks(docs.filter("false"), bm).count() == 0
    assert leaks(docs, bm.filter("false")).count() == 0
    assert drop_leaks(docs, bm.filter("false")).count() == 1
