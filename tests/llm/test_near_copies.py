import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_copies
from tidemark.llm.near_copies import drop_similar


def plain_set(text, words=5):
    tokens = (text or "").encode().lower().split()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return {min((k for k in g if k is not None), default=None) for g in groups.values()}


def edited(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def documents():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rnd.choices(words, k=60))
    base = [" ".join(rnd.choices(words, k=rnd.choice([6, 12, 30, 120, 300]))) for _ in range(40)]
    base += [passage + " " + " ".join(rnd.choices(words, k=rnd.choice([3, 10, 20]))) for _ in range(40)]
    texts = list(base)
    for t in base:
        n = len(t.split())
        texts += [edited(rnd, t, e) for e in {1, n // 60, n // 45, n // 30}]
    chain = " ".join(rnd.choices(words, k=200))
    for _ in range(30):  # each close to the one before, the ends far apart
        chain = edited(rnd, chain, 2)
        texts.append(chain)
    rnd.shuffle(texts)
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    return rows + [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "TWO  words"), (6, "x " * 20_000), (7, "twin text"), (7, "twin text"), (None, base[0] + " more")]


def test_kept_equal_brute_force(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as key", "3 as token").repartition(3)
    want = plain_kept(rows)
    for sample, few in ((2_000, 200_000), (20, 3)):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        monkeypatch.setattr(near_copies, "FEW_LINKS", few)
        kept = drop_similar(df)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == want


def test_pipeline_stage_goes_by_similarity(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(20):
        text = " ".join(rnd.choices(words, k=150))
        rows += [(i, text), (100 + i, edited(rnd, text, 3)), (200 + i, edited(rnd, text, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == plain_kept(rows) == {k for k, _ in rows if not 100 <= k < 200}


def test_texts_that_share_a_hash_stay_apart(spark, monkeypatch):
    """Every text has the same first hash, half of them the same second one."""
    plain = near_copies._hash
    same = {0: F.lit(7).cast("long"), 1: F.pmod(plain(1), F.lit(40))}
    monkeypatch.setattr(near_copies, "_hash", lambda turn: same.get(turn, plain(turn)))
    rows = documents()[::3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_copies._nodes(df.select(F.coalesce("text", F.lit("")).alias("text"))).distinct().collect()
    assert len({r.node for r in nodes}) == len(nodes) == len({t or "" for _, t in rows})
    assert {r.doc_id for r in drop_similar(df).collect()} == plain_kept(rows)


def test_empty_table(spark):
    assert drop_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
