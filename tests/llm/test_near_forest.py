import random

from tidemark.llm import near_copies


def test_the_forest_ties_near_texts_before_shingles_are_joined(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(6):
        text = rnd.choices(words, k=400)
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join([*text, "x"])), (10 * k + 2, " ".join(text).upper())]
    df = spark.createDataFrame(rows, "node long, text string")
    got = {(r.a, r.b) for r in near_copies.forest_pairs(df, 5).collect()}
    tied = lambda k, a, b: (10 * k + a, 10 * k + b) in got
    assert all(tied(k, 0, 2) for k in range(6))
    assert all(a // 10 == b // 10 for a, b in got)
    assert sum(tied(k, 0, 1) or tied(k, 1, 2) for k in range(6)) >= 4
