import random
import zlib

import numpy as np

from tidemark.llm.quality import keep_good, scores, train, words_of


def rows(n, seed=1):
    rnd = random.Random(seed)
    words = ["the", "and", "there", "ninth", "on", "was", "heed", "stone", "river", "of"]
    docs, labels = [], []
    for i in range(n):
        body = [rnd.choice(words) + rnd.choice(words) for _ in range(rnd.randrange(20, 90))]
        good = i % 3 != 0
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 2 else [w + "###" for w in body]
        docs.append((i, " ".join(body)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_texts_are_told_apart(spark):
    docs, labels = rows(600)
    docs += [(9_000, None), (9_001, ""), (9_002, " ... "), (9_003, "x " * 60_000), (5, docs[5][1]), (None, "the and there")]
    labels += [(None, 1), (10_000, 0), (9_001, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as score", "0 as label").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = train(df, lab)
    got = scores(df, model).collect()
    assert len(got) == len(docs)
    truth = {k: v for k, v in labels if v is not None}
    right = [int(r.predicted == truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 80 and np.mean(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_words_end_with_their_text():
    raw = "Ab ab!!".encode() + "!x 12".encode()
    row, shape, owner = words_of(np.frombuffer(raw, np.uint8), np.array([0, 7, 7, 12]))
    assert owner.tolist() == [0, 0, 0, 2, 2, 2]
    assert row[0] == row[1] and shape[0] != shape[1]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in scores(docs, train(docs, none)).collect()] == [0.5]
    assert scores(docs.filter("false"), train(docs.filter("false"), none)).count() == 0
