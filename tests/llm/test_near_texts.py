"""Texts that a round asks for are found where they lie."""

from pyspark.sql import functions as F

from tidemark.llm import near_copies


def test_few_other_texts_come_with_those_asked_for(spark):
    texts = spark.range(20_000).select(F.xxhash64("id").alias("node"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    asked = texts.filter("node % 400 = 7 or node % 400 = -7").select("node")
    wanted = {r.node for r in asked.collect()}
    got = near_copies.texts_among(texts, asked)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.node: r.text for r in got.collect()}
    assert wanted <= set(found) and min(wanted) < 0 < max(wanted)
    assert len(found) < len(wanted) + 4_000
    assert found.items() <= {(r.node, r.text) for r in texts.collect()}
    assert near_copies.texts_among(texts, asked.filter("false")).count() == 0


def test_texts_of_few_files_are_dealt_out_once(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[:40] + [f"x{k % 5}"])) for k in range(5)] + [(10 + k, " ".join(f"y{k}{w}" for w in words)) for k in range(0, 30, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    asked = []
    monkeypatch.setattr(near_copies, "shared_folder", lambda s, name, f=near_copies.shared_folder: asked.append(name) or f(s, name))
    kept = sorted(r.doc_id for r in near_copies.drop_similar(docs).collect())
    assert kept == [0, 10, 20, 30] and asked.count("near-copies-texts") == 1


def test_intermediates_have_no_more_parts_than_the_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40)) + f" x{k}") for k in range(12)], "node long, text string").coalesce(2)
    tasks, parts = near_copies.input_tasks(texts), []
    cut = lambda df, f=near_copies.cut_lineage: parts.append((out := f(df)).rdd.getNumPartitions()) or out
    monkeypatch.setattr(near_copies, "cut_lineage", cut)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(tasks + 9)}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        roots = near_copies.similar_groups(texts).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node for r in roots} == set(range(12)) and len({r.root for r in roots}) == 1
    assert parts and max(parts) <= tasks
