import hashlib
from collections import defaultdict

from tidemark.llm.exact_dedup import drop_exact_copies, exact_groups


def expected(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[t or ""].append(k)
    out = []
    for k, t in rows:
        g = groups[t or ""]
        known = [x for x in g if x is not None]
        out.append((k, max(known) if known else None, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 150}") for i in range(400)]
    rows += [(5000, None), (5001, ""), (5002, "x" * 300_000), (5003, "x" * 300_000), (None, "t1"), (None, "alone"), (7, "twin"), (7, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as kept", "1 as group_size").repartition(5)
    got = exact_groups(df, support=0.05).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_filter_keeps_one_row_of_each_text(spark):
    rows = [(i, "hot") for i in range(50)] + [(60, None), (61, ""), (7, "twin"), (7, "twin"), (None, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as row")
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(7, "twin"), (49, "hot"), (61, "")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).count() == 0
