import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import pack_documents, plan_packing


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 16), max_size=60))
def test_plan_places_every_piece(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=17)
    plan = plan_packing(counts, 16)
    used = np.zeros(17, np.int64)
    for pattern, times in zip(plan.patterns, plan.times):
        assert sum(pattern) <= 16 and times > 0
        for n in pattern:
            used[n] += times
    assert used.tolist() == counts.tolist()
    assert plan.sequences >= -(-sum(lengths) // 16)


def test_two_for_one_closes_a_gap():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = [1, 1, 1]  # greedy is full at once: 7 + 2 + 1
    assert plan_packing(counts, 10).sequences == 1
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy 6 + 3 leaves 1; 6 + 2 + 2 leaves none
    assert plan_packing(counts, 10).patterns[0] == (6, 2, 2)


def test_packed_documents(spark):
    rows = [(i, f"word{i % 7} " * (i % 90)) for i in range(300)] + [(900, None), (901, ""), (902, "long text " * 700), (7, "twin"), (7, "twin"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as task", "'x' as `key`").repartition(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = pack_documents(df, path, capacity=64, keep_ids=True).collect()
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(k), p, a, ids[a : a + 64]) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, list(r.ids)) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= total / 64 * 1.05 + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
