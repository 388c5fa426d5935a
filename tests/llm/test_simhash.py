import random

import numpy as np
import xxhash

from tidemark.llm.graph import components
from tidemark.llm.simhash import close_links, drop_near_copies, near_groups, visits


def plain_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def clustered(n, seed):
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(n // 3)}
    while len(out) < n:
        x = rnd.choice(list(out)) if len(out) < 50 else next(iter(out))
        for _ in range(rnd.randint(1, 6)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return list(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_tie_what_brute_force_ties(spark):
    prints = clustered(1500, 1)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    for how in ({"shard": 32}, {"shard": 64, "block": 20}, {"shard": 5000}):
        roots = {r.node: r.root for r in components(close_links(df, **how)).collect()}
        want = plain_components(prints, 4)
        got = [roots.get(signed(p), signed(p)) for p in prints]
        groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
        assert groups(got) == groups(want)


def test_visits_meet_every_near_pair():
    rnd = random.Random(5)
    a = np.array([rnd.getrandbits(64) for _ in range(300)], np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in rnd.sample(range(64), 4):
            b[k] ^= np.uint64(1 << bit)
    both = np.concatenate([a, b])
    met = set()
    for s in range(3):
        index, node, home = visits(both, s, 3, 7, 4)
        own = {i: n for i, n, h in zip(index, node, home) if h}
        seen = {(i, n) for i, n in zip(index, node)}
        met |= {k for k in range(300) if (k, own[k + 300]) in seen or (k + 300, own[k]) in seen}
    assert met == set(range(300))


def test_documents(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choices(words, k=300)) for _ in range(30)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, t.replace(" w7 ", " W7\t") + " end") for i, t in enumerate(base)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "two words"), (5, "TWO  words"), (6, "x " * 50_000), (7, "twin text"), (7, "twin text"), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key", "3 as component_id").repartition(3)
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints, 4)
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((str(k), f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, root)), key=str)
    got = near_groups(df, shard=8).collect()
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(empty).count() == 0
    assert drop_near_copies(empty).count() == 0
