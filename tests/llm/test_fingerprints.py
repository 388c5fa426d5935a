import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.fingerprints import BITS, Hashes, blocks_kept, document_fingerprints, fingerprints, near_counts, tables

SCHEMA = "doc_id long, text string"
ALL = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    one = [xxhash.xxh64_intdigest(w, 1) for w in words]
    votes = [0] * BITS
    for unit, terms in ((16, [plain_mix(h) for h in one]), (32, [plain_mix((3 * a + 7 * b + 5) & ALL) for a, b in zip(one, one[1:])])):
        for term, count in Counter(terms).items():
            weight = round(unit * (1 + math.log(count)))
            for lane in range(BITS // 64):
                h = plain_mix((term + 0x9E3779B97F4A7C15 * (lane + 1)) & ALL)
                for b in range(64):
                    votes[64 * lane + b] += weight if h >> 63 - b & 1 else -weight
    return sum(1 << BITS - 1 - k for k, v in enumerate(votes) if v > 0)


def apart(a, b):
    return (a ^ b).bit_count()


def plain_likeness(a, b):
    return max(0.0, math.cos(math.pi * apart(a, b) / BITS))


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = [plain_fingerprint(t) for _, t in order]
    out = []
    for k, (key, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        new = plain_fingerprint(changed)
        near = sum(apart(prints[k], p) <= 4 for p in prints) - 1
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{prints[k]:032x}", f"{new:032x}", plain_likeness(prints[k], new), plain_likeness(prints[k], prints[(k + 1) % len(order)]), near))
    return out


def found(docs, **how):
    return [tuple(r) for r in document_fingerprints(docs, **how).collect()]


def order(rows):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def drawn(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "東京\U0001f600", "CAPS", "x\ny"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 9, 60, 300]))) for _ in range(n)]
    for _ in range(n // 3):  # copies, and copies with a word changed
        a, b = rnd.randrange(n), rnd.randrange(n)
        parts = texts[a].split(" ")
        if rnd.random() < 0.6:
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        texts[b] = " ".join(parts)
    return list(zip(rnd.sample(range(-n, 5 * n), n), texts))


@pytest.mark.parametrize("n, parts", [(300, 7), (40, 1), (1, 1), (2, 2)])
def test_rows_equal_plain_fingerprints(spark, n, parts):
    rows = drawn(n, n)
    assert order(found(spark.createDataFrame(rows, SCHEMA).repartition(parts))) == order(plain(rows))


def test_nulls_empty_long_and_repeated_texts(spark):
    rows = [(5, None), (4, ""), (3, "one"), (2, "ab cd " * 200_000), (1, "a b c d"), (None, "last in order"), (6, "a b c d")]
    assert order(found(spark.createDataFrame(rows, SCHEMA))) == order(plain(rows))
    same = [(7, "same words here")] * 20
    assert order(found(spark.createDataFrame(same, SCHEMA).repartition(4))) == order(plain(same))


def test_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = drawn(30, 9)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "tie", "row", "part", "end", "fp", "n", "fingerprint", "near", "table", "front"):
        docs = docs.withColumn(name, F.lit("other"))
    assert order(found(docs)) == order(plain(rows))


def cluster(n, seed):
    """Fingerprints in dense groups and at random."""
    rnd, out = random.Random(seed), set()
    centres = [rnd.getrandbits(BITS) for _ in range(4)]
    while len(out) < n:
        x = rnd.choice(centres) if rnd.random() < 0.8 else rnd.getrandbits(BITS)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(BITS)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("keep, part, radius", [(1, 40, 4), (1, 10_000, 4), (2, 30, 4), (3, 25, 4), (1, 50, 4), (1, 50, 2)])
def test_tables_find_all_within_the_radius(spark, keep, part, radius):
    prints = cluster(700, keep + radius)
    rows = [(bytearray(p.to_bytes(16)), 1 + p % 3) for p in prints]
    df = spark.createDataFrame(rows, "fp binary, n long").repartition(3)
    got = {int.from_bytes(r.fp): r.near for r in near_counts(df, radius, keep=keep, part=part).collect()}
    want = {p: sum(1 + q % 3 for q in prints if q != p and apart(p, q) <= radius) for p in prints}
    assert got == {p: n for p, n in want.items() if n}


def test_blocks_kept_follow_the_number_of_fingerprints():
    assert [blocks_kept(n) for n in (0, 10**6, 10**9, 10**11)] == [1, 1, 1, 2]
    assert len(tables(4, 2)) == 15


def test_edits_are_told_from_other_texts():
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 300))) for _ in range(200)]
    changed = [t[: len(t) - len(t) // 2] + texts[k - 1][: len(t) // 2] for k, t in enumerate(texts)]
    hashes = Hashes()
    own, new = (fingerprints([t.encode() for t in some], hashes) for some in (texts, changed))
    differ = lambda a, b: np.bitwise_count(a ^ b).sum(axis=1)
    assert (differ(own, new) < differ(own, np.roll(own, 1, axis=0))).mean() > 0.97
