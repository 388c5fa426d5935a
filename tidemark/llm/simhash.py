"""SimHash near-duplicates: fingerprints, a forest of vantage-point trees, components.

Fingerprints within ``radius`` bits agree up to ``radius // slices`` bits in at least one of
``slices`` slices of their bits. For each slice a vantage-point tree parts the fingerprints by their
Hamming distance, inside the slice, to the vantage point of each node. A fingerprint's own branch
at every node leads to its home shard; by the triangle inequality it also has to be looked for in the
branches whose boundary is within the slice's radius, and in no others. Shards are searched
independently: deeper in the tree by the same pruning, then by exact distances of all 64 bits.

Vantage points are pseudo-random functions of the node, so no tree is stored or sent. The depth
follows the number of distinct fingerprints, so shards keep their size as the input grows; a shard
that is large all the same is split into cells of two blocks. A shard reports a spanning forest of its
links, never all pairs of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, input_tasks, single, text_of, utf8_buffers
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

SHINGLE_WORDS, RADIUS, SLICES = 4, 4, 3
#: Fingerprints whose home a shard is, on average, and those of a block of a shard that is split.
SHARD, BLOCK = 4_096, 32_768
#: Comparisons of one numpy step.
STEP = 1 << 18


def fingerprint_block(texts: list[bytes], words: int) -> np.ndarray:
    """SimHash of each text: majority bits of the XXH64 of its shingles, ties and no shingles 0."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        tokens = text.lower().split()
        if not tokens:
            continue
        joined = b" ".join(tokens)
        if len(tokens) <= words:
            hashes.append(digest(joined, 42))
            counts[k] = 1
            continue
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        end = np.cumsum(size + 1) - 1
        begin = end - size
        first, last = begin[: len(tokens) - words + 1].tolist(), end[words - 1 :].tolist()
        hashes += [digest(joined[a:b], 42) for a, b in zip(first, last)]
        counts[k] = len(first)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_buffers(single(batch, "text"))
        found = [
            fingerprint_block([raw[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)], words)
            for a, b in blocks(offsets)
        ]
        value = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.record_batch([single(batch, "key"), pa.array(value)], names=["key", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the 64 fingerprint bits of each whole text as a signed long.

    A-Z count as a-z; words are what ASCII white space parts; a shorter text is one shingle; a
    text without words, null or empty, has fingerprint zero.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        rows = rows.repartition(input_tasks(rows))
    return rows.mapInArrow(lambda it: _fingerprints(it, words), "key long, fp long")


# --- the forest --------------------------------------------------------------------------------
def slice_bits(slices: int) -> list[tuple[int, int]]:
    """(shift, width) of each slice; together all 64 bits."""
    edges = [64 * k // slices for k in range(slices + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def vantage(node: np.ndarray, slice_no: int) -> np.ndarray:
    """The vantage points of nodes: a mixing function of the node's number and the slice."""
    x = (node.astype(np.uint64) + np.uint64(slice_no * 0x632BE59BD9B4E019 & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def visits(fp: np.ndarray, slice_no: int, slices: int, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``fp``, shard, is home): every home, and the higher shards that may hold a
    fingerprint within the radius. Of two shards that two fingerprints live in, the higher is
    visited by the other's fingerprint, so each pair meets once."""
    shift, width = slice_bits(slices)[slice_no]
    part = (fp >> np.uint64(shift)) & _mask(width)
    bound, slack = (width - 1) // 2, radius // slices
    index, node, home = np.arange(len(fp)), np.ones(len(fp), np.int64), np.ones(len(fp), bool)
    for _ in range(depth):
        distance = np.bitwise_count(part[index] ^ (vantage(node, slice_no) & _mask(width))).astype(np.int64)
        inside = distance <= bound
        go_in, go_out = distance - slack <= bound, distance + slack > bound
        index = np.concatenate([index[go_in], index[go_out]])
        home = np.concatenate([home[go_in] & inside[go_in], home[go_out] & ~inside[go_out]])
        node = np.concatenate([2 * node[go_in], 2 * node[go_out] + 1])
    own = np.zeros(len(fp), np.int64)
    own[index[home]] = node[home]
    keep = home | (node > own[index])
    return index[keep], node[keep], home[keep]


def _routed(batches: Iterator[pa.RecordBatch], slices: int, depth: int, radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = single(batch, "fp").to_numpy(zero_copy_only=False)
        for start in range(0, len(fp), 4_096):
            chunk = fp[start : start + 4_096]
            for s in range(slices):
                index, node, home = visits(chunk.view(np.uint64), s, slices, depth, radius)
                columns = [pa.array(np.full(len(index), s, np.int32)), pa.array(node), pa.array(chunk[index]), pa.array(home)]
                yield pa.record_batch(columns, names=["slice", "node", "fp", "home"])


class Links:
    """Labels under links that come in pieces; keeps a label per fingerprint and no pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:  # every label to its root
                shorter = self.label[self.label]
                if (shorter == self.label).all():
                    break
                self.label = shorter


def near(fp: np.ndarray, members: np.ndarray, queries: np.ndarray, shift: int, width: int, slack: int, radius: int, links: Links) -> None:
    """Links queries to members within the radius (both are indexes into ``fp``); the part of the
    tree below a shard: vantage points are members, the boundary is their median distance."""
    todo = [(members, queries, True)]
    while todo:
        m, q, by_slice = todo.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) > STEP and len(m) > 64:
            point = fp[m[len(m) // 2]]
            if by_slice:
                to_m = np.bitwise_count(((fp[m] ^ point) >> np.uint64(shift)) & _mask(width)).astype(np.int64)
                to_q = np.bitwise_count(((fp[q] ^ point) >> np.uint64(shift)) & _mask(width)).astype(np.int64)
            else:
                to_m, to_q = np.bitwise_count(fp[m] ^ point).astype(np.int64), np.bitwise_count(fp[q] ^ point).astype(np.int64)
            bound, give = int(np.median(to_m)), slack if by_slice else radius
            if (to_m <= bound).all():
                bound -= 1
            inside = to_m <= bound
            if inside.any():
                todo.append((m[inside], q[to_q - give <= bound], by_slice))
                todo.append((m[~inside], q[to_q + give > bound], by_slice))
                continue
            if by_slice:  # one value in this slice: go on with all bits
                todo.append((m, q, False))
                continue
        rows = max(1, STEP // len(m))
        for at in range(0, len(q), rows):
            some = q[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[m][None, :]) <= radius)
            links.add(some[i], m[j])


def _cell_links(group: pd.DataFrame, slices: int, radius: int) -> pd.DataFrame:
    fp = group["fp"].to_numpy(np.int64).view(np.uint64)
    home, block = group["home"].to_numpy(bool), group["block"].to_numpy()
    low, high, slice_no = int(group["low"].iloc[0]), int(group["high"].iloc[0]), int(group["slice"].iloc[0])
    shift, width = slice_bits(slices)[slice_no]
    links = Links(len(fp))
    mine = np.flatnonzero(home & (block == low))
    others = np.flatnonzero(home & (block == high) if low < high else np.ones(len(fp), bool))
    near(fp, mine, others, shift, width, radius // slices, radius, links)
    tied = np.flatnonzero(links.label != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[tied].view(np.int64), "b": fp[links.label[tied]].view(np.int64)})


def close_links(distinct: DataFrame, radius: int = RADIUS, slices: int = SLICES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that tie together all distinct fingerprints (column fp) within ``radius`` bits.

    Not all pairs: a spanning forest for each shard, whose union has the same components.
    """
    rows = distinct.count()
    depth = max(0, math.ceil(math.log2(max(rows, 1) / shard)))
    routed = distinct.select("fp").mapInArrow(lambda it: _routed(it, slices, depth, radius), "slice int, node long, fp long, home boolean")
    homes = distinct.select("fp").mapInArrow(lambda it: _routed(it, slices, depth, 0), "slice int, node long, fp long, home boolean")
    large = homes.groupBy("slice", "node").count().filter(F.col("count") > block)
    large = large.select("slice", "node", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    cells = routed.join(large, ["slice", "node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.transform(every, lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    guest = F.transform(every, lambda k: F.struct(k.alias("low"), k.alias("high")))
    cells = cells.select("slice", "node", "fp", "home", "block", F.explode(F.when(F.col("home"), own).otherwise(guest)).alias("cell"))
    cells = cells.select("slice", "node", "cell.low", "cell.high", "fp", "home", "block")
    return cells.groupBy("slice", "node", "low", "high").applyInPandas(lambda g: _cell_links(g, slices, radius), "a long, b long")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS, radius: int = RADIUS, **how) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key that links of ``radius`` bits reach; equal fingerprints are linked
    at distance 0. Null keys are no component_id unless their whole component has none. Repeated rows
    come back as often as they came. An empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs, text, key, words))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(close_links(distinct, radius, **how))
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    class_id = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of_tied = tied.join(class_id, "root").select("fp", "component_id")
    label = distinct.join(of_tied.withColumnRenamed("component_id", "joint"), "fp", "left")
    label = label.select("fp", F.coalesce("joint", "least").alias("component_id"))
    return marked.join(label, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each component: that whose key is the component's id.

    Rows that share a key are one document: they stay or go together, and stay if one of them is
    kept. Components without any key stay whole.
    """
    kept = near_groups(docs, text, key, **how).filter(F.col(key).eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col(key).alias("__kept")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("__kept")), "left_semi")
