"""Near copies by similarity: texts whose sets of word shingles have a Jaccard of 0.8 or more.

Exact, by prefixes: under any one order of all shingles, two sets that similar share a shingle among
the first fifth (and one more) of each. Shingles common in a sample of texts come last in the order,
then it is that of their hashes, so few unlike texts meet. The sample moves the cost, never the result.

A group of copies is not compared pair by pair. Texts whose fingerprints of the same shingles a forest of
vantage-point trees ties (``simhash``) are held against each other first. Then, in a few rounds, each text is held
against a few texts, drawn anew each round, of each shingle it meets. The links found are contracted into the roots
known so far, and only texts that this leaves under different roots are paired afterwards. Pairs meet by shingle and band of sizes
and have to share enough by their places in the prefixes. Small bitmaps of the sets rule most of the others out
inside that join, without error; the rest is decided by the whole sets of both texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import input_tasks, shared_folder, single, text_of, utf8_buffers
from tidemark.llm import simhash
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

SHINGLE_WORDS = 5
#: Texts of the sample, in how many of them a shingle is common, and how many common ones are told apart.
SAMPLE, COMMON, MOST_COMMON = 2_000, 3, 100_000

#: Rounds of stars before what is left is paired, texts of a shingle that are centres in a round, and bits of
#: a set's bitmap.
STARS, CENTRES, BITMAP = 3, 4, 512
#: Links that one task unites at most.
FEW_LINKS = 200_000

#: Bits told for each node that is looked for, and the binary logarithm of the most in all (8 MB).
NODE_BITS, MOST_BITS = 8, 26

#: Hashes that different texts meet in, told apart in one turn; at 10^10 texts there are about three.
MOST_MET = 1_000

SETS, MAPS = "node long, size int, tokens array<long>", "node long, size int, bits array<long>"


def shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct XXH64 of the shingles, ascending; a shorter text is one shingle, and so is one without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(tokens) - words + 1].tolist(), end[words - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(first, last)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard of 0.8 or more of two ascending sets, in whole numbers."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    raw, offsets = utf8_buffers(single(batch, name))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[a:b].tobytes()


def _sets(batches: Iterator[pa.RecordBatch], words: int, common: np.ndarray | None, weight: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Prefixes of the sets in the order of all shingles; whole sets if nothing is said of the order."""
    for batch in batches:
        sizes, found = [], []
        for text in _texts(batch, "text"):
            h = shingles(text, words)
            sizes.append(len(h))
            if common is not None:
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, weight[at], 0)))]
                h = h[: len(h) // 5 + 1]
            found.append(h.view(np.int64))
        lengths = np.cumsum([0] + [len(h) for h in found])
        tokens = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        yield pa.record_batch([single(batch, "node"), pa.array(sizes, pa.int32()), tokens], names=["node", "size", "tokens"])


def _tested(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, held = [], None, None
        for one, other in zip(_texts(batch, "one"), _texts(batch, "other")):
            if one != last:
                last, held = one, shingles(one, words)
            keep.append(similar(held, shingles(other, words)))
        yield pa.record_batch([single(batch, n) for n in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bitmaps(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Each set's size and the bits that its shingles fall on, in whole numbers of 64 bits."""
    for batch in batches:
        sizes, bits = [], np.zeros((len(batch), BITMAP), bool)
        for i, text in enumerate(_texts(batch, "text")):
            h = shingles(text, words)
            sizes.append(len(h))
            bits[i, h % np.uint64(BITMAP)] = True
        numbers = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
        maps = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * (BITMAP // 64), pa.int32()), pa.array(numbers))
        yield pa.record_batch([single(batch, "node"), pa.array(sizes, pa.int32()), maps], names=["node", "size", "bits"])


def _told(nodes: DataFrame) -> np.ndarray:
    """Bits, in whole numbers of 64, of which the one that a node's last digits number is set for all of ``nodes``
    (node, distinct) and for few others. Bounded, whatever is looked for."""
    bits = 1 << min(MOST_BITS, max(6, (NODE_BITS * nodes.count()).bit_length()))
    at = F.pmod("node", F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) % 64 as int))")
    found = nodes.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _among(batches: Iterator[pa.RecordBatch], told: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = single(batch, "node").to_numpy() & (64 * len(told) - 1)
        yield batch.filter(pa.array((told[at >> 6] >> (at & 63) & 1).astype(bool)))


def texts_among(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``texts`` (node, text) of ``nodes`` (node, distinct) and few others, found where they lie: what is
    joined afterwards moves these texts, not all."""
    told = texts.sparkSession.sparkContext.broadcast(_told(nodes))
    return texts.select("node", "text").mapInArrow(lambda it: _among(it, told.value), "node long, text string")


def _possible() -> Column:
    """Whether the bitmaps of a pair leave a Jaccard of 0.8 possible: a bit of one alone is a shingle of one alone,
    and there are (a + b) / 9 of those at most."""
    apart = [F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(BITMAP // 64)]
    return sum(apart[1:], apart[0]) * 9 <= F.col("size_a") + F.col("size_b")


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, in how many sampled texts they are), ascending by shingle; bounded."""
    step = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod("node", F.lit(step)) == 0).repartition(input_tasks(texts))
    counted = sample.mapInArrow(lambda it: _sets(it, words, None, None), SETS).select(F.explode("tokens").alias("token")).groupBy("token").count()
    rows = counted.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    token, count = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(token)
    return token[order], count[order]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links of a task; the root is the smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(single(batch, "a").to_pylist(), single(batch, "b").to_pylist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def _cut(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` with its lineage cut, in ``tasks`` parts at most: what shuffles deal to more is small here, and each
    part costs files of its own in every later shuffle."""
    return cut_lineage(df.coalesce(tasks))


def _roots(links: DataFrame, tasks: int) -> DataFrame:
    """(node, root): by one task where the links are counted and few, in rounds of joins beyond."""
    links = _cut(links, tasks)
    if links.limit(FEW_LINKS + 1).count() > FEW_LINKS:
        return components(links)
    return links.repartition(1).mapInArrow(_united, "node long, root long")


def _tied(labels: DataFrame | None, links: DataFrame, tasks: int) -> DataFrame:
    """(node, root) of all nodes under links, where ``labels`` already says it of earlier ones: only the new
    links, between the roots known so far, are followed."""
    if labels is None:
        return _cut(_roots(links, tasks), tasks)
    root = lambda s: labels.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    between = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b").distinct()
    joint = _cut(_roots(between, tasks), tasks)
    over = joint.select(F.col("node").alias("root"), F.col("root").alias("joint"))
    moved = labels.join(over, "root", "left").select("node", F.coalesce("joint", "root").alias("root"))
    return _cut(moved.unionByName(joint.join(labels, "node", "left_anti").select("node", "root")), tasks)


def forest_pairs(texts: DataFrame, words: int, tasks: int | None = None) -> DataFrame:
    """Pairs (a, b) of texts that the forest ties: each text with the first of its fingerprint, and the firsts
    of the fingerprints of a link. A spanning forest, so never more pairs than a few for each text."""
    tasks = tasks or input_tasks(texts)
    marked = _cut(simhash.fingerprints(texts, "text", "node", words), tasks)
    first = _cut(marked.groupBy("fp").agg(F.min("key").alias("first")), tasks)
    same = marked.join(first, "fp").select("first", "key")
    of = lambda s: first.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}"))
    links = _cut(simhash.close_links(first), tasks)
    tied = links.join(of("a"), "a").join(of("b"), "b").select("first_a", "first_b")
    pairs = same.toDF("x", "y").unionByName(tied.toDF("x", "y")).filter("x != y")
    return _cut(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), tasks)


def similar_groups(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, root) for each of ``texts`` (node, text; nodes are unique) that chains of a Jaccard of 0.8 or more
    tie to another; a root is the same for all that are tied."""
    spark, tasks = texts.sparkSession, input_tasks(texts)
    order = spark.sparkContext.broadcast(_common(texts, words))
    prefixes = texts.mapInArrow(lambda it: _sets(it, words, *order.value), SETS).select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    same = Window.partitionBy("token")
    met = prefixes.withColumns({"n": F.count(F.lit(1)).over(same)}).filter("n > 1").drop("n")
    folder = shared_folder(spark, "near-copies")
    met.coalesce(tasks).write.parquet(folder)
    order.unpersist()
    met = spark.read.parquet(folder)
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    wanted = (F.col("size_a") + F.col("size_b")) * 4  # ninths of what has to be shared

    def hopeful(rows: DataFrame) -> DataFrame:
        """The pairs (a, b) that share enough of their prefixes; a row for each shingle a pair meets in.

        Of two prefixes, one ends first in the order: what its set shares beyond the met shingles lies
        behind that prefix.
        """
        n = rows.groupBy("a", "b", "size_a", "size_b").count()
        behind = F.greatest(*[F.col(c) - (F.floor(F.col(c) / 5) + 1) for c in ("size_a", "size_b")])
        return _cut(n.filter((F.col("count") + behind) * 9 >= wanted).select("a", "b"), tasks)

    def texts_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return _cut(texts_among(texts, needed).join(needed, "node", "left_semi"), tasks)

    def possible(pairs: DataFrame, found: DataFrame) -> DataFrame:
        maps = found.mapInArrow(lambda it: _bitmaps(it, words), MAPS)
        of = lambda s: maps.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}"))
        return _cut(pairs.join(of("a"), "a").join(of("b"), "b").filter(_possible()).select("a", "b"), tasks)

    def tested(pairs: DataFrame, found: DataFrame) -> DataFrame:
        both = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("one")), "a")
        both = both.join(found.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
        return _cut(both.select("a", "b", "one", "other").mapInArrow(lambda it: _tested(it, words), "a long, b long"), tasks)

    def apart_yet(labels: DataFrame) -> DataFrame:
        """The rows of shingles that texts under different roots meet in."""
        marked = met.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parted = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token")
        return _cut(marked.join(parted, "token", "left_semi"), tasks)

    # Pairs that a star misses are met below: its shingles may have several centres.
    known = forest_pairs(texts, words, tasks)
    found = texts_of(known)
    labels = _tied(None, tested(possible(known, found), found), tasks)
    marked = apart_yet(labels)
    for turn in range(STARS):
        drawn = lambda k, turn=turn: F.min(F.struct(F.xxhash64("node", F.lit(turn * CENTRES + k)).alias("draw"), "node", "size", "root"))
        centre = marked.groupBy("token").agg(F.array(*[drawn(k) for k in range(CENTRES)]).alias("drawn"))
        firsts = F.array_distinct(F.transform("drawn", lambda d: F.struct(d["node"].alias("node"), d["size"].alias("size"), d["root"].alias("root"))))
        centre = centre.select("token", F.explode(firsts).alias("first"))
        stars = marked.join(centre, "token").filter(F.col("root") != F.col("first.root"))
        node, first = F.col("node"), F.col("first.node")
        stars = stars.select(F.least(node, first).alias("a"), F.greatest(node, first).alias("b"), F.when(node < first, F.col("size")).otherwise(F.col("first.size")).alias("size_a"), F.when(node < first, F.col("first.size")).otherwise(F.col("size")).alias("size_b"))
        stars = hopeful(stars.filter(least * 5 >= most * 4))
        stars = _cut(stars.join(known, ["a", "b"], "left_anti"), tasks)
        found = texts_of(stars)
        more = tested(possible(stars, found), found)
        known = known.unionByName(stars)
        labels = _tied(labels, more, tasks)
        marked = apart_yet(labels)
        if more.isEmpty():
            break

    # Of two sets that similar the larger is in the band of sizes of the smaller or in the next one. The bitmaps
    # are asked inside the join: of a large group of half alike texts it makes no row for each pair.
    maps = texts_among(texts, marked.select("node").distinct()).mapInArrow(lambda it: _bitmaps(it, words), MAPS)
    marked = marked.join(_cut(maps.select("node", "bits"), tasks), "node")
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1.25)).cast("int")
    x, y = (marked.select("token", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "pos", "root", "bits")], band.alias("band")) for s in "ab")
    x = x.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    first = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    shared = F.least("pos_a", "pos_b") + 1 + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    likely = first & (F.col("root_a") != F.col("root_b")) & (F.col("size_a") * 5 >= F.col("size_b") * 4) & (shared * 9 >= wanted)
    apart = hopeful(x.join(y, ["token", "band"]).filter(likely & _possible()))
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = _cut(apart.join(known, ["a", "b"], "left_anti"), tasks)
    return _tied(labels, tested(apart, texts_of(apart)), tasks)


def _nodes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``node``, a number that equal texts share and different ones do not.

    Numbers are hashes; SHA-256 digests tell whether texts meet in one, and those texts get another hash.
    """
    met: list[int] = []
    turn = 0
    while True:
        node = _hash(0)
        for later in range(1, turn + 1):
            node = F.when(node.isin(met), _hash(later)).otherwise(node)
        out = rows.withColumn("node", node)
        digests = out.select("node", F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("node").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
        more = [r.node for r in digests.filter("least != most").select("node").limit(MOST_MET).collect()]
        if not more:
            return out
        met, turn = [*met, *more], turn + 1


def _hash(turn: int) -> Column:
    return F.xxhash64("text") if turn == 0 else F.xxhash64("text", F.lit(turn))


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each group that links of a Jaccard of 0.8 or more tie: that with the
    smallest key.

    A-Z count as a-z; words are what ASCII white space parts. Texts without words, null or empty, are
    alike. Rows that share a key are one document: they stay or go together, and stay if one of them is
    kept. Groups without any key stay whole.
    """
    rows = _nodes(docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        # Dealt out once and kept: the texts are read again in every round.
        folder = shared_folder(rows.sparkSession, "near-copies-texts")
        rows.repartition(input_tasks(rows)).write.parquet(folder)
        rows = rows.sparkSession.read.parquet(folder)
    marked = cut_lineage(rows.select("key", "node"))
    once = _cut(marked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")), input_tasks(rows))
    texts = rows.select("node", "text")
    if not once.filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    roots = similar_groups(texts, words)
    tied = once.join(roots, "node")
    of_tied = tied.groupBy("root").agg(F.min("least").alias("component_id")).join(tied.select("root", "node"), "root")
    label = once.join(of_tied.select("node", F.col("component_id").alias("joint"), F.lit(True).alias("tied")), "node", "left")
    label = label.select("node", F.when(F.col("tied"), F.col("joint")).otherwise(F.col("least")).alias("component_id"))
    kept = marked.join(label, "node").filter(F.col("key").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("key").alias("__kept")).distinct()
    return docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col("__kept")), "left_semi")
