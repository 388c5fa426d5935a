"""Ranked lexical search with hashed max-sketches.

The index holds, per document, how often each of its terms occurs and a sketch: terms are hashed to
coordinates, and a coordinate keeps the largest count of its terms. Only coordinates that are not zero
are stored, so a wide sketch costs three bytes a distinct term. A term's impact in a document grows with
its count, so impacts taken from the sketch are upper bounds whatever the corpus says of lengths and
weights. A search multiplies the sketches of a batch of documents with the weights of all items at once;
the products bound the scores from above. Every task then rescores its documents exactly, by descending
bound, until the next bound is below the item's last place so far.

What leaves a task is ten rows per item at most. Items are the stated query set: they are read in blocks
of bounded size, and each block passes over the index once.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import blocks, input_tasks, shared_folder, single, text_of, utf8_buffers
from tidemark.operators.skew import top_k

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8 every byte of a character outside ASCII is in the class, so bytes match as characters do.
TERM = re.compile(PATTERN.encode())
#: Coordinates of a sketch (65,536 at most); its counts end at FULL, which stands for any count from there on.
WIDTH, FULL = 1 << 14, 255
#: A block of items: so many, with so many bytes of text (or one longer item).
BLOCK_ITEMS, BLOCK_TEXT = 256, 1 << 18
#: Terms whose coordinate a worker remembers.
REMEMBERED = 500_000
#: Documents whose bounds are computed in one step, and no impact reaches this.
STEP, MOST_IMPACT = 256, 1_000_000


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


class Coordinates(dict):
    """Coordinates of terms, computed when a term is first asked for."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.digest = width, xxhash.xxh64_intdigest

    def __missing__(self, term: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = found = self.digest(term, 13) % self.width
        return found


# --- index -------------------------------------------------------------------------------------
def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value per row: the bytes of ``values`` between its ends."""
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def _indexed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    place = Coordinates(width)
    for batch in batches:
        raw, offsets = utf8_buffers(single(batch, "text"))
        for a, b in blocks(offsets):
            lengths, terms, rows, at, counts, ends = [], [], [], [], [], [0]
            for i in range(a, b):
                tf = Counter(terms_of(raw[offsets[i] : offsets[i + 1]].tobytes()))
                lengths.append(tf.total())
                terms.append(b" ".join(tf))
                at += [place[t] for t in tf]
                counts += tf.values()
                rows.append(len(tf))
                ends.append(ends[-1] + len(tf))
            counts = np.array(counts, np.int64)
            spot = np.repeat(np.arange(b - a), rows) * width + np.array(at, np.int64)
            order = np.lexsort((-counts, spot))
            spot, most = spot[order], np.minimum(counts[order], FULL).astype(np.uint8)
            first = np.flatnonzero(np.diff(spot, prepend=-1))
            spot, most = spot[first], most[first]
            per_row = np.searchsorted(spot, np.arange(b - a + 1) * width)
            yield pa.record_batch(
                [
                    single(batch, "key").slice(a, b - a),
                    pa.array(lengths, pa.int64()),
                    _binary((spot % width).astype("<u2"), per_row), _binary(most, per_row),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64())),
                ],
                names=["key", "n", "places", "most", "terms", "counts"],
            )


def index(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The written index, one row per row of ``docs``: key, n (terms with repeats), the sketch (places
    and the most of each), terms (distinct, parted by a space) and their counts.

    Whole texts; a null or empty text has no terms and is found by nothing. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        rows = rows.repartition(input_tasks(rows))
    folder = shared_folder(docs.sparkSession, "search-index")
    rows.mapInArrow(lambda it: _indexed(it, width), "key long, n long, places binary, most binary, terms string, counts array<long>").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


# --- search ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Block:
    """Items of a block: their ids, and of each the terms (once each) with their weights."""

    ids: list
    terms: list[list[tuple[bytes, int]]]
    documents: int
    all_terms: int
    width: int
    k: int

    def weights(self) -> np.ndarray:
        """Summed weights, a row per coordinate and a column per item."""
        place, out = Coordinates(self.width), np.zeros((self.width, len(self.ids)))
        for j, terms in enumerate(self.terms):
            for term, w in terms:
                out[place[term], j] += w
        return out


def impact(tf, m):
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def bounds(places: np.ndarray, tf: np.ndarray, ends: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, a row per document and a column per item: whole numbers below 2 ** 53.

    Document i's sketch is ``places`` and ``tf`` from ``ends[i]`` to ``ends[i + 1]``.
    """
    out = np.empty((len(m), weights.shape[1]))
    used = np.flatnonzero(weights.any(axis=1))
    column = np.full(len(weights), -1)
    column[used] = np.arange(len(used))
    asked = weights[used]
    for a in range(0, len(m), STEP):
        b = min(a + STEP, len(m))
        of = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        at, count = column[places[ends[a] : ends[b]]], tf[ends[a] : ends[b]].astype(np.int64)
        of, at, count = of[at >= 0], at[at >= 0], count[at >= 0]
        impacts = np.zeros((b - a, len(used)))
        impacts[of, at] = np.where(count == FULL, MOST_IMPACT, impact(count, m[a + of]))
        out[a:b] = impacts @ asked
    return out


def _found(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    weights, best, k = block.weights(), [[] for _ in block.ids], block.k
    rescored = 0
    for batch in batches:
        n = single(batch, "n").to_numpy(zero_copy_only=False).astype(np.int64)
        raw, at = utf8_buffers(single(batch, "places"))
        tf, ends = utf8_buffers(single(batch, "most"))
        m = 10 + (90 * n * block.documents) // block.all_terms
        most = bounds(raw[at[0] : at[-1]].view("<u2"), tf[ends[0] : ends[-1]], ends - ends[0], m, weights)
        keys, terms, counts = single(batch, "key"), single(batch, "terms"), single(batch, "counts")
        known: dict[int, dict] = {}
        for j, places in enumerate(best):
            least = -places[-1][0] if len(places) == k else 1
            column = most[:, j]
            for i in (hopeful := np.flatnonzero(column >= least))[np.argsort(-column[hopeful], kind="stable")].tolist():
                if column[i] < (-places[-1][0] if len(places) == k else 1):
                    break
                tf = known.get(i)
                if tf is None:
                    tf = known[i] = dict(zip(terms[i].as_buffer().to_pybytes().split(b" "), counts[i].values.to_pylist()))
                here, rescored = int(m[i]), rescored + 1
                score = sum(w * impact(tf[t], here) for t, w in block.terms[j] if t in tf)
                if score > 0:
                    key = keys[i].as_py()
                    insort(places, (-score, key is None, key or 0))
                    del places[k:]
    rows = [(j, None if missing else key, -score) for j, places in enumerate(best) for score, missing, key in places]
    columns = list(zip(*rows)) if rows else [[], [], []]
    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns] + [pa.array([rescored] * len(rows), pa.int64())], names=["item", "key", "score", "rescored"])


def item_blocks(items: DataFrame, text: str, item: str) -> Iterator[list[tuple]]:
    """Blocks of (id, terms), each term once; items without terms find nothing and are left out."""
    held, size = [], 0
    for row in items.select(item, text_of(text)).toLocalIterator():
        terms = list(dict.fromkeys(terms_of(row[1].encode())))
        if held and (len(held) >= BLOCK_ITEMS or size + len(row[1]) > BLOCK_TEXT):
            yield held
            held, size = [], 0
        if terms:
            held.append((row[0], terms))
            size += len(row[1])
    if held:
        yield held


def weights_of(indexed: DataFrame, vocabulary: Iterable[bytes], documents: int) -> dict[bytes, int]:
    """Weights of the terms that any document holds; counts are over all documents."""
    spark = indexed.sparkSession
    wanted = spark.createDataFrame([(t.decode(),) for t in vocabulary], "term string")
    held = indexed.select(F.explode(F.split("terms", " ")).alias("term")).join(F.broadcast(wanted), "term")  # a block's terms: bounded
    return {r.term.encode(): math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}


def search(indexed: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", key: str = "doc_id", k: int = 10, width: int = WIDTH) -> DataFrame:
    """The ``k`` best documents of each item: item, rank from 1, key, score.

    Scores are above 0; equal ones are ranked by ascending key, null keys last. Every row of ``items`` is
    an item, whether or not its id is null or repeated; rows of ``docs`` that share a key are documents of
    their own. Items without terms and empty tables give no rows.
    """
    spark: SparkSession = indexed.sparkSession
    told = indexed.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("terms")).first()
    id_type = items.schema[item].dataType
    schema = StructType([StructField(item, id_type), StructField("rank", LongType()), StructField(key, LongType()), StructField("score", LongType())])
    out = spark.createDataFrame([], schema).withColumn("rank", F.col("rank").cast("int"))
    if not told.documents:
        return out
    for held in item_blocks(items, text, item):
        weight = weights_of(indexed, {t for _, terms in held for t in terms}, told.documents)
        terms = [[(t, weight[t]) for t in terms if weight.get(t)] for _, terms in held]
        sent = spark.sparkContext.broadcast(Block([i for i, _ in held], terms, told.documents, told.terms, width, k))
        best = indexed.mapInArrow(lambda it, sent=sent: _found(it, sent.value), "item long, key long, score long, rescored long")
        best = top_k(best, ["item"], [F.desc("score"), F.asc_nulls_last("key")], k, rank="rank")
        ids = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(held)], StructType([StructField("item", LongType()), StructField("id", id_type)]))
        best = best.join(F.broadcast(ids), "item")  # a block's items: bounded
        out = out.unionByName(best.select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score"))
    return out


def oracle(k: int = 10) -> str:
    """DuckDB SQL for :func:`search` of the benchmark's items over the documents."""
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {terms} AS terms FROM documents),
      counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
      lengths AS (SELECT d, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
      whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
      weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, docs),
      measured AS (SELECT d, doc_id, 10 + (90 * n * docs) // terms AS m FROM lengths, whole),
      items AS (SELECT row_number() OVER () AS i, item_id, {terms} AS terms FROM benchmark),
      asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(terms) AS term FROM items)),
      scores AS (SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN measured USING (d) GROUP BY ALL)
      SELECT item_id, rank, doc_id, score FROM (
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
      WHERE rank <= {k}"""
