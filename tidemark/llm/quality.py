"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word of the corpus (hashed into a fixed number of rows) gets the sum of the sparse random index
vectors of the words around it, counted over all documents. A text is the mean of its words'
vectors, and of the vectors of their shapes, with how alike its words are. A network of two layers
scores that; its probabilities are calibrated by a temperature fitted on labelled texts kept aside.

Words are runs of letters (A-Z as a-z, anything beyond ASCII counts as a letter), of digits and of
one punctuation mark; a word's shape is its kind, case and length. Tasks work on the bytes of whole
blocks of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, input_tasks, single, text_of, utf8_buffers
from tidemark.session import cut_lineage

#: Rows of word vectors, their dimensions, non-zeros of an index vector, neighbours to each side.
ROWS, DIMS, NONZEROS, REACH = 1 << 15, 32, 2, 2
#: The first rows belong to shapes.
SHAPES = 256
#: Labelled texts that the network is fitted on, at most.
MOST_LABELLED = 12_000
HIDDEN, STEPS, RATE, DECAY, SEED = 24, 600, 0.01, 1e-3, 7
ACCEPT = 0.3

SPACE, LETTER, CAPITAL, DIGIT, MARK = 0, 1, 2, 3, 4
KIND = np.full(256, MARK, np.uint8)
KIND[:33] = SPACE
KIND[97:123] = LETTER
KIND[128:] = LETTER
KIND[65:91] = CAPITAL
KIND[48:58] = DIGIT
#: What a run is made of: letters of any case, digits, or one mark repeated.
RUN = np.zeros(256, np.int16)
RUN[(KIND == LETTER) | (KIND == CAPITAL)] = 1
RUN[KIND == DIGIT] = 2
RUN[KIND == MARK] = 3 + np.flatnonzero(KIND == MARK)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WEIGHT = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of every row's index vector."""
    rnd = np.random.default_rng(SEED + 1)
    return rnd.integers(0, DIMS, (ROWS, NONZEROS)), rnd.choice(np.array([-1, 1], np.int8), (ROWS, NONZEROS))


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, row of its shape, text it is in) of a block of texts."""
    run = RUN[raw]
    cut = np.ones(len(raw), bool)
    cut[1:] = run[1:] != run[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(cut)
    at = at[run[at] != 0] if len(at) else at
    if not len(at):
        return at, at, at
    every = np.flatnonzero(cut)
    size = np.diff(np.append(every, len(raw)))[run[every] != 0]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    codes = raw[np.repeat(at, size) + inside]
    begin = np.cumsum(size) - size
    hashes = np.add.reduceat(WEIGHT[LOWER[codes]] * POWER[inside & 63], begin)
    capitals = np.add.reduceat((KIND[codes] == CAPITAL).astype(np.int64), begin)
    kind = np.minimum(run[at], 4).astype(np.int64) - 1
    case = np.where(capitals == 0, 0, np.where(capitals < size, 1, 2))
    mark = np.where(kind >= 2, raw[at].astype(np.int64) % 16, case)
    length = np.minimum(np.log2(size).astype(np.int64), 3)
    shape = (kind * 16 + mark) * 4 + length
    # Capitals make another word, so that shouting is not the word it shouts.
    hashes += (case == 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    row = SHAPES + ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % (ROWS - SHAPES)
    return row, shape, np.searchsorted(offsets[1:], at, side="right")


# --- word vectors ------------------------------------------------------------------------------
def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = index_vectors()
    total = np.zeros(ROWS * DIMS, np.int64)
    for batch in batches:
        raw, offsets = utf8_buffers(single(batch, "text"))
        for a, b in blocks(offsets):
            word, shape, owner = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for apart in range(1, REACH + 1):
                near = owner[apart:] == owner[:-apart]
                where, what = [], []
                for of in (word, shape):
                    left, right = of[:-apart][near], of[apart:][near]
                    for x, y in ((left, right), (right, left)):
                        where += [x * DIMS + place[y, k] for k in range(NONZEROS)]
                        what += [sign[y, k] for k in range(NONZEROS)]
                total += np.bincount(np.concatenate(where), weights=np.concatenate(what), minlength=ROWS * DIMS).astype(np.int64)
    vectors = total.reshape(ROWS, DIMS)
    rows = np.flatnonzero(vectors.any(axis=1))
    columns = [pa.array(rows)] + [pa.array(vectors[rows, k]) for k in range(DIMS)]
    yield pa.record_batch(columns, names=["row"] + [f"d{k}" for k in range(DIMS)])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all rows, from every document. ROWS x DIMS numbers, whatever the corpus is."""
    rows = docs.select(text_of(text).alias("text"))
    names = [f"d{k}" for k in range(DIMS)]
    counted = rows.mapInArrow(_context_counts, ", ".join(["row long", *[f"{n} long" for n in names]]))
    summed = counted.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((ROWS, DIMS))
    vectors[summed["row"].to_numpy(np.int64)] = summed[names].to_numpy(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


FEATURES = 2 * DIMS + 6


def pooled(raw: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text of a block; texts without words are all zeros."""
    texts = len(offsets) - 1
    out = np.zeros((texts, FEATURES), np.float32)
    word, shape, owner = words_of(raw, offsets)
    if not len(word):
        return out
    n = np.bincount(owner, minlength=texts)
    full = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[full]
    each = n[full][:, None]
    own = vectors[word]
    mean = np.add.reduceat(own, at, axis=0) / each
    by_shape = np.bincount(owner * SHAPES + shape, minlength=texts * SHAPES).reshape(texts, SHAPES)[full]
    shaped = by_shape @ vectors[:SHAPES] / each
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    alike = np.zeros(len(word))
    alike[1:] = np.einsum("ij,ij->i", own[1:], own[:-1]) * (owner[1:] == owner[:-1])
    # Words that occur before in the same text, as a share.
    key = owner.astype(np.int64) * ROWS + word
    distinct = np.bincount(np.unique(key) // ROWS, minlength=texts)[full]
    out[full] = np.concatenate([
        mean, shaped, np.linalg.norm(mean, axis=1)[:, None], np.linalg.norm(shaped, axis=1)[:, None],
        np.add.reduceat(same, at)[:, None] / each, np.add.reduceat(alike, at)[:, None] / each,
        distinct[:, None] / each, np.log1p(each) / 10,
    ], axis=1)
    return out


# --- the network -------------------------------------------------------------------------------
@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.center) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    """Adam on the log loss of the rows not kept ``aside``; the temperature on those that are."""
    rnd = np.random.default_rng(SEED)
    x, y = x.astype(np.float64), y.astype(np.float64)
    use = ~aside if (~aside).any() else np.ones(len(x), bool)
    center, scale = x[use].mean(0), x[use].std(0) + 1e-3
    net = Network(center, scale, rnd.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    z, t = (x[use] - center) / scale, y[use]
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        hidden = np.tanh(z @ weights[0] + weights[1])
        logit = hidden @ weights[2] + weights[3][0]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - t) / len(t)
        back = error[:, None] * weights[2][None, :] * (1 - hidden**2)
        slopes = [z.T @ back + DECAY * weights[0] / len(weights[0]), back.sum(0), hidden.T @ error + DECAY * weights[2] / HIDDEN, np.array([error.sum()])]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if aside.any():
        logit, t = net.logits(x[aside]), y[aside]
        loss = lambda k: float(np.mean(np.logaddexp(0, logit / k) - t * logit / k))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_buffers(single(batch, "text"))
        found = [pooled(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], vectors.value) for a, b in blocks(offsets)]
        x = np.concatenate(found) if found else np.zeros((0, FEATURES), np.float32)
        yield pa.record_batch([single(batch, "key"), single(batch, "label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))], names=["key", "label", "x"])


@dataclass
class Model:
    vectors: object
    network: Network


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most_labelled: int = MOST_LABELLED) -> Model:
    """Word vectors from all ``docs``; the network from labelled rows that are not held out.

    At most ``most_labelled`` labelled keys are used, those of lowest hash. Null labels and keys are
    left out. Without any usable label, or with one kind only, the network knows no better than the
    share of ones (one half without labels).
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text))
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    chosen = usable.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = cut_lineage(chosen.orderBy(F.xxhash64("key"), "key").limit(most_labelled))
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).join(F.broadcast(chosen), "key")
    sample = rows.select("key", "label", "text").mapInArrow(lambda it: _features(it, vectors), "key long, label int, x array<float>").toPandas()
    sample = sample.sort_values("key", kind="stable")
    if sample.empty:
        zero = np.zeros(FEATURES)
        return Model(vectors, Network(zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0))
    x, y = np.stack(sample["x"].to_numpy()), sample["label"].to_numpy()
    aside = pd.util.hash_array(sample["key"].to_numpy(np.int64)) % 5 == 0
    return Model(vectors, fit(x, y, aside))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8_buffers(single(batch, "text"))
        found = [model.network.scores(pooled(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.vectors.value)) for a, b in blocks(offsets)]
        score = np.concatenate(found) if found else np.zeros(0)
        yield pa.record_batch([single(batch, "key"), pa.array(score.astype(np.float64))], names=["key", "score"])


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """One row per input row: key, held_out, score, predicted.

    A text without words, null or empty, gets the score of the zero features. Labels are never looked
    at. Repeated rows are each scored. A null key is not held out.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        rows = rows.repartition(input_tasks(rows))
    scored = rows.mapInArrow(lambda it: _scored(it, model), "key long, score double")
    return scored.select(F.col("key").alias(key), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """``docs`` without those the classifier rejects; rows that share a key stay if one of them does."""
    gone = scores(docs, model, text, key, accept).groupBy(key).agg(F.max("predicted").alias("__best")).filter("__best = 0")
    gone = cut_lineage(gone.select(F.col(key).alias("__gone")))
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
