"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words. Each term's hash votes on the bits of
the fingerprint: for a bit that is set, against one that is not, with a weight that grows with the
logarithm of the term's count; a pair counts twice a word. Weights are whole numbers, so equal texts have
equal fingerprints wherever they are computed. The share of differing bits estimates the angle between
two texts' vectors of terms.

Fingerprints within ``radius`` bits agree in at least ``keep`` of ``radius + keep`` blocks of bits. A table
for each choice of ``keep`` blocks permutes the chosen bits to the front; all that agree there meet. ``keep``
follows the number of fingerprints and moves the cost, never the result. A pair that meets
in several tables counts in the first. Large meetings are split into cells of two parts; only counts leave them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, single, text_of, utf8_buffers
from tidemark.session import broadcast_if_bounded, cut_lineage

BITS, RADIUS = 128, 4
#: Weight of a single word in units; a pair has twice as much.
UNIT = 16
#: Terms that vote in one numpy step, words a worker remembers, and comparisons of one step.
CHUNK, REMEMBERED, STEP = 8_192, 500_000, 1 << 18
#: Fingerprints that meet in a table on average, and those of a part of a larger meeting.
MEETING, PART = 64, 8_192


# --- fingerprints ------------------------------------------------------------------------------
class Hashes(dict):
    """XXH64 of words, computed when a word is first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 1)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_terms(text: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text and their weights. Words are what ASCII white space parts; A-Z count as a-z."""
    words = text.lower().split()
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = mixed(one[:-1] * np.uint64(3) + one[1:] * np.uint64(7) + np.uint64(5))
    terms, weights = [], []
    for found, unit in ((mixed(one), UNIT), (two, 2 * UNIT)):
        distinct, count = np.unique(found, return_counts=True)
        terms.append(distinct)
        weights.append(np.rint(unit * (1 + np.log(count))).astype(np.int64))
    return np.concatenate(terms), np.concatenate(weights)


def fingerprints(texts: list[bytes], hashes: Hashes, bits: int = BITS) -> np.ndarray:
    """A row of ``bits // 8`` bytes per text; a text without words has only zeros."""
    found = [weighted_terms(t, hashes) for t in texts]
    votes = np.zeros((len(texts), bits), np.int64)
    if found:
        term, weight = (np.concatenate(x) for x in zip(*found))
        owner = np.repeat(np.arange(len(texts)), [len(t) for t, _ in found])
        salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64) for k in range(bits // 64)]
        for a in range(0, len(term), CHUNK):
            some = term[a : a + CHUNK]
            lanes = np.stack([mixed(some + s) for s in salts], axis=1).astype(">u8")
            ones = np.unpackbits(lanes.view(np.uint8).reshape(len(some), -1), axis=1).astype(np.float32)
            heavy, of = weight[a : a + CHUNK].astype(np.float32), owner[a : a + CHUNK]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            # Whole numbers below 2 ** 24: their sums are exact in any order.
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(some)]):
                votes[of[x]] += (2 * np.einsum("i,ij->j", heavy[x:y], ones[x:y]) - heavy[x:y].sum()).astype(np.int64)
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of equal bits stands for, 0 at least, of rows of bytes."""
    apart = np.bitwise_count(a ^ b).sum(axis=1) / (8 * a.shape[1])
    return np.maximum(0.0, np.cos(math.pi * apart))


# --- each text and the next --------------------------------------------------------------------
ROWS = (
    "key long, n_chars long, edited binary, fingerprint binary, edited_fingerprint binary, next_fingerprint binary, "
    "near_edited double, near_next double, part int, end string, text string"
)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of another, if it has them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _finished(keys: list, texts: list[str], own: np.ndarray, nexts: list[str], following: np.ndarray, hashes: Hashes, part: int) -> pa.RecordBatch:
    changed = [edited(t, n).encode() for t, n in zip(texts, nexts)]
    new = fingerprints(changed, hashes, own.shape[1] * 8)
    raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    n, nothing = len(keys), pa.nulls(len(keys), pa.string())
    return pa.record_batch(
        [
            pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).digest() for c in changed], pa.binary()), raw(own), raw(new), raw(following),
            pa.array(likeness(own, new)), pa.array(likeness(own, following)), pa.array([part] * n, pa.int32()), nothing, nothing,
        ],
        schema=_schema(),
    )


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ROWS.split(", "))])


def _end(key, text: str, own: np.ndarray, part: int, end: str) -> pa.RecordBatch:
    told = {"key": key, "fingerprint": own.tobytes(), "part": part, "end": end, "text": text}
    return pa.RecordBatch.from_pylist([{name: told.get(name) for name in _schema().names}], schema=_schema())


def _walked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in their order, each finished with the row after it. The first row of a task also leaves as
    'head', for the last row of the task before; the last one leaves as 'tail' and is finished later."""
    hashes, part, held = Hashes(), TaskContext.get().partitionId(), None
    for batch in batches:
        keys, texts = single(batch, "key"), single(batch, "text")
        _, offsets = utf8_buffers(texts)
        for a, b in blocks(offsets):
            some, ids = texts.slice(a, b - a).to_pylist(), keys.slice(a, b - a).to_pylist()
            own = fingerprints([t.encode() for t in some], hashes, bits)
            if held is None:
                yield _end(ids[0], some[0], own[0], part, "head")
            else:
                some, ids, own = [held[1], *some], [held[0], *ids], np.concatenate([held[2], own])
            if len(ids) > 1:
                yield _finished(ids[:-1], some[:-1], own[:-1], some[1:], own[1:], hashes, part)
            held = ids[-1], some[-1], own[-1:]
    if held is not None:
        yield _end(held[0], held[1], held[2][0], part, "tail")


def _ended(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        for row in batch.to_pylist():
            own, following = (np.frombuffer(row[c], np.uint8)[None, :] for c in ("fingerprint", "next_fingerprint"))
            yield _finished([row["key"]], [row["text"]], own, [row["next_text"]], following, hashes, row["part"])


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """A row (ROWS) per row of ``docs``: its fingerprint, that of its edited text and that of the next row.

    The next row is the one with the next smaller key, that after the smallest the one with the largest;
    null keys are smaller than any other and rows of one key are in the order of their texts. Texts are
    range-partitioned once; a task holds two texts and a block at a time.
    """
    tie, spread = F.xxhash64("text"), F.monotonically_increasing_id()
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    rows = rows.withColumns({"tie": tie, "row": spread}).repartitionByRange(F.desc("key"), F.col("tie"), F.col("row"))
    rows = rows.sortWithinPartitions(F.desc("key"), "tie", "text").select("key", "text")
    laid = cut_lineage(rows.mapInArrow(lambda it: _walked(it, bits), ROWS))
    ends = laid.filter("end is not null")
    # One row per task of the walk.
    heads = ends.filter("end = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    order, every = Window.orderBy("part"), Window.partitionBy()
    places = ends.filter("end = 'tail'").select("part")
    places = places.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(every)).alias("next_part"))
    tails = ends.filter("end = 'tail'").select("key", "text", "fingerprint", "part").join(places, "part").join(heads, "next_part")
    tails = tails.mapInArrow(lambda it: _ended(it, bits), ROWS)
    return laid.filter("end is null").unionByName(tails).drop("part", "end", "text")


# --- permuted block tables ---------------------------------------------------------------------
def block_edges(radius: int, keep: int, bits: int = BITS) -> list[int]:
    n = radius + keep
    return [bits * k // n for k in range(n + 1)]


def tables(radius: int, keep: int) -> list[tuple[int, ...]]:
    """The blocks that each table has in front."""
    return list(itertools.combinations(range(radius + keep), keep))


def _front_bits(radius: int, keep: int, bits: int) -> list[int]:
    widths = np.diff(block_edges(radius, keep, bits))
    return [int(widths[list(chosen)].sum()) for chosen in tables(radius, keep)]


def blocks_kept(rows: int, radius: int = RADIUS, bits: int = BITS) -> int:
    """The least number of leading blocks by which about MEETING of ``rows`` evenly spread fingerprints meet."""
    keep, wanted = 1, math.log2(max(rows, 1) / MEETING)
    while bits * keep / (radius + keep) < wanted and max(_front_bits(radius, keep + 1, bits)) < 64:
        keep += 1
    return keep


def front_keys(prints: np.ndarray, chosen: tuple[int, ...], edges: list[int]) -> np.ndarray:
    """The bits of the chosen blocks as one number."""
    bits = np.unpackbits(prints, axis=1)
    front = np.concatenate([bits[:, edges[c] : edges[c + 1]] for c in chosen], axis=1)
    wide = np.zeros((len(prints), 64), np.uint8)
    wide[:, 64 - front.shape[1] :] = front
    return np.packbits(wide, axis=1).view(">u8").ravel().astype(np.int64)


def _as_rows(column: pa.Array) -> np.ndarray:
    raw, offsets = utf8_buffers(column)
    return raw[offsets[0] : offsets[-1]].reshape(len(column), -1)


def _dealt(batches: Iterator[pa.RecordBatch], radius: int, keep: int, bits: int) -> Iterator[pa.RecordBatch]:
    edges = block_edges(radius, keep, bits)
    for batch in batches:
        prints = _as_rows(single(batch, "fp"))
        for t, chosen in enumerate(tables(radius, keep)):
            keys = pa.array(front_keys(prints, chosen, edges))
            yield pa.record_batch([pa.array(np.full(len(prints), t, np.int32)), keys, single(batch, "fp"), single(batch, "n")], names=["table", "front", "fp", "n"])


def near_in(prints: np.ndarray, n: np.ndarray, side: np.ndarray, table: int, radius: int, keep: int) -> np.ndarray:
    """For each fingerprint of a meeting, the rows of others within the radius whose first table is this.

    ``side`` parts a cell of two parts: only its pairs across are counted. One part alone has only zeros.
    """
    bits = prints.shape[1] * 8
    starts, chosen = block_edges(radius, keep, bits)[:-1], np.array(tables(radius, keep)[table])
    lanes, out = np.ascontiguousarray(prints).view(np.uint64), np.zeros(len(prints), np.int64)
    whole = not side.any()
    left, right = (np.arange(len(prints)),) * 2 if whole else (np.flatnonzero(~side), np.flatnonzero(side))
    rows = max(1, STEP // max(1, len(right)))
    for a in range(0, len(left), rows):
        some = left[a : a + rows]
        apart = sum(np.bitwise_count(lanes[some, k][:, None] ^ lanes[right, k][None, :]).astype(np.int16) for k in range(lanes.shape[1]))
        i, j = np.nonzero(apart <= radius)
        i, j = some[i], right[j]
        if whole:
            i, j = i[i < j], j[i < j]
        if len(i):
            differs = np.bitwise_or.reduceat(np.unpackbits(prints[i] ^ prints[j], axis=1), starts, axis=1)
            # The first table of a pair has its first ``keep`` equal blocks in front.
            here = (np.argsort(differs, axis=1, kind="stable")[:, :keep] == chosen).all(axis=1)
            np.add.at(out, i[here], n[j[here]])
            np.add.at(out, j[here], n[i[here]])
    return out


def _counted(batches: Iterator[pa.RecordBatch], radius: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Counts of each meeting; rows come sorted by table, front, low and high, and a cell is held at a time."""
    names, held = ["table", "front", "low", "high"], None

    def counts(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        told = {c: cells[c].to_numpy() for c in [*names, "n", "part"]}
        prints = _as_rows(cells["fp"].combine_chunks())
        new = np.any([np.diff(told[c], prepend=told[c][0] - 1) != 0 for c in names], axis=0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(prints))
        near = np.zeros(len(prints), np.int64)
        for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
            side = (told["part"][a:b] == told["high"][a]) & (told["low"][a] != told["high"][a])
            near[a:b] = near_in(prints[a:b], told["n"][a:b], side, int(told["table"][a]), radius, keep)
        some = np.flatnonzero(near)
        yield pa.record_batch([cells["fp"].combine_chunks().take(pa.array(some)), pa.array(near[some])], names=["fp", "near"])

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        last = [held[c][-1].as_py() for c in names]
        open_from = int(np.argmax(np.all([held[c].to_numpy() == v for c, v in zip(names, last)], axis=0)))
        if open_from:
            yield from counts(held.slice(0, open_from).combine_chunks())
            held = held.slice(open_from).combine_chunks()
    if held is not None:
        yield from counts(held.combine_chunks())


def near_counts(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, keep: int | None = None, part: int = PART) -> DataFrame:
    """(fp, near): for each distinct fingerprint of ``prints`` (fp, n: its rows) that has any, the rows whose
    other fingerprints lie within the radius. Exact."""
    keep = keep or blocks_kept(prints.count(), radius, bits)
    dealt = prints.mapInArrow(lambda it: _dealt(it, radius, keep, bits), "table int, front long, fp binary, n long")
    large = dealt.groupBy("table", "front").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > part)
    large = broadcast_if_bounded(cut_lineage(large.select("table", "front", F.ceil(F.col("size") / part).cast("int").alias("parts"))))
    cells = dealt.join(large, ["table", "front"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "part").alias("low"), F.greatest(k, "part").alias("high")))
    cells = cells.select("table", "front", F.explode(own).alias("cell"), "part", "fp", "n").select("table", "front", "cell.low", "cell.high", "part", "fp", "n")
    order = ["table", "front", "low", "high"]
    cells = cells.repartition(*order).sortWithinPartitions(*order)
    found = cells.mapInArrow(lambda it: _counted(it, radius, keep), "fp binary, near long")
    return found.groupBy("fp").agg(F.sum("near").alias("near"))


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and near_documents, the number of other rows whose fingerprint is within ``radius`` bits.

    Null and empty texts have no characters, fingerprint zero and are near each other. Repeated rows and rows
    of one key are documents of their own, in the order :func:`with_next` tells. An empty table gives
    an empty result. Other columns are not looked at.
    """
    rows = with_next(docs, text, key, bits)
    rows = cut_lineage(rows.drop("next_fingerprint"))
    prints = cut_lineage(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.count(F.lit(1)).alias("n")))
    near = near_counts(prints, radius, bits)
    # Fingerprints with company only; a hot one is then a row that is looked up, not a hot key.
    crowd = prints.join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("near")).filter("near > 0")
    crowd = broadcast_if_bounded(cut_lineage(crowd))
    hex_of = lambda c: F.lower(F.hex(c))
    return rows.join(crowd, F.col("fingerprint") == F.col("fp"), "left").select(
        F.col("key").alias(key), "n_chars", hex_of("edited").alias("edited_sha256"), hex_of("fingerprint").alias("fingerprint"),
        hex_of("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("near", F.lit(0)).alias("near_documents"),
    )
