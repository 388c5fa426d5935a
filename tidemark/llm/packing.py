"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only lengths decide which documents share a sequence, and there are at most ``capacity`` different
lengths. So the packing is planned on the histogram of lengths, whatever the corpus holds: a plan
is a list of patterns (the lengths of one sequence) with the number of sequences that repeat each.
The plan is greedy - the longest piece that fits, until none does - and then tries to replace the
pattern's smallest piece by two others that fit the widened gap more tightly. Pieces are then
numbered within their length and find their place in the plan by that number; neither a length nor
a sequence is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import input_tasks, single, text_of
from tidemark.llm.tokens import encoder
from tidemark.session import cut_lineage

CAPACITY = 2048


@dataclass
class Plan:
    """Patterns: lengths of one sequence (descending), how many sequences have them, first sequence id."""

    patterns: list[tuple[int, ...]]
    times: list[int]
    first: list[int]

    @property
    def sequences(self) -> int:
        return sum(self.times)


def _greedy(left: np.ndarray, capacity: int) -> list[int]:
    """The longest piece that fits, again and again."""
    pattern: list[int] = []
    gap, used = capacity, np.zeros_like(left)
    while gap > 0:
        fits = np.flatnonzero(left[1 : gap + 1] - used[1 : gap + 1] > 0)
        if not len(fits):
            break
        length = int(fits[-1]) + 1
        pattern.append(length)
        used[length] += 1
        gap -= length
    return pattern


def _two_for_one(pattern: list[int], left: np.ndarray, capacity: int) -> list[int]:
    """The pattern with its smallest piece replaced by the two unpacked pieces that fill the widened
    gap best, if they fill it better."""
    gap = capacity - sum(pattern)
    if gap == 0 or not pattern:
        return pattern
    smallest, rest = pattern[-1], pattern[:-1]
    room = gap + smallest
    free = left.copy()
    for length in pattern:
        free[length] -= 1
    free = free[: room + 1]
    there = np.flatnonzero(free > 0)
    if not len(there):
        return pattern
    # For every first piece the longest second one that still fits, as lengths at most ``room``.
    longest = np.zeros(room + 1, np.int64)
    longest[there] = there
    longest = np.maximum.accumulate(longest)
    second = longest[room - there]
    own = (second == there) & (free[there] < 2)
    below = np.where(there > 0, longest[np.maximum(there - 1, 0)], 0)
    second = np.where(own, np.minimum(below, room - there), second)
    filled = np.where(second > 0, there + second, 0)
    best = int(np.argmax(filled))
    if filled[best] <= smallest:
        return pattern
    return sorted([*rest, int(there[best]), int(second[best])], reverse=True)


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """``counts[n]``: pieces of length n, for n from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    left[0] = 0
    plan, made = Plan([], [], []), 0
    while left.any():
        pattern = _two_for_one(_greedy(left, capacity), left, capacity)
        lengths, each = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // each).min())
        left[lengths] -= each * times
        plan.patterns.append(tuple(pattern))
        plan.times.append(times)
        plan.first.append(made)
        made += times
    return plan


def _slots(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its ranges of numbers begin, the pieces it has in one sequence, the
    range's first sequence, and the offset of the first such piece."""
    found: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    for pattern, times, first in zip(plan.patterns, plan.times, plan.first):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            begin = taken.get(length, 0)
            found.setdefault(length, []).append([begin, each, first, offset])
            taken[length] = begin + each * times
            offset += each * length
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in found.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, plain_case: bool, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    import pyspark

    task = pyspark.TaskContext.get().partitionId()
    met = np.zeros(capacity + 1, np.int64)
    pieces = encoder(tokenizer, plain_case)
    for batch in batches:
        key, row = single(batch, "key"), 0
        for found, n in pieces.encode(single(batch, "text")):
            ids = np.insert(found, np.cumsum(n), end_id).astype("<u4")
            size = n + 1
            parts = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), parts)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            start = nth * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = (np.cumsum(size) - size)[doc] + start
            own = [ids[a : a + k] for a, k in zip(begin.tolist(), length.tolist())]
            crc = [zlib.crc32(x.tobytes()) for x in own]
            number = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            grouped = length[order]
            head = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]])) if len(order) else order
            run = np.repeat(head, np.diff(np.append(head, len(order))))
            number[order] = np.arange(len(order)) - run + met[grouped]
            met += np.bincount(length, minlength=capacity + 1)
            names = [f.split()[0] for f in PIECES.split(", ")]
            columns = [key.slice(row, len(size)).take(pa.array(doc)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(number)]
            if keep_ids:
                names.append("ids")
                columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int32())))
            yield pa.record_batch(columns, names=names)
            row += len(size)


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", plain_case: bool = True, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every text's ids and the end id, cut into pieces of ``capacity``; with the pieces' CRC-32.

    ``nth`` numbers the pieces of one length within ``task``. Null texts are empty: one piece, the
    end id alone. ``keep_ids`` adds the ids themselves.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        rows = rows.repartition(input_tasks(rows))
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return rows.mapInArrow(lambda it: _pieces(it, tokenizer, plain_case, end_id, capacity, keep_ids), schema)


def _placed(batches: Iterator[pa.RecordBatch], slots: dict[int, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = single(batch, "length").to_numpy(zero_copy_only=False)
        number = single(batch, "number").to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length).tolist():
            here = np.flatnonzero(length == n)
            begin, each, first, at = slots[n]
            k = np.searchsorted(begin, number[here], "right") - 1
            inside = number[here] - begin[k]
            sequence[here] = first[k] + inside // each[k]
            offset[here] = at[k] + inside % each[k] * n
        keep = [i for i, name in enumerate(batch.schema.names) if name != "number"]
        columns = [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)]
        yield pa.record_batch(columns, names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (columns ``length`` from 1 to ``capacity``, ``task`` and ``nth``: the number within task
    and length) with ``sequence_id`` and ``offset``; the numbering columns go.

    No sequence is longer than ``capacity``, offsets are gapless from 0. Equal lengths take their
    places in the order of their numbers. No pieces give an empty result.
    """
    pieces = cut_lineage(pieces)
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("__n"))
    totals = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in totals.items():
        counts[length] = n
    slots = _slots(plan_packing(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("length", "task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    numbered = pieces.join(shift, ["length", "task"]).withColumn("number", F.col("nth") + F.col("__shift"))
    numbered = numbered.drop("task", "nth", "__shift")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number"]
    return numbered.mapInArrow(lambda it: _placed(it, slots), ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document and
    its place; with ``keep_ids=True`` also the ids."""
    packed = pack_pieces(token_pieces(docs, tokenizer, capacity=capacity, **how), capacity)
    more = ["ids"] if "ids" in packed.columns else []
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *more)
