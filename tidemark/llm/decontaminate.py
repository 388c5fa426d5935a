"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

A benchmark item is searched for in windows of its characters. A text region within k edits of a
window of m characters shares at least ``m - q + 1 - k q`` of its q-grams, and does so on diagonals
(position in the text less position in the window) that lie within k of each other. So:

1. Text positions whose q-gram occurs in the benchmark at all are marked, and only stretches dense
   enough in marks to hold any window's bound go on.
2. Marks there become (window, diagonal) hits, counted in bands of 2 k diagonals that overlap by k;
   bands that reach the window's bound go on.
3. A banded alignment of the window against the text decides, and gives the edits.

Every step is a necessary condition, so nothing within the budget is lost. Items too short for windows are
found by an automaton of all of them, without edits and between characters that are no letter or digit. Texts are compared in lower
case (ASCII) with all white space alike, character for character, so positions are those of the text.

The benchmark is read in parts of bounded size, each broadcast to one pass over the texts; the number of
passes grows with the benchmark, never with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, input_tasks, single, text_of, utf8_buffers
from tidemark.session import cut_lineage

Q = 8
#: Characters of a window and between the starts of two; items shorter than a window are one window.
WINDOW, STEP = 120, 60
#: Edits allowed, as a share of the window.
EDITS = 0.08
#: Items with fewer characters say too little to be found with edits: they are found as whole phrases only.
LEAST_CHARS = 40
#: Benchmark characters of one part.
PART_CHARS = 2_000_000
MARK_BITS = 23
ROLL = np.uint64(0x9E3779B97F4A7C15 | 1)
BLANKS = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x3000], np.uint32)


@dataclass(frozen=True)
class Limits:
    q: int = Q
    window: int = WINDOW
    step: int = STEP
    edits: float = EDITS
    least_chars: int = LEAST_CHARS


def characters(raw: bytes) -> np.ndarray:
    """Code points in lower case (ASCII), any white space as a blank; one for each character."""
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    capital = (codes >= 65) & (codes <= 90)
    codes[capital] += 32
    codes[np.isin(codes, BLANKS)] = 32
    return codes


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at every position (mixed, so that its high bits are good)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, wide = codes.astype(np.uint64), 1
    done, length = np.zeros(n, np.uint64), 0
    power = ROLL
    while wide <= q:  # spans of 1, 2, 4, ... characters, joined as q's bits say
        if q & wide:
            done = done * power + out[length : length + n]
            length += wide
        if wide * 2 <= q:
            out = out[:-wide] * power + out[wide:]
        wide, power = wide * 2, np.uint64(int(power) ** 2 & 2**64 - 1)
    done ^= done >> np.uint64(29)
    return done * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The windows of a part of the benchmark and their q-grams."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], limits: Limits):
        self.limits = limits
        self.ids = [item for item, _ in items]
        self.codes: list[np.ndarray] = []
        self.item: list[int] = []  # the item's place in ``ids``
        self.start: list[int] = []
        short: dict[str, list[int]] = {}
        for item, (_, text) in enumerate(items):
            codes = characters(text.encode())
            inner = np.flatnonzero(codes != 32)
            if not len(inner):
                continue
            codes = codes[inner[0] : inner[-1] + 1]
            if len(codes) < max(limits.least_chars, limits.q):
                short.setdefault(as_text(codes), []).append(item)
                continue
            last = max(0, len(codes) - limits.window)
            for a in sorted({*range(0, last, limits.step), last}):
                self.codes.append(codes[a : a + limits.window])
                self.item.append(item)
                self.start.append(a)
        self.phrases = automaton(short) if short else None
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size = size
        self.budget = (size * limits.edits).astype(np.int64)
        self.bound = np.maximum(1, size - limits.q + 1 - self.budget * limits.q)
        grams = [rolling(c, limits.q) for c in self.codes]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.gram, self.first, self.many = np.unique(hashes[order], return_index=True, return_counts=True)
        self.window, self.offset = window[order].astype(np.int64), offset[order].astype(np.int64)
        self.marked = np.zeros(1 << MARK_BITS, bool)
        self.marked[(self.gram >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
        if len(size):
            self.reach, self.dense = int((size + self.budget).max()), int(self.bound.min())

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, window, offset) of q-grams in stretches of the text that may hold a window."""
        none = np.zeros(0, np.int64)
        grams = rolling(codes, self.limits.q)
        if not len(self.gram) or len(grams) < self.dense:
            return none, none, none
        mark = self.marked[(grams >> np.uint64(64 - MARK_BITS)).astype(np.int64)]
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
        reach = min(self.reach, len(grams))
        dense = np.flatnonzero(total[reach:] - total[:-reach] >= self.dense)
        if not len(dense):
            return none, none, none
        edge = np.zeros(len(grams) + 1, np.int32)
        np.add.at(edge, dense, 1)
        np.add.at(edge, dense + reach, -1)
        at = np.flatnonzero(mark & (np.cumsum(edge[:-1]) > 0))
        place = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        real = self.gram[place] == grams[at]
        at, place = at[real], place[real]
        many = self.many[place]
        where = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.repeat(at, many), self.window[where], self.offset[where]

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, lowest diagonal) of the bands that reach their window's bound."""
        at, window, offset = self.hits(codes)
        if not len(at):
            return at, at
        step = self.budget[window] + 1
        band = (at - offset) // step
        window, step, band = np.concatenate([window] * 2), np.concatenate([step] * 2), np.concatenate([band, band - 1])
        shift = int(band.min())
        width = int(band.max()) - shift + 1
        pairs, count = np.unique(window * width + band - shift, return_counts=True)
        w, b = pairs // width, pairs % width + shift
        keep = count >= self.bound[w]
        return w[keep], b[keep] * (self.budget[w[keep]] + 1)

    def align(self, codes: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the text) of each candidate; any number above the budget if it fails.

        Rows are the window's characters, columns diagonals; the alignment starts and ends freely.
        """
        edits, ends = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        for size in np.unique(self.size[window]).tolist():
            for some in np.array_split(np.flatnonzero(self.size[window] == size), max(1, (self.size[window] == size).sum() // 2_000)):
                k = int(self.budget[window[some[0]]])
                wide = 4 * k + 3
                first = low[some] - k
                text = np.full((len(some), size + wide), 0xFFFFFFFF, np.uint32)
                source = first[:, None] + np.arange(size + wide)[None, :]
                there = (source >= 0) & (source < len(codes))
                text[there] = codes[source[there]]
                pattern = np.stack([self.codes[w] for w in window[some]])
                row = np.where(first[:, None] + np.arange(wide)[None, :] >= 0, 0, size).astype(np.int64)
                slide = np.arange(wide)
                for i in range(size):
                    put = row + (text[:, i : i + wide] != pattern[:, i : i + 1])
                    put[:, :-1] = np.minimum(put[:, :-1], row[:, 1:] + 1)
                    row = np.minimum.accumulate(put - slide, axis=1) + slide
                best = np.argmin(row, axis=1)
                edits[some] = row[np.arange(len(some)), best]
                ends[some] = first + best + size
        return edits, np.minimum(ends, len(codes))

    def search(self, codes: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item, matched windows, fewest edits, start, end) of each item found in one text."""
        found: dict[int, list] = self.whole_phrases(codes) if self.phrases else {}
        window, low = self.candidates(codes)
        if not len(window):
            return self.told(found)
        edits, ends = self.align(codes, window, low)
        good = edits <= self.budget[window]
        for w, e, end in zip(window[good].tolist(), edits[good].tolist(), ends[good].tolist()):
            seen = found.setdefault(self.item[w], [set(), e, end, end])
            seen[0].add(w)
            seen[1] = min(seen[1], e)
            seen[2], seen[3] = min(seen[2], max(0, end - int(self.size[w]))), max(seen[3], end)
        return self.told(found)

    def told(self, found: dict[int, list]) -> list[tuple[int | None, int, int, int, int]]:
        return [(self.ids[item], len(ws), e, a, b) for item, (ws, e, a, b) in sorted(found.items())]

    def whole_phrases(self, codes: np.ndarray) -> dict[int, list]:
        """The short items that stand in a text between characters that are no letter or digit."""
        text, found = as_text(codes), {}
        for end, (phrase, items) in self.phrases.iter(text):
            start = end + 1 - len(phrase)
            inside = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
            if inside or (end + 1 < len(text) and text[end + 1].isalnum() and text[end].isalnum()):
                continue
            for item in items:
                seen = found.setdefault(item, [{-1}, 0, start, end + 1])
                seen[2], seen[3] = min(seen[2], start), max(seen[3], end + 1)
        return found


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def automaton(phrases: dict[str, list[int]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, items in phrases.items():
        out.add_word(phrase, (phrase, items))
    out.make_automaton()
    return out


@lru_cache(maxsize=2)
def _index(items: tuple[tuple[int, str], ...], limits: Limits) -> Index:
    return Index(items, limits)


FOUND = "key long, item_id long, windows int, edits int, first_char long, end_char long"


def _searched(batches: Iterator[pa.RecordBatch], items, limits: Limits) -> Iterator[pa.RecordBatch]:
    index = _index(items.value, limits)
    for batch in batches:
        key = single(batch, "key").to_pylist()
        raw, offsets = utf8_buffers(single(batch, "text"))
        rows: list[tuple] = []
        for a, b in blocks(offsets):
            # One array for the block, with a gap no window can cross between two texts.
            texts = [characters(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b)]
            for i, codes in zip(range(a, b), texts):
                rows += [(key[i], *found) for found in index.search(codes)]
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))], names=names)


def benchmark_parts(benchmark: DataFrame, text: str, key: str, part_chars: int) -> list[int]:
    """Part numbers 0, 1, ... of the benchmark; see :func:`_with_part`."""
    return [r[0] for r in _with_part(benchmark, text, key, part_chars).select("part").distinct().orderBy("part").collect()]


def _with_part(benchmark: DataFrame, text: str, key: str, part_chars: int) -> DataFrame:
    total = benchmark.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    parts = -(-total // part_chars) or 1
    # A part is a share of the items by hash; the longest item bounds how far it exceeds its size.
    rows = benchmark.filter(F.col(text).isNotNull())
    return rows.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"), F.pmod(F.xxhash64(text), F.lit(parts)).alias("part"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", limits: Limits = Limits(), part_chars: int = PART_CHARS) -> DataFrame:
    """One row per text and benchmark item found in it: key, item_id, windows (of the item, found),
    edits (fewest of a window), first_char, end_char (of the region, in characters).

    Null texts and items hold nothing. An item without an id is searched for like any other and reported
    with a null id. Items under ``least_chars`` characters are found as whole phrases, without edits. A
    quote of a longer item is certain to be found from ``window + step - 1`` characters on.
    Repeated rows are each reported. Equal items under two ids are both reported. An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    if rows.rdd.getNumPartitions() < input_tasks(rows):
        rows = rows.repartition(input_tasks(rows))
    marked = _with_part(benchmark, item_text, item_key, part_chars)
    found = None
    for part in benchmark_parts(benchmark, item_text, item_key, part_chars) or [0]:
        items = tuple(sorted(((r[0], r[1]) for r in marked.filter(F.col("part") == part).select("item", "text").distinct().collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        sent = spark.sparkContext.broadcast(items)
        own = rows.mapInArrow(lambda it, sent=sent: _searched(it, sent, limits), FOUND)
        found = own if found is None else found.unionByName(own)
    return found.withColumnRenamed("key", key)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents in which an item is found; rows that share a key go together."""
    gone = cut_lineage(leaks(docs, benchmark, text, key, **how).select(F.col(key).alias("__gone")).distinct())
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
