"""Whole texts to token ids with a public tokenizer, one library call per distinct piece of text.

The library is the slow part of tokenising, and a corpus repeats its words. A text is cut where no
token can reach across - before white space that follows other characters, and before an ASCII
character that is neither letter nor space after a letter - and only pieces a worker has not met
go to the library. The ids of a text are the ids of its pieces, so they equal those of the
whole text (tested). Texts with white space outside ASCII or with the opening of a special token,
where such a cut could be wrong, go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.llm.common import blocks, utf8_buffers

#: Pieces that a worker remembers before it starts anew (about 60 bytes each).
REMEMBERED = 800_000
#: Pieces longer than this many bytes are looked up by their bytes.
LONG_PIECE = 256

# White space outside ASCII, control characters some patterns take for space, and the opening of the
# tokenizers' special tokens; the bytes these begin with.
ODD = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf|[\x1c-\x1f]|<\|"
)
ODD_LEAD = np.zeros(256, bool)
ODD_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF, 0x1C, 0x1D, 0x1E, 0x1F, 0x3C]] = True

SPACE, LETTER, WIDE, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[65:91] = KIND[97:123] = LETTER
KIND[128:] = WIDE
_random = np.random.default_rng(20_240_229)
WEIGHT = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.cumprod(np.full(LONG_PIECE, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


class Slots:
    """A hash table from 64-bit hashes to numbers, in two arrays; whole arrays are looked up at once."""

    def __init__(self, most: int):
        self.bits, self.held = max(4, (2 * most).bit_length()), 0
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _first_place(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for those not there."""
        out, place, open_ = np.full(len(hashes), -1, np.int64), self._first_place(hashes), np.arange(len(hashes))
        while len(open_):
            value = self.values[place]
            here = (value >= 0) & (self.keys[place] == hashes[open_])
            out[open_[here]] = value[here]
            on = (value >= 0) & ~here
            open_, place = open_[on], (place[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there yet; the table grows if they would fill it."""
        if 3 * (self.held + len(hashes)) > 2 * len(self.keys):
            old = self.values >= 0
            keys, numbers = self.keys[old], self.values[old]
            self.__init__(self.held + len(hashes))
            self.add(keys, numbers)
        self.held += len(hashes)
        place = self._first_place(hashes)
        while len(hashes):
            free = self.values[place] < 0
            self.keys[place[free]], self.values[place[free]] = hashes[free], values[free]
            out = (self.values[place] != values) | (self.keys[place] != hashes)  # taken, or lost to another of these
            hashes, values, place = hashes[out], values[out], (place[out] + 1) & (len(self.keys) - 1)


class PieceEncoder:
    """Token ids of texts; remembers the pieces it has met.

    ``plain_case``: the tokenizer lower-cases and drops white space, so pieces that differ only in
    ASCII case or leading space are one piece.
    """

    def __init__(self, path: str, plain_case: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.plain_case = plain_case
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._forget()

    def _forget(self) -> None:
        self.slot_of = Slots(REMEMBERED)
        self.long_slot_of: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length, self.slots = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of pieces not met before."""
        found = self._library_ids([p.decode("utf-8", "replace") for p in pieces])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, first = int(sizes.sum()), self.slots
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(found) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), np.uint32, total)
        self.at[first : first + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.length[first : first + len(found)] = sizes
        self.used += total
        self.slots += len(found)
        return np.arange(first, self.slots)

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of a block; every text begins one."""
        kind = KIND[raw]
        before, here = kind[:-1], kind[1:]
        cut = (here == SPACE) & (before != SPACE)
        cut |= (here == OTHER) & (before == LETTER)
        # A letter of two bytes: Latin-1 letters but the signs of multiplication and division.
        lead = raw[:-2] == 0xC3
        low = raw[1:-1]
        cut[1:] |= lead & (low != 0x97) & (low != 0xB7) & (here[1:] == OTHER)
        mask = np.zeros(len(raw), bool)
        mask[1:] = cut
        mask[starts] = True
        return np.flatnonzero(mask)

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has."""
        if self.slots + self.slots // 8 > REMEMBERED:
            self._forget()
        texts = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        at = self._cuts(raw, offsets[:-1][full])
        size = np.diff(np.append(at, len(raw)))
        owner = np.searchsorted(offsets[1:], at, side="right")
        if self.plain_case:  # leading white space is no part of a piece
            raw = self.lower[raw]
            spaces = np.add.reduceat((KIND[raw] == SPACE).astype(np.int64), at)
            at, size = at + spaces, size - spaces
            keep = size > 0
            at, size, owner = at[keep], size[keep], owner[keep]
        slots = np.full(len(at), -1, np.int64)
        short = np.flatnonzero(size < LONG_PIECE)
        if len(short):
            slots[short] = self._short_slots(raw, at[short], size[short])
        for k in np.flatnonzero(size >= LONG_PIECE):
            piece = raw[at[k] : at[k] + size[k]].tobytes()
            if piece not in self.long_slot_of:
                self.long_slot_of[piece] = int(self._learn([piece])[0])
            slots[k] = self.long_slot_of[piece]
        counts = self.length[slots]
        ends = np.cumsum(counts)
        where = np.repeat(self.at[slots] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        per_text = np.bincount(owner, weights=counts, minlength=texts).astype(np.int64)
        return self.ids[where], per_text

    def _short_slots(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(begin, size)
        codes = raw[np.repeat(at, size) + inside]
        hashes = np.add.reduceat(WEIGHT[codes] * POWER[inside], begin) + size.astype(np.uint64) * WEIGHT[0]
        group, distinct = pd.factorize(hashes)
        first = np.zeros(len(distinct), np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        slot = self.slot_of.find(distinct)
        new = np.flatnonzero(slot < 0)
        if len(new):
            pieces = [raw[a : a + n].tobytes() for a, n in zip(at[first[new]].tolist(), size[first[new]].tolist())]
            slot[new] = self._learn(pieces)
            self.slot_of.add(distinct[new], slot[new].astype(np.int32))
        return slot[group]

    def encode(self, column: pa.Array):
        """Blocks of (ids of all texts of the block, number of ids of each text), in row order."""
        raw, offsets = utf8_buffers(column)
        for a, b in blocks(offsets):
            data, local = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if ODD_LEAD[data].any() and ODD.search(data.tobytes()):
                yield self._block_with_whole_texts(data, local)
            else:
                yield self._block(data, local)

    def _block_with_whole_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text by text; those with unusual white space go to the library whole."""
        ids, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes()
            if ODD.search(text):
                own = np.array(self._library_ids([text.decode("utf-8", "replace")])[0], np.uint32)
            else:
                own = self._block(data[a:b], np.array([0, b - a]))[0]
            ids.append(own)
            counts.append(len(own))
        return np.concatenate(ids), np.array(counts, np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, plain_case: bool) -> PieceEncoder:
    """One encoder per worker process; it lives as long as the worker is reused."""
    return PieceEncoder(path, plain_case)
