"""The greedy one-to-one choice inside one bounded cell of a pairing group.

Removed rows take partners in sorted order, level of score by level: the first free added row that the level
allows. What a level allows is told by labels, never by pairs: class edges (rows of two classes share so
many values beyond those all rows share) and kinds (rows of two sets of columns, which share those at
least). Added rows wait in one queue per label, so a choice looks at the heads of a few queues.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np

from tidemark.config.rules import UNRELATED_RATIO
from tidemark.functions.text import reaches


@dataclass(frozen=True)
class Entry:
    """A row in its side's sorted order, with its labels and demands."""

    cid: str
    columns: tuple[str, ...]
    keyed: bool = False
    must: frozenset = frozenset()
    listed: bool = False
    said: str = ""
    stems: frozenset = frozenset()


class Free:
    """Which places are free, and the next free one from any place on."""

    def __init__(self, n: int):
        self.after = list(range(n + 1))

    def next(self, k: int) -> int:
        root = k
        while self.after[root] != root:
            root = self.after[root]
        while self.after[k] != root:
            self.after[k], k = root, self.after[k]
        return root

    def take(self, k: int) -> None:
        self.after[k] = k + 1


@dataclass
class Queue:
    """The added rows of one label in sorted order, and which of them are free."""

    rows: list[int] = field(default_factory=list)
    free: Free | None = None
    place: dict[int, int] = field(default_factory=dict)

    def close(self) -> None:
        self.free = Free(len(self.rows))
        self.place = {row: k for k, row in enumerate(self.rows)}

    def head(self) -> int | None:
        return self.at(0)

    def at(self, k: int) -> int | None:
        k = self.free.next(k)
        return self.rows[k] if k < len(self.rows) else None

    def after(self, row: int) -> int | None:
        return self.at(self.place[row] + 1)

    def take(self, row: int) -> None:
        if row in self.place:
            self.free.take(self.place[row])


def by_labels(asks: Sequence[Sequence[Iterable[str]]], offers: Sequence[Iterable[str]]) -> list[tuple[int, int]]:
    """(removed, added) places in the order of choice. Both sides are in sorted order; ``asks`` has for each
    removed row and level the labels of which an added row has to offer one."""
    queues: dict = defaultdict(Queue)
    for j, labels in enumerate(offers):
        for label in labels:
            queues[label].rows.append(j)
    for queue in queues.values():
        queue.close()
    waiting, out = list(range(len(asks))), []
    for level in range(max(map(len, asks), default=0)):
        left = []
        for i in waiting:
            heads = [queues[label].head() for label in asks[i][level] if label in queues]
            j = min((h for h in heads if h is not None), default=None)
            if j is None:
                left.append(i)
                continue
            for label in offers[j]:
                queues[label].take(j)
            out.append((i, j))
        waiting = left
    return out


class Ratios(dict):
    """difflib's ratio of two texts, computed once; False for texts that cannot reach the bar."""

    def __missing__(self, pair: tuple[str, str]) -> bool:
        self[pair] = alike = reaches(*pair, UNRELATED_RATIO)
        return alike


class Letters:
    """The most of each letter that a text of a set has, and its shortest text."""

    def __init__(self) -> None:
        self.most, self.shortest = Counter(), None

    def add(self, text: str) -> None:
        self.most |= Counter(text)
        self.shortest = len(text) if self.shortest is None else min(self.shortest, len(text))

    def may_hold(self, text: str, letters: Counter) -> bool:
        """Whether a text of the set can reach the bar: no matching is larger than the letters shared."""
        both = len(text) + self.shortest
        return both == 0 or 2.0 * (letters & self.most).total() / both >= UNRELATED_RATIO


class Cell:
    """Removed and added rows of a cell, each side sorted, and how they may pair."""

    def __init__(self, olds: list[Entry], news: list[Entry], constants: int, least: float):
        self.olds, self.news, self.constants, self.least, self.alike = olds, news, constants, least, Ratios()
        self.queues: dict = defaultdict(Queue)
        # Of each set of stems, what letters its texts have.
        self.letters: dict = defaultdict(lambda: defaultdict(Letters))
        self.guarded = any(o.must or o.listed for o in olds)
        self.labels = []
        for j, n in enumerate(news):
            labels = [("class", n.cid), ("kind", n.columns)]
            if self.guarded:
                labels += [("must", n.columns, cell) for cell in n.must] + [("stem", n.columns, stem) for stem in n.stems]
                labels += [] if n.said else [("blank", n.columns)]
                if n.said:
                    self.letters[n.columns][n.stems].add(n.said)
            self.labels.append(labels)
            for label in labels:
                self.queues[label].rows.append(j)
        for queue in self.queues.values():
            queue.close()

    def kind_scores(self) -> dict[float, dict[tuple, list[tuple]]]:
        """Level -> (columns, keyed) of removed rows -> the columns of added rows they may meet."""
        out: dict = defaultdict(lambda: defaultdict(list))
        offered = {n.columns for n in self.news}
        for columns, keyed in {(o.columns, o.keyed) for o in self.olds}:
            for other in offered:
                score = self.constants / max(len(set(columns) | set(other)), 1)
                if keyed or score >= self.least:
                    out[score][columns, keyed].append(other)
        return out

    def related(self, o: Entry, j: int) -> bool:
        n = self.news[j]
        return not o.listed or not o.said or not n.said or bool(o.stems & n.stems) or self.alike[o.said, n.said]

    def first_fit(self, o: Entry, columns: tuple[str, ...]) -> int | None:
        """The first free added row of a kind that meets what the removed row asks for."""
        if o.must:
            asked = min((self.queues.get(("must", columns, cell), Queue()) for cell in o.must), key=lambda q: len(q.rows))
            j = asked.head() if asked.rows else None
            while j is not None and not (o.must <= self.news[j].must and self.related(o, j)):
                j = asked.after(j)
            return j
        if not o.listed or not o.said:
            return self.queues[("kind", columns)].head()
        known = [self.queues[label] for label in [("blank", columns), *(("stem", columns, s) for s in o.stems)] if label in self.queues]
        sure = min((j for j in (q.head() for q in known) if j is not None), default=None)
        # What shares no stem is asked once by its set of stems: most sets have no text that is alike enough.
        every, sets, letters, hopeful = self.queues[("kind", columns)], self.letters[columns], Counter(o.said), {}
        j = every.head()
        while j is not None and j != sure:
            stems = self.news[j].stems
            if stems not in hopeful:
                hopeful[stems] = sets[stems].may_hold(o.said, letters)
            if hopeful[stems] and self.related(o, j):
                break
            j = every.after(j)
        return j

    def take(self, j: int) -> None:
        for label in self.labels[j]:
            self.queues[label].take(j)

    def pairs(self, edges: Iterable[tuple[str, str, float]], only: float | None = None) -> list[tuple[int, int]]:
        """(removed, added) in the order of choice; ``only`` restricts to one level."""
        by_class: dict = defaultdict(lambda: defaultdict(list))
        for left, right, score in edges:
            if ("class", right) in self.queues:
                by_class[score][left].append(("class", right))
        by_kind = self.kind_scores()
        levels = sorted({*by_class, *by_kind}, reverse=True) if only is None else [only]
        waiting, out = list(range(len(self.olds))), []
        for level in levels:
            classes, kinds, left = by_class.get(level, {}), by_kind.get(level, {}), []
            for i in waiting:
                o = self.olds[i]
                heads = [self.queues[label].head() for label in classes.get(o.cid, ())]
                heads += [self.first_fit(o, columns) for columns in kinds.get((o.columns, o.keyed), ())]
                j = min((h for h in heads if h is not None), default=None)
                if j is None:
                    left.append(i)
                else:
                    self.take(j)
                    out.append((i, j))
            waiting = left
        return out


def entries(pdf, side: str, plain: Callable) -> tuple[list[Entry], list[int]]:
    """A cell's rows of one side in sorted order, and their places in ``pdf``."""
    items = [plain(i) for i in pdf["items"]]
    order = sorted(np.flatnonzero(pdf["side"] == side).tolist(), key=items.__getitem__)
    told = [
        Entry(pdf["cid"].iat[k], tuple(pdf["columns"].iat[k]), bool(pdf["keyed"].iat[k]), frozenset(plain(pdf["must"].iat[k])), bool(pdf["listed"].iat[k]), pdf["said"].iat[k] or "", frozenset(() if pdf["stems"].iat[k] is None else pdf["stems"].iat[k]))
        for k in order
    ]
    return told, order
