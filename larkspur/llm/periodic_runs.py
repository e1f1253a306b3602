"""Periodic run detection over words, by difference-cover longest common extensions.

A run is a stretch of words with smallest period q, of ``least`` words and
``times`` periods at least, that no neighbouring word extends with that period.

A task takes texts together, about ``_WORDS`` words at a time and longer texts
first, as one sequence of word numbers with a number of its own after every
text, so nothing reaches across texts.  Where a run of period q has 4 q words,
its places that equal the place q further on are 3 q in a row; so of the places
0, 3 q, 6 q, ... one falls into every run: n / 3 (1/1 + 1/2 + 1/3 + ...) places
in all, each tested for one equal pair of words, and only equal pairs are
extended to both sides.  How far two places agree comes from an index that sorts
only the suffixes at places of a difference cover: for any i and j there is a
d < 21 for which i + d and j + d are both in the cover, so d words are compared
as they are, and the rest is a minimum over the common prefixes of neighbours in
the order, answered by a sparse table over blocks.  To the left the same index
is built over the reversed sequence.  A stretch found under several multiples of
its period keeps the least.

A text is held whole by its task, with some hundred bytes a word; nothing else
grows with it.  Null and empty texts have no words and no runs.  A null id has
null as its id.  Repeated rows give repeated results, an empty table none.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import in_batches
from larkspur.llm._words import as_bytes

#: Differences of these places give every number modulo 21.
_CYCLE, _COVER = 21, (0, 1, 4, 14, 16)
_IN_COVER = np.isin(np.arange(_CYCLE), _COVER)
#: The least d with (i + d) and (j + d) in the cover, by i and j modulo 21.
_STEP = np.array([[next(d for d in range(_CYCLE) if _IN_COVER[(i + d) % _CYCLE] and _IN_COVER[(j + d) % _CYCLE]) for j in range(_CYCLE)] for i in range(_CYCLE)])
_RANK = np.array([sum(c <= r for c in _COVER) - 1 for r in range(_CYCLE)])
_WORDS = 1 << 19
_SPAN = 16


class Extensions:
    """How many numbers from two places on are equal, for a sequence whose last number occurs nowhere else."""

    def __init__(self, numbers: np.ndarray, part: np.ndarray):
        """Places of different ``part`` are never asked about (nor compared with each other in the order)."""
        self.n = len(numbers)
        # Beyond the end nothing is equal to anything: places there have a number of their own at either side.
        self.numbers = np.concatenate([numbers, np.full(_CYCLE, -1, numbers.dtype)])
        places = np.arange(self.n)
        self.places = places[_IN_COVER[places % _CYCLE]]
        self._sort(part[self.places])

    def _slot(self, place: np.ndarray) -> np.ndarray:
        """Where a place of the cover stands among them."""
        return place // _CYCLE * len(_COVER) + _RANK[place % _CYCLE]

    def _sort(self, part: np.ndarray) -> None:
        m = len(self.places)
        group = np.unique(part, return_inverse=True)[1].astype(np.int64)
        wide = int(self.numbers.max()) + 2

        def refined(group: np.ndarray, key: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            """Groups (numbered by the first place in their order) split by a key; singles stay as they are."""
            size = np.bincount(group, minlength=m + 1)
            open_ = np.flatnonzero(size[group] > 1)
            if len(open_) == 0:
                return group
            k = key(open_)
            order = np.lexsort((k, group[open_]))
            slot, g, k = open_[order], group[open_][order], k[order]
            head = np.diff(g, prepend=-1) != 0
            fresh = head | (np.diff(k, prepend=-1) != 0)
            at = np.arange(len(slot))
            inside = at - np.maximum.accumulate(np.where(head, at, 0))
            out = group.copy()
            out[slot] = g + np.maximum.accumulate(np.where(fresh, at, 0)) - (at - inside)
            return out

        order = np.argsort(group, kind="stable")
        first = np.diff(group[order], prepend=-1) != 0
        start = np.maximum.accumulate(np.where(first, np.arange(m), 0))
        group[order] = start
        at = 0
        while at < _CYCLE:  # the first 21 numbers, some at a time
            take = max(1, min(_CYCLE - at, int(62 / np.log2(wide + 1))))

            def packed(slot: np.ndarray, at: int = at, take: int = take) -> np.ndarray:
                k = np.zeros(len(slot), np.int64)
                for d in range(at, at + take):
                    k = k * wide + self.numbers[np.minimum(self.places[slot] + d, self.n)] + 1
                return k

            group = refined(group, packed)
            at += take
        self.levels, reach = [group], _CYCLE
        while reach < self.n and (np.bincount(group, minlength=m) > 1).any():
            def next_(slot: np.ndarray, group: np.ndarray = group, reach: int = reach) -> np.ndarray:
                later = self.places[slot] + reach
                inside = later < self.n
                return np.where(inside, group[self._slot(np.where(inside, later, 0))] + 1, 0)

            group = refined(group, next_)
            self.levels.append(group)
            reach *= 2
        self.rank = np.empty(m, np.int64)
        order = np.argsort(group, kind="stable")
        self.rank[order] = np.arange(m)
        self.common = self._neighbours(order)
        self.levels = []
        self._table()

    def _words_equal(self, i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Equal numbers from i and j on, at most ``most`` (21 or fewer) of them."""
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        most = np.broadcast_to(most, len(i))
        for d in range(_CYCLE):
            open_ = open_[d < most[open_]]
            if len(open_) == 0:
                break
            a, b = i[open_] + d, j[open_] + d
            same = (self.numbers[np.minimum(a, self.n)] == self.numbers[np.minimum(b, self.n)]) & (np.maximum(a, b) < self.n)
            open_ = open_[same]
            out[open_] += 1
        return out

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix of the order with the one before it, from the groups of every sorting step."""
        i, j = self.places[order[:-1]], self.places[order[1:]]
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            group, a, b = self.levels[k], i + out, j + out
            inside = np.flatnonzero(np.maximum(a, b) < self.n)
            same = inside[group[self._slot(a[inside])] == group[self._slot(b[inside])]]
            out[same] += _CYCLE << k
        return np.concatenate([[0], out + self._words_equal(i + out, j + out, _CYCLE)]).astype(np.int32)

    def _table(self) -> None:
        """Minima of 2**k blocks of ``_SPAN``, and from every place to either end of its block."""
        top = np.iinfo(np.int32).max
        rows = np.concatenate([self.common, np.full(-len(self.common) % _SPAN, top, np.int32)]).reshape(-1, _SPAN)
        self.upto, self.onward = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.sparse = [rows.min(axis=1)]
        while 2 << len(self.sparse) - 1 <= len(rows):
            last, half = self.sparse[-1], 1 << len(self.sparse) - 1
            self.sparse.append(np.minimum(last[:-half], last[half:]))

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least neighbour prefix of first to last, both included."""
        a, b = first // _SPAN, last // _SPAN
        out = np.minimum(self.onward[first], self.upto[last])
        near = np.flatnonzero(a == b)
        if len(near):
            for d in range(_SPAN):
                near = near[first[near] + d <= last[near]]
                if len(near) == 0:
                    break
                at = self.common[first[near] + d]
                out[near] = np.minimum(out[near], at) if d else at
        far = np.flatnonzero(b - a > 1)
        if len(far):
            width = b[far] - a[far] - 1
            level = np.frexp(width)[1] - 1
            for k in np.unique(level):
                own = far[level == k]
                row = self.sparse[k]
                out[own] = np.minimum(out[own], np.minimum(row[a[own] + 1], row[b[own] - (1 << k)]))
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal numbers from i and j on, i < j of the same part."""
        step = _STEP[i % _CYCLE, j % _CYCLE]
        out = self._words_equal(i, j, step)
        on = np.flatnonzero((out == step) & (j + step < self.n))
        if len(on):
            a, b = self.rank[self._slot(i[on] + step[on])], self.rank[self._slot(j[on] + step[on])]
            out[on] += self._least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def find_runs(texts: list[np.ndarray], least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of word numbers (from 0 on), by text, start and period."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    long_first = sorted((k for k, t in enumerate(texts) if len(t) >= max(least, times)), key=lambda k: -len(texts[k]))
    none = np.zeros(0, np.int64)
    if not long_first:
        return none, none, none, none
    sizes = np.array([len(texts[k]) for k in long_first], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum() + len(sizes))
    numbers = np.empty(n, np.int64)
    words = max(int(texts[k].max()) for k in long_first) + 1
    for k, b in zip(long_first, begin):
        numbers[b : b + len(texts[k])] = texts[k]
    numbers[begin + sizes] = words + np.arange(len(sizes))
    part = np.repeat(np.arange(len(sizes)), sizes + 1)

    places, periods = [], []
    for p in range(1, int(sizes[0]) // times + 1):
        # Texts long enough for the period come first.
        last = int(np.searchsorted(-sizes, -times * p, "right")) - 1
        end = int(begin[last] + sizes[last])
        step = max(1, (times - 1) * p)
        if end > p:
            hit = np.flatnonzero(numbers[0 : end - p : step] == numbers[p:end:step]) * step
            if len(hit):
                places.append(hit)
                periods.append(np.full(len(hit), p, np.int64))
    if not places:
        return none, none, none, none
    i, p = np.concatenate(places), np.concatenate(periods)
    # Equal neighbours on either side first: most chance equalities end at once.
    after = (i + p + 1 < n) & (numbers[np.minimum(i + 1, n - 1)] == numbers[np.minimum(i + p + 1, n - 1)])
    before = (i > 0) & (numbers[np.maximum(i - 1, 0)] == numbers[np.maximum(i + p - 1, 0)])
    need = np.maximum(least, times * p) - p
    some = after | before | (need <= 1)
    i, p, need = i[some], p[some], need[some]
    if len(i) == 0:
        return none, none, none, none
    right = Extensions(numbers, part)(i, i + p)
    # A run needs ``need`` equal places in a row; what can't have them is not extended to the left.
    left = np.zeros(len(i), np.int64)
    mirror = Extensions(numbers[::-1].copy(), part[::-1])
    inner = np.flatnonzero(i > 0)
    left[inner] = mirror(n - (i[inner] + p[inner]), n - i[inner])
    whole = left + right >= need
    start, length, p = (i - left)[whole], (left + right + p)[whole], p[whole]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    fresh = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, p = start[fresh], length[fresh], p[fresh]
    text = np.array(long_first, np.int64)[part[start]]
    start = start - begin[part[start]]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def dropped(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``size`` words lie in a run after its first period."""
    edge = np.bincount(start + period, minlength=size + 1) - np.bincount(start + length, minlength=size + 1)
    return np.cumsum(edge)[:size] > 0


def with_planted_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The contract's rows: in one of ten documents, by its id, the words from some place on repeat with some period."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k % p)] for k in range(n - a)]


def detect(
    documents: DataFrame, id_col: str = "doc_id", least: int = 6, times: int = 4, words_of: Callable[[list[bytes], object], list[bytes]] | None = None
) -> DataFrame:
    """(doc_id, runs array of (start, length, period) by start and period, text collapsed) for each row of (doc_id, text).

    ``collapsed`` has the words that no run drops, joined by one blank.  ``words_of`` may change a text's words first.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judged(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        numbers = [np.array([known.setdefault(w, len(known)) for w in own], np.int64) for own in words]
        text, start, length, period = find_runs(numbers, least, times)
        bounds = np.searchsorted(text, np.arange(len(words) + 1))
        collapsed = []
        for k, own in enumerate(words):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                gone = dropped(len(own), start[a:b], length[a:b], period[a:b])
                own = [own[x] for x in np.flatnonzero(~gone)]
            collapsed.append(b" ".join(own))
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
        return pa.RecordBatch.from_pydict({"doc_id": ids, "runs": runs, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size = [], [], 0
        for batch in batches:
            first, texts = 0, as_bytes(batch.column("text"))
            for k, text in enumerate(texts):
                own = text.split()
                if words_of is not None:
                    own = words_of(own, batch.column("doc_id")[k].as_py())
                words.append(own)
                size += len(own) + 1
                if size >= _WORDS or k + 1 == len(texts):
                    ids.append(batch.column("doc_id").slice(first, k + 1 - first))
                    first = k + 1
                if size >= _WORDS:
                    yield judged(pa.concat_arrays(ids), words)
                    ids, words, size = [], [], 0
        if words:
            yield judged(pa.concat_arrays(ids), words)

    return in_batches(rows, work, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of each document's runs the number, the longest (ties: least start, then period), and digests."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    top = found.withColumn("_top", longest)
    length, period = F.col("_top.length"), -F.col("_top.period")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * _top.length) div (-_top.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
