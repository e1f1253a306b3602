"""Suffix-array dedup with a logarithmic index family.

A byte is removed where a string of ``length`` bytes that covers it also starts
anywhere else.  Suffixes are sampled: the anchor of a string of that length is
the place in it whose next ``ANCHOR`` bytes have the least hash, so equal
strings have equal anchors at equal offsets, and consecutive strings with one
anchor form a stretch.  Only stretches whose anchor bytes occur elsewhere go on.

* Equal stretches collapse first (counted, combined before the shuffle).
* The different stretches around equal anchors are dealt out by anchor.  A task
  takes them in batches: each batch gets a suffix array of its anchors, is
  merge-scanned against the existing levels (suffixes with equal anchors are
  neighbours there; what two of them share to the left and to the right gives
  the long matches), joins as a new level, and equal-sized levels merge.
* An anchor with more than ``crowd`` different stretches isn't gathered in one
  task: its strings are compared by hashes of parts, again with equal parts
  collapsed before the shuffle.

Nothing of this is capped; all strings are judged on the input.  A null text is
empty.  Rows that repeat an id and text are documents with equal texts (so they
cover each other); ids may be null.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import checkpointed, in_batches
from larkspur.llm._words import as_bytes, mix, prefix_hash, runs, span_hash

ANCHOR = 64
_PIECE = 1 << 19
_PART = 32


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, start, strings, anchor's offset from start, anchor hash, content hash) of the stretches of all texts."""
    pieces = [(k, at, t[at : at + _PIECE + length - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), _PIECE)]
    pieces = [p for p in pieces if len(p[2]) >= length]
    data = [p[2] for p in pieces]
    for first, last in runs(data, _PIECE):
        own = data[first:last]
        joined = np.frombuffer(b"".join(own), np.uint8)
        sizes = np.array([len(x) for x in own], np.int64)
        begin = np.cumsum(sizes) - sizes
        prefix = prefix_hash(joined)
        at = np.arange(len(joined) - ANCHOR + 1)
        ordered = span_hash(prefix, at, at + ANCHOR) >> np.uint64(21) << np.uint64(21) | at.astype(np.uint64)
        anchor = (_least(ordered, length - ANCHOR + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        inside = sizes - length + 1
        start = np.repeat(begin - np.cumsum(inside) + inside, inside) + np.arange(inside.sum())
        piece = np.repeat(np.arange(len(own)), inside)
        mine = anchor[start]
        edge = np.flatnonzero((np.diff(mine, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
        count = np.diff(np.append(edge, len(start)))
        head, spot = start[edge], mine[edge]
        content = mix(span_hash(prefix, head, head + count - 1 + length) ^ (spot - head).astype(np.uint64) << np.uint64(32))
        where = piece[edge]
        row = np.array([p[0] for p in pieces[first:last]])[where]
        base = np.array([p[1] for p in pieces[first:last]])[where] - begin[where]
        yield row, head + base, count, spot - head, span_hash(prefix, spot, spot + ANCHOR), content


def _emit(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, n, offset, anchor, content in stretches(as_bytes(batch.column("text")), length):
                row = pa.array(row)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(row), "h": batch.column("h").take(row), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int32()),
                    "o": pa.array(offset, pa.int32()), "a": pa.array(anchor.view(np.int64)), "c": pa.array(content.view(np.int64)),
                })

    return work


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for batch in batches:
        out: dict[str, list] = {"a": [], "c": [], "n": [], "o": [], "crowded": [], "piece": []}
        for text, wanted in zip(as_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                for name in ("a", "c", "n", "o", "crowded"):
                    out[name].append(w[name])
                out["piece"].append(text[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_pydict({
            "a": pa.array(out["a"], pa.int64()), "c": pa.array(out["c"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "o": pa.array(out["o"], pa.int32()),
            "crowded": pa.array(out["crowded"], pa.bool_()), "piece": pa.array(out["piece"], pa.binary()),
        })


def _common(rows: np.ndarray, sizes: np.ndarray, one: np.ndarray, size: int) -> np.ndarray:
    """How many leading bytes of each row equal those of ``one``."""
    differ = rows != one
    return np.minimum(np.where(differ.any(1), differ.argmax(1), rows.shape[1]), np.minimum(sizes, size))


class Levels:
    """Suffix arrays whose sizes fall geometrically.  An entry is [suffix from its anchor on, reversed text before it, a, c]."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, batch: list[tuple[bytes, bytes, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
        """Index a batch; gives (a, c): (start, end) of the covered bytes, from a stretch's start on.

        All strings of a stretch hold its anchor, so what they cover is one span.
        """
        own, self.found = sorted(batch), {}
        self._scan(own, [])
        for level in self.levels:
            self._scan(own, level)
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels[-2:] = [sorted(self.levels[-2] + self.levels[-1])]  # two sorted runs: a merge
        return self.found

    def _scan(self, new: list, old: list) -> None:
        """Walk both arrays in step, anchor by anchor; matches of new entries with old ones, or among themselves without old ones."""
        i = j = 0
        while i < len(new):
            key = new[i][0][:ANCHOR]
            stop = i
            while stop < len(new) and new[stop][0].startswith(key):
                stop += 1
            here = new[i:stop]
            if old:
                while j < len(old) and old[j][0][:ANCHOR] < key:
                    j += 1
                end = j
                while end < len(old) and old[end][0].startswith(key):
                    end += 1
                there, j = old[j:end], end
            else:
                there = here
            if there and (old or len(here) > 1):
                self._match(here, there, not old)
            i = stop

    def _cover(self, entry: tuple, low: int, high: int) -> None:
        start, end = len(entry[1]) - high, len(entry[1]) - low + self.length
        before = self.found.get(entry[2:], (start, end))
        self.found[entry[2:]] = min(start, before[0]), max(end, before[1])

    def _match(self, here: list, there: list, same: bool) -> None:
        sizes = [np.array([len(x[k]) for x in there]) for k in (0, 1)]
        tables = [np.zeros((len(there), 1 + max(int(sizes[k].max()), max(len(x[k]) for x in here))), np.uint8) for k in (0, 1)]
        for k in (0, 1):
            for n, x in enumerate(there):
                tables[k][n, : len(x[k])] = np.frombuffer(x[k], np.uint8)
        far, near = np.full(len(there), -1), np.full(len(there), self.length + 1)  # offsets of the anchor in shared strings
        for n, x in enumerate(here):
            common = []
            for k in (0, 1):
                one = np.zeros(tables[k].shape[1], np.uint8)
                one[: len(x[k])] = np.frombuffer(x[k], np.uint8)
                common.append(_common(tables[k], sizes[k], one, len(x[k])))
            good = common[0] + common[1] >= self.length
            if same:
                good[n] = False
            if good.any():
                low, high = np.maximum(0, self.length - common[0][good]), common[1][good]
                self._cover(x, int(low.min()), int(high.max()))
                far[good], near[good] = np.maximum(far[good], high), np.minimum(near[good], low)
        for n in [] if same else np.flatnonzero(far >= 0):
            self._cover(there[n], int(near[n]), int(far[n]))


def _index(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(length)
        for batch in batches:
            rows = []
            for a, c, o, piece in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "o", "piece"))):
                rows.append((piece[o:], piece[:o][::-1], a, c))
            found = levels.add(rows)
            a, c, s, e = zip(*[(*k, *v) for k, v in found.items()]) if found else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "c": pa.array(c, pa.int64()), "s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64())})

    return work


def _parts(length: int):
    """Crowded stretches in parts of strings whose anchors lie ``_PART`` offsets apart at most.

    core: what all strings of a part share; whole: all of the part; each: one hash for each string.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, c, n, o, piece in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "n", "o", "piece"))):
                prefix = prefix_hash(np.frombuffer(piece, np.uint8))
                at = np.arange(n)
                strings = span_hash(prefix, at, at + length).view(np.int64)
                for part in range((o - n + 1) // _PART, o // _PART + 1):
                    first, last = max(0, o - part * _PART - _PART + 1), min(n - 1, o - part * _PART)
                    # Every string of the part holds the bytes that all its possible strings share.
                    core, whole = (int(span_hash(prefix, np.array([s]), np.array([e])).view(np.int64)[0]) for s, e in ((o - part * _PART, o - part * _PART - _PART + 1 + length), (first, last + length)))
                    out.append((a, part, core, whole, c, first, strings[first : last + 1].tolist(), o))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("a", "part", "core", "whole", "c", "first", "each", "o"), columns, kinds)})

    return work


def _crowded(pieces: DataFrame, length: int) -> DataFrame:
    """(a, c, s, e) of the covered bytes of crowded stretches."""
    parts = checkpointed(in_batches(pieces, _parts(length), "a long, part int, core long, whole long, c long, first int, each array<long>, o int"))
    size = F.size("each")
    keys = ["a", "part", "whole"]
    names = [F.first(x).alias(x) for x in ("core", "each", "c", "o", "first")]
    wholes = parts.groupBy(*keys, size.alias("size")).agg(F.count("*").alias("n"), *names)
    twice = wholes.where("n > 1").select(*keys, "size")
    equal = parts.withColumn("size", size).join(twice, [*keys, "size"]).select("a", "c", F.col("first").cast("long").alias("s"), (F.col("first") + F.col("size") - 1 + length).cast("long").alias("e"))
    # Of the different wholes, only those that share a core can share a string; those found twice are covered already.
    mixed = wholes.groupBy("a", "part", "core").agg(F.count("*").alias("k"), F.min("n").alias("n")).where("k > 1 and n = 1").select("a", "part", "core")
    strings = wholes.join(mixed, ["a", "part", "core"], "left_semi").select("a", "c", "n", (F.col("o") - F.col("first")).alias("far"), "first", F.posexplode("each").alias("k", "string"))
    strings = checkpointed(strings.select("a", "c", "n", (F.col("far") - F.col("k")).alias("offset"), "string", (F.col("first") + F.col("k")).cast("long").alias("s")))
    again = strings.groupBy("a", "offset", "string").agg(F.count("*").alias("found")).where("found > 1").select("a", "offset", "string")
    some = strings.where("n = 1").join(again, ["a", "offset", "string"]).select("a", "c", "s", (F.col("s") + length).alias("e"))
    return equal.union(some)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, count, digest, kept = [], [], [], [], []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            at, left = 0, []
            for s, e in merged:
                left.append(text[at:s])
                at = e
            left.append(text[at:])
            size.append(len(text))
            gone.append(sum(e - s for s, e in merged))
            count.append(len(merged))
            digest.append(hashlib.sha256(b"".join(left)).hexdigest())
            kept.append([{"s": s, "e": e} for s, e in merged])
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()), "removed": pa.array(kept, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
        })


def repeated_spans(documents: DataFrame, length: int = 400, crowd: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row; removed lists the byte spans."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = in_batches(rows, _emit(length), f"doc_id {kind}, h long, start long, n int, o int, a long, c long")

    first = [F.first(x).alias(x) for x in ("doc_id", "h", "start", "n", "o")]
    each = found.groupBy("a", "c").agg(F.count("*").alias("times"), *first)
    anchors = found.groupBy("a").agg(F.count("*").alias("all")).where("all > 1").select("a")
    each = checkpointed(each.join(anchors, "a"))
    kinds = each.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = each.join(kinds.select("a", (F.col("kinds") > crowd).alias("crowded")), "a")
    entry = F.struct("a", "c", "n", "o", "crowded", "start", (F.col("n") - 1 + length).alias("size"))
    by_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(entry).alias("wanted"))

    def with_texts(side: DataFrame, how: str) -> DataFrame:
        side = side.withColumnsRenamed({"doc_id": "_id", "h": "_h"}).hint("shuffle_hash")
        return rows.join(side, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["h"] == F.col("_h")), how)

    # Rows that repeat an id and text would give a stretch twice.
    pieces = with_texts(by_doc, "inner").select("text", "wanted").mapInArrow(_cut, "a long, c long, n int, o int, crowded boolean, piece binary")
    pieces = checkpointed(pieces.groupBy("a", "c").agg(*[F.first(x).alias(x) for x in ("n", "o", "crowded", "piece")]))
    lone = pieces.where("not crowded").select("a", "c", "o", "piece").repartition("a")
    covered = in_batches(lone, _index(length), "a long, c long, s long, e long")
    if not kinds.where(F.col("kinds") > crowd).isEmpty():
        covered = covered.union(_crowded(pieces.where("crowded"), length))
    whole = each.where("times > 1").select("a", "c", F.lit(0).cast("long").alias("s"), (F.col("n") - 1 + length).cast("long").alias("e"))
    covered = checkpointed(covered.union(whole).groupBy("a", "c").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    spans = found.select("a", "c", "doc_id", "h", "start").join(covered, ["a", "c"])
    spans = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct((F.col("s") + F.col("start")).alias("s"), (F.col("e") + F.col("start")).alias("e"))).alias("spans"))
    return with_texts(spans, "left").select("doc_id", "text", "spans").mapInArrow(
        _apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:long,e:long>>"
    )
