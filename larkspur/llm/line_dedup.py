"""Line dedup by a segment-partition edit join.

Every line with a word takes part.  Equal lines form a class; so do different
lines of at least ``min_chars`` code points whose edit distance, over code
points, is at most ``edits``, and whatever chains of such links hold together.
Shorter lines have a threshold of 0: two edits would make another line of them.
Of a class the line that stands first stays (order: id, a hash of the text,
place in the text); all its other places are removed.

A line is split into edits + 1 even segments; a line within the distance holds
one of them whole, at a place and for a length that the distance allows, so each
line probes the index with just those substrings.  Candidates are verified with
banded bit-parallel edit distance.

* Under a key with up to ``crowd`` lines all candidate pairs are made.
* Under a key with more, the lines are paired with a few centres first.  Then
  only those that still lie in different classes, and whose letter counts allow
  a link, are paired; so a group of near copies costs a few pairs a line.
* A key with more than ``group`` lines isn't held in one task: its lines go on to
  the next level, where edits + 2 segments mean that two must match and keys are
  pairs of segments, and so on.  The last level deals such keys out in blocks.

No link between classes is lost on any way.  Lines are told apart by 128-bit
hashes, and candidates by their texts.

Null texts have no lines.  Rows that repeat an id and text are treated alike (as
one document).  Ids may be null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._graph import connected_components
from larkspur.llm._spark import bit_filter, checkpointed, filter_bits, in_batches
from larkspur.llm._words import as_bytes

_hash = xxhash.xxh3_64_intdigest
#: A line that a crowded key passes on, the mark of such a key, and the two roles of a line under a key.
_MOVED, _CROWD, _INDEX, _PROBE = -2, -1, 0, 1
#: What a task finds: a pair of lines, a line under a key whose lines aren't all paired yet, a line for the next level.
_PAIR, _WAITS, _NEXT = 0, 1, 2
_LAST_LEVEL = 6
_CENTRES = 4
_BLANK = b" \t\v\f\r"


def _units(line: bytes) -> bytes | str:
    """The line as a sequence of code points: bytes do for ASCII, and hash alike."""
    return line if line.isascii() else line.decode()


def within(one: bytes | str, two: bytes | str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    Columns of the distance table are kept as bit vectors of vertical steps,
    over the 2 * edits + 1 rows around the diagonal only.
    """
    if len(one) > len(two):
        one, two = two, one
    if len(two) - len(one) > edits:
        return False
    first = last = 0
    while first + 32 <= len(one) and one[first : first + 32] == two[first : first + 32]:
        first += 32
    while first < len(one) and one[first] == two[first]:
        first += 1
    while last + 32 <= len(one) - first and one[-32 - last : len(one) - last] == two[-32 - last : len(two) - last]:
        last += 32
    while last < len(one) - first and one[-1 - last] == two[-1 - last]:
        last += 1
    one, two = one[first : len(one) - last], two[first : len(two) - last]
    if len(two) <= edits:
        return True
    width = 2 * edits + 1
    full = (1 << width) - 1
    # Bit k of a column j stands for row j - edits + k (rows and columns count from 1); rows up to 0 step by -1.
    up, down = full << edits + 1 & full, (1 << edits + 1) - 1
    distance = edits  # at the band's last row
    for j in range(1, len(two) + 1):
        match = 0
        for k in range(width):
            row = j - edits + k
            if 1 <= row <= len(one) and one[row - 1] == two[j - 1]:
                match |= 1 << k
        # The band moved down one row: the vectors of the column before, in this column's rows.
        up_, down_ = up >> 1 | 1 << width - 1, down >> 1
        diagonal = ((match & up_) + up_ ^ up_ | match | down_) & full
        right_up = (down_ | ~(diagonal | up_)) & full
        right_down = diagonal & up_
        up = (right_down << 1 | ~(diagonal | (right_up << 1 | 1))) & full
        down = diagonal & (right_up << 1 | 1) & full
        distance += not diagonal >> width - 1 & 1
    # Down the last column from the band's last row to the last row of ``one``.
    for row in range(len(two) + edits, len(one), -1):
        k = row - (len(two) - edits)
        distance -= (up >> k & 1) - (down >> k & 1)
    return distance <= edits


@cache
def _segments(size: int, parts: int) -> tuple[tuple[int, int], ...]:
    """Start and end of even segments, longer ones last."""
    short, more = divmod(size, parts)
    sizes = [short] * (parts - more) + [short + 1] * more
    ends = np.cumsum(sizes).tolist()
    return tuple((e - s, e) for s, e in zip(sizes, ends))


@cache
def _probes(size: int, edits: int, level: int) -> tuple[tuple[int, int, tuple[tuple[int, int], ...]], ...]:
    """(role, number that stands for length and segments, substrings) of all keys of a line of ``size`` code points."""
    parts, out = edits + level, []
    for less in range(edits + 1):
        short = size - less
        if short < parts:
            continue
        cuts = _segments(short, parts)
        for chosen in combinations(range(parts), level):
            number = short << 16 | sum(1 << k for k in chosen)

            # Edits lie in segments that aren't chosen (what is put in between two belongs to one that isn't):
            # a shift arises only where there is such a segment, and the last one leads to the line's end.
            def shifts(k: int, done: tuple[int, ...], spent: int):
                at = done[-1] if done else 0
                if k == level:
                    if spent + abs(less - at) <= edits and (less == at or chosen[-1] < parts - 1):
                        yield done
                    return
                free = chosen[k] > (chosen[k - 1] + 1 if k else 0)
                for s in range(at - edits + spent, at + edits - spent + 1) if free else (at,):
                    yield from shifts(k + 1, (*done, s), spent + abs(s - at))

            for shift in shifts(0, (), 0):
                if level == 1 and (abs(shift[0]) > chosen[0] or abs(less - shift[0]) > edits - chosen[0]):
                    continue
                spots = tuple((cuts[k][0] + s, cuts[k][1] + s) for k, s in zip(chosen, shift))
                if all(0 <= s and e <= size for s, e in spots):
                    out.append((_PROBE if less or any(shift) else _INDEX, number, spots))
    return tuple(out)


_NIBBLE = np.array([pow(0x9E3779B1, b + 1, 1 << 32) >> 28 for b in range(256)], np.uint8)


def _tally(line: bytes | str) -> int:
    """Code points of 16 classes, counted modulo 16."""
    points = np.frombuffer(line, np.uint8) if isinstance(line, bytes) else np.frombuffer(line.encode("utf-32-le"), np.uint32) & 255
    counts = np.bincount(_NIBBLE[points], minlength=16) & 15
    return int((counts.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)).sum())


def _tally_apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """What the counts differ by, in all; an edit changes it by two at most."""
    out = np.zeros(len(one), np.int64)
    for k in range(0, 64, 4):
        d = ((one >> np.uint64(k)) - (two >> np.uint64(k)) & np.uint64(15)).astype(np.int64)
        out += np.minimum(d, 16 - d)
    return out


def _named(line: bytes) -> bytes:
    """128 bits that stand for a line; the first eight bytes are its short number."""
    return xxhash.xxh3_128_digest(line)


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, place, line = [], [], []
        for r, text in enumerate(as_bytes(batch.column("text"))):
            for k, x in enumerate(text.split(b"\n")):
                if x.strip(_BLANK):
                    row.append(r)
                    place.append(k)
                    line.append(_named(x))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(at), "h": batch.column("h").take(at), "place": pa.array(place, pa.int64()), "line": pa.array(line, pa.binary()),
        })


def _long_lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """(name, bytes) of the lines of ``least`` code points or more of each batch of texts, most of them once a task."""
    done: set[bytes] = set()
    for batch in batches:
        out = []
        for text in as_bytes(batch.column("text")):
            for x in text.split(b"\n"):
                if len(x) >= least and (x.isascii() or len(x.decode()) >= least) and x.strip(_BLANK):
                    name = _named(x)
                    if name not in done:
                        done.add(name)
                        out.append((name, x))
        if len(done) > 200_000:  # whatever comes twice is merged later
            done.clear()
        yield out


def _entries(least: int, edits: int, level: int, group: int):
    """(key, line, role), from texts at level 1 and from different lines beyond it; lines by their short numbers.

    A key that has more than ``group`` lines in one batch sends one mark, and its lines move on.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _long_lines(batches, least) if level == 1 else (list(zip(b.column("line").to_pylist(), b.column("words").to_pylist())) for b in batches)
        for found in read:
            for at in range(0, len(found), 20_000):
                yield _keyed(found[at : at + 20_000], edits, level, group)

    return work


def _keyed(found: list[tuple[bytes, bytes]], edits: int, level: int, group: int) -> pa.RecordBatch:
    keys: list[int] = []
    each, kinds = [], []
    for _, x in found:
        x = _units(x)
        probes = _probes(len(x), edits, level)
        if level == 1:
            keys += [_hash(x[s:e], number) for _, number, ((s, e),) in probes]
        else:
            gap = "\0" if isinstance(x, str) else b"\0"
            keys += [_hash(gap.join([x[s:e] for s, e in spots]), number) for _, number, spots in probes]
        each.append(len(probes))
        kinds += [role for role, _, _ in probes]
    key, role = np.array(keys, np.uint64).view(np.int64), np.array(kinds, np.int8)
    line = np.repeat(np.array([_short(n) for n, _ in found], np.int64), each)
    if len(key) > group:
        order = np.argsort(key)
        key, line, role = key[order], line[order], role[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(edge, len(key)))
        if (size > group).any():
            over = np.repeat(size > group, size)
            moved, marks = np.unique(line[over]), key[edge[size > group]]
            key, line = np.concatenate([key[~over], marks, moved]), np.concatenate([line[~over], np.zeros(len(marks), np.int64), moved])
            role = np.concatenate([role[~over], np.full(len(marks), _CROWD, np.int8), np.full(len(moved), _MOVED, np.int8)])
    return pa.RecordBatch.from_pydict({"key": pa.array(key), "line": pa.array(line), "role": pa.array(role)})


def _whole_keys(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Rows of whole keys, from batches sorted by key; rows of a key of more than ``limit`` come in pieces, marked True.

    Only the rows of the key that is still open are kept from batch to batch.
    """
    held, over = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if over is not None:
            n = int(np.searchsorted(rows["key"], over, "right"))
            if n:
                yield {c: x[:n] for c, x in rows.items()}, True
                rows = {c: x[n:] for c, x in rows.items()}
            if not len(rows["key"]):
                continue
            over = None
        if held is not None:
            rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
        cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
        if cut:
            yield {c: x[:cut] for c, x in rows.items()}, False
        held = {c: x[cut:].copy() for c, x in rows.items()}
        if len(held["key"]) > limit:
            over = held["key"][-1]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each run of equal keys."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(key)))


def _found(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind, np.int8)), "key": pa.array(key), "a": pa.array(a), "b": pa.array(b)})


def _pairs(crowd: int, group: int, blocks: bool):
    """(kind, key, a, b) from entries sorted by key: pairs, lines that wait under their key (b is the role), lines for the next level.

    With ``blocks``, entries of a key that is dealt out have a side: pairs are of different sides, or of side 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 1 << 30 if blocks else group  # blocks are of bounded size
        for rows, over in _whole_keys(batches, limit):
            key, line, role = rows["key"], rows["line"], rows["role"]
            moved = role == _MOVED
            if over or moved.any():
                gone = np.unique(line[moved | (role >= _INDEX)] if over else line[moved])
                yield _found(_NEXT, gone, gone, gone)
                if over:
                    continue
            order = np.lexsort((role, line, key))
            key, line, role = key[order], line[order], role[order]
            again = np.concatenate(([False], (key[1:] == key[:-1]) & (line[1:] == line[:-1]))) if len(key) else np.zeros(0, bool)
            keep = ~again & (role != _MOVED)
            key, line, role = key[keep], line[keep], role[keep]
            side = rows["side"][order][keep] if blocks else None
            edge, size = _edges(key)
            marked = np.zeros(len(edge), bool)
            marked[np.searchsorted(edge, np.flatnonzero(role == _CROWD), "right") - 1] = True
            left, right = [], []
            for n in range(2, crowd + 1):
                first = edge[(size == n) & ~marked][:, None]
                x, y = np.triu_indices(n, 1)
                left.append((first + x).ravel())
                right.append((first + y).ravel())
            for s, n, mark in zip(*(x[(size > crowd) | marked].tolist() for x in (edge, size, marked))):
                own = np.arange(s, s + n)
                own = own[role[own] != _CROWD]
                if mark or n > limit:
                    yield _found(_NEXT, line[own], line[own], line[own])
                    continue
                centres = own[role[own] == _INDEX]
                if not len(centres):
                    continue
                centres = np.unique(centres[np.linspace(0, len(centres) - 1, _CENTRES).astype(np.int64)])
                left.append(np.repeat(centres, len(own)))
                right.append(np.tile(own, len(centres)))
                yield _found(_WAITS, key[own], line[own], role[own].astype(np.int64) | (side[own].astype(np.int64) << 8 if blocks else 0))
            x, y = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (left, right))
            good = ((role[x] == _INDEX) | (role[y] == _INDEX)) & (line[x] != line[y])
            if blocks:
                good &= (side[x] != side[y]) | (side[x] == 0)
            a, b = line[x[good]], line[y[good]]
            for k in range(0, len(a), 100_000):
                yield _found(_PAIR, a[k : k + 100_000], np.minimum(a, b)[k : k + 100_000], np.maximum(a, b)[k : k + 100_000])

    return work


def _apart(edits: int, group: int):
    """Pairs (a, b) of lines under the keys whose lines wait: of different classes, and such that lengths and letter counts allow a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _whole_keys(batches, 1 << 30):
            for s, n in zip(*(x.tolist() for x in _edges(rows["key"]))):
                own = {c: x[s : s + n] for c, x in rows.items()}
                root, tally, size, role, side, line = (own[c] for c in ("root", "tally", "size", "role", "side", "id"))
                if (root == root[0]).all():
                    continue
                tally = tally.view(np.uint64)
                for at in range(0, n, 256):
                    x, y = np.meshgrid(np.arange(at, min(n, at + 256)), np.arange(at, n), indexing="ij")
                    x, y = x.ravel(), y.ravel()
                    good = (x < y) & (root[x] != root[y]) & ((role[x] == _INDEX) | (role[y] == _INDEX)) & (np.abs(size[x] - size[y]) <= edits) & ((side[x] != side[y]) | (side[x] == 0))
                    x, y = x[good], y[good]
                    good = _tally_apart(tally[x], tally[y]) <= 2 * edits
                    x, y = x[good], y[good]
                    if len(x):
                        yield pa.RecordBatch.from_pydict({"a": pa.array(line[x]), "b": pa.array(line[y])})

    return work


def _texts(least: int, wanted, bits: int):
    """(short, line, words, tally, size) of the lines that the bitmap lets through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, mask = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").view(bool), (1 << bits) - 1
        for found in _long_lines(batches, least):
            found = [x for x in found if ask[_short(x[0]) & mask]]
            units = [_units(x) for _, x in found]
            yield pa.RecordBatch.from_pydict({
                "short": pa.array([_short(n) for n, _ in found], pa.int64()), "line": pa.array([n for n, _ in found], pa.binary()), "words": pa.array([x for _, x in found], pa.binary()),
                "tally": pa.array(np.array([_tally(x) for x in units], np.uint64).view(np.int64)), "size": pa.array([len(x) for x in units], pa.int64()),
            })

    return work


def _verify(edits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(x, y, edits) if x.isascii() and y.isascii() else within(x.decode(), y.decode(), edits) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(at), "b": batch.column("b").take(at)})

    return work


def _dealt(entries: DataFrame, group: int) -> DataFrame:
    """Entries of the last level with a side: keys of more than ``group`` lines are dealt out to pairs of blocks of that size."""
    counted = entries.where(F.col("role") >= _INDEX).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group)
    m = F.ceil(F.col("n") / group).cast("long")
    own = F.pmod(F.xxhash64("line"), F.col("m"))
    big = entries.join(counted.select("key", m.alias("m")), "key").withColumn("s", own).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    side = F.when(F.col("s") == F.col("t"), 0).when(F.col("s") < F.col("t"), 1).otherwise(2)
    big = big.select(F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "line", "role", side.cast("byte").alias("side"))
    rest = entries.join(counted.select("key"), "key", "left_anti").select("key", "line", "role", F.lit(0).cast("byte").alias("side"))
    return rest.union(big)


def line_links(rows: DataFrame, least: int, edits: int, crowd: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(links, lines): links (a, b) between different lines that hold each class together, and the lines (id, line, ...) that they name.

    Documents are read for the first level, and once for the texts of lines that
    it found in a pair or under a crowded key; further levels read those only.
    """
    spark = rows.sparkSession
    texts, lines, links = rows.select("text"), None, None

    def verified(pairs: DataFrame, by: str) -> DataFrame:
        side = lambda c, own, text: lines.select(F.col(by).alias(c), F.col("id").alias(own), F.col("words").alias(text))
        both = pairs.join(side("a", "ia", "x"), "a").join(side("b", "ib", "y"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "x", "y")
        good = in_batches(both, _verify(edits), "a long, b long")
        return checkpointed(good if links is None else links.union(good))

    for level in range(1, _LAST_LEVEL + 1):
        last = level == _LAST_LEVEL
        source = texts if level == 1 else lines.join(moved, "short", "left_semi").select("line", "words")
        entries = in_batches(source, _entries(least, edits, level, 1 << 62 if last else group), "key long, line long, role byte")
        if last:
            entries = _dealt(checkpointed(entries), group)
        entries = entries.repartition("key").sortWithinPartitions("key")
        found = checkpointed(in_batches(entries, _pairs(crowd, group, last), "kind byte, key long, a long, b long"))
        pairs = found.where(F.col("kind") == _PAIR).select("a", "b").distinct()
        waiting = found.where(F.col("kind") == _WAITS).select("key", F.col("a").alias("short"), F.col("b").bitwiseAND(255).cast("byte").alias("role"), F.shiftright("b", 8).cast("byte").alias("side"))
        moved = found.where(F.col("kind") == _NEXT).select(F.col("a").alias("short")).distinct()
        if lines is None:
            asked = pairs.select("a").union(pairs.select("b")).union(waiting.select("short")).union(moved).toDF("short")
            asked = checkpointed(asked.distinct())
            bits = filter_bits(asked.count())
            shared = spark.sparkContext.broadcast(bit_filter(asked, "short", bits))
            made = in_batches(texts, _texts(least, shared, bits), "short long, line binary, words binary, tally long, size long")
            # Two lines of one short number both come along; ids are unique, and fixed by the checkpoint.
            made = made.join(asked, "short", "left_semi").groupBy("short", "line").agg(*[F.first(c).alias(c) for c in ("words", "tally", "size")])
            lines = checkpointed(made.withColumn("id", F.monotonically_increasing_id()))
        links = verified(pairs, "short")
        if not waiting.isEmpty():
            roots = connected_components(links)
            links = roots.where("node <> root").toDF("a", "b")
            known = lines.join(roots, lines["id"] == roots["node"], "left").select("short", "id", "tally", "size", F.coalesce("root", "id").alias("root"))
            waits = waiting.join(known, "short").select("key", "role", "side", "id", "root", "tally", "size").repartition("key").sortWithinPartitions("key")
            links = verified(checkpointed(in_batches(waits, _apart(edits, group), "a long, b long").distinct()), "id")
        if last or moved.isEmpty():
            break
    return links, lines


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n = [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            lines = text.split("\n") if text else []
            if gone:
                out = set(gone)
                kept.append("\n".join([x for k, x in enumerate(lines) if k not in out]))
            else:
                kept.append(text)
            n.append(len(lines))
        names = [c for c in batch.schema.names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {"kept": pa.array(kept, pa.string()), "n_lines": pa.array(n, pa.int64())})


def dedup_lines(documents: DataFrame, min_chars: int = 40, edits: int = 2, crowd: int = 16, group: int = 2048, id_col: str = "doc_id", text_col: str = "text", classes: bool = False) -> DataFrame:
    """All columns of ``documents`` with kept (the text without removed lines), n_lines, n_removed and n_links added.

    n_links counts, for each line of the document, the other different lines of
    its class.  With ``classes``, there is also classes: (place, class_id) of each
    line of the document that repeats or links, in order; a class is named by the
    least 128-bit hash of its lines.  Columns of the added names are replaced.
    """
    if min_chars < edits + _LAST_LEVEL:
        raise ValueError("lines must be longer than the number of segments")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    places = checkpointed(in_batches(rows, _occurrences, f"doc_id {kind}, h long, place long, line binary"))
    where = F.struct("doc_id", "h", "place")
    links, known = line_links(rows, min_chars, edits, crowd, group)
    roots = connected_components(links).join(known.select(F.col("id").alias("node"), "line"), "node").select("line", "root")
    kinds = roots.groupBy("root").agg(F.min("line").alias("class_id"), (F.count("*") - 1).alias("n"))
    roots = roots.join(kinds, "root").select("line", "class_id", "n")
    lines = places.groupBy("line").agg(F.count("*").alias("times")).join(roots, "line", "left").where("times > 1 or class_id is not null")
    lines = checkpointed(lines.select("line", "times", F.coalesce("class_id", "line").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n")))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join_hot(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
        """Rows of keys with more than an eighth of a partition would fill one task; there are at most 8 * parts such keys, and these are broadcast."""
        hot = F.col("times") > left.count() // parts // 8 + 1
        common = F.broadcast(right.where(hot).drop("times"))
        return left.join(common, by, "left_anti").join(right.where(~hot).drop("times"), by).unionByName(left.join(common, by))

    placed = checkpointed(join_hot(places, lines, "line").drop("line"))
    first = placed.groupBy("class_id").agg(F.min(where).alias("kept_at"), F.count("*").alias("times"))
    marked = join_hot(placed, checkpointed(first), "class_id")
    marked = marked.select("doc_id", "h", F.when(F.col("kept_at") != where, F.col("place")).alias("gone"), "n", *([F.struct("place", F.hex("class_id").alias("class_id")).alias("own")] if classes else []))
    by_doc = marked.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("gone").alias("gone"), F.sum("n").alias("n_links"), *([F.array_sort(F.collect_set("own")).alias("classes")] if classes else []))
    rest = documents.drop("kept", "n_lines", "n_removed", "n_links", *(["classes"] if classes else []), "gone", "_id", "_h", "_n")
    full = rest.withColumn("_n", F.xxhash64(text)).join(by_doc.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_h")), "left")
    keep = [c for c in rest.columns if c != text_col]
    full = full.select(*keep, F.col(text_col).alias("text"), "gone", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), *([F.coalesce("classes", F.array()).alias("classes")] if classes else []))
    schema = full.drop("text", "gone")._jdf.schema().toDDL()
    return in_batches(full, _strip, f"{schema}, kept string, n_lines long")
