"""Vector code compression: product codes learnt by k-means with Drake-Hamerly adaptive bounds.

Components become integers (256 times the value, rounded down), so distances,
sums and codebooks are exact.  A vector is cut into equal parts, each position
with a codebook of its own; the first codebook is that part of the vectors of
least id.  A round assigns every part to its nearest entry (ties: the lower
index) and moves each entry to the mean of its parts, rounded down.

Between rounds every part keeps its b closest entries, ordered, each with a
lower bound of its distance, and one outer bound that holds for all others:
whole numbers of 1/16, rounded down, that shrink by how far an entry (outside:
any entry) has moved, rounded up.  In the next round the distance to the part's
own entry is computed anew; entries whose bounds lie beyond it can't be nearest
and are not looked at.  Where bounds leave a choice, the integer distances to
just the entries in reach decide, and to all entries where the outer bound is in
reach; then the part's list is ordered anew.  b follows the data: after a round
it is the least that would have settled ``_SETTLED`` of the parts without all
entries, between an eighth and a quarter of the entries.  b and the bounds only
save work; codes and codebooks are those of plain k-means.

On Spark: the vectors with their lists and bounds are written once a round, as
they lie, and never shuffled; a round's sums are taken in each task and merged
by part and entry, so parts * entries rows reach the driver (their number is
fixed by the parameters), and the next round is sent out with the codebooks.

Rows whose vector is null or holds null or non-finite components are dropped,
and those whose vector isn't as long as that of the least id that is left.  Null
ids come last in the order of ids; rows of one id are ordered by their vectors.
With fewer vectors than entries there are as many entries as vectors.  Repeated
rows count each time; an empty table gives no rows.  Null labels are one label.
A length that the parts don't divide, or components of 2**18 and more in size
(beyond them the sums may not be exact), raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import checkpointed, in_batches

SCALE = 256
_LARGEST = SCALE << 18
_UNIT = 16
_SETTLED = 0.98
_FEW_LABELS = 200_000
_FAR = np.int64(1) << 40


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to all entries, exact; by products of doubles where these are exact."""
    if x.size and book.size and 4 * x.shape[1] * max(np.abs(x).max(), np.abs(book).max()) ** 2 < 1 << 52:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] - book[:, k]
        out += d * d
    return out


def _floor_root(square: np.ndarray) -> np.ndarray:
    """``_UNIT`` times the root of a whole number, rounded down (never above it)."""
    root = np.floor(_UNIT * np.sqrt(square.astype(np.float64))).astype(np.int64)
    return np.where(root * root > _UNIT * _UNIT * square, root - 1, root)


class Bounds:
    """For each part of a batch: its own entry and the next closest ones, their lower bounds, the outer bound."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    @classmethod
    def of(cls, distance: np.ndarray, b: int) -> Bounds:
        """From all distances; ``near[:, 0]`` is the nearest entry, the lower index of equals."""
        k = distance.shape[1]
        order = np.argsort(distance * k + np.arange(k), axis=1)  # of equals the lower index
        low = _floor_root(np.take_along_axis(distance, order, 1))
        outer = low[:, b + 1] if b + 1 < k else np.full(len(low), _FAR)
        return cls(order[:, : b + 1].astype(np.uint8), low[:, : b + 1], outer)

    def moved(self, step: np.ndarray) -> None:
        """Entries moved by at most ``step`` (in units, rounded up)."""
        self.low = np.maximum(self.low - step[self.near], 0)
        self.outer = np.maximum(self.outer - step.max(initial=0), 0)

    def assign(self, x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entries, squared distances, how many of its list each part needed; all of it and one more for all entries)."""
        own = book[self.near[:, 0]]
        square = ((x - own) ** 2).sum(1)
        reach = _floor_root(square) + 1
        # An entry whose bound lies at or beyond ``reach`` is farther than the part's own.
        open_ = self.low[:, 1:] < reach[:, None]
        width = open_.shape[1]
        depth = np.where(open_.any(1), width - np.argmax(open_[:, ::-1], axis=1), 0) if width else np.zeros(len(x), np.int64)
        whole = self.outer < reach
        depth[whole] = width + 1
        nearest = self.near[:, 0].astype(np.int64)
        some = np.flatnonzero((depth > 0) & ~whole)
        if len(some):
            at, slot = np.nonzero(open_[some])
            row, entry = some[at], self.near[some[at], slot + 1].astype(np.int64)
            found = ((x[row] - book[entry]) ** 2).sum(1)
            self.low[row, slot + 1] = _floor_root(found)
            # The least (distance, index) of the part's own entry and those in reach.
            both = np.concatenate([square[some] * 256 + nearest[some], found * 256 + entry])
            who = np.concatenate([np.arange(len(some)), at])
            order = np.lexsort((both, who))
            best = both[order][np.diff(who[order], prepend=-1) != 0]
            self.low[some, 0] = _floor_root(square[some])
            nearest[some], square[some] = best % 256, best // 256
            self._front(some, nearest[some])
        settled = np.flatnonzero(~whole & (depth == 0))
        self.low[settled, 0] = reach[settled] - 1
        if whole.any():
            all_ = np.flatnonzero(whole)
            distance = _distances(x[all_], book)
            new = Bounds.of(distance, self.near.shape[1] - 1)
            self.near[all_], self.low[all_], self.outer[all_] = new.near, new.low, new.outer
            nearest[all_] = new.near[:, 0]
            square[all_] = distance[np.arange(len(all_)), nearest[all_]]
        self._narrow(b)
        return nearest, square, depth

    def _front(self, rows: np.ndarray, nearest: np.ndarray) -> None:
        """Puts these rows' nearest entries first and the rest in the order of their bounds."""
        near, low = self.near[rows], self.low[rows]
        order = np.lexsort((low, near != nearest[:, None]), axis=1)
        self.near[rows], self.low[rows] = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)

    def _narrow(self, b: int) -> None:
        """Keeps b entries beside the own; those that go are covered by the outer bound."""
        if self.near.shape[1] > b + 1:
            order = np.concatenate([np.zeros((len(self.low), 1), np.int64), 1 + np.argsort(self.low[:, 1:], axis=1, kind="stable")], axis=1)
            near, low = np.take_along_axis(self.near, order, 1), np.take_along_axis(self.low, order, 1)
            self.outer = np.minimum(self.outer, low[:, b + 1 :].min(axis=1))
            self.near, self.low = near[:, : b + 1], low[:, : b + 1]


# -- rows of integers


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v array<long>) of the vectors that count."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda e: F.floor(e * float(SCALE))).alias("v"),
    )


def _matrix(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """A batch's binary column as one array; copied, so that it can be changed."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).copy()


def _vectors(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """A batch's vectors; each row holds them in two bytes a component, or in four."""
    rows = column.to_pylist()
    out = np.empty((len(rows), parts * width), np.int64)
    for kind in (np.int16, np.int32):
        own = [k for k, x in enumerate(rows) if len(x) == parts * width * kind().itemsize]
        if own:
            out[own] = np.frombuffer(b"".join(rows[k] for k in own), kind).reshape(len(own), -1)
    return out.reshape(len(rows), parts, width)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


_SUMS = "part int, entry int, n long, s array<long>"


def _first(rows: DataFrame, books: np.ndarray, b: int, kinds: str) -> DataFrame:
    """Lists and bounds of all rows from all distances."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column("v").values.to_numpy(), np.int64).reshape(batch.num_rows, parts, width)
            if v.size and np.abs(v).max() >= _LARGEST:
                raise ValueError("components of 2**18 and more are beyond what the sums hold exactly")
            bounds = [Bounds.of(_distances(v[:, p], books[p]), b) for p in range(parts)]
            yield _state(batch, v, bounds, np.zeros((batch.num_rows, parts), np.uint8))

    return in_batches(rows, work, f"{kinds}, v binary, near binary, low binary, outer binary, depth binary")


def _state(batch: pa.RecordBatch, v: np.ndarray, bounds: list[Bounds], depth: np.ndarray) -> pa.RecordBatch:
    clip = lambda x: np.minimum(x, np.iinfo(np.uint16).max).astype(np.uint16)  # noqa: E731  (less is still a lower bound)
    short = np.int16 if v.size == 0 or np.abs(v).max() < 1 << 15 else np.int32
    return pa.RecordBatch.from_pydict({
        "vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": _packed(v.astype(short)),
        "near": _packed(np.stack([x.near for x in bounds], 1)), "low": _packed(clip(np.stack([x.low for x in bounds], 1))),
        "outer": _packed(clip(np.stack([x.outer for x in bounds], 1))), "depth": _packed(depth.astype(np.uint8)),
    })


def _held(batch: pa.RecordBatch, parts: int, width: int, b: int) -> tuple[np.ndarray, list[Bounds]]:
    v = _vectors(batch.column("v"), parts, width)
    near, low = (_matrix(batch.column(c), kind, (parts, b + 1)) for c, kind in (("near", np.uint8), ("low", np.uint16)))
    outer = _matrix(batch.column("outer"), np.uint16, (parts,)).astype(np.int64)
    return v, [Bounds(near[:, p].copy(), low[:, p].astype(np.int64), outer[:, p].copy()) for p in range(parts)]


def _again(rows: DataFrame, books: np.ndarray, steps: np.ndarray, had: int, b: int, kinds: str) -> DataFrame:
    """Lists and bounds of all rows after the entries moved."""
    parts, _, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, bounds = _held(batch, parts, width, had)
            depth = np.zeros((len(v), parts), np.int64)
            for p, own in enumerate(bounds):
                own.moved(steps[p])
                depth[:, p] = own.assign(v[:, p], books[p], b)[2]
            yield _state(batch, v, bounds, depth)

    return in_batches(rows, work, f"{kinds}, v binary, near binary, low binary, outer binary, depth binary")


def _sums(state: DataFrame, books: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, component sums, parts by depth) of the state's codes; parts * (entries + 1) rows come to the driver."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        depths, any_ = np.zeros(256, np.int64), False
        for batch in batches:
            any_ = any_ or batch.num_rows > 0
            code = _matrix(batch.column("near"), np.uint8, (parts, b + 1))[:, :, 0]
            v = _vectors(batch.column("v"), parts, width)
            depths += np.bincount(_matrix(batch.column("depth"), np.uint8, (parts,)).ravel(), minlength=256)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(s[p], code[:, p], v[:, p])
        if any_:
            part, entry = np.indices((parts, entries)).reshape(2, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(parts * entries + 1) * width, pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(n.ravel()), "s": lists})
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "entry": pa.array([0], pa.int32()), "n": pa.array([0]), "s": pa.array([depths.tolist()], pa.list_(pa.int64()))})

    cells = in_batches(state, work, _SUMS).select("part", "entry", "n", F.posexplode("s").alias("k", "x"))
    rows = cells.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    part, entry, k, count, x = (rows.column(c).to_numpy() for c in ("part", "entry", "k", "n", "x"))
    n, s, depths = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), np.zeros(256, np.int64)
    real = part >= 0
    n[part[real], entry[real]] = count[real]
    s[part[real], entry[real], k[real]] = x[real]
    depths[k[~real]] = x[~real]
    return n, s, depths


def adapted(depths: np.ndarray, b: int, entries: int) -> int:
    """The b that the depths of a round ask for: an eighth to a quarter of the entries."""
    least, most = max(1, entries // 8), max(1, entries // 4)
    total = depths.sum()
    if total == 0:
        return b
    need = int(np.searchsorted(np.cumsum(depths), _SETTLED * total))
    return min(max(need, least), most, b)


def learn(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", width_b: int | None = None
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, v, near, ...) after the last assignment, the codebooks: parts x entries x components)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = _integers(vectors, id_col, vector_col, label_col)
    in_order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.orderBy(*in_order).limit(1).select(F.size("v").alias("n")).first()
    size = first["n"] if first else parts
    if size == 0 or size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == size)
    start = np.array([r["v"] for r in rows.orderBy(*in_order).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    found = books.shape[1]
    had = b = min(width_b or max(1, entries // 4), max(found - 1, 0), 254)
    state = checkpointed(_first(rows, books, b, kinds))
    for _ in range(rounds):
        n, s, depths = _sums(state, books, had)
        new = np.where(n[:, :, None] > 0, s // np.maximum(n, 1)[:, :, None], books)  # whole numbers divide down
        b = adapted(depths, had, entries) if width_b is None else had
        square = ((new - books) ** 2).sum(2)
        steps = _floor_root(square) + (square > 0)
        books = new
        state = checkpointed(_again(state, books, steps, had, b, kinds))
        had = b
    return state, books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code binary: an index for each part, error long: the squared distance) for each row, the codebooks)."""
    state, books = learn(vectors, parts, entries, rounds, id_col, vector_col, label_col)
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("v"), parts, width)
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(len(v), parts, -1)
            code = near[:, :, 0] if len(v) else np.zeros((0, parts), np.uint8)
            error = ((v - books[np.arange(parts), code]) ** 2).sum((1, 2)) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": _packed(code), "error": pa.array(error)})

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return in_batches(state, work, f"{kinds}, code binary, error long"), books


def with_label_error(codes: DataFrame, salts: int = 32) -> DataFrame:
    """Adds label_error, the sum of errors over equal labels (nulls together).

    Few labels (counted first) are broadcast.  More are joined, each under ``salts`` keys, so that a frequent label is no one task's.
    """
    sums = checkpointed(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    names = sums.select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= _FEW_LABELS:
        return codes.join(F.broadcast(names), same).drop("_label")
    names = names.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    return salted.join(names, same & (F.col("_salt") == F.col("_s"))).drop("_label", "_s", "_salt")
