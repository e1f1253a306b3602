"""LM scoring: context-tree weighting over the bytes of token sequences.

A text's tokens are its words (runs of bytes that are no ASCII white space, A-Z
lower-cased) and one end.  They are coded as bytes: words joined by one blank,
then a line feed, which no word holds; so the bytes' probability is that of the
token sequence.  Every byte is eight binary decisions.  Each decision has its
own context tree, over the ``depth`` bytes before (zero before a text begins):
a node is a context of 0 to ``depth`` bytes with the decision's leading bits.

A node's zeros and ones n0, n1 in the training texts give its
Krichevsky-Trofimov estimate KT = (n1 + 1/2) / (n0 + n1 + 1) and block
probability Pe.  Bottom-up, Pw = Pe at ``depth`` and else (Pe + product of the
children's Pw) / 2.  A decision's probability mixes the estimates of all depths
on its path: a node takes the share Pe / (2 Pw) of what the nodes above it left,
and the deepest node that training reached takes the rest, so the probabilities
of both outcomes sum to one.  Without training texts all decisions cost a bit.

On Spark: texts go to Parquet as blocks of about ``_BLOCK`` bytes; each block
asks for the prices of its different (depth + 1)-grams and for the counts of its
different words.  Grams are dealt by their nearest three context bytes and
sorted, so a task works through them in runs that hold whole subtrees; sums at
two context bytes (2**16 contexts of 255 nodes at most, 16 bytes each; that
bound holds for any corpus) pass through the driver and come back as the upper
part of all paths.  Prices and counts join their blocks again, and only there
texts are held.  A frequent gram or word has one row a block, however often it
occurs.  A text is held whole by one task; nothing else grows with a text.

Null texts are empty (the end alone).  A null id is no reason to be held out.
Repeated rows count, and are scored, each time; an empty table gives no rows.
Extra columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import checkpointed, in_batches, removed, shared_folder
from larkspur.llm._words import as_bytes

DEPTH = 5
_BLOCK = 24 << 20
_RUN = 1 << 20
_PACK = 1 << 18
_ROWS = 1 << 16
_NEAR = 3
_LGAMMA = np.array([np.inf] + [lgamma(k / 2) for k in range(1, 4001)])


def _log_gamma(twice: np.ndarray) -> np.ndarray:
    """The log of gamma at ``twice / 2``, for whole numbers."""
    z = np.maximum(twice, 4000) / 2
    far = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return np.where(twice <= 4000, _LGAMMA[np.minimum(twice, 4000)], far)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in a given order."""
    n0, n1 = np.asarray(n0, np.int64), np.asarray(n1, np.int64)
    return _log_gamma(2 * n0 + 1) + _log_gamma(2 * n1 + 1) - np.log(np.pi) - _log_gamma(2 * (n0 + n1) + 2)


def weighted(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log Pw, the node's own share of it), from the children's summed log Pw."""
    own = log_kt(n0, n1)
    both = np.logaddexp(own, children) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


# A path carries three numbers down: the probability of a one that the nodes so far gave (given), the weight
# that is left (left), and the probability of a one if the path ended here (closed).


def _descend(given: np.ndarray, left: np.ndarray, closed: np.ndarray, n0: np.ndarray, n1: np.ndarray, share: np.ndarray):
    seen, kt = n0 + n1 > 0, (n1 + 0.5) / (n0 + n1 + 1)
    return (
        np.where(seen, given + left * share * kt, closed), np.where(seen, left * (1 - share), 0.0), np.where(seen, given + left * kt, closed),
    )


# -- blocks of texts


def _to_blocks(documents: DataFrame, id_col: str, held_out: Column) -> DataFrame:
    """A row for about ``_BLOCK`` bytes of token sequences, compressed, with their ids, sizes and sides."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size, block = [], [], [], 0, TaskContext.get().partitionId() << 32

        def flushed() -> pa.RecordBatch:
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            sizes = pa.array([len(x) for x in texts], pa.int32())
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_pydict({
                "block": pa.array([block]), "ids": one(pa.concat_arrays(ids)), "held": one(pa.concat_arrays(held)), "sizes": one(sizes), "texts": pa.array([blob], pa.binary()),
            })

        for batch in batches:
            first, column = 0, as_bytes(batch.column("text"))
            for k, text in enumerate(column):
                texts.append(b" ".join(text.lower().split()) + b"\n")
                size += len(texts[-1])
                if size >= _BLOCK or k + 1 == len(column):
                    ids.append(batch.column("doc_id").slice(first, k + 1 - first))
                    held.append(batch.column("held").slice(first, k + 1 - first))
                    first = k + 1
                if size >= _BLOCK:
                    yield flushed()
                    ids, held, texts, size, block = [], [], [], 0, block + 1
        if texts:
            yield flushed()

    return in_batches(rows, work, f"block long, ids array<{kind}>, held array<boolean>, sizes array<int>, texts binary")


class Block:
    """One row of the blocks, with its arrays."""

    def __init__(self, row: pa.RecordBatch | pa.Table, k: int = 0):
        take = lambda name: row.column(name)[k].values
        self.block, self.ids = row.column("block")[k].as_py(), take("ids")
        self.train = ~np.array(take("held").to_pylist(), bool)
        self.sizes = take("sizes").to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = pa.decompress(row.column("texts")[k].as_buffer(), decompressed_size=int(self.sizes.sum()), codec="zstd", asbytes=True)

    def grams(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of (first document, gram of each position, document of each position counted from the first).

        A gram has the nearest context byte in its highest byte and the symbol in its lowest.
        """
        data, ends = np.frombuffer(self.raw, np.uint8), self.starts + self.sizes
        a = 0
        while a < len(data):
            first = int(np.searchsorted(ends, a, "right"))
            b = min(a + _RUN, len(data), int(ends[min(first + 65535, len(ends) - 1)]))
            from_ = max(0, a - depth)
            own = data[from_:b].astype(np.int64)
            own = np.concatenate([np.zeros(depth - (a - from_), np.int64), own])
            n = b - a
            key = own[depth:].copy()
            for d in range(1, depth + 1):
                key |= own[depth - d : depth - d + n] << 8 * (depth - d + 1)
            for r in range(depth):  # nothing before a text counts
                at = self.starts + r - a
                at = at[(at >= 0) & (at < n) & (self.sizes > r)]
                key[at] &= 255 | sum(255 << 8 * (depth - d + 1) for d in range(1, r + 1))
            last = int(np.searchsorted(ends, b - 1, "right"))
            sizes = np.minimum(ends[first : last + 1], b) - np.maximum(self.starts[first : last + 1], a)
            yield first, key, np.repeat(np.arange(last + 1 - first), sizes)
            a = b

    def counts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(different grams in order, how often each stands in a training text)."""
        def merged() -> list[tuple[np.ndarray, np.ndarray]]:
            key, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            return [(key[begin], np.add.reduceat(n, begin))]

        held, rows, least = [], 0, 2 * _RUN
        for first, key, doc in self.grams(depth):
            both = np.sort(key << 1 | self.train[first + doc])
            begin = np.flatnonzero(np.diff(both >> 1, prepend=-1))
            held.append((both[begin] >> 1, np.add.reduceat(both & 1, begin)))
            rows += len(begin)
            if rows > least:  # different grams are far fewer than those of all runs together
                held = merged()
                rows = len(held[0][0])
                least = 2 * max(_RUN, rows)
        return merged()[0]

    def words(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(different words by first place, the word of each place, words of each document, times of each word in training texts)."""
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        parts, a = [], 0
        while a < len(self.raw):  # some whole texts at a time: a list of words takes much more than their bytes
            b = self.raw.find(b"\n", min(a + _RUN, len(self.raw) - 1)) + 1
            own = self.raw[a:b].split()
            parts.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
            a = b
        at = np.concatenate(parts)
        blanks = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)  # no running total: it takes eight bytes for each byte of the block
        n = np.diff(np.searchsorted(blanks, self.starts), append=len(blanks)) + (self.sizes > 1)
        del blanks, parts
        return list(known), at, n, np.bincount(at[np.repeat(self.train, n)], minlength=len(known))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch, k)


def _out(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=_ROWS)


def _asked_grams(blocks: DataFrame, depth: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks_of(batches):
            key, n = b.counts(depth)
            yield from _out({"key": key, "block": np.full(len(key), b.block), "n": n})

    return in_batches(blocks, work, "key long, block long, n long")


def _asked_words(blocks: DataFrame) -> DataFrame:
    """(word, block, key: -1 less its place in the block, n); the end is the line feed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks_of(batches):
            words, _, _, n = b.words()
            n = np.append(n, b.train.sum())
            yield from _out({"word": pa.array([*words, b"\n"], pa.binary()), "block": np.full(len(n), b.block), "key": -1 - np.arange(len(n)), "n": n})

    return in_batches(blocks, work, "word binary, block long, key long, n long")


# -- the trees


def _packs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (gram, block, n) in the order of grams, cut only where the nearest context bytes change."""
    shift, held, rows = 8 * (depth + 1 - _NEAR), [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("key", "block", "n")])
        rows += batch.num_rows
        if rows >= _PACK:
            whole = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(whole[0], whole[0][-1] >> shift << shift))
            if cut:
                yield tuple(x[:cut] for x in whole)
            held, rows = [[x[cut:] for x in whole]], len(whole[0]) - cut
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held))


class _Level:
    """The nodes of one decision at one depth: zeros, ones, each gram's node, a gram of each node."""

    def __init__(self, order: np.ndarray, code: np.ndarray, bit: np.ndarray, n: np.ndarray):
        fresh = np.diff(code, prepend=-1) != 0
        self.some = order[fresh]
        self.node = np.empty(len(order), np.int64)
        self.node[order] = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        total, self.n1 = np.add.reduceat(n[order], begin), np.add.reduceat((n * bit)[order], begin)
        self.n0 = total - self.n1


class Subtrees:
    """All nodes below the nearest two context bytes, for grams (different, in order) with their counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.key, self.depth, self.symbol = key, depth, key & 255
        codes = [(key >> 8 * (depth - d + 1)) << 8 | self.symbol for d in range(_NEAR, depth + 1)]
        orders = [np.argsort(c, kind="stable") for c in codes]
        sorted_ = [c[o] for c, o in zip(codes, orders)]
        self.bits, self.levels, self.share, self.log = [], [], [], []
        for k in range(8):
            bit = self.symbol >> (7 - k) & 1
            levels = [_Level(o, s >> (8 - k), bit, n) for s, o in zip(sorted_, orders)]
            log = log_kt(levels[-1].n0, levels[-1].n1)
            share = [np.ones(len(log))]
            for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
                below = np.bincount(upper.node[lower.some], log, len(upper.n0))
                log, own = weighted(upper.n0, upper.n1, below)
                share.insert(0, own)
            self.bits.append(bit)
            self.levels.append(levels)
            self.share.append(share)
            self.log.append(log)

    def _above(self, k: int) -> np.ndarray:
        """For each highest node of decision ``k`` its parent: two context bytes, then the leading bits after a one."""
        some = self.levels[k][0].some
        return (self.key[some] >> 8 * (self.depth - 1)) << 8 | 1 << k | self.symbol[some] >> (8 - k)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node at two context bytes, summed log Pw of children, n0, n1)."""
        node = np.concatenate([self._above(k) for k in range(8)])
        found, at = np.unique(node, return_inverse=True)
        log = np.bincount(at, np.concatenate(self.log), len(found))
        n0, n1 = (np.bincount(at, np.concatenate([getattr(x[0], c) for x in self.levels]), len(found)).astype(np.int64) for c in ("n0", "n1"))
        return found, log, n0, n1

    def prices(self, top: Top) -> np.ndarray:
        """The log10 probability of each gram's symbol in its context."""
        out = np.zeros(len(self.key))
        for k in range(8):
            at = np.searchsorted(top.node, self._above(k))
            path = [x[at] for x in (top.given, top.left, top.closed)]
            before = None
            for level, share in zip(self.levels[k], self.share[k]):
                if before is not None:
                    path = [x[before.node[level.some]] for x in path]
                path, before = _descend(*path, level.n0, level.n1, share), level
            one = path[2][before.node]
            out += np.log10(np.where(self.bits[k] == 1, one, 1 - one))
        return out


class Top:
    """What paths carry after the nodes of 0 to 2 context bytes; 2**16 * 255 nodes at most."""

    def __init__(self, node: np.ndarray, children: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(node)
        nodes, counts, shares, ups = [node[order]], [(n0[order], n1[order])], [], []
        log, share = weighted(*counts[0], children[order])
        shares.append(share)
        for _ in range(2):
            parent = (nodes[-1] >> 16) << 8 | nodes[-1] & 255
            found, up = np.unique(parent, return_inverse=True)
            counts.append(tuple(np.bincount(up, x, len(found)).astype(np.int64) for x in counts[-1]))
            log, share = weighted(*counts[-1], np.bincount(up, log, len(found)))
            nodes.append(found)
            shares.append(share)
            ups.append(up)
        n = len(nodes[-1])
        path = (np.zeros(n), np.ones(n), np.full(n, 0.5))
        for k in (2, 1, 0):
            if k < 2:
                path = tuple(x[ups[k]] for x in path)
            path = _descend(*path, *counts[k], shares[k])
        self.node = nodes[0].astype(np.int32)
        self.given, self.left, self.closed = (x.astype(np.float32).astype(np.float64) if n > 1 << 20 else x for x in path)


def _by_nearness(grams: DataFrame, depth: int) -> DataFrame:
    return grams.repartition(F.shiftright("key", 8 * (depth + 1 - _NEAR))).sortWithinPartitions("key")


def _upper_sums(grams: DataFrame, depth: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, n in _packs(batches, depth):
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            yield from _out(dict(zip(("node", "log", "n0", "n1"), Subtrees(key[begin], np.add.reduceat(n, begin), depth).sums())))

    parts = in_batches(grams, work, "node long, log double, n0 long, n1 long")
    return parts.groupBy("node").agg(F.sum("log").alias("log"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _priced(grams: DataFrame, top: Top, depth: int) -> DataFrame:
    """(block, key, value) for each row of the grams."""
    shared = grams.sparkSession.sparkContext.broadcast(top)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, n in _packs(batches, depth):
            fresh = np.diff(key, prepend=-1) != 0
            begin = np.flatnonzero(fresh)
            price = Subtrees(key[begin], np.add.reduceat(n, begin), depth).prices(shared.value).astype(np.float32).astype(np.float64)
            yield from _out({"block": block, "key": key, "value": price[np.cumsum(fresh) - 1]})

    return in_batches(grams, work, "block long, key long, value double")


# -- scores


def _scored(blocks: DataFrame, told: DataFrame, depth: int) -> DataFrame:
    """Each document of the blocks with its sums; ``told`` has the prices (keys from 0 on) and counts (keys below 0)."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.combine_chunks())
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        words, at, n_words, n = b.words()
        n = np.append(n, b.train.sum()).astype(np.float64)
        n[-1 - key[key < 0]] = value[key < 0]
        doc = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        logs, known = np.log10(n + 0.5), n > 0
        total = lambda x: np.bincount(doc, x[:-1][at], len(n_words)) + x[-1]
        key, value = key[key >= 0], value[key >= 0]
        order = np.argsort(key)
        key, value = key[order], value[order]
        score = np.zeros(len(n_words))
        for first, grams, where in b.grams(depth):
            both = np.sort(grams.astype(np.uint64) << np.uint64(16) | where.astype(np.uint64))
            gram = (both >> np.uint64(16)).astype(np.int64)
            fresh = np.diff(gram, prepend=-1) != 0
            found = np.searchsorted(key, gram[fresh])
            if len(key) == 0 or (key[np.minimum(found, len(key) - 1)] != gram[fresh]).any():
                raise ValueError(f"block {b.block} asked for prices that are not there")
            part = np.bincount((both & np.uint64(65535)).astype(np.int64), value[found][np.cumsum(fresh) - 1])
            score[first : first + len(part)] += part
        return pa.table({
            "doc_id": b.ids, "held_out": pa.array(~b.train), "n_tokens": pa.array(n_words + 1), "n_known": pa.array(total(known.astype(np.float64)).astype(np.int64)),
            "log_counts": pa.array(total(logs)), "score": pa.array(score), "n_bytes": pa.array(b.sizes),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(work, schema)


def score(documents: DataFrame, held_out: Column, id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of (doc_id, text).

    ``base_score`` is that of the token counts alone, ``score`` that of the trees, both as log10 of the text's probability;
    ``bits_per_byte`` is the trees' code length for each byte of the token sequence.  ``depth`` is 3, 4 or 5 (a gram and
    the number of a document share 64 bits).
    """
    if not _NEAR <= depth <= 5:
        raise ValueError("depth is 3, 4 or 5")
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    _to_blocks(documents, id_col, held_out).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")

    same = Window.partitionBy("word")
    words = _asked_words(blocks).withColumns({"value": F.sum("n").over(same), "first": F.row_number().over(same.orderBy("block")) == 1})
    words.where("first or value != n").select("block", "key", "value", "first", (F.col("value") != F.col("n")).alias("news")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    seen = words.where("first and value > 0").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    grams = _by_nearness(_asked_grams(blocks, depth), depth).persist(StorageLevel.DISK_ONLY)
    sums = _upper_sums(grams, depth).toArrow()
    top = Top(*(sums.column(c).to_numpy() for c in ("node", "log", "n0", "n1")))
    told = _priced(grams, top, depth).unionByName(words.where("news").select("block", "key", F.col("value").cast("double").alias("value")))
    out = checkpointed(_scored(blocks, told, depth))
    grams.unpersist()
    removed(spark, folder)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(seen["n"]).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * float(np.log10(seen["n"] + 0.5 * (seen["v"] + 1)))).alias("base_score"),
        "score", (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
