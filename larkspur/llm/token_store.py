"""Token ids in Simple-8b blocks, in ascending document order.

A 64-bit word holds a selector in its top four bits and 60 bits of ids; the
selector says how many ids of how many bits.  Selector 15 is an escape: the
next word is a single id as it is, for values of over 60 bits.

The file format is a Parquet table whose rows are blocks, in document order:

    part, block   place of the block: ascending part, then block
    first         ids of the part before this block
    n_ids         ids in the block
    doc_ids       its documents, ascending
    counts        ids of each document, the end id included
    offsets       word at which each document starts, and the end
    words         the words, little-endian

Documents start at a word of their own, so one document or a whole block is
decoded with a few array operations.

A null text is empty: just the end id.  Rows sort by id (null first), then by a
hash of the text; repeated rows stay.  An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import in_batches
from larkspur.llm.tokens import Coder, held_coder

#: Fixed values of Simple-8b: (ids in a word, bits of each), selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_ESCAPE = 15
_COUNT = np.array([0, *(n for n, _ in SELECTORS), 1], np.int64)


def _widths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out += np.uint8(step) * big
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word at which each document starts, and the end) of ids that lie document after document."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n)  # ids up to the document's end
    widths = _widths(ids) if n and ids.max() >= 1 << 16 else _NARROW[ids.astype(np.int64)]
    choice = np.full(n, _ESCAPE, np.uint8)
    wide, have = np.concatenate([widths, np.full(60, 64, np.uint8)]), 1  # nothing fits beyond the last id: see below
    for s in range(len(SELECTORS), 0, -1):  # from one id a word to sixty
        count, bits = SELECTORS[s - 1]
        while have < count:
            step = min(have, count - have)
            wide = np.maximum(wide, np.concatenate([wide[step:], np.full(step, 64, np.uint8)]))
            have += step
        if n and wide.min() > bits:  # nor does it with more ids in fewer bits
            break
        choice[wide[:n] <= bits] = s
    # Beyond a document's end no id counts, so its last words may be short.
    tail = np.flatnonzero(left < 60)
    if len(tail):
        top = np.maximum.reduceat(np.append(widths, np.uint8(0)), np.stack([tail, tail + left[tail]], 1).ravel())[::2]
        for s in range(len(SELECTORS), 0, -1):
            count, bits = SELECTORS[s - 1]
            choice[tail[(left[tail] <= count) & (top <= bits)]] = s
    steps = np.minimum(_COUNT[choice], left).tolist()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += steps[at]
    start = np.array(starts, np.int64)
    selector = choice[start]
    size = np.where(selector == _ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == _ESCAPE:
            words[place[mine] + 1] = ids[start[mine]]
            continue
        count, bits = SELECTORS[s - 1]
        for k in range(count):
            own = mine[left[start[mine]] > k]
            words[place[own]] |= ids[start[own] + k] << np.uint64(k * bits)
    begin = np.append(place, len(words))[np.searchsorted(start, ends - counts)]
    return words, np.append(begin, len(words))


_NARROW = _widths(np.arange(1 << 16, dtype=np.uint64))


def unpack(words: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids again, document after document."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == _ESCAPE).any() or len(words) and selector.min() == 0:  # raw words follow escapes: find the true selectors
        raw, k = np.zeros(len(words), bool), 0
        for k in np.flatnonzero(selector == _ESCAPE).tolist():
            if not raw[k]:
                raw[k + 1] = True
        selector[raw] = 0
    room = _COUNT[selector]
    out = np.zeros(int(room.sum()), np.uint64)
    at = np.cumsum(room) - room
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == _ESCAPE:
            out[at[mine]] = words[mine + 1]
        elif s:
            count, bits = SELECTORS[s - 1]
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    begin = np.append(at, len(out))[offsets]
    keep = np.repeat(begin[:-1] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    return out[keep]


_BLOCK = "part int, block int, first long, n_ids long, doc_ids array<{id}>, counts array<long>, offsets array<long>, words binary"


def write_store(documents: DataFrame, path: str, coder: Coder, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 256, part_bytes: int = 256 << 20) -> None:
    """Encode whole texts and write them to a new store at ``path``, a folder that all executors share.

    Parts are of ``part_bytes`` of text at most on average, whatever the size of the corpus.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(coder.file_text)
    end = [] if end_id is None else [end_id]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block, first = held_coder(shared.value).ids, TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                piece = batch.slice(at, block_docs)
                each = [np.append(x, np.array(end, np.uint32)) for x in code(piece.column("text").to_pylist())]
                counts = np.array([len(x) for x in each], np.int64)
                words, offsets = pack(np.concatenate(each), counts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([int(counts.sum())], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), piece.column("doc_id")),
                    "counts": pa.array([counts.tolist()], pa.list_(pa.int64())), "offsets": pa.array([offsets.tolist()], pa.list_(pa.int64())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                })
                block, first = block + 1, first + int(counts.sum())

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    in_batches(ordered, work, _BLOCK.format(id=kind)).write.option("compression", "uncompressed").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>) for each document of a store."""
    return _read(spark, path, "ids array<long>", lambda x: x.astype(np.int64).tolist(), pa.list_(pa.int64()))


def read_crc32(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of the ids as little-endian unsigned 32-bit integers."""
    return _read(spark, path, "ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, made, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.parquet(path)
    name = column.split()[0]
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each part: the running total over parts is as long as their number.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("part", "first", "doc_ids", "counts", "offsets", "words")}
                counts, offsets = (np.array(row[c].as_py(), np.int64) for c in ("counts", "offsets"))
                ids = unpack(np.frombuffer(row["words"].as_py(), "<u8"), offsets, counts)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"].as_py()] * len(counts), pa.int32()), "doc_id": row["doc_ids"].values,
                    "place": pa.array(ends - counts + row["first"].as_py(), pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                    name: pa.array([made(ids[a:b]) for a, b in zip(ends - counts, ends)], kind),
                })

    docs = blocks.select("part", "first", "doc_ids", "counts", "offsets", "words").mapInArrow(work, f"part int, doc_id {id_type}, place long, n_tokens long, {column}")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", name)
