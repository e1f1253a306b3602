"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is an Arrow batch of documents.  Its words become symbols: those of
the benchmark have numbers, all others part the text, and only stretches that
are long enough to hold a phrase are kept, which loses no occurrence.  Over
the stretches a suffix array gives the Burrows-Wheeler text, held as a wavelet
matrix.  All phrases search backward together through its ranks; occurrences
are located from every eighth suffix position, and the hit words of a document
are merged into removal spans.

Phrases: each run of ``size`` words of an item; an item of fewer words, but not
none, is one phrase.  Null texts, of documents or items, have no words; a null
item id counts as an empty string.  Items that repeat an id count once.  Matches
never cross documents.  Repeated rows give repeated results; an empty corpus or
benchmark gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import in_batches
from larkspur.llm._words import as_bytes

_WORD = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Lower-cases A-Z and turns what is in no word into a blank.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x in _WORD else 32 for x in range(256))
_SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends first sorts first."""
    n, h = len(text), 1
    rank = text.astype(np.int64) + 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:]
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
        h *= 2
        if rank[order[-1]] == n or h >= n:
            return order


class FMIndex:
    """Counts and locates phrases, by backward search, in a text of small integers that ends with its only 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        self.n, self.bits = len(text), max(1, int(text.max()).bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << self.bits))))
        bwt = text[order - 1]
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        kept = order % _SAMPLE == 0
        self.kept, self.kept_before, self.at = kept, np.cumsum(kept) - kept, order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first i of the Burrows-Wheeler text."""
        start = np.zeros(len(i), np.int64)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones[k], (symbol >> level) & 1 == 1
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
            start = np.where(one, self.zeros[k] + ones[start], start - ones[start])
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[i + 1] - ones[i]
            out = out << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of ``phrases`` that occur, first, end of their suffixes); a phrase is padded with -1 on the left."""
        row = np.arange(len(phrases))
        low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[row, k].astype(np.int64)
            going = symbol >= 0
            sure = np.where(going, symbol, 0)
            ok = sure < 1 << self.bits
            row, low, high, going, sure = row[ok], low[ok], high[ok], going[ok], sure[ok]
            low = np.where(going, self.first[sure] + self.rank(sure, low), low)
            high = np.where(going, self.first[sure] + self.rank(sure, high), high)
            there = low < high
            row, low, high = row[there], low[there], high[there]
        return row, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a sampled one."""
        out, todo, steps = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        while len(todo):
            got = self.kept[i]
            out[todo[got]] = self.at[self.kept_before[i[got]]] + steps
            todo, i = todo[~got], i[~got]
            symbol = self.symbol(i)
            i = self.first[symbol] + self.rank(symbol, i)
            steps += 1
        return out


class Phrases:
    """The phrases of a block of benchmark items, as numbers."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        for item, text in items:
            word = [self.words.setdefault(w, len(self.words) + 2) for w in text.translate(FOLD).split()]
            for k in range(max(1, len(word) - size + 1) if word else 0):
                found.setdefault(tuple(word[k : k + size]), set()).add(place[item])
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(x) for x in found], np.int64)
        self.table = np.full((len(found), size), -1, np.int32)
        for k, x in enumerate(found):
            self.table[k, size - len(x) :] = x
        self.least = int(self.length.min()) if found else 0


def find(texts: list[bytes], phrases: Phrases) -> dict[int, tuple[np.ndarray, list[str]]]:
    """Of the texts with hits: (which words are hit, ids of the items found)."""
    if not phrases.least:
        return {}
    get, parts, where = phrases.words.get, [], []
    for d, text in enumerate(texts):
        words = text.split()
        if len(words) < phrases.least:
            continue
        ids = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(ids > 1, prepend=False, append=False))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= phrases.least:
                parts += [ids[s:e], [1]]
                where.append((d, s, e - s + 1))
    if not parts:
        return {}
    index = FMIndex(np.concatenate([*parts, [0]]).astype(np.int64))
    row, low, high = index.search(phrases.table)
    if not len(row):
        return {}
    count = high - low
    suffix = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    at, phrase = index.locate(suffix), np.repeat(row, count)
    doc, start, length = map(np.array, zip(*where))
    begin = np.cumsum(length) - length
    stretch = np.searchsorted(begin, at, "right") - 1
    out: dict[int, tuple[list, set]] = {}
    for d, s, p in zip(doc[stretch], start[stretch] + at - begin[stretch], phrase):
        spans, items = out.setdefault(int(d), ([], set()))
        spans.append((s, s + phrases.length[p]))
        items.update(phrases.items[p])
    made = {}
    for d, (spans, items) in out.items():
        hit = np.zeros(len(texts[d].split()), bool)
        for s, e in spans:
            hit[s:e] = True
        made[d] = hit, [phrases.ids[k] for k in items]
    return made


def _blocks(benchmark: DataFrame, size: int, block_bytes: int, item_col: str, text_col: str) -> list[Phrases]:
    """The benchmark in blocks of about ``block_bytes`` of text, each small enough to be sent to every task."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    made = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        made.append(Phrases([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], size))
    return made


def scan(
    documents: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 8 << 20, keep_text: bool = False,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans[, text]) for every document.

    spans are the maximal runs of hit words as byte ranges of the text's UTF-8.
    A benchmark of more than ``block_bytes`` is searched block after block.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("words", F.array().cast("array<struct<s:long,e:long>>")).withColumn("items", F.array().cast("array<string>"))
    blocks = [spark.sparkContext.broadcast(p) for p in _blocks(benchmark, size, block_bytes, item_col, item_text)]
    span = "array<struct<s:long,e:long>>"
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ("" if last and not keep_text else "text string, ") + (f"n_words long, n_hit long, items array<string>, spans {span}" if last else f"words {span}, items array<string>")
        rows = in_batches(rows, _searcher(block, last, keep_text), fields)
    return rows


def _searcher(block, last: bool, keep_text: bool):
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.translate(FOLD) for x in as_bytes(batch.column("text"))]
            found = find(texts, block.value)
            words, items = batch.column("words").to_pylist(), batch.column("items").to_pylist()
            n_hit, spans = [0] * len(texts), [[]] * len(texts)
            for d in set(found) | {d for d, x in enumerate(words) if x}:
                hit, ids = found.get(d, (np.zeros(len(texts[d].split()), bool), []))
                for x in words[d]:
                    hit[x["s"] : x["e"]] = True
                edge = np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2)
                words[d], items[d] = [{"s": int(s), "e": int(e)} for s, e in edge], sorted({*items[d], *ids})
                if last:
                    bounds = [m.span() for m in re.finditer(rb"[^ ]+", texts[d])]
                    n_hit[d], spans[d] = int(hit.sum()), [{"s": bounds[s][0], "e": bounds[e - 1][1]} for s, e in edge]
            out = {"doc_id": batch.column("doc_id")}
            if not last or keep_text:
                out["text"] = batch.column("text")
            if last:
                out |= {"n_words": pa.array([len(x.split()) for x in texts], pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, kind)}
            else:
                out |= {"words": pa.array(words, kind), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(out)

    return work


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, a line break in place of each."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"\n".join([*parts, text[at:]]).decode() if spans else text.decode()


def remove(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, items, text): the text without its hit words and what stands between them."""
    found = scan(documents, benchmark, keep_text=True, **options).select("doc_id", "n_words", "n_hit", "items", "spans", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            texts = [cut(t, [(x["s"], x["e"]) for x in own]) for t, own in zip(as_bytes(batch.column("text")), spans)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "n_words", "n_hit", "items")} | {"text": pa.array(texts, pa.string())})

    return in_batches(found, work, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, text string")
