"""BPE through a minimal acyclic transducer of frequent words.

Spark counts words over the whole corpus; the most frequent become a lexicon: a
minimal acyclic automaton whose common endings are shared, with numbers on its
arcs that add up to a word's place in a table of id lists.  Tasks map it into
memory from a file and run the different words of some texts through it together;
what they hold at a time is bounded by a few hundred KB of text, or by one text.
Words that it doesn't hold, of any script, are merged exactly, by the file's own
merges.  The lexicon changes speed only.

Counting is lossy with a stated bound: a task reports the words that make up at
least ``share`` of its own words, so every word with that share of the corpus
is counted, whatever the corpus's size, and a task reports at most 1 / share.

A null text is empty (no ids, decoded as empty).  Rows are judged one by one,
so ties and repeated rows need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import in_batches
from larkspur.llm._words import as_bytes, runs
from larkspur.llm.tokens import Coder

#: Letters and digits stay; all else parts words.
_PART = bytes(x if 48 <= x < 58 or 65 <= x < 91 or 97 <= x < 123 or x > 127 else 32 for x in range(256))
#: Words that a task remembers, twice; characters of the texts that it encodes together, unless one text has more.
_HELD, _STEP = 60_000, 1 << 19


def frequent_words(documents: DataFrame, text_col: str = "text", top: int = 50_000, share: float = 2e-6) -> list[bytes]:
    """About the ``top`` most frequent words, each as " word"; a bounded list.

    Tasks drop words that are rare so far now and then, and count them anew if they come back, so counts may be short.
    The list decides which words the lexicon holds, never their ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, most = Counter(), 0, 100_000
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                words = text.translate(_PART).split()
                total += len(words)
                counts.update(words)
                if len(counts) > most:
                    counts = Counter({w: c for w, c in counts.items() if c > max(1, share * total)})
                    most = max(100_000, 2 * len(counts))
        kept = [(w, c) for w, c in counts.items() if c >= max(2, share * total)]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in kept], pa.binary()), "n": pa.array([c for _, c in kept], pa.int64())})

    counted = in_batches(documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), work, "word binary, n long")
    best = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    return [b" " + bytes(r["word"]) for r in best.collect()]


class Transducer:
    """word -> ids, as flat arrays: sorted arcs (state << 8 | byte), their targets and numbers, and the id lists."""

    _PARTS = ("arcs", "target", "number", "final", "ends", "ids")

    def __init__(self, **parts: np.ndarray):
        for name in self._PARTS:
            setattr(self, name, parts[name])

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        """Sorted words are added one by one; finished branches that equal an earlier one are replaced by it."""
        words = sorted(entries)
        known: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple]] = []

        def freeze(node: list) -> int:
            form = (node[0], tuple(node[1]))
            if form not in known:
                known[form] = len(nodes)
                nodes.append(form)
            return known[form]

        open_nodes, before = [[False, []]], b""
        for word in [*words, b""]:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            while len(open_nodes) > same + 1:
                done = freeze(open_nodes.pop())
                open_nodes[-1][1].append((before[len(open_nodes) - 1], done))
            for _ in word[same:]:
                open_nodes.append([False, []])
            if word or b"" in entries:
                open_nodes[-1][0] = True
            before = word
        root = freeze(open_nodes[0])
        below = [0] * len(nodes)  # words from each node on
        for k, (final, arcs) in enumerate(nodes):
            below[k] = final + sum(below[t] for _, t in arcs)
        rows = []
        for k, (final, arcs) in enumerate(nodes):
            before_arc = int(final)
            for byte, t in arcs:
                rows.append(((len(nodes) - 1 - k) << 8 | byte, len(nodes) - 1 - t, before_arc))
                before_arc += below[t]
        assert root == len(nodes) - 1
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        lists = [entries[w] for w in words]
        return cls(
            arcs=table[:, 0].copy(), target=table[:, 1].astype(np.int32), number=table[:, 2].astype(np.int32),
            final=np.array([f for f, _ in reversed(nodes)], np.uint8),
            ends=np.cumsum([0] + [len(x) for x in lists], dtype=np.int64), ids=np.array([i for x in lists for i in x], np.uint32),
        )

    def to_bytes(self) -> bytes:
        parts = [getattr(self, n) for n in self._PARTS]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """From a file that is mapped into memory; it has no name any more once it is open."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, parts = np.frombuffer(view, np.int64, len(cls._PARTS)), 8 * len(cls._PARTS), {}
        for name, n, kind in zip(cls._PARTS, sizes.tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int64, np.uint32)):
            parts[name] = np.frombuffer(view, kind, n, at)
            at += parts[name].nbytes + -parts[name].nbytes % 8
        return cls(**parts)

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word; None for those that aren't in the lexicon."""
        n = len(words)
        out: list[list[int] | None] = [None] * n
        if not n or not len(self.arcs):
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        data, begin = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(sizes) - sizes
        going, state, number, k = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(going):
            over = sizes[going] == k
            done = going[over]
            good = done[self.final[state[over]] == 1]
            for w, place in zip(good.tolist(), number[over][self.final[state[over]] == 1].tolist()):
                out[w] = self.ids[self.ends[place] : self.ends[place + 1]].tolist()
            going, state, number = going[~over], state[~over], number[~over]
            key = state << 8 | data[begin[going] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[arc] == key
            going, state, number = going[there], self.target[arc[there]].astype(np.int64), number[there] + self.number[arc[there]]
            k += 1
        return out


class LexiconCoder:
    """Encodes and decodes whole texts: a transducer for frequent words, exact merges for the rest."""

    def __init__(self, coder: Coder, transducer: Transducer):
        self.coder, self.transducer = coder, transducer
        self.found = self.missed = 0  # different words that the lexicon holds, and that had to be merged
        self._known: dict[str, tuple[int, bytes, bytes]] = {}
        self._older: dict[str, tuple[int, bytes, bytes]] = {}

    def entry(self, ids: Iterable[int]) -> tuple[int, bytes, bytes]:
        """(how many, decimal ids, decoded bytes) of the ids of a piece."""
        ids, token = list(ids), self.coder.token_bytes
        return len(ids), ",".join(map(str, ids)).encode(), b"".join([token[i] for i in ids])

    def _learn(self, words: set[str]) -> None:
        if len(self._known) > _HELD:  # words not met since the last time are forgotten
            self._older, self._known = self._known, {}
        if self._older:
            self._known |= {w: self._older[w] for w in words & self._older.keys()}
        new = [w for w in words if w not in self._known]
        raw = [w.encode() for w in new]
        found = self.transducer.look_up(raw)
        merged = iter(self.coder.merged_all([piece for piece, ids in zip(raw, found) if ids is None]))
        for word, ids in zip(new, found):
            self.found, self.missed = self.found + (ids is not None), self.missed + (ids is None)
            self._known[word] = self.entry(next(merged) if ids is None else ids)

    def _parts(self, text: str) -> list:
        """The text's words in lists, and the entries of what is no word, in order."""
        parts = self.coder.parts(text)
        if parts is None:
            return [self.entry(self.coder.library_ids(text))]
        return [self.entry([p]) if isinstance(p, int) else p for p in parts]

    def encode(self, texts: list[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """Entries of each text, in order; the new words of all the texts are looked up together."""
        parts = [self._parts(t) for t in texts]
        self._learn({w for x in parts for p in x if isinstance(p, list) for w in p})
        known = self._known
        for x in parts:
            out = []
            for p in x:
                out += [known[w] for w in p] if isinstance(p, list) else [p]
            yield out


def encode(documents: DataFrame, coder: Coder, top: int = 50_000, id_col: str = "doc_id", text_col: str = "text", keep: bool | Collection[str] = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row; with ``keep`` also ``ids`` and ``decoded``, or those of them that it names."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = frequent_words(rows, "text", top)
    model = spark.sparkContext.broadcast((coder.file_text, Transducer.build({w: coder.merged(w) for w in frequent}).to_bytes()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = [c for c in ("ids", "decoded") if keep is True or keep and c in keep]

    def encoded(run: LexiconCoder, texts: list[str]) -> dict[str, pa.Array]:
        n, digests, lists, decoded = [], ([], []), [], []
        for pieces in run.encode(texts):
            counts, ids, raw = zip(*pieces) if pieces else ((), (), ())
            n.append(sum(counts))
            ids, text = b",".join([x for x in ids if x]), b"".join(raw).decode("utf-8", "replace")
            digests[0].append(hashlib.sha256(ids).hexdigest())
            digests[1].append(hashlib.sha256(text.encode()).hexdigest())
            if "ids" in whole:
                lists.append(np.fromstring(ids, np.int32, sep=","))
            if "decoded" in whole:
                decoded.append(text)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests[0], pa.string()), "decoded_sha256": pa.array(digests[1], pa.string())}
        if "ids" in whole:
            ends = np.cumsum([0] + [len(x) for x in lists], dtype=np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
        if "decoded" in whole:
            out["decoded"] = pa.array(decoded, pa.string())
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_text, lexicon = model.value
        run = LexiconCoder(Coder(file_text), Transducer.mapped(lexicon))  # goes with the task, not with the worker
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in runs(texts, _STEP):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a)} | encoded(run, texts[a:b]))

    kinds = {"ids": "array<int>", "decoded": "string"}
    return in_batches(rows, work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {kinds[c]}" for c in whole))
