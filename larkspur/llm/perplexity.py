"""Quality rules: n-gram perplexity with language-specific bands.

The model is an interpolated modified Kneser-Ney model of 5-grams for each
language, over the bytes of UTF-8 as they are.  Spark counts all n-grams of all
texts (each task counts its own share first), takes continuation counts and
discounts from them, and the result is kept as arrays sorted by hashed key.
What is counted grows with the corpus, and every language has its own model and
band.  A context has at most 256 next bytes, so no key of these joins is hot.

No text is priced by a model that was learnt from it: texts fall into two halves by
their hash (so all copies of a text into one), each half has a model of its own for
every language, and the texts of one half are priced by the other's.  What the other
half never saw backs off to shorter n-grams.  A text counts an n-gram once, however
often it holds it, so that one long alien text teaches little to the next.

Models of at most ``most_keys`` n-grams of all lengths go to all tasks (some 16
bytes an n-gram; they are counted first).  Larger ones stay distributed: documents
are dealt evenly into blocks, the different n-grams of all blocks are priced by
joins with one level after the other, and each block is scored with the sorted
arrays that come back.  Both ways give the same perplexities.

A document's perplexity is that of its 5-grams for each code point (scripts of two
or three bytes a letter are not cheaper for that), whatever their number; one without
any has none, and no band rejects it.  The bands of a language come from the
quartiles of its documents' log-perplexities: ``reach`` times their distance (0.1 at least)
beyond either, so the bulk of a corpus is kept whatever its language is.

Base rules look at words (runs of bytes that are no ASCII white space).  Null
texts have no words; a null language is a language of its own.  Repeated rows
give repeated results; an empty table gives an empty result.  Very long texts
are counted and scored in pieces.  Over 2**20 languages raise an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._spark import checkpointed, in_batches
from larkspur.llm._words import as_bytes, runs

ORDER = 5
_SHIFT = 8
_OTHER = ""
_PIECE = 1 << 19
_MOST_LANGS = 1 << 20
#: Different n-grams that a task holds before it passes its counts on.
_HELD = 4_000_000
_BLOCK_BYTES = 16 << 20


def _grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (text, n-gram): the place of its text in ``texts``, and its bytes as one number."""
    pieces = [(k, t[a : a + _PIECE + order - 1]) for k, t in enumerate(texts) for a in range(0, len(t) - order + 1, _PIECE)]
    for first, last in runs([x for _, x in pieces], _PIECE):
        own = pieces[first:last]
        sizes = np.array([len(x) for _, x in own], np.int64)
        byte = np.frombuffer(b"".join(x for _, x in own), np.uint8).astype(np.int64)
        key = byte.copy()
        for k in range(1, order):
            key[k:] |= byte[:-k] << _SHIFT * k
        whole = np.arange(len(byte)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order - 1
        yield np.repeat([k for k, _ in own], sizes)[whole], key[whole]


def count_grams(documents: DataFrame, langs: list[str], order: int = ORDER) -> DataFrame:
    """(block, slot, gram, n) over all of (block, text, lang); slot is the place of the language in ``langs``.

    An n-gram counts once for each text (of a very long text: each 2**19 bytes) that holds it.
    """
    slots = {x: k for k, x in enumerate(langs)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged() -> int:
            for own in held.values():
                keys, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                own[:] = [(keys, np.bincount(at, np.concatenate([n for _, n in own])).astype(np.int64))]
            return sum(len(own[0][0]) for own in held.values())

        def given() -> Iterator[pa.RecordBatch]:
            for block, own in held.items():
                for keys, n in own:
                    same = pa.array(np.full(len(keys), block, np.int32))
                    yield pa.RecordBatch.from_pydict({"block": same, "slot": pa.array(keys >> _SHIFT * order, pa.int32()), "gram": pa.array(keys & (1 << _SHIFT * order) - 1), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            texts, blocks = as_bytes(batch.column("text")), batch.column("block").to_numpy()
            slot = np.array([slots[x or _OTHER] for x in batch.column("lang").to_pylist()], np.int64)
            for block in np.unique(blocks):
                mine = np.flatnonzero(blocks == block)
                for doc, key in _grams([texts[k] for k in mine], order):
                    keys = slot[mine][doc] << _SHIFT * order | key
                    at = np.argsort(keys, kind="stable")
                    keys, doc = keys[at], doc[at]
                    edge = np.flatnonzero(np.diff(keys, prepend=-1))
                    first = (np.diff(keys, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
                    held.setdefault(int(block), []).append((keys[edge], np.add.reduceat(first.astype(np.int64), edge) if len(edge) else edge))
            if sum(len(k) for own in held.values() for k, _ in own) > _HELD and merged() > _HELD // 2:
                yield from given()
        if held:
            merged()
            yield from given()

    rows = documents.select("block", F.coalesce("text", F.lit("")).alias("text"), "lang")
    return in_batches(rows, work, "block int, slot int, gram long, n long").groupBy("block", "slot", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER, weights: bool = True) -> list[DataFrame]:
    """For each order from 1: (slot, gram, p, back): the interpolated probability, and the weight that its gram has as a context.

    Without ``weights`` all ``back`` are 1: enough where only n-grams of the counts are looked up.
    """
    size = lambda k: F.lit(1 << _SHIFT * k)
    by = {order: counts}
    for k in range(order - 1, 0, -1):  # how many different symbols stand before
        by[k] = checkpointed(by[k + 1].groupBy("slot", (F.col("gram") % size(k)).alias("gram")).agg(F.count("*").alias("n")))
    made: list[DataFrame] = []
    for k in range(1, order + 1):
        own = by[k].withColumn("context", F.shiftright("gram", _SHIFT))
        tops = own.groupBy("slot").agg(*[F.sum(F.when(F.col("n") == j, 1.0).otherwise(0.0)).alias(f"n{j}") for j in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        # Where a count of counts is 0, the discount falls back to a plain one.
        cut = [F.when((F.col(f"n{j}") > 0) & (F.col(f"n{j + 1}") > 0), F.greatest(F.lit(0.05), j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}"))).otherwise(0.5 * j) for j in (1, 2, 3)]
        cuts = tops.select("slot", *[c.alias(f"d{j}") for j, c in zip((1, 2, 3), cut)])
        own = own.join(F.broadcast(cuts), "slot").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        own = own.withColumn("d", F.least("d", "n"))
        total = own.groupBy("slot", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("rest"))
        own = own.join(total, ["slot", "context"])
        if k == 1:
            low = F.lit(1 / (1 << _SHIFT))
        else:
            below = made[-1].select("slot", F.col("gram").alias("short"), F.col("p").alias("low"))
            own = own.withColumn("short", F.col("gram") % size(k - 1)).join(below, ["slot", "short"])
            low = F.col("low")
            if weights:
                back = total.select("slot", F.col("context").alias("gram"), F.col("rest").alias("back"))
                made[-1] = checkpointed(made[-1].drop("back").join(back, ["slot", "gram"], "left").select("slot", "gram", "p", F.coalesce("back", F.lit(1.0)).alias("back")))
        made.append(checkpointed(own.select("slot", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("rest") * low).alias("p"), F.lit(1.0).alias("back"))))
    return made


def _hashed(slot: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """One-to-one: an odd factor modulo 2**64."""
    return (slot.astype(np.uint64) << np.uint64(_SHIFT * ORDER) | gram.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


class Model:
    """For each order, keys in hash order with log-probabilities and log-weights."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.slots, self.levels = {x: k for k, x in enumerate(langs)}, []
        for slot, gram, p, back in tables:
            key = _hashed(slot, gram)
            order = np.argsort(key)
            self.levels.append((key[order], np.log(p[order]).astype(np.float32), np.log(back[order]).astype(np.float32)))
        # The share of each language's bytes that were never seen, from what the seen ones leave.
        slot, _, p, _ = tables[0]
        seen, given = np.bincount(slot, minlength=len(langs) + 1), np.bincount(slot, p, len(langs) + 1)
        size = 1 << _SHIFT
        self.unseen = np.log(np.where(seen, np.maximum(1 - given, 1e-12) / np.maximum(size - seen, 1), 1 / size))

    def slot(self, lang: str | None) -> int:
        """A language that the model doesn't know has no n-grams."""
        return self.slots.get(lang or _OTHER, len(self.slots))

    def log_probability(self, slot: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Of the last symbol of each n-gram of the highest order, backing off where it was never seen."""
        out, todo, give = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for k in range(len(self.levels), 0, -1):
            found, at = self._find(k, slot[todo], gram[todo] & (1 << _SHIFT * k) - 1)
            out[todo[found]] = give[todo[found]] + self.levels[k - 1][1][at[found]]
            todo = todo[~found]
            if not len(todo):
                return out
            if k > 1:
                seen, at = self._find(k - 1, slot[todo], (gram[todo] & (1 << _SHIFT * k) - 1) >> _SHIFT)
                give[todo[seen]] += self.levels[k - 2][2][at[seen]]
        out[todo] = give[todo] + self.unseen[slot[todo]]
        return out

    def _find(self, k: int, slot: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.levels[k - 1][0]
        if not len(keys):
            return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
        want = _hashed(slot, gram)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return keys[at] == want, at

    def mean_log(self, texts: list[bytes], slots: list[int]) -> np.ndarray:
        """Minus the log-probability of each text's n-grams for each code point that they end in: log-perplexity; nan without any."""
        order, total, n = len(self.levels), np.zeros(len(texts)), np.zeros(len(texts))
        for doc, key in _grams(texts, order):
            # Equal n-grams of a run are looked up once.
            full = np.array(slots, np.int64)[doc] << _SHIFT * order | key
            ordered = np.sort(full)
            keys = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]
            value = self.log_probability(keys >> _SHIFT * order, keys & (1 << _SHIFT * order) - 1)
            total += np.bincount(doc, value[np.searchsorted(keys, full)], len(texts))
            n += np.bincount(doc, (key & 0xC0) != 0x80, len(texts))
        return -total / np.where(n, n, np.nan)


def languages(documents: DataFrame) -> list[str]:
    found = documents.select(F.coalesce("lang", F.lit(_OTHER)).alias("lang")).distinct().limit(_MOST_LANGS + 1).collect()
    if len(found) > _MOST_LANGS:
        raise ValueError(f"more than {_MOST_LANGS} languages")
    return sorted(r["lang"] for r in found)


def half() -> Column:
    """0 or 1, by the text."""
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2))


def by_halves(documents: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(documents to learn from, documents to price, names): ``lang`` is the language with its own half, or the other one.

    The names of a language's halves stand side by side, so a slot's half is its language.
    """
    lang, own = F.coalesce("lang", F.lit(_OTHER)), half()
    named = lambda h: documents.withColumn("lang", F.concat(lang, F.lit("\0"), h.cast("string")))
    return named(own), named(1 - own), [f"{x}\0{h}" for x in languages(documents) for h in (0, 1)]


def train(documents: DataFrame, langs: list[str], weights: bool = True) -> list[DataFrame]:
    """The levels of ``kneser_ney`` from all rows of (text, lang)."""
    counts = count_grams(documents.select(F.lit(0).alias("block"), "text", "lang"), langs)
    return kneser_ney(checkpointed(counts.drop("block")), weights=weights)


def load(langs: list[str], levels: list[DataFrame]) -> Model:
    """The whole model in one process: for levels whose size was checked."""
    tables = []
    for k, level in enumerate(levels):
        kind = "float" if k else "double"
        rows = level.select("slot", "gram", F.col("p").cast(kind), F.col("back").cast(kind)).toArrow()
        tables.append(tuple(rows.column(c).to_numpy() for c in ("slot", "gram", "p", "back")))
    return Model(langs, tables)


def top_only(langs: list[str], slot: np.ndarray, gram: np.ndarray, p: np.ndarray) -> Model:
    """A model for texts all of whose n-grams have a price of their own."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    return Model(langs, [none] * (ORDER - 1) + [(slot, gram, p, np.ones(len(p), np.float32))])


def fit(documents: DataFrame) -> Model:
    """From all rows of (text, lang), for a corpus whose model one process can hold."""
    langs = languages(documents)
    return load(langs, train(documents, langs))


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    n = len(words)
    chars = sum(len(w) for w in words) if text.isascii() else len(b"".join(words).decode())
    symbols = sum(map(text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _rows(documents: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows, f"doc_id {kind}, slot int, {', '.join(f'{c} long' for c in _BASE)}, log_perplexity double"


def _measured(rows: pa.RecordBatch | pa.Table, model: Model) -> dict[str, pa.Array | pa.ChunkedArray]:
    texts, slots = as_bytes(rows.column("text")), [model.slot(x) for x in rows.column("lang").to_pylist()]
    logs = model.mean_log(texts, slots)
    base = np.array([base_measures(t) for t in texts], np.int64).reshape(-1, len(_BASE))
    columns = {c: pa.array(base[:, k]) for k, c in enumerate(_BASE)}
    return {"doc_id": rows.column("doc_id"), "slot": pa.array([x // 2 for x in slots], pa.int32()), **columns, "log_perplexity": pa.array(logs, pa.float64(), mask=np.isnan(logs))}


def measure(documents: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, slot of the language, the base measures, log_perplexity) for each row, with a model of checked size."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows, schema = _rows(documents, id_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_measured(batch, shared.value))

    return in_batches(rows, work, schema)


def prices(asked: DataFrame, levels: list[DataFrame], langs: list[str]) -> DataFrame:
    """(slot, gram, p) of different n-grams (slot, gram) of the highest order, by a join with each level and its contexts."""
    unseen = load(langs, levels[:1]).unseen  # a number for each language; the first level has 256 grams of each at most
    out = asked.withColumns({"p": F.lit(None).cast("double"), "w": F.lit(1.0)})
    for k in range(len(levels), 0, -1):
        short = F.col("gram") % F.lit(1 << _SHIFT * k)
        own = levels[k - 1].select("slot", F.col("gram").alias("_g"), F.col("p").alias("_p"))
        out = out.withColumn("_g", short).join(own, ["slot", "_g"], "left").withColumn("p", F.coalesce("p", F.col("w") * F.col("_p"))).drop("_p", "_g")
        if k > 1:
            context = levels[k - 2].select("slot", F.col("gram").alias("_g"), F.col("back").alias("_b"))
            out = out.withColumn("_g", F.shiftright(short, _SHIFT)).join(context, ["slot", "_g"], "left")
            out = out.withColumn("w", F.when(F.col("p").isNull(), F.col("w") * F.coalesce("_b", F.lit(1.0))).otherwise(F.col("w"))).drop("_b", "_g")
    rest = F.element_at(F.array(*[F.lit(float(np.exp(x))) for x in unseen]), F.col("slot") + 1)
    return out.select("slot", "gram", F.coalesce("p", F.col("w") * rest).alias("p"))


def measure_joined(documents: DataFrame, langs: list[str], levels: list[DataFrame], id_col: str = "doc_id", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """As ``measure``, with the models left distributed.

    A block holds some ``block_bytes`` of texts (one text at least), dealt
    round-robin so that no hot value fills one.
    """
    rows, schema = _rows(documents, id_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = checkpointed(rows.repartition(size // block_bytes + 1).withColumn("block", F.spark_partition_id()))
    grams = checkpointed(count_grams(dealt, langs).select("block", "slot", "gram"))
    priced = grams.join(prices(grams.select("slot", "gram").distinct(), levels, langs), ["slot", "gram"]).select("block", "slot", "gram", "p")

    def work(texts: pa.Table, prices: pa.Table) -> pa.Table:
        model = top_only(langs, *(prices.column(c).to_numpy() for c in ("slot", "gram", "p")))
        return pa.table(_measured(texts.combine_chunks(), model))

    return dealt.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(work, schema)


def bands(measured: DataFrame, reach: float = 3.0, step: float = 1e-3, least: float = 0.1) -> DataFrame:
    """(slot, low, high) of the log-perplexities, from a histogram of all documents in steps of ``step``."""
    binned = measured.where("log_perplexity is not null").groupBy("slot", F.floor(F.col("log_perplexity") / step).alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("slot").orderBy("bin")
    ranked = binned.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("slot"))})
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) * step
    edges = ranked.groupBy("slot").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    far = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
    return edges.select("slot", (F.col("q1") - far).alias("low"), (F.col("q3") + far).alias("high"))


def judge(
    documents: DataFrame, id_col: str = "doc_id", reach: float = 3.0, min_words: int = 50, max_repeat_percent: int = 50, most_keys: int = 6_000_000
) -> DataFrame:
    """(doc_id, base measures, base_failed, kept, perplexity, low, high) for each row of (doc_id, text, lang)."""
    learnt, asked, langs = by_halves(documents)
    levels = train(learnt, langs)
    if sum(x.count() for x in levels) <= most_keys:
        measured = checkpointed(measure(asked, load(langs, levels), id_col))
    else:
        measured = checkpointed(measure_joined(asked, langs, levels, id_col))
    judged = measured.join(F.broadcast(bands(measured, reach)), "slot", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"),
        F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("lower_band"), F.exp("high").alias("upper_band"),
    )
