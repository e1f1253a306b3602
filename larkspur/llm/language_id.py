"""Language identification by error-correcting output codes.

Each language has a codeword.  For each bit a binary classifier over character
n-grams (of the UTF-8 bytes, letters lower-cased, hashed to a fixed number of
features) tells the languages with a 1 from those with a 0: a linear one whose
weights are log-odds of Spark-counted n-grams.  Decoding is loss-weighted: a
language's loss is the logistic loss of the bits' margins against its codeword,
each bit weighted by how far that bit's classifier sets the language apart.
The codeword of least loss wins; where the next one is close, the answer is
flagged as ambiguous.

Texts without a letter, and null, are ``und`` with score 0.  Rows are judged
one by one, so ties and repeated rows need no rule (equal losses: the first
language in order).  Without labelled texts every answer is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import in_batches
from larkspur.llm._words import as_bytes, runs

UNKNOWN = "und"
_BITS = 16
#: Lower-cased letters and bytes above 127 stay; runs of anything else count as one blank each byte.
_FOLD = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32 for x in range(256)], np.uint64)


def _features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: (first text, hashed 2- and 3-grams by position, where each text starts and the end)."""
    for first, last in runs(texts):
        joined = _FOLD[np.frombuffer(b" " + b"  ".join(texts[first:last]) + b"  ", np.uint8)]
        two = joined[:-1] << np.uint64(8) | joined[1:]
        three = two[:-1] << np.uint64(8) | joined[2:]
        short = (two[:-1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
        long = ((three + np.uint64(1 << 24)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
        starts = np.cumsum([0] + [len(x) + 2 for x in texts[first:last]])
        yield first, np.stack([short, long], 1).astype(np.int32), starts


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1: all splits for up to five languages, else the random code of best distance."""
    if n <= 5:
        rows = [[1 if c >> k & 1 else -1 for c in range((1 << n - 1) - 1)] for k in range(n - 1)]
        return np.array([[1] * ((1 << n - 1) - 1), *rows]) if n > 1 else np.ones((max(n, 1), 1))
    size, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice([-1, 1], (n, size))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * size
        best = max(best, (int(apart.min()), code), key=lambda x: x[0])
    return best[1]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: n-grams of each language (rows) by feature."""
        self.langs, self.code = langs, codewords(len(langs)) if langs else np.zeros((0, 1))
        smooth = counts + 0.5
        p = smooth / smooth.sum(1, keepdims=True) if langs else smooth
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1] if len(langs) > 1 else 0):
            one = self.code[:, b] > 0
            self.weights[:, b] = np.log(p[one].mean(0)) - np.log(p[~one].mean(0))
        apart = np.abs(p @ self.weights) if langs else np.zeros((0, 1))
        self.trust = apart / np.maximum(apart.sum(1, keepdims=True), 1e-12)
        self.scale = 1 / max(float(apart.mean()) if langs else 1.0, 1e-6)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-odds of each text's n-grams by bit, scaled so that 1 is usual."""
        out = np.zeros((len(texts), self.code.shape[1]), np.float64)
        for first, features, starts in _features(texts):
            size, total = np.maximum(np.diff(starts), 1), np.zeros((len(starts) - 1, self.code.shape[1]))
            for k in range(2):
                total += np.add.reduceat(self.weights[features[:, k]], starts[:-1], axis=0)[: len(starts) - 1]
            out[first : first + len(size)] = total / size[:, None] / 2
        return out * self.scale

    def decode(self, margins: np.ndarray, sharp: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its share of the softmax of all)."""
        loss = np.stack([np.logaddexp(0, -sharp * margins * self.code[k]) @ self.trust[k] for k in range(len(self.langs))], 1)
        likely = np.exp(sharp * (loss.min(1, keepdims=True) - loss))
        best = loss.argmin(1)
        return best, likely[np.arange(len(best)), best] / likely.sum(1)


def count_ngrams(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Counts by language over all of (text, lang); what is collected is languages times features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), as_bytes(batch.column("text"))
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs) if x == lang]
                total = sums.setdefault(lang, np.zeros(1 << _BITS, np.int64))
                for _, features, _ in _features(own):
                    total += np.bincount(features.ravel(), minlength=1 << _BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "feature": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = labelled.where("text is not null and lang is not null").mapInArrow(work, "lang string, feature int, n long")
    rows = found.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(langs), 1 << _BITS))
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=int), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return langs, counts


def fit(labelled: DataFrame) -> Model:
    """From all rows of (text, lang)."""
    return Model(*count_ngrams(labelled))


def identify(documents: DataFrame, model: Model, ambiguous_below: float = 0.6, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` with lang_pred, score (0 to 1) and ambiguous added; columns of those names are replaced."""
    names = ["lang_pred", "score", "ambiguous"]
    rows = documents.drop(*names)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = f"{rows._jdf.schema().toDDL()}, lang_pred string, score double, ambiguous boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            whole = batch.column(text_col)
            texts = as_bytes(whole)
            known = np.array([bool(m.langs) and any(map(str.isalpha, t or "")) for t in whole.to_pylist()], bool)
            best, score = m.decode(m.margins(texts)) if m.langs and texts else (np.zeros(len(texts), int), np.zeros(len(texts)))
            score = np.where(known, score, 0.0)
            langs = [m.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score), "ambiguous": pa.array(score < ambiguous_below)})

    return in_batches(rows, work, fields)
