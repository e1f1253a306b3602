"""Vector codes, periodic runs and context trees against plain versions."""

import random
import re
import zlib
from collections import defaultdict
from math import lgamma, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import context_tree, periodic_runs, vector_codes
from larkspur.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, code string, _s int"


def plain_codes(vectors, parts, entries, rounds):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)
    for _ in range(rounds):
        code = near()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    code = near()
    return code, ((x - books[np.arange(parts), code]) ** 2).sum((1, 2)), books


@pytest.mark.parametrize("entries,rounds,b", [(64, 2, None), (16, 5, None), (7, 3, 2), (1, 1, None), (256, 1, None), (40, 4, 1)])
def test_vector_codes_equal_plain_k_means(spark, entries, rounds, b):
    rng = np.random.default_rng(entries)
    x = np.concatenate([rng.normal(0, 0.1, (400, 8)), np.round(rng.normal(0, 0.02, (300, 8)), 2), np.repeat(rng.normal(0, 0.1, (1, 8)), 60, 0)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    if entries == 40:  # some rows need four bytes a component, and distances more than bounds hold
        x[::50] *= 1e5
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)
    state, books = vector_codes.learn(df, 4, entries, rounds, width_b=b)
    code, error, want = plain_codes(x, 4, entries, rounds)
    assert (books == want).all()
    width = len(state.first()["near"]) // 4
    got = {r["vec_id"]: list(r["near"][::width]) for r in state.collect()}
    assert [got[k] for k in range(len(x))] == code.tolist()
    rows, _ = vector_codes.compress(df, 4, entries, rounds)
    assert {r["vec_id"]: r["error"] for r in rows.collect()} == dict(enumerate(error.tolist()))


def test_vector_codes_on_odd_rows(spark, monkeypatch):
    good = [[0.5, -0.25, 0.0, 1.0], [0.5, -0.25, 0.0, 1.0], [-3.0, 2.0, 100.0, -100.0]]
    rows = [(5, good[0], None), (5, good[1], None), (None, good[2], 1), (7, None, 1), (8, [1.0, None, 0.0, 0.0], 1), (9, [float("nan"), 0.0, 0.0, 0.0], 1), (10, [float("inf"), 0.0, 0.0, 0.0], 1), (11, [1.0] * 6, 2), (12, [], 2)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS)
    for few in (10, 0):  # labels broadcast, labels joined under salted keys
        monkeypatch.setattr(vector_codes, "_FEW_LABELS", few)
        codes, books = vector_codes.compress(df, 2, 64, 2)
        got = sorted((r["vec_id"] is None, r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in vector_codes.with_label_error(codes).collect())
        assert books.shape == (2, 3, 2)
        assert got == [(False, 5, "0000", 0, 0), (False, 5, "0000", 0, 0), (True, None, "0202", 0, 0)]
    assert vector_codes.compress(df.limit(0), 2)[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(df, 3)
    with pytest.raises(Exception, match="2\\*\\*18"):
        vector_codes.compress(spark.createDataFrame([(1, [2.0**18] * 4, 1)], "vec_id long, embedding array<float>, label int"), 2)


def test_bounds_spare_most_distances(spark, monkeypatch):
    x = np.random.default_rng(3).normal(0, 0.1, (2000, 4)).astype(np.float32)
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    book = v[:64]
    bounds = vector_codes.Bounds.of(vector_codes._distances(v, book), 16)
    step = np.full(64, 8)
    bounds.moved(step)
    _, _, depth = bounds.assign(v, book, 16)
    assert (depth <= 16).mean() > 0.9  # all 64 distances for less than a tenth of the parts


def plain_runs(words, least=6, times=4):
    out = {}
    for p in range(1, len(words) // times + 1):
        k = 0
        while k + p < len(words):
            if words[k] != words[k + p]:
                k += 1
                continue
            start = k
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            if k - start + p >= max(least, times * p):
                out.setdefault((start, k - start + p), p)
    return sorted((s, length, p) for (s, length), p in out.items())


def test_runs_equal_all_pairs(monkeypatch):
    rng = random.Random(7)
    for least, times in [(6, 4)] * 120 + [(2, 2), (3, 3), (12, 2)] * 20:
        texts = []
        for _ in range(rng.randint(0, 7)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 25, 80, 300]), rng.choice([1, 2, 3, 40])
            t = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                t = t[:a] + [t[a + k % p] for k in range(n - a)]
            texts.append(np.array(t, np.int64))
        found = list(zip(*(x.tolist() for x in periodic_runs.find_runs(texts, least, times))))
        for k, t in enumerate(texts):
            assert [x[1:] for x in found if x[0] == k] == plain_runs(t.tolist(), least, times)


def test_extensions_equal_plain_ones():
    rng = np.random.default_rng(2)
    numbers = np.append(np.tile(rng.integers(0, 2, 37), 30), 99)
    numbers[500] = 7
    longest = periodic_runs.Extensions(numbers, np.zeros(len(numbers), np.int64))
    i = rng.integers(0, len(numbers) - 1, 3000)
    j = rng.integers(0, len(numbers), 3000)
    i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    want = [next((d for d in range(len(numbers) - b) if numbers[a + d] != numbers[b + d]), len(numbers) - b) for a, b in zip(i, j)]
    assert longest(i, j).tolist() == want


def test_periodic_runs_on_odd_rows(spark):
    texts = [None, "", " \n", "a", "a " * 9, "x y " * 4 + "x", "so it goes " * 20000, "ü\x1cü ü\x1cü ü\x1cü ü\x1cü ü\x1cü ü\x1cü", "a b c d e f a b c d e f"]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "q " * 6, "clash", 1), (4, "a " * 9, "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, words int")
    got = {r["doc_id"]: r for r in periodic_runs.digest(periodic_runs.detect(df)).collect()}
    assert [got[k]["n_runs"] for k in (0, 1, 2, 3, 8)] == [0] * 5 and got[0]["length"] is None
    pick = lambda k: tuple(got[k][c] for c in ("n_runs", "start", "length", "period", "exponent_milli"))
    assert pick(4) == (1, 0, 9, 1, 9000) and pick(5) == (1, 0, 9, 2, 4500) and pick(6) == (1, 0, 60000, 3, 20000000) and pick(7) == (1, 0, 6, 1, 6000) and pick(None) == (1, 0, 6, 1, 6000)
    plain = {r["doc_id"]: r["collapsed"] for r in periodic_runs.detect(df).collect()}
    assert plain[5] == "x y" and plain[6] == "so it goes" and plain[0] == ""
    assert periodic_runs.detect(df.limit(0)).count() == 0
    assert periodic_runs.detect(df).count() == len(rows)


def plain_tree(train, texts, depth):
    """Context-tree weighting by dictionaries: log10 probabilities of the texts' token sequences."""
    encoded = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    counts = defaultdict(lambda: [0, 0])

    def decisions(data):
        data = bytes(depth) + data
        for k in range(depth, len(data)):
            for b in range(8):
                yield [(data[k - d : k], b, data[k] >> (8 - b)) for d in range(depth + 1)], data[k] >> (7 - b) & 1

    for t in train:
        for path, bit in decisions(encoded(t)):
            for node in path:
                counts[node][bit] += 1
    pe = {s: lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1) for s, (a, b) in counts.items()}
    below, share, pw = defaultdict(float), {}, {}
    for s in sorted(counts, key=lambda s: -len(s[0])):
        pw[s] = pe[s] if len(s[0]) == depth else float(np.logaddexp(pe[s], below[s])) - np.log(2)
        share[s] = 1.0 if len(s[0]) == depth else float(np.exp(pe[s] - np.log(2) - pw[s]))
        if s[0]:
            below[s[0][1:], s[1], s[2]] += pw[s]
    out = []
    for t in texts:
        total = 0.0
        for path, bit in decisions(encoded(t)):
            path = [s for s in path if s in pe]
            p, left = 0.0, 1.0
            for s in path:
                kt = (counts[s][bit] + 0.5) / (sum(counts[s]) + 1)
                own = left if s is path[-1] else left * share[s]
                p, left = p + own * kt, left - own
            total += log10(p if path else 0.5)
        out.append(total)
    return out


@pytest.mark.parametrize("depth", [3, 5])
def test_context_trees_equal_plain_ones(spark, depth, monkeypatch):
    rng = random.Random(depth)
    words = ["the", "then", "Thé", "日本", "a\x00b", "x" * 30, "end."]
    texts = [None, "", " \t", "one", "The  the\nTHE"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["zebra quickly jumps", "the then " * 300]
    texts += texts[5:8]
    rows = [(k, t, "x", 1.0) for k, t in enumerate(texts)] + [(None, "the end.", "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, score double").repartition(3)
    held = F.col("doc_id") % 4 == 1
    train = [t for k, t, *_ in rows if k is None or k % 4 != 1]
    want = plain_tree(train, [t for _, t, *_ in rows], depth)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    count = defaultdict(int)
    for t in train:
        for w in tokens(t):
            count[w] += 1
    n, v = sum(count.values()), len(count)
    for small in (False, True):
        if small:  # borders of runs, packs and blocks inside texts
            for name, value in (("_RUN", 97), ("_PACK", 50), ("_BLOCK", 700), ("_ROWS", 64)):
                monkeypatch.setattr(context_tree, name, value)
        got = {r["doc_id"]: r for r in context_tree.score(df, held, depth=depth).collect()}
        assert len(got) == len(rows)
        for (k, t, *_), s in zip(rows, want):
            r = got[k]
            assert abs(r["score"] - s) < 1e-5 * max(1, -s), (k, t)
            assert r["held_out"] == (k is not None and k % 4 == 1) and r["train_tokens"] == n
            assert r["n_tokens"] == len(tokens(t)) and r["n_known"] == sum(count[w] > 0 for w in tokens(t))
            assert abs(r["base_score"] - sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) < 1e-6 * max(1, -s)


def test_a_block_takes_little_more_memory_than_its_text():
    import tracemalloc

    import numpy as np

    own = " ".join(f"word{k % 50:06d}" for k in range(40)).encode() + b"\n"
    b = object.__new__(context_tree.Block)
    b.block, b.raw = 0, own * 10_000 + b"\n"  # the last text is empty
    b.sizes = np.array([len(own)] * 10_000 + [1])
    b.starts, b.train = np.cumsum(b.sizes) - b.sizes, np.ones(len(b.sizes), bool)
    tracemalloc.start()
    words, at, n_words, n = b.words()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 40 and len(at) == 400_000 and n_words.tolist() == [40] * 10_000 + [0] and n.tolist() == [10_000] * 40
    assert peak < 8 * len(b.raw)


def test_context_trees_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.score(df, F.lit(True)).collect()}
    assert abs(got[1]["score"] + 5 * 8 * log10(2)) < 1e-6 and abs(got[1]["bits_per_byte"] - 8) < 1e-6 and got[2]["n_tokens"] == 1 and got[1]["base_score"] == 0
    assert context_tree.score(df.limit(0), F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        context_tree.score(df, F.lit(False), depth=6)


def test_trees_beat_token_counts_on_unseen_texts(spark):
    rows = [r for r in QUERIES["op13_context_tree"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert len(rows) > 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
