"""The numbered operators against brute force, on small tables with nulls, ties, empties and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import _graph, chat_format, decontaminate, jaccard_join, language_id, lexicon_bpe, line_dedup, perplexity, suffix_dedup, token_store, tokens, url_rules
from larkspur.llm.queries import HOST_RULES, ORACLE_SQL, QUERIES, tokenizer

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "ü", "word " * 30000, "<|endoftext|> don't 12³ 日本 \x1c x", "😀", "it's  two   gaps \r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_000 + k, t, None) for k, t in enumerate(ODD)] + [(None, "null id " * 80, "en"), (10_001, "", None)], "doc_id long, text string, lang string")
    return real.unionByName(odd).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def counted(rows):
    return Counter(map(tuple, rows))


def test_op1_base_measures(spark, docs, rows):
    got = {r["doc_id"]: r for r in perplexity.judge(docs).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = list(zip(words, words[1:], words[2:]))
        times, hit = Counter(windows), set()
        for k, w in enumerate(windows):
            hit |= {k, k + 1, k + 2} if times[w] > 1 else set()
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op1_probabilities_sum_to_one(spark, docs):
    model = perplexity.fit(docs.select("text", "lang"))
    for context in (b"the ", b"e th", "日".encode() + b" "):
        grams = int.from_bytes(context) << 8 | np.arange(256)
        p = np.exp(model.log_probability(np.full(256, model.slot("en")), grams))
        assert abs(p.sum() - 1) < 1e-3


def plain_perplexities(rows, order=5):
    """Log-perplexity of each (text, lang, half) row under modified Kneser-Ney of the other half, by dictionaries."""
    grams = lambda t: [t[k : k + order] for k in range(len(t) - order + 1)]
    rows = [((t or "").encode(), lang, half) for t, lang, half in rows]
    models = {}
    for lang, half in {(x, h) for _, x, _ in rows for h in (0, 1)}:
        by = {order: Counter(g for t, x, h in rows if (x, h) == (lang, half) for g in sorted({*grams(t)}))}
        for k in range(order - 1, 0, -1):
            by[k] = Counter(g[1:] for g in by[k + 1])
        p, weight = {b"": 1 / 256}, {}
        for k in range(1, order + 1):
            n = Counter(by[k].values())
            y = n[1] / max(n[1] + 2 * n[2], 1)
            cut = [0] + [max(0.05, j - (j + 1) * y * n[j + 1] / n[j]) if n[j] and n[j + 1] else 0.5 * j for j in (1, 2, 3)]
            total, less = Counter(), Counter()
            for g, c in by[k].items():
                total[g[:-1]] += c
                less[g[:-1]] += min(cut[min(c, 3)], c)
            weight |= {c: less[c] / total[c] for c in total}
            p |= {g: (c - min(cut[min(c, 3)], c) + less[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, c in by[k].items()}
        seen = [g for g in by[1]]
        rest = max(1 - sum(p[g] for g in seen), 1e-12) / max(256 - len(seen), 1) if seen else 1 / 256
        models[lang, half] = p, weight, rest

    def price(g, p, weight, rest):
        w = 1.0
        while g:
            if g in p:
                return w * p[g]
            w *= weight.get(g[:-1], 1.0) if len(g) > 1 else 1.0
            g = g[1:]
        return w * rest

    out = []
    for t, lang, half in rows:
        own = grams(t)
        n = sum(g[-1] & 0xC0 != 0x80 for g in own)
        out.append(-sum(np.log(price(g, *models[lang, 1 - half])) for g in own) / n if n else None)
    return out


def test_op1_both_ways_equal_a_plain_model(spark, docs, monkeypatch):
    # Many languages.
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("l"), F.col("doc_id"))).otherwise(F.col("lang")))
    many = many.where(F.length(F.coalesce("text", F.lit(""))) < 20_000)
    rows = [(r["doc_id"], r["text"], r["lang"], r["h"]) for r in many.withColumn("h", perplexity.half()).collect()]
    want = sorted((str(i), x) for (i, *_), x in zip(rows, plain_perplexities([r[1:] for r in rows])) if x is not None)
    assert len({r[2] for r in rows}) > 17
    few, joined = (perplexity.judge(many, most_keys=n).collect() for n in (10**7, 0))
    for got in (few, joined):
        logs = sorted((str(r["doc_id"]), np.log(r["perplexity"])) for r in got if r["perplexity"] is not None)
        assert len(got) == len(rows) and [i for i, _ in logs] == [i for i, _ in want] and np.allclose([x for _, x in logs], [x for _, x in want], atol=2e-3)
    assert counted((r["doc_id"], r["n_words"], r["kept"]) for r in few) == counted((r["doc_id"], r["n_words"], r["kept"]) for r in joined)
    monkeypatch.setattr(perplexity, "_PIECE", 300)  # borders inside most texts
    few, joined = (perplexity.judge(many, most_keys=n).collect() for n in (10**7, 0))
    assert counted((r["doc_id"], r["perplexity"] and round(r["perplexity"], 1)) for r in few) == counted((r["doc_id"], r["perplexity"] and round(r["perplexity"], 1)) for r in joined)


def test_op1_rejects_noise_of_any_length(spark):
    """Random letters of five alphabets, 90 to 20 000 words, in an otherwise clean corpus; nearly all clean texts stay."""
    rng = random.Random(5)
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    alphabets = ["qxzjvkw", "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмн", "αβγδεζηθικλ", "一二三四五六七八九十"]
    junk = [(-1 - k, " ".join("".join(rng.choice(a) for _ in range(rng.randint(3, 8))) for _ in range(n)), "en")
            for k, (a, n) in enumerate((a, n) for a in alphabets for n in (90, 300, 600, 1200, 2400, 5000, 20000))]
    both = clean.unionByName(spark.createDataFrame(junk, clean.schema))
    for most in (10**7, 0):
        got = perplexity.judge(both, most_keys=most).collect()
        mine = [r for r in got if r["doc_id"] < 0]
        rest = [r for r in got if r["doc_id"] >= 0 and not r["base_failed"]]
        assert len(mine) == len(junk) and sum(not r["kept"] for r in mine) >= 0.9 * len(junk)
        assert sum(not r["kept"] for r in rest) <= 0.02 * len(rest)


def test_op1_verdict_follows_the_bands(spark, docs):
    """Bands are quartiles of the language's log-perplexities, three distances beyond, in steps of a thousandth."""
    got = perplexity.judge(docs).withColumn("lang", F.lit(None)).drop("lang").join(docs.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        logs = sorted(np.floor(np.log(r["perplexity"]) / 1e-3 + 1e-9) for r in got if r["lang"] == lang and r["perplexity"] is not None)
        q1, q3 = (logs[int(np.ceil(q * len(logs))) - 1] * 1e-3 for q in (0.25, 0.75))
        far = 3 * max(q3 - q1, 0.1)
        for r in got:
            if r["lang"] == lang and r["perplexity"] is not None:
                assert abs(np.log(r["lower_band"]) - (q1 - far)) < 0.01 and abs(np.log(r["upper_band"]) - (q3 + far)) < 0.01
                inside = r["lower_band"] <= r["perplexity"] <= r["upper_band"]
                assert r["kept"] == (inside and not r["base_failed"]) or abs(np.log(r["perplexity"] / r["upper_band"])) < 1e-6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_line_dedup(texts, least=40, edits=2):
    """{doc_id: (kept, n_removed, n_links)} and {(doc_id, place): class} by comparing all lines; ids differ."""
    places = [(i, k, x) for i, t in texts for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\v\f\r")]
    first = {}
    for i, k, x in places:
        first.setdefault(x, (i, k))
    root, lines = {x: x for x in first}, list(first)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(lines):
        for y in lines[:a]:
            if min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= edits and top(x) != top(y) and distance(x, y) <= edits:
                root[top(x)] = top(y)
    start, members = {}, Counter()
    for x in lines:
        start[top(x)] = min(start.get(top(x), first[x]), first[x])
        members[top(x)] += 1
    times = Counter(x for _, _, x in places)
    out = {}
    for i, t in texts:
        own = [(k, x) for j, k, x in places if j == i]
        gone = {k for k, x in own if start[top(x)] != (i, k)}
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        out[i] = kept, len(gone), sum(members[top(x)] - 1 for _, x in own)
    return out, {(i, k): top(x) for i, k, x in places if times[x] > 1 or members[top(x)] > 1}


def mutated(rng, base, n, letters, most):
    lines = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, most)):
            k = rng.randrange(len(s))
            s[k : k + rng.randint(0, 1)] = rng.choice(letters)
        lines.append("".join(s))
    return lines


@pytest.mark.parametrize(("letters", "crowd", "group"), [("abcdefgh ", 16, 2048), ("日本語中文абвгdeé😀 ", 0, 2048), ("abcdefgh ", 0, 7), ("日本語中文абвгdeé😀 ", 0, 2)])
def test_op2_against_all_pairs(spark, letters, crowd, group):
    rng = random.Random(crowd + group)
    base = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(9)]
    lines = mutated(rng, base, 110, ["", *letters[:3]], 4) + ["short one", "short one", "short two", "\t", ""] * 2
    rng.shuffle(lines)
    texts = [(k, "\n".join(lines[4 * k : 4 * k + 4])) for k in range(30)] + [(98, None), (99, "")]
    df = spark.createDataFrame([(i, t, "own") for i, t in texts], "doc_id long, text string, gone string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, crowd=crowd, group=group, classes=True).collect()}
    want, classes = plain_line_dedup(texts)
    assert {i: (r["kept"], r["n_removed"], r["n_links"]) for i, r in got.items()} == want
    found = {(i, place): c for i, r in got.items() for place, c in r["classes"]}
    assert set(found) == set(classes) and len({(found[k], classes[k]) for k in found}) == len(set(found.values())) == len(set(classes.values()))


def test_op2_work_grows_with_a_group_not_its_pairs(spark):
    """Near copies of one line, all of different texts: a few links a line hold the class together."""
    rng = random.Random(5)
    line, per_line = "".join(rng.choice("abcdefghij ") for _ in range(400)), []
    for n in (250, 500, 1000):
        own = rng.sample([line[:k] + x + line[k + 1 :] for k in range(400) for x in "xyz"], n)  # all within two edits of each other
        df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
        per_line.append(line_dedup.line_links(df, 40, 2, 16, 2048)[0].count() / n)
    got = line_dedup.dedup_lines(df, classes=True).collect()
    assert len({x["class_id"] for r in got for x in r["classes"]}) == 1 and sum(r["kept"] != "" for r in got) == 1 and {r["n_links"] for r in got} == {999}
    assert max(per_line) < 40 and per_line[2] < 1.5 * per_line[0]


def test_op3_against_all_strings(spark, docs):
    for crowd in (512, 1):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_spans(docs, crowd=crowd).collect())
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
        want = Counter()
        for i, t in texts:
            gone = np.zeros(len(t) + 1, bool)
            for k in range(len(t) - 399):
                if seen[t[k : k + 400]] > 1:
                    gone[k : k + 400] = True
            kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
            want[(i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
        assert got == want


def test_op4_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 34", None), (-3, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("crc32(cast(doc_id as string)) % 3 <> 1").select("text", "lang"))
    judged = language_id.identify(docs.select("doc_id", "text", "lang").union(odd), model).collect()
    assert {r["lang_pred"] for r in judged if r["doc_id"] < 0} == {"und"} and all(0 <= r["score"] <= 1 for r in judged)
    held = [r for r in judged if r["doc_id"] >= 0 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert language_id.identify(odd, language_id.fit(odd.select("text", "lang"))).where("lang_pred = 'und'").count() == 3


def test_codewords_are_apart():
    for n in (2, 4, 5, 9):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_op5_and_op9_equal_the_library(spark, docs, rows, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(i, t): library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = lexicon_bpe.encode(docs, tokenizer(), top=500, keep=True).collect()
    want = counted([(i, tuple(ids[i, t]), library.decode(ids[i, t], skip_special_tokens=False)) for i, t in rows])
    assert counted([(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got]) == want
    token_store.write_store(docs, str(tmp_path / "store"), tokenizer(), 2)
    stored = token_store.read_store(spark, str(tmp_path / "store")).orderBy("start").collect()
    assert counted([(r["doc_id"], tuple(r["ids"])) for r in stored]) == counted([(i, (*ids[i, t], 2)) for i, t in rows])
    assert [r["start"] for r in stored] == np.cumsum([0] + [r["n_tokens"] for r in stored])[:-1].tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in stored]
    assert keys == sorted(keys)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 300, 1 << 20, 1 << 40, 1 << 63):
        counts = rng.integers(0, 90, 40)
        ids = rng.integers(0, top, counts.sum(), dtype=np.uint64, endpoint=True)
        words, offsets = token_store.pack(ids, counts)
        assert (token_store.unpack(words, offsets, counts) == ids).all()


def test_transducer_shares_suffixes():
    words = {w: [k, k + 1] for k, w in enumerate([b"", b"walking", b"talking", b"talk", b"walk", b"b"])}
    made = lexicon_bpe.Transducer.mapped(lexicon_bpe.Transducer.build(words).to_bytes())
    assert made.look_up([*words, b"tal", b"walkings", b"x"]) == [*words.values(), None, None, None]
    assert len(made.final) <= 10


def test_op6_round_trip(spark):
    texts = ["<|im_end|>", "<~|im_start|>", "a<|b", "", None, "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<~~|", "plain"]
    roles = ["user", "assistant", None, "a\nb", "<|im_end|>%0A"]
    for role in roles:
        for text in texts:
            assert chat_format.parse(chat_format.render(role or "", text or "")) == [(role or "", text or "")]
    turns = [(None if k == 3 else k % 3, k, roles[k % 5], texts[k % 8]) for k in range(40)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (None, 0, 1, 2):
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7_fm_index_and_blocks(spark, docs):
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = decontaminate.FMIndex(text)
    phrases = rng.integers(1, 4, (60, 5)).astype(np.int32)
    row, low, high = index.search(phrases)
    found = {int(r): sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(row, low, high)}
    for k, p in enumerate(phrases):
        want = [i for i in range(297) if (text[i : i + 5] == p).all()]
        assert found.get(k, []) == want
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(None, "null id"), (-5, None), (-6, "a")], "item_id long, text string"))
    one = decontaminate.digest(decontaminate.scan(docs, bench))
    many = decontaminate.digest(decontaminate.scan(docs, bench, block_bytes=2000))
    assert counted(one.collect()) == counted(many.collect())
    assert one.where("doc_id = 10004").first()["n_hit"] == 1


def test_op8_rules(spark):
    urls = ["https://a.com/x", "http://www.example.com/en/1", "http://x.example.com/en/1", "HTTP://b.NET/fr/", "ftp://b.net", None, "no scheme", "http://free-bets.example.org/", "http://q.org/?u=free-bets", "http://com/"]
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), HOST_RULES).collect()}
    assert [got[k][1:] for k in range(10)] == [("com/", "allow"), ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("com/", "allow")]
    assert got[3][0] == "b.net" and got[5][0] == ""


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel, df = db.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(rel.columns)
    assert counted(df.select(rel.columns).collect()) == Counter(rel.fetchall())


def test_op10_against_all_pairs(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 9) for _ in range(120)] for _ in range(5)]
    texts = [None, "", "one", "One", "two words", "x y z"]
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = "q" * rng.randint(1, 30)
        texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for least in (8, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(df, crowd_least=least).collect()}
        assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_op8_all_patterns_go_through_the_index(spark):
    urls = ["http://porn.a.com/", "http://a.XXX.b.com/", "http://x.xxx-y.org", "http://aporn.com/", "http://b.com/porn.html", "http://free-bets.com/", "http://c.com/wp-login.php", "//xxx."]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(frame, []).collect()}
    assert got == {k: "block" if any(re.search(p.pattern, u.lower()) for p in url_rules.PATTERNS) else "allow" for k, u in enumerate(urls)}
    keys = url_rules.rarest_tokens(frame, url_rules.PATTERNS)
    assert all(url_rules.index_tokens(keys, url_rules.PATTERNS))
    plan = url_rules.judge_urls(frame, [])._jdf.queryExecution().optimizedPlan().toString()
    assert "porn" not in plan and "Union" not in plan


def plain_components(texts, size, percent):
    """(size of the set, least place in the component) of each text, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def test_op10_white_space_between_words(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(60, 200))]
        for k in range(4):
            own = list(words)
            for _ in range(k and rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "q" * rng.randint(1, 9)
            gaps = [" "] * len(own)
            for _ in range(k and 12):
                gaps[rng.randrange(len(own))] = rng.choice(["  ", "\n\n", "\r\n", "\n" + " " * 30, "\t" * 9])
            texts.append("".join(w + g for w, g in zip(own, gaps)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(plain_components(texts, 3, 90)))
    for least in (8, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(df, crowd_least=least).collect()}
        assert got == want


def test_pipeline_keeps_short_lines(spark):
    license = "Permission is hereby granted to copy this text, free of charge, to anyone."
    verse = [f"{license}\n" + "\n".join(f"line {k} of verse {d}" for k in range(30)) for d in range(4)]
    texts = [license, *verse, f" \n{license}\n\t\n", f"{license}\nend", None, "", " "]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    want = [license, *[v.removeprefix(license + "\n") for v in verse], None, "end", None, "", " "]
    assert got == {k: (t, None if t is None else len(t)) for k, t in enumerate(want) if k != 5}


def test_pipeline_near_duplicates(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(250)]
        texts.append(" ".join(words))
        for edits in (5, 9, 20):
            own = list(words)
            for k in range(edits):
                own[(2 * k + 1) * 125 // edits] = "q" * rng.randint(1, 9)
            texts.append(" ".join(own))
    rows = [(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)]
    rows += [rows[1], rows[1], rows[0], rows[0], (1, texts[-1]), (None, "alone"), (None, "alone too")]
    rng.shuffle(rows)
    component = [r for _, r in plain_components([t for _, t in rows], 5, 80)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    place = {row: c for row, c in zip(rows, component)}
    assert sorted(place[row] for row in got) == sorted(set(component))
    low = {c: min((i is None, i or 0) for (i, _), own in zip(rows, component) if own == c) for c in component}
    assert all((i is None, i or 0) == low[place[i, t]] for i, t in got)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert jaccard_join.similar_components(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert perplexity.judge(none).count() == 0
    assert perplexity.judge(none, most_keys=-1).count() == 0
    assert lexicon_bpe.encode(none, tokenizer()).count() == 0


def test_words_of_all_scripts_equal_the_library():
    coder, rng = tokenizer(), random.Random(3)
    lexicon = lexicon_bpe.Transducer.build({w.encode(): coder.merged(w.encode()) for w in (" text", "日本語の文章です", " мир")})
    run = lexicon_bpe.LexiconCoder(coder, lexicon)
    pool = [
        "“quoted” text—dash…", "日本語の文章です", "Привет мир!", "emoji 😀👍🏽 👩‍👩‍👧", "it’s 'll don't   x　y", "\x1c\x1d a b\u0085c", "१२३ ½ ²³", "\u0378\U000323b0 new",
        " " * 20 + "\n\n \t x", "<|endoftext|>", "ﬁ ligature İı ß", "한국어 조사", "العربية ١٢٣",
    ]
    for _ in range(1500):
        other = [chr(rng.randrange(0x20, 0x3000)), chr(rng.choice([rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x110000)]))]
        text = "".join(rng.choice(pool + other) for _ in range(rng.randint(1, 8)))
        want = coder.library_ids(text)
        assert coder.ids([text])[0].tolist() == want
        assert [int(x) for _, ids, _ in next(run.encode([text])) if ids for x in ids.split(b",")] == want
    assert run.found == 3 and run.missed > 100
    long = " " + "".join(rng.choice("abcdefgh") for _ in range(50_000))
    assert coder.merged(long.encode()) == coder.library_ids(long)


def test_many_near_copies_meet_few_centres(spark, monkeypatch):
    """Most pairs of a crowd link, but a first round settles nothing: further ones do, and not all pairs are formed."""
    rng, links, found = random.Random(5), [], jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda made: links.append(made.count()) or found(made))
    base, rows = [f"word{k}" for k in range(200)], []
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 2, 3])):
            own[at] = f"other{k}x{at}"
        rows.append((k, " ".join(own)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(df, 5, 80, star_rounds=0).collect()}
    assert got == dict(enumerate(root)) and max(links) < 10 * len(rows)


def test_components_of_few_links_need_few_tasks(spark, monkeypatch):
    """One task settles links that fit it; of more, tasks keep stars, and rounds over all of them do the rest."""
    rng, context = random.Random(8), spark.sparkContext
    pairs = [(k, k + 1) for k in range(400)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(7, 7), (2000, 2000), (None, 3), (5, None), (2, 1)] + [(3000, 3001)] * 3
    root: dict[int, int] = {}

    def least(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = least(a), least(b)
            root[max(a, b)] = min(a, b)
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(8).localCheckpoint()
    context.setJobGroup("components", "")
    assert sorted(map(tuple, _graph.connected_components(links).collect())) == sorted((x, least(x)) for x in root)
    context.setJobGroup("", "")
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 20
    for most in (50, 3):
        monkeypatch.setattr(_graph, "_TASK_LINKS", most)
        assert sorted(map(tuple, _graph.connected_components(links).collect())) == sorted((x, least(x)) for x in root)
    assert _graph.connected_components(links.limit(0)).count() == 0


def test_a_process_asks_for_a_frequent_word_once(monkeypatch):
    monkeypatch.setattr(tokens, "_HELD", 50)
    coder, asked = tokens.held_coder(tokenizer().file_text), Counter()
    assert coder is tokens.held_coder(tokenizer().file_text)  # tasks share what they have built
    made = tokens.Coder(coder.file_text)._word_ids
    coder = tokens.Coder(coder.file_text)
    coder.__dict__["_word_ids"] = lambda word: asked.update([word]) or made(word)
    for k in range(100):  # many more words than are held
        text = "often" + "".join(f" é{chr(97 + k // 10)}{chr(97 + k % 10)}{chr(97 + j)}" for j in range(5))
        assert coder.ids([text])[0].tolist() == coder.library_ids(text)
        assert len(coder._known) + len(coder._known.older) <= 150
    assert asked["often"] == 1 and len(asked) > 400


def test_pipeline_filters_on_odd_rows(spark):
    """The filtering stages on nulls, empty texts, repeated rows and clashing names, held against plain versions."""
    own = "own words of this text that nobody else has written down so far number"
    texts = [(1, f"{own} one\nA line that two documents share, word for word and letter for letter.", "en"), (2, f"{own} two and three\nA line that two documents share, word for word and letter for letter.", "en"),
             (3, None, None), (4, "", "en"), (5, "only\nonly", "en"), (6, "A line that two documents share, word for word and letter for letter.", "en")]
    rows = [(i, t, x, "s", None if t is None else len(t), "clash") for i, t, x in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, df, DATA).collect()}
    plain, _ = plain_line_dedup([(i, t) for i, t, *_ in rows])
    assert got == {i: kept for i, (kept, gone, _) in plain.items() if not gone or (kept or "").strip(" \t\n")}
    repeated = df.union(df).union(df.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long")))
    ids = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, repeated, DATA).collect())
    assert ids == [1, 2, 3, 4, 5, 6]
    assert corpus_pipeline.dedup_lines(spark, df.limit(0), DATA).count() == corpus_pipeline.drop_near_duplicates(spark, df.limit(0), DATA).count() == 0


def test_encoding_holds_little_of_a_batch(spark, monkeypatch):
    """A task's memory follows a part of a batch and the words it remembers, not all ids of the batch and all words before."""
    work, held = [], lexicon_bpe.in_batches
    monkeypatch.setattr(lexicon_bpe, "in_batches", lambda df, made, schema: work.append(made) or held(df, made, schema))
    lexicon_bpe.encode(spark.createDataFrame([(1, "a text of a few words")], "doc_id long, text string"), tokenizer(), keep=True)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(1400)) for _ in range(400)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400)), "text": pa.array(texts)})] * 2
    made = work[-1](iter(batches))
    first = next(made)
    tracemalloc.start()
    try:
        got = [first.num_rows] + [b.num_rows for b in made]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(got) == 800 and most < 50e6, most
    coder = tokenizer()
    for text, ids in list(zip(texts, first["ids"].to_pylist()))[:5]:
        assert ids == coder.library_ids(text)


def test_words_in_use_are_not_forgotten(monkeypatch):
    """Beyond the bound, words of before the last turn go; those met since then stay, and ids are the same."""
    monkeypatch.setattr(lexicon_bpe, "_HELD", 50)
    coder = tokenizer()
    run = lexicon_bpe.LexiconCoder(coder, lexicon_bpe.Transducer.build({}))
    for k in range(39):
        text = "often " + " ".join(f"w{chr(97 + j)}{chr(97 + k % 26)}{'x' * (k // 26)}" for j in range(20))
        assert [int(x) for _, ids, _ in next(run.encode([text])) for x in ids.split(b",")] == coder.library_ids(text)
        assert len(run._known) < 400
    merged = run.missed
    next(run.encode(["often"]))
    assert run.missed == merged


def test_words_merged_together_equal_those_merged_alone():
    coder, rng = tokenizer(), random.Random(6)
    words = [b"", b"a", b" ", b" the", "日本".encode()] + [bytes(rng.choice(b" aeinorst\xc3\xa9\xff") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert coder.merged_all(words, lot=100) == [coder.merged(w) for w in words] and coder.merged_all([]) == []
