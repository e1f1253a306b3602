"""N-gram Jaccard join by grouped prefixes.

The set of a document is its distinct word shingles, as 64-bit hashes.  Equal
sets collapse first (a node for each different set).  Any total order of
shingles makes prefix filtering exact; ours puts shingles of long words first
(bytes of the words alone, ties by hash), which are rare, and shingles found in many
prefixes last (a bitmap says which), so few documents meet under one shingle.

Nodes of the same size and prefix form a group, and only groups are posted under
shingles.  Groups that share a prefix shingle are a candidate pair if their
sizes, the number of shingles their prefixes share and, for groups of one
member, their sketches allow the similarity.  Only pairs left after that are
expanded to members, which are verified on whole sets.

Copies are not expanded into all pairs: in rounds of star links the members of
each group meet one centre of their own group and of each shingle, which settles
most components.  Rounds go on, with other centres, while many groups that meet
lie in different components and the last round made them fewer.  After that only
groups that still lie in different components, or whose own members do, are
paired, all of them.  So no link between components is lost.

A null or wordless text has an empty set and links with nothing.  Repeated rows
give repeated results; a null id takes part, and a component's id is the least
id that isn't null.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._graph import connected_components
from larkspur.llm._spark import bit_filter, checkpointed, filter_bits, gathered, in_batches
from larkspur.llm._words import NOT_SPACE, as_bytes, byte_table, mix, runs, words_of

_TABLE = byte_table(NOT_SPACE)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)


def shingles(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, (hashes of its shingles, the bytes of their words), repeats included.

    Both depend on the words alone, not on what stands between them.
    """
    for first, last in runs(texts):
        word, start, end, begin = words_of(texts[first:last], *_TABLE)
        n = max(0, len(word) - size + 1)
        whole = np.zeros(n, np.uint64)
        for k in range(size):
            whole += word[k : k + n] * _FACTORS[k]
        spent = np.concatenate(([0], np.cumsum(end - start)))
        whole, long = mix(whole), spent[size : size + n] - spent[:n]
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if b - a >= size:
                yield whole[a : b - size + 1], long[a : b - size + 1]
            elif b > a:
                yield mix((word[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)), spent[b : b + 1] - spent[a]
            else:
                yield whole[:0], long[:0]


def _node(sets: np.ndarray) -> int:
    return int(mix(sets + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(sets))) if len(sets) else 0


def _sketch(sets: np.ndarray) -> np.ndarray:
    """For each of 256 classes of shingles, whether their number is odd.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    odd = (np.bincount((sets >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate([np.zeros(0, np.uint64), *parts]))))


def _signatures(size: int, percent: int, hot, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = None if hot is None else np.unpackbits(np.frombuffer(hot.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            n, nodes, prefixes, sketches = [], [], [], []
            for hashes, long in shingles(as_bytes(batch.column("text")), size):
                sets, at = np.unique(hashes, return_index=True)
                rank = -np.minimum(long[at], 255)
                if common is not None:
                    rank = rank + 256 * common[(sets & np.uint64((1 << bits) - 1)).astype(np.int64)]
                keep = len(sets) - -(-percent * len(sets) // 100) + 1 if len(sets) else 0
                sketches.append(_sketch(sets))
                n.append(len(sets))
                nodes.append(_node(sets))
                prefixes.append(sets[np.argsort(rank, kind="stable")[:keep]])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                "node": pa.array(_signed(np.array(nodes, np.uint64))), "prefix": _lists(prefixes),
                **{f"s{k}": pa.array(np.array([x[k] for x in sketches], np.int64)) for k in range(4)},
            })

    return work


def _members(size: int, wanted, bits: int):
    """Whole sets of the nodes that the bitmap lets through, once for each node and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, mask, done = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").view(bool), (1 << bits) - 1, set()
        for batch in batches:
            nodes, sets = [], []
            for hashes, _ in shingles(as_bytes(batch.column("text")), size):
                own = np.unique(hashes)
                node = _node(own)
                if len(own) and ask[node & mask] and node not in done:
                    done.add(node)
                    nodes.append(node)
                    sets.append(own)
            yield pa.RecordBatch.from_pydict({"node": pa.array(_signed(np.array(nodes, np.uint64))), "members": _lists(sets)})

    return work


def _posted(shared, bits: int):
    """(token, grp, n) of the prefix shingles that the bitmap lets through."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            lists = batch.column("prefix")
            token = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            good = ask[token & (1 << bits) - 1]
            at = pa.array(row[good])
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[good]), "grp": batch.column("grp").take(at), "n": batch.column("n").take(at)})

    return work


def similar_components(
    documents: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
    star_rounds: int = 1, most_rounds: int = 6, few_apart: int = 8, crowd_least: int = 8, few_pairs: int = 100_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents link from ``percent`` % Jaccard similarity on.

    Bitmaps are broadcast with about 8 bits a value, 4 MB at most; beyond that they
    let more through, and the joins behind them still keep only what belongs.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {id_type}, n long, node long, prefix array<long>, s0 long, s1 long, s2 long, s3 long"

    plain = in_batches(rows, _signatures(size, percent, None, 0), form)
    counted = plain.select(F.explode("prefix").alias("token")).groupBy("token").count()
    hot = checkpointed(counted.where(F.col("count") > crowd_least).select("token"))
    del plain, counted
    hot_bits = filter_bits(hot.count(), 25)
    common = spark.sparkContext.broadcast(bit_filter(hot, "token", hot_bits))
    signed = checkpointed(in_batches(rows, _signatures(size, percent, common, hot_bits), form))

    # A group is the nodes of one size and prefix, named by the least of them.
    marks = signed.where("n > 0").select("node", "n", F.xxhash64("prefix").alias("own"), F.hash("prefix").alias("own2"))
    groups = marks.groupBy("own", "own2", "n").agg(F.min("node").alias("grp"))
    grouped = checkpointed(marks.distinct().join(groups, ["own", "own2", "n"]).select("node", "n", "grp"))
    heads = signed.where("n > 0").join(grouped.where("node = grp").select("node", "grp"), "node").dropDuplicates(["node"]).select("grp", "n", "prefix")
    heads = checkpointed(heads)
    shared = heads.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    shared = checkpointed(shared)
    bits = filter_bits(shared.count(), 25)
    common = spark.sparkContext.broadcast(bit_filter(shared, "token", bits))
    posted = in_batches(heads, _posted(common, bits), "token long, grp long, n long")
    # Sizes that allow the similarity differ by one step of this scale at most: entries stand under their step and the next.
    step = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))))
    posted = posted.select(F.explode(F.array(F.struct(F.xxhash64("token", step).alias("token"), F.lit(False).alias("next")), F.struct(F.xxhash64("token", step + 1).alias("token"), F.lit(True).alias("next")))).alias("p"), "grp", "n").select("p.token", "p.next", "grp", "n")
    many = posted.groupBy("token").agg(F.count("*").alias("many")).where("many > 1").select("token")
    places = checkpointed(posted.join(many, "token").select("token", "grp", "n", "next"))
    crowds = places.groupBy("token").agg(F.count("*").alias("many"))
    # What a group shares with others: most for the document that copies were made from.
    shares = places.join(crowds, "token").groupBy("grp").agg(F.sum("many").alias("shares"))
    crowded = grouped.groupBy("grp").agg(F.count("*").alias("members")).join(shares, "grp", "left").where("members > 1 or shares is not null")
    sketches = signed.where("n > 0").groupBy("node").agg(*[F.first(f"s{k}").alias(f"s{k}") for k in range(4)])
    active = grouped.join(crowded.select("grp", "members", F.coalesce("shares", F.lit(0)).alias("shares")), "grp")
    active = checkpointed(active.join(sketches, "node"))
    nodes = active.count()
    active = gathered(active, nodes, 5000)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        many = pairs.count()
        pairs = gathered(pairs, many, 20_000)
        bits = filter_bits(min(2 * many, nodes), 25)
        asked = spark.sparkContext.broadcast(bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("a")), "a", bits))
        sets = in_batches(rows.select("text"), _members(size, asked, bits), "node long, members array<long>").groupBy("node").agg(F.first("members").alias("members"))
        left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
        # One set of each pair goes to the other's place: sets by node are where they are made, so only these move.
        near = F.broadcast(pairs) if many <= few_pairs else pairs  # 16 bytes each
        both = left.join(near, "a").join(right, "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    apart = " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(4))
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    fits = f"{sizes} and {apart} <= x.n + y.n - 2 * ceil({percent} * (x.n + y.n) / {100 + percent})"
    sketch = [f"s{k}" for k in range(4)]
    labels = active.withColumn("root", F.col("node"))
    links = spark.createDataFrame([], "a long, b long")
    most_apart, last = few_apart * nodes, None

    def meetings(whole: DataFrame) -> float:
        """How often two groups of different components, or of several ones, stand under one shingle."""
        own = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("grp"))
        each = places.select("token", "grp").join(whole.select("grp", own.alias("own")), "grp").groupBy("token", "own").agg(F.count("*").cast("double").alias("c"))
        return each.groupBy("token").agg((F.pow(F.sum("c"), F.lit(2)) - F.sum(F.col("c") * F.col("c"))).alias("n")).agg(F.sum("n") / 2).first()[0] or 0.0

    for turn in range(max(star_rounds, most_rounds) + 1):
        # Roots of a group's members, and the sketch of the node that names it: the sketch of all where there is one member.
        whole = checkpointed(labels.groupBy("grp").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n"), F.first("members").alias("members"), F.first("shares").alias("shares"),
            *[F.max(F.when(F.col("node") == F.col("grp"), F.col(c))).alias(c) for c in sketch], F.max(F.when(F.col("node") == F.col("grp"), F.col("root"))).alias("root"),
        ))
        kinds = places.select("token", "grp").join(whole.select("grp", "low", "high"), "grp").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("many")).where("low < high")
        final = turn >= star_rounds
        if final and turn < most_rounds:
            left = meetings(whole)
            final, last = left <= most_apart or (last is not None and left > 0.9 * last), left
        if not final:
            kinds = kinds.where(F.col("many") > crowd_least)
        at = places.join(kinds.select("token"), "token").select("token", "grp", "next").join(whole, "grp")
        split = whole.where("low < high").select("grp")
        if final:
            # Pairs of groups first. Two sets whose prefixes share c shingles have at most c more in common than the larger rest behind a prefix.
            alike = f"x.grp < y.grp and not (x.next and y.next) and {sizes} and (x.low < x.high or y.low < y.high or x.low <> y.low) and (x.members > 1 or y.members > 1 or ({fits}))"
            counted = at.alias("x").join(at.alias("y"), "token").where(alike)
            counted = counted.groupBy(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).agg(F.count("*").alias("c"), F.first("x.n").alias("nx"), F.first("y.n").alias("ny"), F.first(F.expr("x.members < y.members")).alias("turned"))
            rest = F.ceil(percent * F.greatest("nx", "ny") / 100) - 1
            chosen = counted.where(F.col("c") + rest >= F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent)))
            # The group of more members comes first.
            chosen = chosen.select(F.when(F.col("turned"), F.col("h")).otherwise(F.col("g")).alias("g"), F.when(F.col("turned"), F.col("g")).otherwise(F.col("h")).alias("h"))
            # Those left are expanded to their members, and a group is paired with itself.
            chosen = checkpointed(chosen.union(split.select(F.col("grp").alias("g"), F.col("grp").alias("h"))))
            # Its members must allow a link with the other group's only one, or not lie in the component of all the others.
            able = f"(y.members = 1 and x.root <> y.root and {fits}) or (y.members > 1 and not (y.low = y.high and x.root = y.low))"
            pairs = chosen.join(whole.alias("y"), F.col("h") == F.col("y.grp")).join(labels.alias("x"), (F.col("g") == F.col("x.grp")) & F.expr(able))
            pairs = pairs.join(labels.alias("z"), F.col("h") == F.col("z.grp")).where(f"x.root <> z.root and (g <> h or x.node < z.node) and {fits.replace('y.', 'z.')}")
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("z.node").alias("b"))
        else:
            first = F.xxhash64("grp", F.lit(turn)) if turn else -F.col("shares")
            centre = at.groupBy("token").agg(F.min(F.struct(first.alias("d"), "grp")).alias("c")).select("token", F.col("c.grp").alias("h"))
            near = at.select("token", F.col("grp").alias("g")).join(centre, "token").select("g", "h").where("g <> h").distinct()
            # Members of each group against the node that names the centre, of another group or of their own.
            near = near.union(split.select(F.col("grp").alias("g"), F.col("grp").alias("h")))
            pairs = near.join(whole.alias("y"), F.col("h") == F.col("y.grp")).join(labels.alias("x"), F.col("g") == F.col("x.grp")).where(f"x.root <> y.root and {fits}")
            pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.grp").alias("b"))
        links = checkpointed(links.union(verified(pairs)))
        roots = connected_components(links)
        links = roots.where("node <> root").toDF("a", "b")
        labels = checkpointed(active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        if final:
            break

    known = signed.select("doc_id", "n", "node")
    linked = labels.where("node <> root").select("node", "root")
    linked = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    named = known.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(low, "root").select("node", "component_id")
    return known.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
