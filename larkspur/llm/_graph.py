"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import checkpointed, in_batches

#: So many links go to one task, and are held by it, at most.
_TASK_LINKS = 1 << 18


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links, beside the least node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _forests(most: int):
    """(node, root) of the components of a task's links; where these are too many, of one part of them after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                a, b = (np.concatenate((x, batch.column(c).slice(k, most).to_numpy())) for x, c in ((a, "a"), (b, "b")))
                if len(a) > most:
                    a, b = _forest(a, b)
                    if len(a) > most // 2:
                        yield pa.RecordBatch.from_pydict({"node": pa.array(a), "root": pa.array(b)})
                        a, b = a[:0], b[:0]
        a, b = _forest(a, b)
        yield pa.RecordBatch.from_pydict({"node": pa.array(a), "root": pa.array(b)})

    return work


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the component's least node.

    ``links`` is read twice.  Tasks of a bounded number of links each turn theirs
    into stars around the least nodes; if all fit one task, that is the result.

    Else two star contractions alternate on what they gave until nothing changes:
    every node first hands its larger neighbours to the least one, then its
    smaller ones.  Both are a grouped minimum (combined before the shuffle) and a
    join that Spark can split on skew.  Null ends and loops are ignored; no links
    give no rows.
    """
    links = links.where(F.col(left) != F.col(right)).select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    n = links.count()
    stars = checkpointed(in_batches(links.coalesce(n // _TASK_LINKS + 1), _forests(_TASK_LINKS), "node long, root long"))
    if n <= _TASK_LINKS:
        return stars
    edges = checkpointed(stars.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
