"""Samples and their labels as column functions, and token vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.stem import stems
from larkspur.functions.text import plain_words, tag_post


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda x: (x == label).cast("int"))


def arg_max(values: Column) -> Column:
    """Place of the greatest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def flat(rows: Column) -> Column:
    """A two-dimensional sample as one array."""
    return F.flatten(rows)


def token_vectors(tokens: DataFrame, vectors: DataFrame, token: str, vector: str, size: int) -> DataFrame:
    """Tokens with their vectors; those that have none get zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return tokens.join(vectors.select(token, F.col(vector).cast("array<double>").alias(vector)), token, "left").withColumn(vector, F.coalesce(vector, zeros))


def mean_pool(rows: DataFrame, owner: str, vector: str, size: int | None = None) -> DataFrame:
    """(owner, dim, value): the mean of the owner's vectors by dimension.

    Where all vectors have ``size`` values (others are an error then), an owner's sums are one row and not one for each dimension.
    """
    if size is None:
        return rows.select(owner, F.posexplode(vector).alias("dim", "v")).groupBy(owner, "dim").agg(F.avg("v").alias("value"))
    whole = F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector without {size} values")).cast("array<double>"))
    means = rows.where(F.col(vector).isNotNull()).select(owner, whole.alias("v")).groupBy(owner).agg(F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(size)]).alias("m"))
    return means.select(owner, F.posexplode("m").alias("dim", "value"))


def item_popularity(ratings: DataFrame, item: str) -> DataFrame:
    return ratings.groupBy(item).agg(F.count("*").alias("n"))


def popular_items(ratings: DataFrame, item: str, top: int) -> DataFrame:
    """The ``top`` items with most ratings (ties: the least id), with their place in id order."""
    kept = item_popularity(ratings, item).orderBy(F.desc("n"), item).limit(top)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(item)) - 1)


def rating_rows(ratings: DataFrame, user: str, item: str, value: str, top: int) -> DataFrame:
    """(user, x): a user's ratings of the most popular items in id order, 0 where there are none."""
    items = popular_items(ratings, item, top).select(item, "place")
    own = ratings.join(F.broadcast(items), item).groupBy(user, "place").agg(F.max(value).alias("v"))
    held = own.groupBy(user).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    return held.select(user, F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("x"))


def labelled(rows: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, x, y): rows with the label of their key; those without a label are left out."""
    return rows.join(labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("y")), key).select(key, "x", "y")


def char_samples(texts: DataFrame, key: str, text: str, alphabet: str, width: int, step: int | None = None, strict: bool = False) -> DataFrame:
    """(key, k, x, y): character ids of each stretch of a text and the id of the character after it.

    With ``strict`` the job fails at a character outside the alphabet; else its id is null.
    """
    step, size = step or width, (1 << 20) // (width + 1) + 1
    places = np.full(max(map(ord, alphabet), default=0) + 2, -1)
    for at in range(len(alphabet) - 1, -1, -1):
        places[ord(alphabet[at])] = at

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for owner, t in zip(b.column(0), b.column(1).to_pylist()):
                codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
                if len(codes) <= width:
                    continue
                ids = places[np.minimum(codes, len(places) - 1)]
                spans = np.lib.stride_tricks.sliding_window_view(ids, width + 1)[::step]
                for first in range(0, len(spans), size):  # a long text gives many batches
                    own = spans[first : first + size]
                    x, y = own[:, :width].ravel(), own[:, width]
                    yield pa.RecordBatch.from_pydict({
                        key: pa.array([owner.as_py()] * len(own), b.schema.field(0).type), "k": pa.array(np.arange(first, first + len(own), dtype="i4") * step, pa.int32()),
                        "x": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype="i4") * width), pa.array(x, mask=x < 0)), "y": pa.array(y, mask=y < 0),
                    })

    conf = texts.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    cut = texts.select(key, text).mapInArrow(kernel, f"`{key}` {texts.schema[key].dataType.simpleString()}, k int, x array<long>, y long")
    if strict:
        whole = F.forall("x", lambda i: i.isNotNull()) & F.col("y").isNotNull()
        cut = cut.withColumn("y", F.when(whole, F.col("y")).otherwise(F.raise_error(F.lit("a character outside the alphabet")).cast("long")))
    return cut


def post_vectors(posts: DataFrame, key: str, text: str, vectors: DataFrame, token: str, vector: str, size: int, stemmed: bool = True) -> DataFrame:
    """(key, x): the mean of the vectors of a post's words, by their stems if ``stemmed``; words without a vector count as zeros.

    Posts are tagged and cleaned first, and key must tell them apart.  An empty or null post is one word without a vector.
    """
    words = F.split(plain_words(tag_post(F.coalesce(F.col(text), F.lit("")))), " ")
    tokens = posts.select(key, F.explode(stems(words) if stemmed else words).alias(token))
    found = mean_pool(token_vectors(tokens, vectors, token, vector, size), key, vector, size)
    return found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda c: c["value"]).alias("x"))  # ``size`` cells


def by_label(samples: DataFrame, label: str, key: str, cuts: int = 64) -> DataFrame:
    """Adds place: the sample's rank by (label, numeric key), nulls first.

    A label's keys are cut into stretches at approximate quantiles, so a frequent label is ranked by many tasks; ranks
    are those within a stretch, plus the sizes of the stretches and labels before, and exact wherever the cuts fall.
    """
    edges = samples.groupBy(F.col(label).alias("_l")).agg(F.percentile_approx(key, [k / cuts for k in range(1, cuts)], 10_000).alias("_e"))
    placed = samples.join(edges, F.col(label).eqNullSafe(F.col("_l")))
    placed = placed.withColumn("_s", F.coalesce(F.size(F.filter("_e", lambda e: e < F.col(key))), F.lit(0))).drop("_e")
    sizes = placed.groupBy("_l", "_s").agg(F.count("*").alias("_c"))  # labels times ``cuts`` rows
    labels = sizes.groupBy("_l").agg(F.sum("_c").alias("_t"))
    labels = labels.select(F.col("_l").alias("_m"), (F.sum("_t").over(Window.orderBy(F.col("_l").asc_nulls_first())) - F.col("_t")).alias("_b"))
    before = F.sum("_c").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_c")
    sizes = sizes.withColumn("_o", before).join(labels, F.col("_l").eqNullSafe(F.col("_m"))).select(F.col("_l").alias("_m"), F.col("_s").alias("_n"), (F.col("_o") + F.col("_b")).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_l", "_s").orderBy(key)) - 1
    ranked = placed.withColumn("_r", own).join(sizes, F.col("_l").eqNullSafe(F.col("_m")) & (F.col("_s") == F.col("_n")))
    return ranked.withColumn("place", F.col("_b") + F.col("_r")).drop("_l", "_s", "_r", "_m", "_n", "_b")
