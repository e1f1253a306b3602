"""Rounds of least squares over clients, out of sums that are taken once.

A client's gradient at any parameters follows from its sums of products, so the
samples are read once: ``statistics`` leaves a row for each client (features
squared numbers), and rounds, with as many local steps as wanted, are work over
these rows and not over samples.  Local steps are array functions in the JVM,
the host's mean is a grouped sum.

Samples are (client_id long, x array<double>, y double).  Those with a null
client, label or component, or with another number of components than ``width``,
are left out; repeated samples count as often as they occur.  A client without
samples has no row, and no samples at all give empty tables.  Other columns are
dropped.  Host parameters are (layer, pos, value), all in layer 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import aggregate, strategies
from larkspur.operators.extensions import STRATEGIES, Strategy

#: Bytes of sums that a task holds before it hands them on.
_HELD = 64 << 20


def statistics(samples: DataFrame, width: int) -> DataFrame:
    """(client_id, n_train, gram, moment, square): sums of x x', x y and y y of each client.

    Tasks add up products batch by batch, so that a client with most of all
    samples sends a row for each task; these are added cell by cell.
    """
    side = width + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cells = [pa.array(v) for v in held.values()]
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([c.to_pylist() for c in cells], pa.list_(pa.float64()))], ["client_id", "cells"])
            held.clear()
            return made

        for batch in batches:
            clients = batch.column("client_id").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            z = np.column_stack([x, batch.column("y").to_numpy()])
            order = np.argsort(clients, kind="stable")
            ids, first = np.unique(clients[order], return_index=True)
            for c, part in zip(ids.tolist(), np.split(order, first[1:])):
                own = z[part]
                cells = np.append((own.T @ own).ravel(), len(own))
                held[c] = held[c] + cells if c in held else cells
            if len(held) * side * side * 8 > _HELD:
                yield out()
        if held:
            yield out()

    rows = samples.select(F.col("client_id").cast("long").alias("client_id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.where((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull() & F.col("client_id").isNotNull())
    cells = rows.mapInArrow(work, "client_id long, cells array<double>").select("client_id", F.posexplode("cells").alias("k", "v"))
    summed = cells.groupBy("client_id", "k").agg(F.sum("v").alias("v")).groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("m"))  # bounded by width squared
    m = F.transform("m", lambda c: c["v"])
    places = F.array(*[F.lit(i) for i in range(width)])
    return summed.select("client_id", m.alias("m")).select(
        "client_id", F.col("m")[side * side].cast("long").alias("n_train"),
        F.transform(places, lambda i: F.slice("m", i * side + 1, F.lit(width))).alias("gram"),
        F.transform(places, lambda i: F.get("m", i * side + width)).alias("moment"), F.col("m")[side * side - 1].alias("square"),
    )


def pooled(stats: DataFrame) -> DataFrame:
    """The statistics of all clients' samples together, as those of one client 0."""
    cells = stats.select("n_train", "square", F.posexplode("gram").alias("i", "g"), "moment").select("n_train", "square", "i", F.get("moment", F.col("i")).alias("b"), F.posexplode("g").alias("j", "v"))
    rows = cells.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("b").alias("b"), F.sum("n_train").alias("n"), F.sum("square").alias("s"))
    rows = rows.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("g"), F.first("b").alias("b"), F.first("n").alias("n"), F.first("s").alias("s"))
    whole = rows.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("i", "g", "b"))).alias("r"), F.first("s").alias("square"))
    return whole.select(F.lit(0).cast("long").alias("client_id"), F.col("n").alias("n_train"), F.transform("r", lambda c: c["g"]).alias("gram"), F.transform("r", lambda c: c["b"]).alias("moment"), "square")


def zeros(stats: DataFrame) -> DataFrame:
    """Host parameters of nothing but zeros, as many as the statistics have features."""
    width = stats.agg(F.max(F.size("moment")).alias("w")).where("w > 0")
    return width.select(F.lit(0).alias("layer"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("pos"), F.lit(0.0).alias("value"))


def _as_array(params: DataFrame, name: str, *by: str) -> DataFrame:
    """Parameters as one array in order of their places (for each client)."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda c: c["value"]).alias(name)
    return params.where("layer = 0").groupBy(*by).agg(listed)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def descend(stats: DataFrame, host: DataFrame, lr: float, steps: int = 1, mu: float = 0.0, shift: DataFrame | None = None) -> DataFrame:
    """(client_id, layer, pos, value): each client's parameters after some steps down from the host's.

    A step follows the gradient of half the client's mean squared error, plus ``mu`` times the
    way gone from the host's parameters, plus the client's ``shift`` (client_id, layer, pos, value; none: 0).
    """
    own = stats.crossJoin(F.broadcast(_as_array(host, "_w")))  # one row, as wide as a sample
    if shift is not None:
        own = own.join(_as_array(shift, "_s", "client_id"), "client_id", "left").withColumn("_s", F.coalesce("_s", F.transform("moment", lambda _: F.lit(0.0))))

    def step(w: Column) -> Column:
        grad = F.zip_with("gram", "moment", lambda row, b: (_dot(row, w) - b) / F.col("n_train"))
        if mu:
            grad = _plus(grad, F.zip_with(w, F.col("_w"), lambda a, o: mu * (a - o)))
        if shift is not None:
            grad = _plus(grad, F.col("_s"))
        return F.zip_with(w, grad, lambda a, g: a - lr * g)

    after = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_w"), lambda w, _: step(w))
    return own.select("client_id", F.lit(0).alias("layer"), F.posexplode(after).alias("pos", "value"))


def squared_errors(stats: DataFrame, host: DataFrame) -> DataFrame:
    """(client_id, n_train, mse) of the host's parameters over each client's samples, without the samples."""
    told = stats.crossJoin(F.broadcast(_as_array(host, "_w")))  # one row
    quadratic = _dot(F.transform("gram", lambda row: _dot(row, F.col("_w"))), F.col("_w"))
    return told.select("client_id", "n_train", ((quadratic - 2 * _dot(F.col("moment"), F.col("_w")) + F.col("square")) / F.col("n_train")).alias("mse"))


@STRATEGIES.register("least_squares")
class LeastSquares(Strategy):
    """Mean of the clients' parameters after ``steps`` local steps: one step is gradient averaging, ``mu`` holds clients near the host.

    Takes ``statistics`` for samples, so that ``run_rounds`` reads the samples once for all rounds.
    """

    def __init__(self, lr: float, steps: int = 1, mu: float = 0.0):
        self.lr, self.steps, self.mu = lr, steps, mu

    def local(self, samples: DataFrame, host: DataFrame, round_: int) -> DataFrame:
        return descend(samples, host, self.lr, self.steps, self.mu)

    def sizes(self, samples: DataFrame) -> DataFrame:
        return samples.select("client_id", "n_train")


def control_round(
    stats: DataFrame, host: DataFrame, control: DataFrame, own: DataFrame, lr: float, steps: int, server_lr: float, share: float,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round with control variates: (host, the server's control, the clients' controls) after it.

    ``stats`` are those of the clients that take part; the others' controls
    (``own``: client_id, layer, pos, value; none: 0) stay as they are.
    """
    shift = strategies.control_gap(stats, control, own)
    trained = descend(stats, host, lr, steps, shift=shift)
    delta, change, new = strategies.control_update(trained, host, shift, stats.select("client_id", F.lit(steps).alias("steps")), lr, own)
    sizes = stats.select("client_id", "n_train")
    host, control = strategies.scaffold_step(host, control, aggregate.weighted_mean(delta, sizes), aggregate.weighted_mean(change, sizes), server_lr, share)
    return host, control, own.join(stats.select("client_id"), "client_id", "left_anti").unionByName(new)
