"""Server and client update rules over (layer, pos, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["layer", "pos"]


def momentum_step(host: DataFrame, average: DataFrame, velocity: DataFrame | None = None, momentum: float = 0.9) -> DataFrame:
    """(layer, pos, value, v): v = momentum * v + (1 - momentum) * (host - average); host -= v."""
    both = host.join(average.withColumnRenamed("value", "avg"), KEYS)
    both = both.withColumn("old", F.lit(0.0)) if velocity is None else both.join(velocity.select(*KEYS, F.col("v").alias("old")), KEYS)
    v = momentum * F.col("old") + (1 - momentum) * (F.col("value") - F.col("avg"))
    return both.select(*KEYS, (F.col("value") - v).alias("value"), v.alias("v"))


def server_opt_step(host: DataFrame, delta: DataFrame, state: DataFrame | None = None, variant: str = "adam", lr: float = 0.1, beta1: float = 0.9, beta2: float = 0.99, tau: float = 1e-3) -> DataFrame:
    """(layer, pos, value, m, v) after one adagrad, yogi or adam step on the mean delta; 'none' leaves v."""
    both = host.join(delta.withColumnRenamed("value", "delta"), KEYS)
    both = both.withColumns({"m0": F.lit(0.0), "v0": F.lit(tau * tau)}) if state is None else both.join(state.select(*KEYS, F.col("m").alias("m0"), F.col("v").alias("v0")), KEYS)
    both = both.withColumn("m", beta1 * F.col("m0") + (1 - beta1) * F.col("delta"))
    m2, v = F.col("m") * F.col("m"), F.col("v0")
    new = {"adagrad": v + m2, "yogi": v - (1 - beta2) * m2 * F.signum(v - m2), "adam": beta2 * v + (1 - beta2) * m2, "none": v}[variant]
    return both.withColumn("v", new).select(*KEYS, (F.col("value") + lr * F.col("m") / (F.sqrt("v") + tau)).alias("value"), "m", "v")


def proximal_gradient(grad: DataFrame, local: DataFrame, start: DataFrame, mu: float) -> DataFrame:
    """grad + mu * (local - start)."""
    both = grad.join(local.withColumnRenamed("value", "w"), KEYS).join(start.withColumnRenamed("value", "w0"), KEYS)
    return both.select(*KEYS, (F.col("value") + mu * (F.col("w") - F.col("w0"))).alias("value"))


def scaffold_step(host: DataFrame, control: DataFrame, deltas: DataFrame, control_deltas: DataFrame, lr: float, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Server side of the variance-reduced update: x += lr * mean delta; c += ratio * mean control delta."""
    mean = lambda d: d.groupBy(*KEYS).agg(F.avg("value").alias("d"))
    x = host.join(mean(deltas), KEYS).select(*KEYS, (F.col("value") + lr * F.col("d")).alias("value"))
    c = control.join(mean(control_deltas), KEYS).select(*KEYS, (F.col("value") + ratio * F.col("d")).alias("value"))
    return x, c


def local_steps(samples: Column, batch: int, epochs: int) -> Column:
    """Optimiser steps of a client with so many samples: the least whole number from samples / batch * epochs on."""
    return F.ceil(samples / batch * epochs)


def control_gap(clients: DataFrame, control: DataFrame, own: DataFrame) -> DataFrame:
    """(client_id, layer, pos, value): the server's control less the client's own, which is added to its gradients.

    A client without a control of its own has 0.
    """
    each = clients.select("client_id").crossJoin(control.select(*KEYS, F.col("value").alias("_c")))  # as many rows as the clients' parameters
    both = each.join(own.select("client_id", *KEYS, F.col("value").alias("_o")), ["client_id", *KEYS], "left")
    return both.select("client_id", *KEYS, (F.col("_c") - F.coalesce("_o", F.lit(0.0))).alias("value"))


def control_update(trained: DataFrame, host: DataFrame, gap: DataFrame, steps: DataFrame, lr: float, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Client side of the variance-reduced update: (parameter deltas, control deltas, new controls), all by client.

    From what clients were given and made of it after ``steps`` (client_id, steps) steps: a client's new
    control is (given - made) / (steps * lr) less the gap, so its own less the server's plus that mean gradient.
    """
    both = trained.join(host.withColumnRenamed("value", "_x"), KEYS).join(gap.withColumnRenamed("value", "_g"), ["client_id", *KEYS]).join(steps, "client_id")
    both = both.join(own.select("client_id", *KEYS, F.col("value").alias("_o")), ["client_id", *KEYS], "left")
    both = both.withColumn("_d", F.col("value") - F.col("_x")).withColumn("_n", -F.col("_d") / (F.col("steps") * lr) - F.col("_g"))
    named = lambda x: both.select("client_id", *KEYS, x.alias("value"))
    return named(F.col("_d")), named(F.col("_n") - F.coalesce("_o", F.lit(0.0))), named(F.col("_n"))


def ternary(vector: DataFrame, sparsity: float) -> DataFrame:
    """(client_id, layer, pos, value): of each client the max(1, int(P * s)) largest by magnitude, as sign times their mean magnitude."""
    own = Window.partitionBy("client_id")
    ranked = vector.withColumns({
        "r": F.row_number().over(own.orderBy(F.desc(F.abs("value")), *KEYS)), "k": F.greatest(F.lit(1), F.floor(F.count("*").over(own) * sparsity)),
    }).where("r <= k")
    return ranked.withColumn("value", F.signum("value") * F.avg(F.abs("value")).over(own)).select("client_id", *KEYS, "value")


def ternary_step(delta: DataFrame, sparsity: float, residual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(what is sent, the residual kept for the next round), of clients or, with one client_id, of the server.

    The residual of earlier rounds is added before the choice; absent coordinates are 0 on either side.
    """
    whole = delta.select("client_id", *KEYS, "value")
    if residual is not None:
        whole = whole.unionByName(residual.select("client_id", *KEYS, "value")).groupBy("client_id", *KEYS).agg(F.sum("value").alias("value"))
    sent = ternary(whole, sparsity)
    kept = whole.join(sent.withColumnRenamed("value", "sent"), ["client_id", *KEYS], "left")
    return sent, kept.select("client_id", *KEYS, (F.col("value") - F.coalesce("sent", F.lit(0.0))).alias("value"))


def sparse_mean(sparse: DataFrame, sizes: DataFrame) -> DataFrame:
    """Weighted mean where an absent coordinate is 0: by the total weight of all clients."""
    total = sizes.agg(F.sum("n_train").alias("total"))
    summed = sparse.join(sizes, "client_id").groupBy(*KEYS).agg(F.sum(F.col("value") * F.col("n_train")).alias("s"))
    return summed.crossJoin(F.broadcast(total)).select(*KEYS, (F.col("s") / F.col("total")).alias("value"))


def missed_updates(updates: DataFrame, last_round: DataFrame) -> DataFrame:
    """(client_id, layer, pos, value): the sum of sparse server updates after each client's last round.

    Updates are summed once for each different last round, of which there are no more than rounds.
    """
    ends = last_round.select("last_round").distinct()
    since = updates.join(ends, F.col("round") > F.col("last_round")).groupBy("last_round", *KEYS).agg(F.sum("value").alias("value"))
    return last_round.join(since, "last_round").select("client_id", *KEYS, "value")


def sketch(vector: DataFrame, rows: int = 5, buckets: int = 64) -> DataFrame:
    """(row, bucket, value): a count sketch of (key, value)."""
    spread = vector.select("key", "value", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    h = F.xxhash64("key", "row")
    return spread.groupBy("row", F.pmod(F.shiftright(h, 1), F.lit(buckets)).alias("bucket")).agg(F.sum(F.col("value") * F.when(F.pmod(h, F.lit(2)) == 0, 1).otherwise(-1)).alias("value"))


def sketch_mean(sketches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, bucket, value): the mean of clients' sketches weighted by n_train; a bucket that a client lacks is 0 there."""
    total = sizes.agg(F.sum("n_train").alias("total"))
    summed = sketches.join(sizes, "client_id").groupBy("row", "bucket").agg(F.sum(F.col("value") * F.col("n_train")).alias("s"))
    return summed.crossJoin(F.broadcast(total)).select("row", "bucket", (F.col("s") / F.col("total")).alias("value"))


def _sketch_sum(*parts: tuple[DataFrame, float]) -> DataFrame:
    scaled = [t.select("row", "bucket", (F.col("value") * by).alias("value")) for t, by in parts]
    both = scaled[0]
    for t in scaled[1:]:
        both = both.unionByName(t)
    return both.groupBy("row", "bucket").agg(F.sum("value").alias("value"))


def sketch_step(
    mean: DataFrame, keys: DataFrame, k: int, momentum: DataFrame | None = None, error: DataFrame | None = None, rho: float = 0.9, lr: float = 1.0, rows: int = 5, buckets: int = 64
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(update, momentum, error) of one server round in sketch space.

    momentum = rho * momentum + mean; error += lr * momentum; the update is the k heaviest keys of error,
    whose own sketch is then taken off it.
    """
    momentum = mean if momentum is None else _sketch_sum((momentum, rho), (mean, 1.0))
    error = _sketch_sum((momentum, lr)) if error is None else _sketch_sum((error, 1.0), (momentum, lr))
    update = unsketch(error, keys, k, rows, buckets)
    return update, momentum, _sketch_sum((error, 1.0), (sketch(update, rows, buckets), -1.0))


def unsketch(table: DataFrame, keys: DataFrame, k: int, rows: int = 5, buckets: int = 64) -> DataFrame:
    """The k keys of greatest estimated magnitude, estimates being medians over rows."""
    h = F.xxhash64("key", "row")
    asked = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).withColumns({"bucket": F.pmod(F.shiftright(h, 1), F.lit(buckets)), "sign": F.when(F.pmod(h, F.lit(2)) == 0, 1).otherwise(-1)})
    found = asked.join(table, ["row", "bucket"]).groupBy("key").agg(F.median(F.col("value") * F.col("sign")).alias("value"))
    return found.orderBy(F.desc(F.abs("value")), "key").limit(k)


def pair_seeds(clients: DataFrame, secret: str) -> DataFrame:
    """(client_id, seed, sign): of each pair of clients the seed that both hold, once with either sign.

    ``secret`` stands for what the pairs' key agreement gave; whoever lacks the seeds can't take a mask off.
    """
    ids = clients.select("client_id").distinct()
    both = ids.join(ids.withColumnRenamed("client_id", "peer"), F.col("client_id") != F.col("peer"))
    seed = F.sha2(F.concat_ws("|", F.lit(secret), F.least("client_id", "peer"), F.greatest("client_id", "peer")), 256)
    return both.select("client_id", seed.alias("seed"), F.when(F.col("client_id") < F.col("peer"), -1).otherwise(1).alias("sign"))


def masked(params: DataFrame, seeds: DataFrame, modulus: int = 1 << 31, scale: int = 1 << 16) -> DataFrame:
    """Adds masked: fixed-point values plus pairwise masks that cancel in the sum over clients (modulo ``modulus``, a power of 2 up to 2**32).

    A mask is the first 32 bits of the digest of a pair's seed and the coordinate.
    """
    digest = F.sha2(F.concat_ws("|", "seed", *KEYS), 256)
    mask = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(modulus)) * F.col("sign")
    fixed = F.round(F.first("value") * scale).cast("long")
    own = params.join(seeds, "client_id", "left").groupBy("client_id", *KEYS)
    return own.agg(F.first("value").alias("value"), F.pmod(fixed + F.coalesce(F.sum(mask), F.lit(0)), F.lit(modulus)).alias("masked"))


def unmasked_sum(masked_params: DataFrame, modulus: int = 1 << 31, scale: int = 1 << 16) -> DataFrame:
    s = F.pmod(F.sum("masked"), F.lit(modulus))
    return masked_params.groupBy(*KEYS).agg((F.when(s > modulus // 2, s - modulus).otherwise(s) / scale).alias("value"))
