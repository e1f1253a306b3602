"""Heavy coordinates out of a hierarchy of sketches, without a list of keys.

A key is a number below 2**bits.  At level l, keys that are equal but for their
last l * step bits form a group.  Every level has a sketch: a group's hash says
a run of 16 buckets, a key's own hash the bucket in it and the sign.  The squares
of a run, added up, tell a group's energy, and values of both signs don't cancel.
At level 0 a group is one key, and the sketch a plain count sketch.  All of it
is linear: sketches of clients add up, scale, and take sent coordinates off.

A sketch has at most levels * rows * buckets cells, whatever the number of keys,
and is summed on the map side first.  The descent keeps ``width`` groups of a
level and asks for their children only: width * 2**step estimates a level.
Null keys or values are left out; an empty vector gives an empty sketch and no keys.

Estimates err where keys outnumber buckets or no key stands out.  Who can ask the
clients once more takes ``checked``: the candidates' exact sums give a bound that
the k heaviest keys reach, and the clients' sums from this bound on are the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.streaming.client_state import own_folder

CELL = ["level", "row", "bucket"]
_SPREAD = 4  # a group's keys are spread over 2**4 buckets


@dataclass(frozen=True)
class Shape:
    """Form of a hierarchy; sketches add up only if theirs is the same."""

    rows: int = 5
    buckets: int = 1 << 14
    bits: int = 32
    step: int = 4

    def __post_init__(self):
        if not 0 < self.step <= self.bits < 63:
            raise ValueError("keys have 1 to 62 bits, and a level takes at least one of them")
        if self.buckets < 1 << _SPREAD or self.buckets % (1 << _SPREAD):
            raise ValueError("buckets come in runs of 16")

    @property
    def levels(self) -> int:
        return -(-self.bits // self.step)

    def place(self, group: Column) -> Column:
        """A group's run of buckets at levels above 0, and a key's bucket at level 0."""
        runs = F.when(F.col("level") == 0, self.buckets).otherwise(self.buckets >> _SPREAD)
        return F.pmod(F.xxhash64(group, "level", "row"), runs)

    def bucket(self, group: Column, key: Column) -> Column:
        within = F.pmod(F.xxhash64(key, "row", F.lit("bucket")), F.lit(1 << _SPREAD))
        return F.when(F.col("level") == 0, self.place(group)).otherwise(self.place(group) * (1 << _SPREAD) + within)

    @staticmethod
    def sign(key: Column) -> Column:
        return F.when(F.pmod(F.xxhash64(key, "row", F.lit("sign")), F.lit(2)) == 0, 1).otherwise(-1)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(own_folder(df.sparkSession, "sketches"))
    return df.checkpoint()


def hierarchy(vector: DataFrame, shape: Shape = Shape(), by: list[str] | None = None) -> DataFrame:
    """(by..., level, row, bucket, value) of (by..., key, value); a key outside of the shape's bits is an error."""
    by = by or []
    key = F.when(F.col("key").between(0, (1 << shape.bits) - 1), F.col("key").cast("long")).otherwise(F.raise_error(F.lit(f"a key doesn't fit {shape.bits} bits")))
    rows = vector.where("key is not null and value is not null").select(*by, key.alias("key"), "value")
    rows = rows.groupBy(*by, "key").agg(F.sum("value").alias("value"))  # linear: one row for each key goes into the sketch
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(shape.rows - 1)))).withColumn("value", F.col("value") * Shape.sign(F.col("key")))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(shape.levels - 1))))
    group = F.expr(f"shiftright(key, level * {shape.step})")
    return rows.groupBy(*by, "level", "row", shape.bucket(group, F.col("key")).alias("bucket")).agg(F.sum("value").alias("value"))


def combined(*parts: tuple[DataFrame, float]) -> DataFrame:
    """The sum of sketches of one shape, each times a factor."""
    scaled = [t.select(*CELL, (F.col("value") * by).alias("value")) for t, by in parts]
    both = scaled[0]
    for t in scaled[1:]:
        both = both.unionByName(t)
    return both.groupBy(*CELL).agg(F.sum("value").alias("value"))


def weighted(sketches: DataFrame, sizes: DataFrame) -> DataFrame:
    """The mean of clients' sketches (client_id, level, row, bucket, value) by n_train; a cell that a client lacks is 0."""
    total = sizes.agg(F.sum("n_train").alias("total"))
    summed = sketches.join(sizes, "client_id").groupBy(*CELL).agg(F.sum(F.col("value") * F.col("n_train")).alias("s"))
    return summed.crossJoin(F.broadcast(total)).select(*CELL, (F.col("s") / F.col("total")).alias("value"))


def heaviest(table: DataFrame, k: int, shape: Shape = Shape(), width: int = 256) -> DataFrame:
    """(key, value): the k keys of greatest estimated magnitude (ties: smaller key), out of the ``width`` heaviest groups of each level.

    Estimates are medians over the sketch's rows.  Keys whose estimate is 0 aren't given.
    ``table`` is read once for each level, so it should be settled.
    """
    spark = table.sparkSession
    fan, top = 1 << shape.step, shape.levels - 1
    kept = spark.range(1 << (shape.bits - top * shape.step)).select(F.col("id").alias("at"))
    for level in range(top, -1, -1):
        if level < top:
            kept = kept.select(F.explode(F.sequence(F.col("at") * fan, F.col("at") * fan + (fan - 1))).alias("at"))
        asked = kept.select("at", F.lit(level).alias("level"), F.explode(F.sequence(F.lit(0), F.lit(shape.rows - 1))).alias("row"))
        asked = asked.withColumn("bucket", shape.place(F.col("at")))
        own = table.where(F.col("level") == level)
        if level:
            own = own.groupBy("level", "row", F.shiftright("bucket", _SPREAD).alias("bucket")).agg(F.sum(F.col("value") * F.col("value")).alias("value"))
        # Where nothing was added there is no row; that is a 0, and counts in the median.
        cells = asked.join(own, CELL, "left").select("at", "row", F.coalesce("value", F.lit(0.0)).alias("value"))
        if level:
            energy = cells.groupBy("at").agg(F.median("value").alias("energy")).where("energy > 0")
            kept = energy.orderBy(F.desc("energy"), "at").limit(width).select("at")
        else:
            found = cells.groupBy(F.col("at").alias("key")).agg(F.median(F.col("value") * Shape.sign(F.col("at"))).alias("value")).where("value <> 0")
    return found.orderBy(F.desc(F.abs("value")), "key").limit(k)


def checked(vector: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(key, value): the k keys of greatest magnitude (ties: smaller key) by exact sums of (key, value), whatever ``candidates`` (key) miss.

    No key below the k-th magnitude among the candidates can be one of the k, so all others are dropped where they are
    summed.  Magnitudes that differ by the order of adding only count as ties.  With fewer than k candidates nothing is dropped.
    """
    sums = vector.where("key is not null and value is not null").groupBy("key").agg(F.sum("value").alias("value"))
    asked = F.broadcast(candidates.select("key"))  # no more rows than the estimates gave, k in the queries
    best = vector.where("value is not null").join(asked, "key", "left_semi").groupBy("key").agg(F.abs(F.sum("value")).alias("m"))
    told = best.orderBy(F.desc("m")).limit(k).agg(F.min("m").alias("m"), F.count("*").alias("n")).first()
    bound = told["m"] if told["n"] == k else 0.0
    found = sums.where(F.abs("value") >= bound * (1 - 1e-9))
    same = F.round(F.abs("value") / bound, 10) if bound else F.abs("value")
    return found.orderBy(same.desc(), "key").limit(k)


def run_rounds(
    updates: DataFrame, sizes: DataFrame, rounds: list[int], k: int, shape: Shape = Shape(), width: int = 256, rho: float = 0.9, lr: float = 1.0, exact: bool = False
) -> DataFrame:
    """(round, key, value): what the server sends in each of ``rounds``, from (round, client_id, key, value).

    Momentum and error live in sketches from round to round: momentum = rho * momentum + mean of the clients' sketches;
    error += lr * momentum; the k heaviest keys of error are sent, and their own sketch comes off it.
    A round without updates goes on with what error and momentum hold.  With ``exact`` the clients are asked once more
    each round (``checked``): a key's error is a sum over its updates, by round, less what was sent of it.
    """
    momentum = error = sent = None
    past: list[int] = []
    if exact:
        total = sizes.agg(F.sum("n_train").alias("total"))
        means = updates.where("key is not null and value is not null").join(sizes, "client_id").crossJoin(F.broadcast(total))  # one row
        means = means.groupBy("round", "key").agg(F.sum(F.col("value") * F.col("n_train") / F.col("total")).alias("value"))
    for r in rounds:
        past.append(r)
        own = hierarchy(updates.where(F.col("round") == r).select("client_id", "key", "value"), shape, ["client_id"])
        mean = weighted(own, sizes)
        momentum = settled(mean if momentum is None else combined((momentum, rho), (mean, 1.0)))
        error = settled(combined((momentum, lr)) if error is None else combined((error, 1.0), (momentum, lr)))
        update = heaviest(error, k, shape, width)
        if exact:
            times = [lr * sum(rho**j for j in range(len(past) - n)) for n in range(len(past))]  # an update counts in every momentum since
            factor = F.coalesce(*[F.when(F.col("round") == p, t) for p, t in zip(past, times)])
            owed = means.where(F.col("round").isin(past)).select("key", (F.col("value") * factor).alias("value"))
            update = checked(owed if sent is None else owed.unionByName(sent.select("key", (-F.col("value")).alias("value"))), settled(update), k)
        update = settled(update)
        error = combined((error, 1.0), (hierarchy(update, shape), -1.0))
        made = update.select(F.lit(r).cast("long").alias("round"), "key", "value")
        sent = made if sent is None else sent.unionByName(made)
    if sent is None:
        raise ValueError("no rounds are named")
    return sent
