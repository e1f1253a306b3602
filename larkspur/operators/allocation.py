"""Skewed datasets of clients: who gets which ranks of which class, without a loop over clients.

What clients want of each class, added up in the order of clients, are intervals;
so is what a class has.  Where wants go beyond a class its clients get less, and
what other classes have left makes up for it: the missing rows of all clients and
the spare rows of all classes, each laid end to end, are matched by an interval
overlap join.  All tables are clients by classes at most, in Spark; rows find
their client by a join on (class, stretch of ranks), so no class is one task's.
"""

from __future__ import annotations

from math import erf, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larkspur.operators.partition import class_ranks


def running(df: DataFrame, keys: list[str], order: str, value: str, width: int = 1024) -> DataFrame:
    """Adds first and end: the running total of ``value`` before and with each row, by a whole-numbered ``order``.

    Totals within stretches of ``width`` and before them, so a key's rows are spread over tasks.
    """
    cut = df.withColumn("_g", F.floor(F.col(order) / width))
    sums = cut.groupBy(*keys, "_g").agg(F.sum(value).alias("_t"))
    sums = sums.select(*keys, "_g", (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_g")) - F.col("_t")).alias("_b"))
    inner = F.sum(value).over(Window.partitionBy(*keys, "_g").orderBy(order))
    both = cut.join(sums, [*keys, "_g"]).withColumn("end", (F.col("_b") + inner).cast("long"))
    return both.withColumn("first", F.col("end") - F.col(value)).drop("_g", "_b")


def overlaps(a: DataFrame, b: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals share a place; a has (a_first, a_end), b has (b_first, b_end), ends not included.

    Both sides are dealt into stretches of ``width`` places and joined by an equality; a pair counts in the first
    stretch that both touch.  Empty intervals meet nothing.
    """
    keys = keys or []
    stretch = lambda first, end: F.sequence(F.floor(F.col(first) / width), F.floor((F.col(end) - 1) / width))
    left = a.where("a_end > a_first").withColumn("_s", F.explode(stretch("a_first", "a_end")))
    right = b.where("b_end > b_first").withColumn("_s", F.explode(stretch("b_first", "b_end")))
    meet = (F.col("a_first") < F.col("b_end")) & (F.col("b_first") < F.col("a_end"))
    first_shared = F.col("_s") == F.floor(F.greatest("a_first", "b_first") / width)
    return left.join(right, [*keys, "_s"]).where(meet & first_shared).drop("_s")


def normal_offsets(n: int, scale: float) -> list[tuple[int, int]]:
    """(offset, how many): ``n`` rows around 0 as rounded normals fall, each offset its share of the distribution."""
    if scale <= 0:
        return [(0, n)]
    reach = int(6 * scale) + 1
    upto = lambda k: int(n * (1 + erf((k + 0.5) / (scale * sqrt(2)))) / 2 + 0.5)
    counts = [(k, upto(k) - upto(k - 1)) for k in range(-reach + 1, reach)]
    counts = [(-reach, upto(-reach)), *counts, (reach, n - upto(reach - 1))]
    return [x for x in counts if x[1]]


def drawn(client: Column, label: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", client.cast("string"), label.cast("string"), F.lit(str(seed))))


def wanted(supply: DataFrame, clients: int, classes: int, each: int, scale: float | None = None, seed: int = 0) -> DataFrame:
    """(client_id, place, want): of ``classes`` drawn classes ``each`` rows, or as many spread over neighbours by rounded normals.

    ``supply`` has (label, place), place numbering the classes from 0.
    """
    everyone = supply.sparkSession.range(clients).select(F.col("id").alias("client_id"))
    own = Window.partitionBy("client_id").orderBy(drawn(F.col("client_id"), F.col("label"), seed), "label")
    chosen = everyone.crossJoin(supply.select("label", "place")).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= classes)
    if scale is None:
        return chosen.select("client_id", "place", F.lit(each).cast("long").alias("want"))
    spread = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(n).cast("long").alias("n")) for o, n in normal_offsets(each, scale)]))
    total = supply.agg(F.count("*").alias("_c"))
    moved = chosen.withColumn("_o", spread).crossJoin(F.broadcast(total))  # one row
    return moved.groupBy("client_id", F.pmod(F.col("place") + F.col("_o.o"), F.col("_c")).alias("place")).agg(F.sum("_o.n").alias("want"))


def granted(supply: DataFrame, wants: DataFrame, clients: int, each_client: int) -> DataFrame:
    """(client_id, place, first, end): ranks within classes, ``each_client`` rows for every client in all.

    ``supply`` has (place, size); its sizes add up to clients * each_client at least.
    """
    asked = running(wants, ["place"], "client_id", "want").join(supply.select("place", "size"), "place")
    got = asked.select("client_id", "place", F.least("first", "size").alias("first"), F.least("end", "size").alias("end")).where("end > first")
    had = got.groupBy("client_id").agg(F.sum(F.col("end") - F.col("first")).alias("_n"))
    everyone = supply.sparkSession.range(clients).select(F.col("id").alias("client_id"))
    lacks = everyone.join(had, "client_id", "left").select("client_id", (each_client - F.coalesce("_n", F.lit(0))).cast("long").alias("lack"))
    missing = running(lacks, [], "client_id", "lack").select("client_id", F.col("first").alias("a_first"), F.col("end").alias("a_end"))
    used = got.groupBy("place").agg(F.max("end").alias("_u"))
    spare = supply.join(used, "place", "left").select("place", F.coalesce("_u", F.lit(0)).alias("_u"), (F.col("size") - F.coalesce("_u", F.lit(0))).alias("spare"))
    spare = running(spare, [], "place", "spare").select("place", "_u", F.col("first").alias("b_first"), F.col("end").alias("b_end"))
    both = overlaps(missing, spare, max(1, each_client))
    at = lambda x: F.col("_u") + x - F.col("b_first")
    more = both.select("client_id", "place", at(F.greatest("a_first", "b_first")).alias("first"), at(F.least("a_end", "b_end")).alias("end"))
    return got.unionByName(more)


def skewed_splits(
    samples: DataFrame, label: str, key: str, clients: int, classes: int, scale: float | None = None, per_client: int | None = None,
    ratio: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0,
) -> DataFrame:
    """Adds client_id and split: training rows skewed by class, validation and test rows dealt out evenly.

    A client has int(size * ratio) rows of each part.  The first rows in md5 order are for training, the next for
    validation, then test.  A client wants as many training rows of each of ``classes`` classes (drawn by md5; with
    ``scale`` they are spread over neighbouring classes by rounded normals); what its classes lack other classes make
    up, so all clients have equally many.  A null label is a class of its own, the last.
    """
    total = samples.count()
    size = min(per_client or total, total // clients)
    n_train, n_val, n_test = (int(size * r / sum(ratio)) for r in ratio)
    if min(n_train, n_val, n_test) < 1:
        raise ValueError("too few samples for so many clients")
    placed = class_ranks(samples.withColumn("_all", F.lit(0)), "_all", key, seed).withColumnRenamed("rank", "_r").drop("_all")
    ends = [n_train * clients, (n_train + n_val) * clients, (n_train + n_val + n_test) * clients]
    is_val = F.col("_r") < ends[1]
    later = placed.where((F.col("_r") >= ends[0]) & (F.col("_r") < ends[2])).withColumns({
        "split": F.when(is_val, "val").otherwise("test"),
        "client_id": F.when(is_val, F.floor((F.col("_r") - ends[0]) / n_val)).otherwise(F.floor((F.col("_r") - ends[1]) / n_test)).cast("int"),
    }).drop("_r")
    train = placed.where(F.col("_r") < ends[0]).drop("_r")
    supply = train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))
    supply = supply.withColumn("place", F.row_number().over(Window.orderBy(F.col("label").asc_nulls_last())).cast("long") - 1)  # a row for each class
    grants = granted(supply, wanted(supply, clients, classes, n_train // classes, scale, seed), clients, n_train)
    ranked = class_ranks(train.withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("\0"))), "_l", key, seed + 1)
    names = supply.select(F.coalesce(F.col("label").cast("string"), F.lit("\0")).alias("_l"), "place")
    spots = grants.join(names, "place").select("_l", F.col("client_id").cast("int").alias("client_id"), F.col("first").alias("b_first"), F.col("end").alias("b_end"))
    rows = ranked.withColumns({"a_first": F.col("rank").cast("long"), "a_end": F.col("rank").cast("long") + 1}).drop("rank")
    found = overlaps(rows, spots, max(1, n_train // classes), ["_l"]).drop("_l", "a_first", "a_end", "b_first", "b_end")
    return found.withColumn("split", F.lit("train")).unionByName(later)
