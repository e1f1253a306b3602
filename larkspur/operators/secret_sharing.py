"""Secure sums that survive dropouts: double masks, and secrets shared by polynomials over a prime field.

Every client has two secrets: one that it agrees pair masks with (g to that power
is public; a pair's seed comes from either's secret and the other's public
number), one for a mask of its own.  Both are cut into shares for its neighbours
in a ring: values of a polynomial whose degree is the threshold less one.  What a
client sends is its parameters in fixed point plus its own mask plus or minus the
pair masks of its neighbours.  Of clients that sent, neighbours give the shares of
the own mask; of clients that dropped out, those of the pair secret: so the masks
that nothing cancels can be taken off, and no client's parameters can be read, as
nobody is asked for both.  Fewer shares than the threshold raise an error.

Neighbours are few (2 k of them), so there are 2 k seeds a client and 2 k shares
of a secret, however many clients there are; parameters are never joined with
pairs.  A mask is a 64-bit hash of seed and coordinate; seeds are digests.  The
prime 2**521 - 1 carries secrets whole; callers with stronger needs give another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.partition import class_ranks

PRIME, GENERATOR = 2**521 - 1, 3
MODULUS, SCALE = 1 << 40, 1 << 16
KEYS = ["layer", "pos"]


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.sha512("|".join(map(str, parts)).encode()).digest(), "big")


def share(secret: int, xs: list[int], threshold: int, salt: str, prime: int = PRIME) -> list[int]:
    """Values at ``xs`` of a polynomial of degree threshold - 1 that is ``secret`` at 0."""
    if not 1 <= threshold <= len(xs):
        raise ValueError("the threshold is from 1 to the number of shares")
    terms = [secret % prime] + [_number(salt, secret, k) % prime for k in range(1, threshold)]
    out = []
    for x in xs:
        y = 0
        for c in reversed(terms):
            y = (y * x + c) % prime
        out.append(y)
    return out


def combine(points: list[tuple[int, int]], prime: int = PRIME) -> int:
    """The polynomial through the points, at 0 (Lagrange)."""
    total = 0
    for j, (x, y) in enumerate(points):
        up = down = 1
        for m, (other, _) in enumerate(points):
            if m != j:
                up, down = up * other % prime, down * (other - x) % prime
        total += y * up * pow(down, -1, prime)
    return total % prime


def seed_of(*parts: object) -> int:
    """A signed 64-bit seed."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big", signed=True)


def _each(df: DataFrame, out: str, work) -> DataFrame:
    """``work`` makes a row of each row (a dict); for tables of clients and neighbours, not of parameters."""
    names = [x.split()[0] for x in out.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [work(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], schema.field(c).type) for k, c in enumerate(names)}, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(out))
    return df.mapInArrow(kernel, out)


def client_keys(clients: DataFrame, entropy: str) -> DataFrame:
    """(client_id, pair_secret, own_secret, public), numbers as hexadecimal text.

    ``entropy`` stands for each client's own random source; a client's secrets follow from it and its id.
    """
    def work(r):
        pair = _number(entropy, "pair", r["client_id"]) % (PRIME - 1)
        return r["client_id"], hex(pair), hex(_number(entropy, "own", r["client_id"]) % PRIME), hex(pow(GENERATOR, pair, PRIME))

    return _each(clients.select(F.col("client_id").cast("long").alias("client_id")).distinct(), "client_id long, pair_secret string, own_secret string, public string", work)


def ring(clients: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(client_id, peer, x): the k clients on either side in md5 order; x, from 1 on, numbers a client's neighbours."""
    ids = clients.select(F.col("client_id").cast("long").alias("client_id")).distinct()
    placed = class_ranks(ids.withColumn("_all", F.lit(0)), "_all", "client_id", seed).drop("_all")
    n = placed.count()
    k = min(k, (n - 1) // 2)
    if k < 1:
        raise ValueError("a ring has three clients at least")
    asked = placed.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (*range(-k, 0), *range(1, k + 1))])))
    asked = asked.select("client_id", F.pmod(F.col("rank") + F.col("d"), F.lit(n)).alias("rank"), F.when(F.col("d") < 0, F.col("d") + k + 1).otherwise(F.col("d") + k).cast("int").alias("x"))
    return asked.join(placed.select("rank", F.col("client_id").alias("peer")), "rank").select("client_id", "peer", "x")


def shared_out(keys: DataFrame, neighbours: DataFrame, threshold: int) -> DataFrame:
    """(client_id, holder, message): what each neighbour holds, as ``owner||holder||x||share of pair secret||share of own secret``."""
    lists = neighbours.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("x", "peer"))).alias("to"))  # 2 k of them

    def work(r):
        xs = [t["x"] for t in r["to"]]
        pair = share(int(r["pair_secret"], 16), xs, threshold, "pair")
        own = share(int(r["own_secret"], 16), xs, threshold, "own")
        return r["client_id"], [f"{r['client_id']}||{t['peer']}||{t['x']}||{a:x}||{b:x}" for t, a, b in zip(r["to"], pair, own)]

    made = _each(keys.join(lists, "client_id"), "client_id long, messages array<string>", work)
    return made.select("client_id", F.explode("messages").alias("message")).select("client_id", F.split("message", r"\|\|")[1].cast("long").alias("holder"), "message")


def pair_masks(keys: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(client_id, seeds): for each client the (seed, sign) of its neighbours and of its own mask."""
    publics = keys.select(F.col("client_id").alias("peer"), "public")
    both = neighbours.join(publics, "peer").join(keys.select("client_id", "pair_secret"), "client_id")

    def work(r):
        shared = pow(int(r["public"], 16), int(r["pair_secret"], 16), PRIME)
        return r["client_id"], seed_of("pair", shared), -1 if r["client_id"] < r["peer"] else 1

    pairs = _each(both, "client_id long, seed long, sign int", work)
    own = _each(keys, "client_id long, seed long, sign int", lambda r: (r["client_id"], seed_of("own", int(r["own_secret"], 16)), 1))
    return pairs.unionByName(own).groupBy("client_id").agg(F.collect_list(F.struct("seed", "sign")).alias("seeds"))  # 2 k + 1 of them


def _mask(seeds: str) -> Column:
    """The masks of a row's seeds at its coordinate, added up."""
    spot = [F.col(c) for c in KEYS]
    one = lambda s: F.pmod(F.xxhash64(s["seed"], *spot), F.lit(MODULUS)) * s["sign"]
    return F.aggregate(F.coalesce(F.col(seeds), F.array().cast("array<struct<seed: bigint, sign: int>>")), F.lit(0).cast("long"), lambda a, s: a + one(s))


def masked(params: DataFrame, seeds: DataFrame) -> DataFrame:
    """(client_id, layer, pos, masked): fixed point plus all masks, modulo 2**40."""
    fixed = F.round(F.col("value") * SCALE).cast("long")
    return params.join(seeds, "client_id").select("client_id", *KEYS, F.pmod(fixed + _mask("seeds"), F.lit(MODULUS)).alias("masked"))


def _recovered(messages: DataFrame, threshold: int, which: int) -> DataFrame:
    """(client_id, secret) from the first ``threshold`` shares of each client; fewer raise an error."""
    parts = F.split("message", r"\|\|")
    shares = messages.select("client_id", F.struct(parts[2].cast("int").alias("x"), parts[2 + which].alias("y")).alias("s"))
    lists = shares.groupBy("client_id").agg(F.sort_array(F.collect_list("s")).alias("s"))  # 2 k at most

    def work(r):
        if len(r["s"]) < threshold:
            raise ValueError(f"{len(r['s'])} shares of client {r['client_id']}, {threshold} needed")
        return r["client_id"], hex(combine([(s["x"], int(s["y"], 16)) for s in r["s"][:threshold]]))

    return _each(lists, "client_id long, secret string", work)


def unmasked_sum(sent: DataFrame, all_clients: DataFrame, neighbours: DataFrame, publics: DataFrame, messages: DataFrame, threshold: int) -> DataFrame:
    """(layer, pos, value): the sum over clients that sent, from their masked rows and the shares that they hold.

    ``publics`` has (client_id, public), ``messages`` what ``shared_out`` gave; holders that dropped out don't answer.
    """
    alive = sent.select("client_id").distinct()
    gone = all_clients.select(F.col("client_id").cast("long").alias("client_id")).distinct().join(alive, "client_id", "left_anti")
    answered = messages.join(alive.select(F.col("client_id").alias("holder")), "holder", "left_semi")
    whole = alive.join(answered.select("client_id").distinct(), "client_id", "left_anti").count() + gone.join(answered.select("client_id").distinct(), "client_id", "left_anti").count()
    if whole:
        raise ValueError(f"no shares are left of {whole} clients")
    own = _recovered(answered.join(alive, "client_id", "left_semi"), threshold, 2)
    own = _each(own, "client_id long, seed long, sign int", lambda r: (r["client_id"], seed_of("own", int(r["secret"], 16)), -1))
    lost = _recovered(answered.join(gone, "client_id", "left_semi"), threshold, 1)
    # A dropped client's masks with neighbours that sent: its secret and their public numbers give the seeds.
    edges = lost.join(neighbours.select("client_id", "peer"), "client_id").join(publics.select(F.col("client_id").alias("peer"), "public"), "peer")

    def work(r):
        shared = pow(int(r["public"], 16), int(r["secret"], 16), PRIME)
        return r["peer"], seed_of("pair", shared), 1 if r["peer"] < r["client_id"] else -1

    pairs = _each(edges, "client_id long, seed long, sign int", work)
    off = own.unionByName(pairs).groupBy("client_id").agg(F.collect_list(F.struct("seed", "sign")).alias("off"))
    freed = sent.join(off, "client_id", "left").select(*KEYS, F.pmod(F.col("masked") + _mask("off"), F.lit(MODULUS)).alias("m"))
    s = F.pmod(F.sum("m"), F.lit(MODULUS))
    return freed.groupBy(*KEYS).agg((F.when(s > MODULUS // 2, s - MODULUS).otherwise(s) / SCALE).alias("value"))
