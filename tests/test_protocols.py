"""Client state in streams and sums that survive dropouts, against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import secret_sharing
from larkspur.plans import catalog, protocols
from larkspur.streaming import client_state

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == protocols.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_query(twins, name):
    twins(name)


def plain_state(messages, unit, grace, mark_us):
    day = client_state.DAY_MS * 1000
    out, residual = [], {}
    for c in sorted({m[0] for m in messages}):
        seen = set()
        for r, t, i, v in sorted((m[1], m[2], m[3], m[4]) for m in messages if m[0] == c):
            close = (r + 1 + grace) * day
            if t >= close:
                out.append(("late", c, r, i, None, None))
            elif close <= mark_us:
                if r in seen:
                    out.append(("doubled", c, r, i, None, None))
                else:
                    seen.add(r)
                    whole = residual.get(c, 0) + v
                    residual[c] = whole % unit
                    out.append(("sent", c, r, i, whole - whole % unit, whole % unit))
    return sorted(map(str, out))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    rng = random.Random(4)
    start = 19_000 * 86_400_000_000
    messages = []
    for k in range(240):
        t = start + rng.randrange(12 * 86_400_000_000)
        messages.append((rng.randrange(4), t // 86_400_000_000 - rng.choice([0, 0, 1, 3]), t // 1000 * 1000, k, rng.randrange(-500, 500)))
    messages.sort(key=lambda m: m[2])
    zero = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(c, r, zero + datetime.timedelta(microseconds=t), i, v) for c, r, t, i, v in messages]
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for a, b in ((0, 100), (100, 130), (130, 240)):  # a file now and then; the stream is started again each time
        spark.createDataFrame(rows[a:b], protocols._MESSAGE).coalesce(1).write.mode("append").parquet(path)
        got = client_state.run(spark, path, protocols._MESSAGE, 100, folder)
        want = plain_state(messages[:b], 100, 1, messages[b - 1][2] - 86_400_000_000)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    kinds = {r["kind"] for r in got.collect()}
    assert kinds == {"sent", "doubled", "late"}


def test_shares():
    rng = random.Random(2)
    for n, t in ((1, 1), (3, 2), (10, 7)):
        secret = rng.randrange(secret_sharing.PRIME)
        points = list(zip(range(1, n + 1), secret_sharing.share(secret, list(range(1, n + 1)), t, "salt")))
        rng.shuffle(points)
        assert secret_sharing.combine(points[:t]) == secret
        if t > 1:
            assert secret_sharing.combine(points[: t - 1]) != secret
    with pytest.raises(ValueError):
        secret_sharing.share(1, [1, 2], 3, "salt")


@pytest.fixture(scope="module")
def round_(spark):
    clients = spark.range(9).withColumnRenamed("id", "client_id")
    params = clients.select("client_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"), F.lit(1).alias("layer")).withColumn("value", F.col("client_id") * 0.25 - F.col("pos") * 0.5)
    keys, near = secret_sharing.client_keys(clients, "e").cache(), secret_sharing.ring(clients, 3).cache()
    messages = secret_sharing.shared_out(keys, near, 3).cache()
    return clients, params, keys, near, messages, secret_sharing.masked(params, secret_sharing.pair_masks(keys, near)).cache()


@pytest.mark.parametrize("gone", [[], [4], [0, 3, 6], [1, 2, 3]])
def test_sums_without_the_dropped(round_, gone):
    clients, params, keys, near, messages, sent = round_
    left = sent.where(~F.col("client_id").isin(gone)) if gone else sent
    got = secret_sharing.unmasked_sum(left, clients, near, keys.select("client_id", "public"), messages, 3)
    want = {p: sum(c * 0.25 - p * 0.5 for c in range(9) if c not in gone) for p in range(6)}
    assert {r["pos"]: r["value"] for r in got.collect()} == want


def test_too_few_shares(round_):
    clients, params, keys, near, messages, sent = round_
    for alive in ([0, 1], [5]):
        with pytest.raises(Exception, match="shares"):
            secret_sharing.unmasked_sum(sent.where(F.col("client_id").isin(alive)), clients, near, keys.select("client_id", "public"), messages, 3).collect()


def test_masked_rows_say_nothing(round_):
    _, params, _, near, messages, sent = round_
    assert near.groupBy("client_id").count().where("count != 6").count() == 0
    plain = {(r["client_id"], r["pos"]): round(r["value"] * secret_sharing.SCALE) % secret_sharing.MODULUS for r in params.collect()}
    rows = sent.collect()
    assert all(plain[r["client_id"], r["pos"]] != r["masked"] for r in rows) and len({r["masked"] for r in rows}) == 54
    parts = messages.first()["message"].split("||")
    assert len(parts) == 5 and int(parts[3], 16) < secret_sharing.PRIME


def test_state_rows_are_rounds_not_messages():
    import pandas as pd

    class Held(list):
        appendList = list.extend

    class Handle:
        def getListState(self, name, schema):
            return Held()

        def getValueState(self, name, schema):
            return None

        def registerTimer(self, at):
            pass

    work = client_state.ClientRounds(100, 1)
    work.init(Handle())
    frame = pd.DataFrame({"round": [0, 1] * 50, "ts": pd.to_datetime([1] * 100, unit="s"), "id": range(100), "value": [5] * 100})
    assert all(x.empty for x in work.handleInputRows((7,), iter([frame]), None))
    assert [(r, n) for r, n, _ in work.pending] == [(0, 50), (1, 50)]
