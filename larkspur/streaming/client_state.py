"""State of clients over rounds in a stream: pending messages, residuals, rounds closed by event-time timers.

A message (client_id, round, ts, id, value) is for a round; a round closes
``grace`` after its end.  Per client the first message of a round counts (by ts,
then id); repeats go to the side as "doubled", and messages whose own time is at
or beyond the close as "late".  When the watermark passes a round's close, a timer
settles it: what is sent is the residual plus the value, rounded down to whole
``unit``s, and the rest stays with the client for its next round.

State is keyed by client and holds its open rounds only.  The order in which
messages come, and how they fall into micro-batches, don't change the result as
long as the watermark's delay covers the source's disorder; older rows are
dropped by Spark before they reach the state.  Rounds that the watermark has not
passed when a stream ends stay open, in the state, for the next run.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
OUT = "kind string, client_id long, round long, id long, sent long, residual long"
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClientRounds(StatefulProcessor):
    """Keyed by client.  Rounds are numbered in days; ``grace`` is in days."""

    def __init__(self, unit: int, grace: int):
        self.unit, self.grace = unit, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "round long, n long, rows binary")  # n messages of a round: ts, id, value
        self.residual = handle.getValueState("residual", "residual long, last_round long")

    def _close(self, round_):
        return (round_ + 1 + self.grace) * DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            ts = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            round_, id_, value = (frame[c].to_numpy("int64") for c in ("round", "id", "value"))
            late = ts >= self._close(round_) * 1000
            kept, cells = round_[~late], np.column_stack([ts, id_, value])[~late]
            rounds, place = np.unique(kept, return_inverse=True)
            parts = np.split(cells[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))[:-1]) if len(rounds) else []
            if parts:
                self.pending.appendList([(int(r), len(p), p.tobytes()) for r, p in zip(rounds, parts)])
            for r in rounds.tolist():
                self.handle.registerTimer(self._close(r))
            yield self._rows("late", key[0], round_[late], id_[late])

    @staticmethod
    def _rows(kind, client, rounds, ids, sent=None, residual=None) -> pd.DataFrame:
        found = pd.DataFrame({"kind": kind, "client_id": client, "round": rounds, "id": ids, "sent": sent, "residual": residual}, columns=_COLUMNS)
        return found.astype({"sent": "Int64", "residual": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        due, rest = [x for x in held if self._close(x[0]) <= at], [x for x in held if self._close(x[0]) > at]
        residual = self.residual.get()[0] if self.residual.exists() else 0
        last = None
        for r in sorted({x[0] for x in due}):
            cells = np.concatenate([np.frombuffer(rows, "int64").reshape(n, 3) for own, n, rows in due if own == r])
            cells = cells[np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))]
            last, whole = r, residual + int(cells[0, 2])
            sent = whole // self.unit * self.unit
            residual = whole - sent
            yield self._rows("sent", key[0], [r], [int(cells[0, 1])], sent, residual)
            yield self._rows("doubled", key[0], r, cells[1:, 1])
        if last is not None:
            self.residual.update((residual, last))
        self.pending.clear()
        if rest:
            self.pending.put(rest)
        yield self._rows("sent", key[0], [], [])

    def close(self) -> None:
        pass


def settled(messages: DataFrame, unit: int, grace: int = 1, delay: str = "1 day") -> DataFrame:
    """The stream of rows (kind: sent, doubled or late) from a stream of messages."""
    # The process that starts stateful operators has no packages sent by addPyFile: the processor goes with its code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    keyed = messages.select("client_id", "round", "ts", "id", "value").withWatermark("ts", delay).groupBy("client_id")
    return keyed.transformWithStateInPandas(ClientRounds(unit, grace), OUT, "Append", "EventTime")


def run(spark: SparkSession, path: str, schema: str, unit: int, folder: str, grace: int = 1, delay: str = "1 day") -> DataFrame:
    """Reads the files at ``path`` one micro-batch a file, as they were written; returns what the stream gave.

    Progress and state are in ``folder``: another call with the same one goes on where this one ended.
    """
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = settled(source, unit, grace, delay).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        if had is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names; only tests, which name none, get a local one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="larkspur-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def in_time_slices(messages: DataFrame, path: str, slices: int) -> None:
    """Writes messages as files of equal stretches of time, one after another, as a service would leave them."""
    edge = messages.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    step = ((edge["b"] or 0) - (edge["a"] or 0)) / slices or 1
    at = F.least(F.floor((F.col("ts").cast("double") - F.lit(edge["a"] or 0)) / step), F.lit(slices - 1))
    for k in range(slices):
        messages.where(at == k).coalesce(1).write.mode("append").parquet(path)
