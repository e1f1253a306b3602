"""Chat formatting with a grammar round trip.

Grammar of the output, one record for each turn::

    turn := "<|im_start|>" role "\n" body "<|im_end|>\n"

``parse`` is the deterministic parser: the role runs up to the first line
break, the body up to the first ``<|im_end|>``; escapes are undone.  ``render``
writes a turn as it is, parses that, and compares.  Where the two differ (a
control string in the text, or something that looks like an escape), it
escapes the conflicting content and tries again, until they are identical.

Escapes: in bodies ``<|`` becomes ``<~|`` and ``<~|`` becomes ``<~~|`` and so
on; in roles ``%``, ``<`` and the line break become ``%25 %3C %0A``.

A null role or text is empty, a null conversation id is a conversation of its
own and sorts first, as does a null turn.  Equal turns sort by role, then text;
repeated rows stay.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ROLE = (("%", "%25"), ("<", "%3C"), ("\n", "%0A"))
_PLAIN = {code: char for char, code in _ROLE}


def escape(text: str) -> str:
    return re.sub(r"<(~*)\|", r"<~\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<~(~*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    for char, code in _ROLE:
        role = role.replace(char, code)
    return role


def parse(record: str) -> list[tuple[str, str]]:
    """The turns of formatted text; ValueError where it isn't of the grammar."""
    turns, at = [], 0
    while at < len(record):
        line = record.find("\n", at)
        end = record.find(f"{END}\n", line + 1)
        if not record.startswith(START, at) or line < 0 or end < 0:
            raise ValueError(f"no turn at character {at}")
        body = record[line + 1 : end]
        if START in body:
            raise ValueError(f"a turn starts inside the one at character {at}")
        role = re.sub("%25|%3C|%0A", lambda m: _PLAIN[m[0]], record[at + len(START) : line])
        turns.append((role, unescape(body)))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> str:
    """The record of a turn, which parses to just that turn."""
    for write_role, write_text in ((str, str), (str, escape), (_escape_role, str), (_escape_role, escape)):
        record = f"{START}{write_role(role)}\n{write_text(text)}{END}\n"
        try:
            if END not in write_text(text) and parse(record) == [(role, text)]:
                return record
        except ValueError:
            pass
    raise AssertionError("the escapes are reversible")


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end) for each turn, in any order.

    loss_start and loss_end bound the characters of ``formatted`` that an
    assistant wrote, as written there (escapes included); both are 0 for other roles.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [render(r or "", t or "") for r, t in zip(f["role"], f["text"])]
            bounds = [(m.index("\n") + 1, len(m) - len(END) - 1) if r == "assistant" else (0, 0) for r, m in zip(f["role"], made)]
            yield f[["conv_id", "turn"]].assign(formatted=made, loss_start=[a for a, _ in bounds], loss_end=[b for _, b in bounds])

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    schema = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
    # Integers with nulls must not pass through pandas floats.
    wide = rows.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})
    return wide.mapInPandas(work, schema.replace("conv_id long, turn long", "conv_id string, turn string")).withColumns(
        {"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}
    )


class _Digest:
    def __init__(self, key: str | None):
        self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, record: str, start: int, end: int) -> None:
        for role, text in parse(record):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if end > start:
            masked = unescape(record[start:end])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(record)

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed back from its formatted turns.

    A digest of a whole conversation needs its turns in order, so they are
    dealt out by conversation and sorted, and a task reads them as a stream: it
    holds one digest, never a whole conversation.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for f in frames:
            done = []
            for key, record, start, end in zip(f["key"], f["formatted"], f["loss_start"], f["loss_end"]):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                now.add(record, start, end)
            if done:
                yield pd.DataFrame(done, columns=columns)
        if now is not None:
            yield pd.DataFrame([now.row()], columns=columns)

    ordered = (
        formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
        .select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "formatted", "loss_start", "loss_end")
    )
    out = ordered.mapInPandas(work, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.expr("try_cast(conv_id as long)"))
