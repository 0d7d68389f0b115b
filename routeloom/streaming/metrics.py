"""Incremental log metrics as a stateful stream, and idempotent sinks.

The state of a run is its unfinished last line, phase, progress, last signature and sequence number: bounded, whatever
the length of the log. The batch twin is ``operators.logs.metric_points``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from routeloom.operators.logs import _FIELDS, _NUMBER, PHASES

POINT = "run string, sequence long, phase string, kind string, loss double, epoch double, learning_rate double, grad_norm double, step long, total_steps long"
_STATE = "rest string, phase string, done long, total long, signature string, sequence long"
_PROGRESS = re.compile(r"(?<![\d.])(\d[\d,]*)\s*/\s*(\d[\d,]*)(?![\d.])")
_ANSI = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]")


def _point(line: str, state: list, run: str) -> tuple | None:
    """Advance the state by one line; the point that it completes, if any."""
    line = _ANSI.sub("", line)
    for name, _, patterns in PHASES:
        if any(re.search(p, line) for p in patterns):
            if state[1] != name:
                state[1], state[2], state[3] = name, None, None
            break
    if found := _PROGRESS.findall(line):
        state[2], state[3] = (int(x.replace(",", "")) for x in found[-1])
    values = {}
    for f in _FIELDS:
        if m := re.search(rf"[\"']{f}[\"']\s*:\s*({_NUMBER})", line):
            x = float(m[1])
            values[f] = x if abs(x) != float("inf") else None
    if values.get("loss") is None and values.get("eval_loss") is None:
        return None
    kind = "eval" if values.get("eval_loss") is not None else "train"
    loss = values["eval_loss"] if kind == "eval" else values["loss"]
    row = (state[1], kind, loss, values.get("epoch"), values.get("learning_rate"), values.get("grad_norm"), state[2])
    if (mark := repr(row)) == state[4]:
        return None
    state[4], state[5] = mark, state[5] + 1
    return (run, state[5], *row, state[3])


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(state.get) if state.exists else ["", "unknown", None, None, "", 0]
    rows = pd.concat(list(parts)).sort_values("seq")
    points = []
    for text in rows["text"]:
        lines = re.split(r"\r\n|\n|\r", held[0] + (text or ""))
        held[0] = lines.pop()
        points += [p for line in lines if (p := _point(line, held, str(key[0]))) is not None]
    state.update(tuple(held))
    names = [c.split()[0] for c in POINT.split(", ")]
    yield pd.DataFrame(points, columns=names).astype({"step": "Int64", "total_steps": "Int64"})


def metric_stream(chunks: DataFrame) -> DataFrame:
    """Points of a stream of ``run, seq, text`` chunks; a chunk may end within a line, which then waits for the next."""
    return chunks.groupBy("run").applyInPandasWithState(_advance, POINT, _STATE, "append", GroupStateTimeout.NoTimeout)


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes each batch to its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
