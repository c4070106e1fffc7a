"""Streaming forms of the admission gates, on the same pure steps as the batch forms.

State is keyed, aged by event time and never by the clock: an entry is dropped once the watermark has passed it by more than
the gate's hold, since nothing that may still arrive can meet it. Rows of a micro-batch are taken in the order of their event
time and id, so a replay gives the same rows however it is cut into batches, as long as it arrives in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spotlake.operators.gates import greedy_step, respot_step


def _streamed(df: DataFrame, keys: list[str], at: str, hold_ms: int, schema, step) -> DataFrame:
    """df (with a watermark on the timestamp column `at`) through step(entries, rows) -> rows, per key."""
    state_type = "b array<bigint>, t array<bigint>, freq array<double>, snr array<double>, kind array<string>, source array<bigint>"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[int, tuple] = {}
        if state.exists:
            for b, *entry in zip(*(list(x) for x in state.get), strict=True):
                held[b] = tuple(entry)
        # the chunks of a key's micro-batch may overlap in time: they are put together before the step sorts them
        yield step(held, pd.concat(list(frames), ignore_index=True))
        newest = max((e[0] for e in held.values()), default=0)
        held = {b: e for b, e in held.items() if newest - e[0] <= hold_ms * 1000}
        state.update(tuple([list(held)] + [[e[i] for e in held.values()] for i in range(5)]))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(newest // 1000 + hold_ms, watermark) + 1)

    return df.groupBy(*keys).applyInPandasWithState(run, schema, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def greedy_gate(df: DataFrame, keys: list[str], at: str, tie: str, hold_ms: int, out: str = "admitted") -> DataFrame:
    """df with whether each row is admitted: nothing of its key was in the last hold_ms."""

    def step(held: dict, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, tie], kind="stable")
        verdicts = []
        for t in _micros(rows[at]):
            verdicts.append(greedy_step(held, t, hold_ms * 1000))
            if verdicts[-1]:
                held[0] = (t, 0.0, 0.0, "", 0)
        return rows.assign(**{out: verdicts})

    return _streamed(df, keys, at, hold_ms, T.StructType([*df.schema.fields]).add(out, "boolean"), step)


def respot_dedupe(df: DataFrame, call: str, at: str, tie: str, freq: str, snr: str, kind: str, source: str, hold_ms: int, bucket: float = 300.0, near: float = 93.75, gain: float = 6.0) -> DataFrame:
    """df with outcome: new, changed, duplicate or other_input."""

    def step(held: dict, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, tie], kind="stable")
        columns = (rows[c].tolist() for c in (freq, snr, kind, source))
        return rows.assign(outcome=[respot_step(held, *r, hold_ms * 1000, bucket, near, gain) for r in zip(_micros(rows[at]), *columns, strict=True)])

    return _streamed(df, [call], at, hold_ms, T.StructType([*df.schema.fields]).add("outcome", "string"), step)


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64")).tolist()
