"""Admission gates over ordered rows of a key: greedy re-admission, re-spot dedupe, repetition counts, rate limits.

Whether a row passes depends on the last row that passed, which no window frame can say. A gate is one pure step, used by the
batch form here and by the streaming form in spotlake.streaming. In batch a key is cut where it cannot matter: after a silence of at
least the hold, nothing from before counts, so each stretch between such silences stands alone. Stretches of one row need no state and
pass in SQL; the others are dealt over tasks by key and stretch, sorted, and run through in one stream of Arrow batches that carries
the state from row to row. So no stretch is held in memory, however long; a key without any silence is one stream, since each of
its rows may hang on all before.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.operators.temporal import by

State = dict[int, tuple]


def greedy_step(state: State, t: int, hold: int) -> bool:
    """Admit if nothing was admitted in the last `hold`; a refused row does not renew the hold."""
    last = state.get(0)
    if last is not None and t - last[0] < hold:
        return False
    state[0] = (t,)
    return True


def respot_step(state: State, t: int, freq: float, snr: float, kind: str, source: int, window: int, bucket: float, near: float, gain: float) -> str:
    """Outcome of a spot of one call: new, changed, duplicate or other_input.

    Entries are kept per frequency bucket; a neighbour bucket's entry within `near` stands for this one. An entry in the window from
    another input withholds the spot; otherwise the newest of its own decides, that of its own bucket if both are as new: emit again on
    a gain or a change of kind.
    """
    own = int(round(freq / bucket))
    beside = own + (1 if freq / bucket > own else -1)
    at_own, at_edge = (e if e is not None and t - e[0] < window else None for e in (state.get(own), state.get(beside)))
    if at_edge is not None and abs(at_edge[1] - freq) >= near:
        at_edge = None
    if any(e is not None and e[4] != source for e in (at_own, at_edge)):
        return "other_input"
    last = at_edge if at_own is None or (at_edge is not None and at_edge[0] > at_own[0]) else at_own
    if last is not None and snr - last[2] < gain and kind == last[3]:
        return "duplicate"
    before = state.get(own)
    state[own] = (max(t, before[0]) if before else t, freq, snr, kind, source)
    return "new" if last is None else "changed"


def _streamed(df: DataFrame, keys: list[str], at: str, tie: str, hold: int, out: str, kind: str, alone, inputs: list[str], start: Callable[[], object], step: Callable) -> DataFrame:
    """df with out: step(state, *inputs) of each row, in the order of at and tie within a key; alone: its value for a row without others in its hold."""
    order = by(keys, at, tie)
    before, after = F.col(at) - F.lag(at).over(order), F.lead(at).over(order) - F.col(at)
    opens = F.coalesce(before >= hold, F.lit(True))
    marked = df.withColumn("__opens", opens).withColumn("__lone", opens & F.coalesce(after >= hold, F.lit(True)))
    stretch = F.count_if("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("__stretch", stretch)
    lone = marked.where("__lone").select(*df.columns, F.lit(alone).cast(kind).alias(out))
    rest = marked.where("NOT __lone").repartition(*keys, "__stretch").sortWithinPartitions(*keys, "__stretch", at, tie)
    names, types = df.columns, {"boolean": pa.bool_(), "string": pa.string(), "integer": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            verdicts = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__opens", *inputs)]
            for first, *values in zip(*columns, strict=True):
                if first:
                    state = start()
                verdicts.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(verdicts, types[kind])], names=[*names, out])

    return lone.unionByName(rest.select(*df.columns, "__opens").mapInArrow(run, T.StructType([*df.schema.fields]).add(out, kind)))


def greedy_gate(df: DataFrame, keys: list[str], at: str, tie: str, hold: int, out: str = "admitted") -> DataFrame:
    """df with whether each row is admitted."""
    return _streamed(df, keys, at, tie, hold, out, "boolean", True, [at], dict, lambda state, t: greedy_step(state, t, hold))


def respot_dedupe(df: DataFrame, call: str, at: str, tie: str, freq: str, snr: str, kind: str, source: str, window: int, bucket: float = 300.0, near: float = 93.75, gain: float = 6.0) -> DataFrame:
    """df with outcome (new, changed, duplicate, other_input)."""
    return _streamed(df, [call], at, tie, window, "outcome", "string", "new", [at, freq, snr, kind, source], dict, lambda state, *row: respot_step(state, *row, window, bucket, near, gain))


def rate_limit(df: DataFrame, keys: list[str], at: str, tie: str, window: int, most: int, out: str = "allowed") -> DataFrame:
    """df with whether a row is among the first `most` of its tumbling window."""
    frame = df.withColumn("__w", F.floor(F.col(at) / window))
    return frame.withColumn(out, F.row_number().over(by([*keys, "__w"], at, tie)) <= most).drop("__w")


def message_repetitions(df: DataFrame, keys: list[str], at: str, tie: str, word: str, window: int, words_apart: int, time_apart: int, out: str = "repetitions") -> DataFrame:
    """df with the distinct messages counted for its key so far: a row counts if it is words_apart words or time_apart after the last that counted; those older than window are forgotten."""

    def step(counted: deque[tuple[int, int]], t: int, w: int) -> int:
        while counted and t - counted[0][0] > window:
            counted.popleft()
        if not counted or abs(w - counted[-1][1]) >= words_apart or t - counted[-1][0] >= time_apart:
            counted.append((t, w))
        return len(counted)

    return _streamed(df, keys, at, tie, window + 1, out, "integer", 1, [at, word], deque, step)
