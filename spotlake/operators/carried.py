"""Rows of a key in order through a small step that carries a state, as streams of Arrow batches.

For rules in which a row hangs on all rows before it, so that no window frame can say them. Rows are dealt over tasks by key, sorted there,
and run through once; only the state of one key is held, never its rows. One key is one stream, however hot: where rows before some place cannot matter
(a long silence, say), put a number that grows there among the keys, as stretches() does, and a key becomes many streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spotlake.operators.temporal import by


def stretches(df: DataFrame, keys: list[str], at: str, silence: float, out: str = "stretch") -> DataFrame:
    """df with a number that grows at each row of its key that comes `silence` or more after the row before.

    Cells of half a silence are numbered, not rows: a window over the occupied cells, with their first and last row, finds the silences, so a key's rows are not sorted for it in one task.
    """
    cell = F.when(F.isnan(at), F.lit(2**63 - 1)).otherwise(F.floor(F.col(at) / (silence / 2)))
    cells = df.groupBy(*keys, cell.alias("__cell")).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    order = by(keys, "__cell")
    opens = F.coalesce(F.col("__first") - F.lag("__last").over(order) >= silence, F.lit(False))
    numbered = cells.withColumn("__opens", opens).withColumn(out, F.count_if("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = {c: f"__of{i}" for i, c in enumerate([*keys, "__cell"])}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return df.withColumn("__cell", cell).join(numbered.select(*[F.col(c).alias(n) for c, n in names.items()], out), same).drop("__cell", *names.values())


def carried(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], object], step: Callable, end: Callable | None = None) -> DataFrame:
    """keys and outputs (a schema string) of the tuples that step(state, *inputs) and, after a key's last row, end(state) give.

    Each returns any number of tuples; the state is whatever start() makes and step() changes.
    """
    # a column that is key, order and input at once is sorted and sent once
    names = list(dict.fromkeys([*keys, *order, *inputs]))
    n_keys, at = len(keys), [names.index(c) for c in inputs]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).repartition(*[f"c{i}" for i in range(n_keys)])
    rows = rows.sortWithinPartitions(*[f"c{i}" for i in range(n_keys)], *[f"c{names.index(c)}" for c in order])
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in keys]).schema.fields, *T.StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out: list[tuple] = []
            for row in zip(*columns, strict=True):
                if key is None or row[:n_keys] != key:
                    if key is not None and end is not None:
                        out += [key + tuple(o) for o in end(state)]
                    key, state = row[:n_keys], start()
                out += [key + tuple(o) for o in step(state, *[row[i] for i in at])]
            yield _batch(out, arrow)
        if key is not None and end is not None:
            yield _batch([key + tuple(o) for o in end(state)], arrow)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def running(value: Column, keys: list[str], *order: str) -> Column:
    """The sum of value over a key's rows up to and with this one."""
    return F.sum(value).over(by(keys, *order).rowsBetween(Window.unboundedPreceding, 0))
