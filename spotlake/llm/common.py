"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a column that an Arrow operator turns into Python objects at once; a single longer value goes alone.
SLICE_BYTES = 4 << 20
#: A key counts as hot when it holds more than one row in HOT_SHARE, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only in local mode where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spotlake-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return root


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as Parquet: for wide rows of which later readers need few columns."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(df: DataFrame, columns: list[str], **others: str) -> DataFrame:
    """Those columns of df, each as k_<name>: no name of an operator's own begins so, so none of them can clash. others: further columns, by the operator's names for them."""
    return df.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in columns], *[F.col(f"`{c}`").alias(name) for name, c in others.items()])


def unshielded(df: DataFrame, columns: list[str], *added: str | Column) -> DataFrame:
    """The columns of shielded() under their own names again, and those added."""
    return df.select(*[F.col(f"`k_{c}`").alias(c) for c in columns], *added)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose values in a string or binary column hold about `most` bytes, so that long texts aren't all held as objects."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def attach(rows: DataFrame, values: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the columns of values (one row per key, its number of rows in column n, `total` in all), null where there is none.

    Hot keys, of which there are fewer than HOT_SHARE, are joined by broadcast, so no task receives a hot key's rows; the others by a shuffle.
    """
    hot = values.where(F.col(n) * HOT_SHARE > total).drop(n)
    cold = values.where(F.col(n) * HOT_SHARE <= total).drop(n)
    marked = rows.join(F.broadcast(hot.select(F.col(key), F.struct(*[c for c in hot.columns if c != key]).alias("__hot"))), key, "left")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot").join(cold, key, "left")
    done = marked.where(F.col("__hot").isNotNull())
    done = done.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__hot.{c}").alias(c) for c in hot.columns if c != key])
    return rest.select(*done.columns).unionByName(done)
