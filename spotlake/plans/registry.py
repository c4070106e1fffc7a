"""Registered queries by name, each a function of (spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that DuckDB runs for the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t (microseconds) and k (from props)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("t")
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t, k)


#: The same view in DuckDB.
EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000
