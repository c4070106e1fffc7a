"""Families of values that pairs link, over DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares (spark.checkpoint.dir) and read back; a temporary folder only in local mode where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spotlake-"))
    return df.checkpoint()


def families(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member, family): each value of a pair with the smallest value that it reaches. Every round takes the smallest of the neighbours' and then of that one's own."""
    links = pairs.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    links = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    own = cut(links.select(F.col("x").alias("member")).distinct().withColumn("family", F.col("member")))
    while True:
        near = links.join(own.select(F.col("member").alias("y"), "family"), "y").groupBy(F.col("x").alias("member")).agg(F.min("family").alias("near"))
        closer = own.join(near, "member").select("member", F.col("family").alias("old"), F.least("family", "near").alias("via"))
        onward = own.select(F.col("member").alias("via"), F.col("family").alias("next"))
        own = cut(closer.join(onward, "via").select("member", F.least("via", "next").alias("family"), "old"))
        if own.where("family <> old").isEmpty():
            return own.select("member", "family")
        own = own.select("member", "family")
