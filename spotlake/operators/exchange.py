"""Roles of calls in decoded words: who calls, who is called, who is merely mentioned; by windows over the words of a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.text import is_plausible

#: Words that frame a call.
FILLERS, SIGN_OFFS = ("DX", "NA", "EU", "POTA", "SOTA"), ("TU", "EE", "SK", "73")


def word_kind(word: Column) -> Column:
    named = F.when(word.isin("CQ", "DE", "TEST", "UP", "V"), word).when(word.isin(*FILLERS), "filler").when(word.isin(*SIGN_OFFS), "signoff")
    return named.when(word.rlike(r"^[1-5][1-9N][1-9N]$"), "report").when(word.rlike(r"^[0-9]{1,4}$"), "serial").when(word.endswith("?"), "query").when(is_plausible(word), "call").otherwise("other")


def call_roles(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """words (keys, order, word) -> the calls with role and basis.

    First match of: DE follows, addressee; DE, or CQ through fillers, or TEST stands before, self; UP follows, self; a report,
    serial or query follows, addressee; a sign-off stands before, self; another call identified itself earlier in the turn, mention; else
    uncertain. Runs of one call count as one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    kinds = words.withColumn("kind", word_kind(F.col("word"))).withColumn("again", F.coalesce(F.lag("word").over(w) == F.col("word"), F.lit(False)) & (word_kind(F.col("word")) == "call"))
    once = kinds.where(~F.col("again"))
    before = F.lag("kind").over(w)
    after = F.lead("kind").over(w)
    solid = F.last(F.when(F.col("kind") != "filler", F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = once.withColumn("before", before).withColumn("after", after).withColumn("solid", solid)
    own = (F.col("before") == "DE") | (F.col("solid") == "CQ") | (F.col("before") == "TEST")
    basis = (
        F.when(F.col("after") == "DE", "called")
        .when(own, "framed")
        .when(F.col("after") == "UP", "up")
        .when(F.col("after").isin("report", "serial", "query"), "exchange")
        .when(F.col("before") == "signoff", "signoff")
    )
    calls = marked.where("kind = 'call'").withColumn("basis", basis)
    calls = calls.withColumn("self", F.col("basis").isin("framed", "up", "signoff"))
    earlier = F.max(F.coalesce(F.col("self"), F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    role = F.when(F.col("self"), "self").when(F.col("basis").isin("called", "exchange"), "addressee").when(F.coalesce(earlier, F.lit(False)), "mention").otherwise("uncertain")
    return calls.select(*keys, order, F.col("word").alias("call"), role.alias("role"), F.coalesce("basis", F.lit("none")).alias("basis"))
