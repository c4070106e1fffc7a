"""Who is sending, who is called, who is mentioned: the exchange grammar over decoded words, with the words that decided.

Words fall into classes; turns end after certain words, prosigns and silences, and nothing is read across their ends. Inside a turn, equal calls in a row, framing
words in a row and other words form segments, and a call's role hangs on a few segments before it and the one after it. So the whole grammar is two
sorted windows, one over words and one over segments of a turn, and a long transcript is as many groups as it has turns.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.text import CONVENTIONS, is_plausible

# Words of each class.
TURN_ENDS, QUERIES, SIGN_OFFS = ("K", "KN", "(", "BK", "AR", "SK"), ("?", "AGN", "AGN?", "RPT"), ("TU", "TNX", "QSL")
FILLERS = ("CONTEST", "WPX", "WW", "NA", "SS", "FD", "DX")
NAMED = {"CQ": "cq", "TEST": "test", "DE": "de", "UP": "up", "V": "v", "T": "t", "HH": "correction"}
#: Classes by form, the first that matches.
FORMS = {"report": r"^[1-5][1-9N][1-9N]$", "serial": r"^(?=.*[0-9])[0-9TN]{1,4}$", "qcode": r"^Q[A-Z]{2}\??$", "correction": r"^E{5,}$"}
CALL_FORM = r"^[A-Z0-9/]{3,15}$"
#: Spot types of the frames that have one.
SPOT_TYPES = {"cq": "cq", "de": "de", "up": "de", "beacon": "beacon"}


def upper(word: Column) -> Column:
    """A-Z in place of a-z, and nothing else."""
    return F.translate(word, string.ascii_lowercase, string.ascii_uppercase)


def word_class(word: Column) -> Column:
    """The class of an upper-case word; the first that matches."""
    out = F.when(word.isin(*TURN_ENDS), "end")
    for name, kind in NAMED.items():
        out = out.when(word == name, kind)
    out = out.when(word.isin(*QUERIES), "query").when(word.isin(*FILLERS), "filler").when(word.isin(*SIGN_OFFS), "signoff")
    for kind, form in FORMS.items():
        out = out.when(word.rlike(form), kind)
    call = word.rlike(CALL_FORM) & ~F.substring_index(word, "/", 1).isin(*CONVENTIONS)
    return out.when(call, "call").otherwise("other")


def _segments(words: DataFrame, keys: list[str], order: str, word: str, ends_turn: str | None, corrected: str | None) -> DataFrame:
    """keys, turn, seg, and of each segment: kind, first and last place a and b, number of words n, last word, whether it has a CQ or begins with TEST, class of its first word, corrected, ends."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    whole = Window.partitionBy(*keys).orderBy(order)
    told = words.select(*keys, order, upper(F.coalesce(F.col(word), F.lit(""))).alias("w"), flag(ends_turn).alias("ends"), flag(corrected).alias("bad"))
    told = told.withColumn("kind", word_class(F.col("w"))).withColumn("at", F.row_number().over(whole).cast("long") - 1)
    closes = F.when(F.col("ends") | (F.col("kind") == "end"), 1).otherwise(0)
    told = told.withColumn("turn", F.coalesce(F.sum(closes).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    group = F.when(F.col("kind").isin("cq", "test", "filler"), "frame").when(F.col("kind") == "v", "v").when(F.col("kind") == "call", F.concat(F.lit("call "), F.col("w")))
    turn = Window.partitionBy(*keys, "turn").orderBy("at")
    told = told.withColumn("g", group)
    told = told.withColumn("opens", F.coalesce(F.col("g") != F.lag("g").over(turn), F.lit(True)) | F.col("g").isNull() | ((F.col("kind") == "call") & F.lag("bad").over(turn)))
    told = told.withColumn("seg", F.sum(F.col("opens").cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c: F.max_by(c, "at")
    return told.groupBy(*keys, "turn", "seg").agg(
        F.when(F.min("g") == "frame", "frame").otherwise(F.min("kind")).alias("kind"),
        F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"), last("w").alias("w"), last("bad").alias("bad"), last("ends").alias("ends"),
        F.bool_or(F.col("kind") == "cq").alias("has_cq"), (F.min_by("kind", "at") == "test").alias("tests"), F.min_by("kind", "at").alias("first"),
    )


def interpret(words: DataFrame, keys: list[str], order: str, word: str, ends_turn: str | None = None, corrected: str | None = None, complete: bool = True) -> DataFrame:
    """words -> keys, place (from 0), call, role, frame, basis, settled, span_start, span_end (the words that decided, end exclusive), a row for each call.

    role: self, addressee, mention or uncertain; frame of a self only. Not settled: a later word may change it. The rules, in order: a correction
    after the calls withdraws them; before DE stands who is called; DE, CQ through fillers, TEST, and V three times frame the sender, TEST after a sign-off or another
    call does not; before UP stands the sender; before a report, serial or query who is called; after a sign-off the sender signs; another call
    after a sender's own is a mention. Order breaks no ties: give a unique one. Null words are words of no class.
    """
    segs = _segments(words, keys, order, word, ends_turn, corrected)
    w = Window.partitionBy(*keys, "turn").orderBy("seg")
    one = F.struct("kind", "a", "b", "n", "w", "bad", "has_cq", "tests")
    told = segs
    for i in range(1, 6):
        told = told.withColumn(f"p{i}", F.lag(one, i).over(w))
    told = told.withColumn("after", F.when(F.col("ends"), "end").otherwise(F.lead("first").over(w))).withColumn("followed", F.lead("first").over(w).isNotNull() & ~F.col("ends"))
    # a correction, or calls withdrawn by one, is looked through once
    skip = F.when(F.col("p1.kind") == "correction", F.when(F.col("p2.kind") == "call", 2).otherwise(1)).when((F.col("p1.kind") == "call") & F.col("p1.bad"), 1).otherwise(0)
    told = told.where("kind = 'call'").withColumn("skip", skip)
    for name, i in (("e", 1), ("eb", 2), ("ebb", 3)):
        told = told.withColumn(name, F.when(F.col("skip") == 2, F.col(f"p{i + 2}")).when(F.col("skip") == 1, F.col(f"p{i + 1}")).otherwise(F.col(f"p{i}")))
    parting = lambda p: F.coalesce(((F.col(f"{p}.w") != F.col("w")) & is_plausible(F.col(f"{p}.w"))) | F.col(f"{p}.w").isin(*SIGN_OFFS), F.lit(False))
    led = F.coalesce((F.col("eb.kind") == "frame") & (F.col("eb.has_cq") | (F.col("eb.tests") & ~parting("ebb"))), F.lit(False))
    kind = F.col("e.kind")
    back = (
        F.when((kind == "de") & (led | (F.col("after") == "cq")), "de cq").when(kind == "de", "de")
        .when((kind == "frame") & F.col("e.has_cq"), "cq").when((kind == "frame") & F.col("e.tests"), F.when(parting("eb"), "parting test").otherwise("test"))
        .when((kind == "v") & (F.col("e.n") >= 3), "beacon").when(kind == "signoff", "signoff")
    )
    start = F.when((kind == "de") & led, F.col("eb.a")).when(kind.isin("de", "frame", "signoff"), F.col("e.a")).when((kind == "v") & (F.col("e.n") >= 3), F.col("e.b") - 2).otherwise(F.col("a"))
    told = told.withColumn("back", back).withColumn("span_start", start)
    framed = F.col("back").isin("de cq", "de", "cq", "test", "beacon")
    told = told.withColumn("framed", F.coalesce(framed, F.lit(False))).withColumn("next", F.col("b") + F.when(F.col("followed"), 2).otherwise(1))
    frame = F.when(F.col("back").isin("de cq", "cq", "test"), "cq").otherwise(F.col("back"))
    basis = F.when(F.col("back").isin("de cq", "de"), "after_de").when(F.col("back") == "beacon", "preamble").otherwise(F.concat(F.lit("after_"), F.col("back")))

    def verdict(role: str, basis: Column | str, end: str, frame: Column | str | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        ends = F.col("next") if end == "next" else F.col("b") + 1
        return F.struct(F.lit(role).alias("role"), lit(frame).alias("frame"), lit(basis).alias("basis"), ends.alias("end"))

    plain_end = F.when(F.col("framed") & (F.col("after") == "cq"), F.col("next")).otherwise(F.col("b") + 1)
    self_framed = F.struct(F.lit("self").alias("role"), frame.alias("frame"), basis.alias("basis"), plain_end.alias("end"))
    signing = verdict("self", "after_signoff", "b", "signoff")
    called = verdict("addressee", "before_de", "next")
    after = F.coalesce(F.col("after"), F.lit(""))
    rule = (
        F.when((after == "correction") | F.col("bad"), verdict("uncertain", "corrected", "next"))
        .when(after == "de", called)
        .when(F.col("framed"), self_framed)
        .when(F.col("back") == "parting test", verdict("uncertain", "parting_test", "b"))
        .when(after == "up", verdict("self", "before_up", "next", "up"))
        .when(after.isin("report", "serial"), verdict("addressee", "before_report", "next"))
        .when(after == "query", verdict("addressee", "before_query", "next"))
        .when(F.col("back") == "signoff", signing)
    )
    # of calls before DE only the last is called for sure: earlier ones are the sender's if framed
    earlier = F.when(~((after == "correction") | F.col("bad")) & (after == "de"), F.when(F.col("framed"), self_framed).when(F.col("back") == "signoff", signing).otherwise(called)).otherwise(rule)
    told = told.withColumn("last_is", rule).withColumn("others_are", earlier)
    own = F.when(is_plausible(F.col("w")) & ((F.col("last_is.role") == "self") | ((F.col("n") > 1) & (F.col("others_are.role") == "self"))), F.col("w"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("own", own)
    named = F.coalesce((F.min("own").over(before) != F.col("w")) | (F.max("own").over(before) != F.col("w")), F.lit(False))
    told = told.withColumn("rest", F.when(named, verdict("mention", "mention_in_turn", "b")).otherwise(verdict("uncertain", "no_frame", "b")))
    each = told.select(*keys, "w", "b", "rest", "last_is", "others_are", "span_start", (F.col("followed") | F.col("ends") | F.lit(complete)).alias("settled"), F.explode(F.sequence("a", "b")).alias("place"))
    said = F.coalesce(F.when(F.col("place") == F.col("b"), F.col("last_is")).otherwise(F.col("others_are")), F.col("rest"))
    each = each.withColumn("v", said)
    return each.select(*keys, "place", F.col("w").alias("call"), "v.role", "v.frame", "v.basis", "settled", "span_start", F.col("v.end").alias("span_end"))


def power_steps(words: DataFrame, keys: list[str], order: str, word: str) -> DataFrame:
    """keys, place, call of each word that ends in a call's letters and is followed by a lone T: a beacon's power steps; framed: a bare CQ, TEST or DE stands anywhere in the text, which voids them."""
    w = Window.partitionBy(*keys).orderBy(order)
    text = upper(F.coalesce(F.col(word), F.lit("")))
    told = words.select(*keys, text.alias("w"), (F.row_number().over(w).cast("long") - 1).alias("place"), F.lead(text).over(w).alias("next"))
    told = told.withColumn("framed", F.bool_or(F.col("w").isin("CQ", "TEST", "DE")).over(Window.partitionBy(*keys)))
    call = F.regexp_extract("w", r"\b([A-Z0-9/]{3,15})$", 1)
    return told.where((F.col("next") == "T") & (call != "")).select(*keys, "place", call.alias("call"), "framed")


def context_matches(words: DataFrame, keys: list[str], order: str, word: str) -> DataFrame:
    """keys, place, call, spot_type, span_start, span_end: calls that a whole text shows to be sending, and its power steps where nothing in it frames a call."""
    types = F.create_map(*[F.lit(x) for item in SPOT_TYPES.items() for x in item])
    own = interpret(words, keys, order, word).where((F.col("role") == "self") & F.col("frame").isin(*SPOT_TYPES))
    own = own.select(*keys, "place", "call", F.element_at(types, F.col("frame")).alias("spot_type"), "span_start", "span_end")
    steps = power_steps(words, keys, order, word).where("NOT framed")
    return own.unionByName(steps.select(*keys, "place", "call", F.lit("beacon").alias("spot_type"), F.col("place").alias("span_start"), (F.col("place") + 2).alias("span_end")))
