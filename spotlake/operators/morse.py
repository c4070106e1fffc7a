"""Morse keying of texts as rows of marks and spaces, and decoding of such runs, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The international code.
CODE = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---", "K": "-.-", "L": ".-..", "M": "--",
    "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-", "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-", "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
    "/": "-..-.", "?": "..--..", ".": ".-.-.-", ",": "--..--", "=": "-...-",
}
#: Gaps in dits from which a space parts characters, and words.
CHAR_GAP, WORD_GAP = 2.0, 5.0


def encoded(text: Column) -> Column:
    """A text as code: dots and dashes, characters apart by a blank, words by ' / '. Characters without a code are left out."""
    code = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    words = F.filter(F.split(F.regexp_replace(F.upper(text), r"[^A-Z0-9/?.,= ]", ""), " "), lambda w: w != "")
    spelled = F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit("."), F.lit(0)), lambda c: F.element_at(code, c)), " "))
    return F.array_join(spelled, " / ")


def keyed_runs(df: DataFrame, track: str, text: str, dit: Column) -> DataFrame:
    """(track, text) -> track, seq, mark, length: marks and the spaces after them, in the unit of dit."""
    stream = F.replace(F.replace(encoded(F.col(text)), F.lit(" / "), F.lit("W")), F.lit(" "), F.lit("C"))
    elements = df.select(F.col(track).alias("track"), dit.alias("dit"), F.posexplode(F.regexp_extract_all(stream, F.lit("[.-][WC]?"), F.lit(0))).alias("n", "e"))
    on = F.when(F.startswith("e", F.lit("-")), 3).otherwise(1)
    off = F.when(F.endswith("e", F.lit("W")), 7).when(F.endswith("e", F.lit("C")), 3).otherwise(1)
    runs = F.array(F.struct((F.col("n") * 2).alias("seq"), F.lit(True).alias("mark"), (on * F.col("dit")).alias("length")), F.struct((F.col("n") * 2 + 1).alias("seq"), F.lit(False).alias("mark"), (off * F.col("dit")).alias("length")))
    return elements.select("track", F.explode(runs).alias("r")).select("track", "r.seq", "r.mark", "r.length")


def dit_length(runs: DataFrame) -> DataFrame:
    """Per track the dit: the mean of the shorter cluster of marks, parted from the longer at the geometric mean of the shortest and longest; all marks alike are dits."""
    marks = runs.where("mark")
    ends = marks.groupBy("track").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    edge = F.when(F.col("high") / F.col("low") < 2, F.col("high")).otherwise(F.sqrt(F.col("low") * F.col("high")))
    return marks.join(ends.select("track", edge.alias("edge")), "track").groupBy("track").agg(F.avg(F.when(F.col("length") <= F.col("edge"), F.col("length"))).alias("dit"))


def decode_runs(runs: DataFrame) -> DataFrame:
    """(track, seq, mark, length) -> track, text. Marks over two dits are dashes; gaps part characters and words; unknown patterns are `?`.

    Characters are grouped by running sums of gaps, so the work is two windows and two aggregations per track.
    """
    glyphs = F.create_map(*[F.lit(x) for c, pattern in CODE.items() for x in (pattern, c)])
    scaled = runs.join(dit_length(runs), "track").withColumn("dits", F.col("length") / F.col("dit"))
    order = Window.partitionBy("track").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    after = lambda least: F.coalesce(F.sum(F.when(~F.col("mark") & (F.col("dits") >= least), 1).otherwise(0)).over(order), F.lit(0))
    placed = scaled.withColumn("char", after(CHAR_GAP)).withColumn("word", after(WORD_GAP)).where("mark")
    element = F.when(F.col("dits") > 2, "-").otherwise(".")
    chars = placed.groupBy("track", "word", "char").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", element.alias("e"))))["e"], "").alias("pattern"))
    glyph = F.coalesce(F.element_at(glyphs, F.col("pattern")), F.lit("?"))
    words = chars.groupBy("track", "word").agg(F.array_join(F.sort_array(F.collect_list(F.struct("char", glyph.alias("g"))))["g"], "").alias("w"))
    return words.groupBy("track").agg(F.array_join(F.sort_array(F.collect_list(F.struct("word", "w")))["w"], " ").alias("text"))
