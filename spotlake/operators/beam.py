"""Characters from the lengths of their marks: a beam over the code trie, in column functions.

A node of the trie is the pattern up to it. Each mark extends every kept node by a dot and by a dash, at the log-likelihood of its length under each; nodes
off the trie fall away and the best `width` are kept. What is left and stands for a character is a reading, its confidence a softmax over the readings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotlake.operators.morse import CODE

#: 0 for a dot and 1 for a dash, so that equal scores go dot first.
PATTERNS = {pattern.replace(".", "0").replace("-", "1"): glyph for glyph, pattern in CODE.items()}
PREFIXES = sorted({pattern[:n] for pattern in PATTERNS for n in range(1, len(pattern) + 1)})
#: Nodes kept, spread of log lengths, and dots in a row that are a sender's mark of an error.
WIDTH, SIGMA, ERROR_DOTS = 4, 0.25, 6
READING = "array<struct<glyph:string,score:double,confidence:double>>"


def char_readings(marks: Column, dot: Column, dash: Column, quality: Column | None = None, width: int = WIDTH, sigma: float = SIGMA) -> Column:
    """marks (array of lengths) of one character -> its readings, best first; dot, dash: their usual lengths, in the same unit.

    Null where nothing on the trie has so many marks, or there are none; `?` of confidence 0 where no kept node is a character. Six dots or more are
    one reading, `<err>`.
    """
    quality = F.lit(1.0) if quality is None else quality
    start = F.array(F.struct(F.lit(0.0).alias("worse"), F.lit("").alias("path")))

    def grown(h: Column, d: Column) -> Column:
        off = lambda usual: F.pow(F.log(d) - F.log(usual), F.lit(2.0)) / (2 * sigma * sigma)
        return F.array(*[F.struct((h["worse"] + off(usual)).alias("worse"), F.concat(h["path"], F.lit(c)).alias("path")) for c, usual in (("0", dot), ("1", dash))])

    def step(beam: Column, d: Column) -> Column:
        every = F.filter(F.flatten(F.transform(beam, lambda h: grown(h, d))), lambda h: h["path"].isin(PREFIXES))
        return F.slice(F.array_sort(every), 1, width)

    kept = F.aggregate(marks, start, step)
    glyphs = F.create_map(*[F.lit(x) for item in PATTERNS.items() for x in item])
    named = F.transform(F.filter(kept, lambda h: h["path"].isin(list(PATTERNS))), lambda h: F.struct(F.element_at(glyphs, h["path"]).alias("glyph"), (-h["worse"]).alias("score")))
    total = F.aggregate(named, F.lit(0.0), lambda a, r: a + F.exp(r["score"] - named[0]["score"]))
    told = F.transform(named, lambda r: F.struct(r["glyph"].alias("glyph"), r["score"].alias("score"), (F.exp(r["score"] - named[0]["score"]) / total * quality).alias("confidence")))
    one = lambda glyph, confidence: F.array(F.struct(F.lit(glyph).alias("glyph"), F.lit(0.0).alias("score"), confidence.cast("double").alias("confidence"))).cast(READING)
    dots = (F.size(marks) >= ERROR_DOTS) & F.forall(marks, lambda d: d < F.sqrt(dot * dash))
    none = F.coalesce(F.size(marks) <= 0, F.lit(True)) | (~dots & (F.size(kept) == 0))
    return F.when(none, F.lit(None).cast(READING)).when(dots, one("<err>", quality)).when(F.size(named) == 0, one("?", F.lit(0.0))).otherwise(told.cast(READING))
