"""Text from keying evidence by dynamic programming over segments.

Evidence is a log-likelihood ratio per hop: positive for a mark. A reading cuts the hops into segments, marks and gaps in turn, each a kind with a usual length in
dots and a prior; its score is the evidence that it explains plus the priors of kinds and lengths. Cuts are at anchors, where the evidence changes sign, which
windows find in SQL. From each anchor on, the best few readings are kept, one for each place in the code, kind of the last segment and
speed; the speed follows the lengths. A character is given out once all readings of the newest anchor agree on it, or once it is
older than the lookahead; from then on only readings with it are followed, wherever they were cut. Its confidence is the margin to
the best reading that says otherwise.

Anchors of a track pass through one stream that carries the state, which holds anchors for as long as the longest silence only. A track is cut where it is
quiet for longer than that, so a long track is many streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.carried import carried, stretches
from spotlake.operators.morse import CODE
from spotlake.operators.temporal import by

GLYPHS = {pattern: glyph for glyph, pattern in CODE.items()}
PREFIXES = {pattern[:n] for pattern in GLYPHS for n in range(len(pattern) + 1)}
# Kinds of segments with their usual length in dots, and log of their prior; every mark costs a penalty, silences too.
MARK_PENALTY, SILENCE_PENALTY = -1.5, -4.0
MARKS = ((".", 1.0, math.log(0.6) + MARK_PENALTY), ("-", 3.0, math.log(0.4) + MARK_PENALTY))
GAPS = (("element", 1.0, math.log(0.62)), ("char", 3.0, math.log(0.28)), ("word", 7.0, math.log(0.10)), ("silence", 10.0, math.log(0.10) + SILENCE_PENALTY))
#: Lengths that a kind may have, as shares of its usual one.
LEAST_SHARE, MOST_SHARE = 0.6, 1.5


@dataclass(frozen=True)
class Settings:
    """Fixed values of the decoder: spread of log lengths, readings kept, lookahead in dots, rate of the speed, first speeds (hops a dot) and their bounds, scale of confidences, longest silence in dots."""

    spread: float = 0.22
    beam: int = 12
    lookahead: float = 25.0
    alpha: float = 0.2
    speeds: tuple[float, ...] = (9.0, 13.0, 18.0, 26.0, 38.0)
    slowest: float = 56.0
    fastest: float = 7.5
    kappa: float = 6.0
    silence: float = 80.0
    #: Give out what all readings agree on before the lookahead forces it.
    agree: bool = True

    def reach(self) -> float:
        return self.silence * self.slowest


@dataclass(frozen=True, slots=True)
class Reading:
    score: float
    #: Pattern since the last character, and whether a mark came last.
    node: str
    marked: bool
    unit: float
    #: Characters (and blanks for words) in all, and those of them not given out yet: each with the hop of the gap that closed it and the hop at which it was read.
    said: int
    pending: tuple[tuple[str, int, int], ...]

    def rank(self) -> tuple:
        return -self.score, [e[0] for e in self.pending], self.unit, self.node, self.marked


def followed(reading: Reading, length: int, evidence: float, at: int, cfg: Settings) -> list[Reading]:
    """The readings that one more segment makes, from hop `at` on."""
    out, narrow = [], 2 * cfg.spread * cfg.spread
    for kind, dots, prior in GAPS if reading.marked else MARKS:
        usual = dots * reading.unit
        if kind == "silence":
            if not usual <= length <= cfg.silence * reading.unit:
                continue
            fit = 0.0
        else:
            if not LEAST_SHARE * usual <= length <= MOST_SHARE * usual:
                continue
            fit = -(math.log(length / usual) ** 2) / narrow
        unit = reading.unit
        if kind not in ("word", "silence"):
            unit = min(max(unit + cfg.alpha * (length / dots - unit), cfg.fastest), cfg.slowest)
        score = reading.score + (-evidence if reading.marked else evidence) + fit + prior
        if not reading.marked:
            node = reading.node + kind
            if node in PREFIXES:
                out.append(Reading(score, node, True, unit, reading.said, reading.pending))
        elif kind == "element":
            out.append(Reading(score, reading.node, False, unit, reading.said, reading.pending))
        elif reading.node in GLYPHS:
            new = ((GLYPHS[reading.node], at, at + length),) if kind == "char" else ((GLYPHS[reading.node], at, at + length), (" ", at, at + length))
            out.append(Reading(score, "", False, unit, reading.said + len(new), reading.pending + new))
    return out


class Decoder:
    """The state of one stretch of a track."""

    def __init__(self, cfg: Settings):
        self.cfg, self.anchors, self.given = cfg, [], 0
        #: What was given out, by number, as far back as a reading may still say it.
        self.said: dict[int, str] = {}

    def _allowed(self, r: Reading) -> Reading | None:
        """r without what has been given out; null if it says otherwise."""
        first = r.said - len(r.pending)
        late = self.given - first
        if late <= 0:
            return r
        if any(self.said.get(first + i, r.pending[i][0]) != r.pending[i][0] for i in range(min(late, len(r.pending)))):
            return None
        return Reading(r.score, r.node, r.marked, r.unit, r.said, r.pending[late:])

    def push(self, hop: int, total: float) -> list[tuple[str, int, float]]:
        """The anchor at `hop`, evidence before it summing to total -> what can be given out: character or blank, hop, confidence."""
        if not self.anchors:
            self.anchors.append((hop, total, [Reading(0.0, "", False, u, 0, ()) for u in self.cfg.speeds]))
            return []
        while self.anchors and hop - self.anchors[0][0] > self.cfg.reach():
            self.anchors.pop(0)
        best: dict[tuple, Reading] = {}
        longest = MOST_SHARE * MARKS[-1][1], max(MOST_SHARE * GAPS[2][1], self.cfg.silence)
        for at, before, readings in self.anchors:
            for reading in readings:
                if hop - at > longest[reading.marked] * reading.unit:
                    continue  # no kind of segment is as long
                for r in followed(reading, hop - at, total - before, at, self.cfg):
                    key = r.node, r.marked, round(2 * r.unit)
                    if (old := best.get(key)) is None or r.score > old.score or (r.score == old.score and r.rank() < old.rank()):
                        if (r := self._allowed(r)) is not None:
                            best[key] = r
        live = sorted(best.values(), key=Reading.rank)[: self.cfg.beam]
        if not live:
            return []  # no cut fits here: the anchor is passed over
        out = self._given(live, hop)
        self.anchors.append((hop, total, live))
        return out

    def _given(self, live: list[Reading], hop: int, last: bool = False) -> list[tuple[str, int, float]]:
        out = []
        while live and live[0].pending:
            glyph, at, read = live[0].pending[0]
            says = [r.pending[0][0] if r.pending else None for r in live]
            agreed = self.cfg.agree and all(s == glyph for s in says)
            if not (last or agreed or hop - read > self.cfg.lookahead * live[0].unit):
                break
            against = max((r.score for r, s in zip(live, says, strict=True) if s != glyph), default=live[0].score - 4 * self.cfg.kappa)
            out.append((glyph, at, 1 / (1 + math.exp(-(live[0].score - against) / self.cfg.kappa))))
            self.said[self.given] = glyph
            self.given += 1
            live[:] = [r for r in (self._allowed(r) for r in live) if r is not None and r.said >= self.given]
            for i, (h, t, readings) in enumerate(self.anchors):
                self.anchors[i] = (h, t, [r for r in map(self._allowed, readings) if r is not None])
        least = min((r.said - len(r.pending) for _, _, readings in self.anchors for r in readings), default=self.given)
        self.said = {n: g for n, g in self.said.items() if n >= least}
        return out

    def finish(self) -> list[tuple[str, int, float]]:
        """The rest of the best reading, its last character closed by the end, whether or not a gap has begun."""
        if not self.anchors:
            return []
        hop, _, readings = self.anchors[-1]
        closed = []
        for r in readings:
            if r.node in GLYPHS:
                closed.append(Reading(r.score, "", False, r.unit, r.said + 1, (*r.pending, (GLYPHS[r.node], hop, hop))))
            elif not r.node:
                closed.append(r)
        return self._given(sorted(closed, key=Reading.rank), hop, last=True)


def anchors(hops: DataFrame, track: str, hop: str, evidence: str) -> DataFrame:
    """hops (track, hop, evidence) -> (track, hop, total): the first hop, each one whose evidence has another sign than the one before, and the end; total: the evidence before it."""
    order = by([track], hop)
    total = F.coalesce(F.sum(evidence).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    turned = F.coalesce((F.lag(evidence).over(order) > 0) != (F.col(evidence) > 0), F.lit(True))
    told = hops.select(F.col(track).alias("track"), F.col(hop).cast("long").alias("hop"), total.alias("total"), turned.alias("turned"), F.lead(hop).over(order).isNull().alias("last"), F.col(evidence).cast("double").alias("e"))
    here = F.filter(F.array(F.when(F.col("turned"), F.struct("hop", "total")), F.when(F.col("last"), F.struct((F.col("hop") + 1).alias("hop"), (F.col("total") + F.col("e")).alias("total")))), lambda a: a.isNotNull())
    return told.select("track", F.explode(here).alias("a")).select("track", "a.hop", "a.total")


def decode(anchored: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """(track, hop, total) -> (track, stretch, n, glyph, hop, confidence): characters and blanks of each track in order.

    A stretch ends where no anchor comes within the longest silence. Null hops are left out; of equal hops the anchor of smallest total counts.
    """
    cfg = cfg or Settings()
    once = anchored.where(F.col("hop").isNotNull() & F.col("total").isNotNull()).groupBy("track", "hop").agg(F.min("total").alias("total"))
    cut = stretches(once, ["track"], "hop", cfg.reach())

    class State:
        def __init__(self):
            self.decoder, self.n = Decoder(cfg), 0

        def numbered(self, out: list) -> list[tuple]:
            self.n += len(out)
            return [(self.n - len(out) + i, *o) for i, o in enumerate(out)]

    return carried(
        cut, ["track", "stretch"], ["hop"], ["hop", "total"], "n int, glyph string, hop bigint, confidence double", State,
        lambda s, hop, total: s.numbered(s.decoder.push(hop, total)), lambda s: s.numbered(s.decoder.finish()),
    )


def texts(decoded: DataFrame) -> DataFrame:
    """(track, text, confidence): the characters of a track in order, words parted by blanks, and the least confidence of a character."""
    held = F.sort_array(F.collect_list(F.struct("stretch", "n", "glyph")))
    said = decoded.groupBy("track").agg(held.alias("h"), F.min(F.when(F.col("glyph") != " ", F.col("confidence"))).alias("confidence"))
    return said.select("track", F.trim(F.regexp_replace(F.array_join(F.col("h.glyph"), ""), " +", " ")).alias("text"), "confidence")
