"""Signals of two tones that take turns: pairs of channels by block, evidence over blocks, and the text that such a pair frames.

A pair of tones keys exactly one of them at any instant: levels of both channels are anti-correlated, one of them is always up, each leads for a fair share, and
they lie a standard shift apart. What a block says of a pair is joins and aggregates over hot channels only; passing blocks add evidence, contradicting ones
take it away, and enough of it marks the pair until it has not passed for a while. The text comes from a start/stop framer over the two tones' levels, in both polarities at once
until one of them has framed a few characters. Evidence and framer are streams that carry a small state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.functions.numeric import CHANNEL_HZ, sign_correction
from spotlake.operators.carried import carried
from spotlake.operators.temporal import by

# Hops of a block, distances of channels, levels (dB) and shares of the tests, windows of shifts (Hz), blocks that a mark outlives its last pass, hops a second.
BLOCK, LAGS, HOT, RHO, FILL, FILL_SHARE, LEADS, LEAD_SHARE, PHASE = 375, (1, 2, 3, 4, 5, 9, 10), 6.0, -0.5, 10.0, 0.8, 6.0, 0.1, 10.0
SHIFTS, STANDARD, HOLD, HOPS = ((130.0, 230.0), (395.0, 475.0), (820.0, 885.0)), (170.0, 200.0, 425.0, 450.0, 850.0), 30, 375.0
# The five-bit code, letters and figures by number; \0 stands for none, 27 shifts to figures and 31 back to letters.
LETTERS = "\0E\nA SIU\rDRJNFCKTZLWHYPQOBG\0MXV\0"
FIGURES = "\0" + "3\n- '87\r$4\a,!:(5\")2#6019?&\0./;\0"
TO_FIGURES, TO_LETTERS = 27, 31


def judged_blocks(hops: DataFrame, block: int = BLOCK, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """hops (input, hop, channel, snr, re, im) -> input, block, low, high, rho, verdict (pass, contra, neutral), low_at, high_at (fractional channels), level, for each pair of hot channels.

    channel: in the order of frequency. Whole blocks only. snr: dB over the floor. re, im: the channel's output, for the exact frequencies; a hop without them says nothing of those.
    """
    rows = hops.withColumn("block", F.floor(F.col("hop") / block).cast("long"))
    means = rows.groupBy("input", "block", "channel").agg(F.avg("snr").alias("mean"), F.count("*").alias("n"))
    hot = means.where((F.col("mean") >= HOT) & (F.col("n") == block)).select("input", "block", "channel")
    warm = rows.join(hot, ["input", "block", "channel"], "left_semi")
    left = warm.select("input", "block", "hop", F.col("channel").alias("low"), F.col("snr").alias("a"), F.explode(F.array(*[F.col("channel") + d for d in lags])).alias("high"))
    right = warm.select("input", "hop", F.col("channel").alias("high"), F.col("snr").alias("b"))
    pairs = left.join(right, ["input", "hop", "high"])
    up = F.greatest("a", "b")
    share = lambda c: F.count_if(c) / F.lit(float(block))
    told = pairs.groupBy("input", "block", "low", "high").agg(
        F.coalesce(F.corr("a", "b"), F.lit(0.0)).alias("rho"), F.avg(up).alias("level"), share(up >= FILL).alias("fill"),
        share(F.col("a") - F.col("b") >= LEADS).alias("a_leads"), share(F.col("b") - F.col("a") >= LEADS).alias("b_leads"),
    )
    told = told.withColumn("rho", F.when(F.isnan("rho"), 0.0).otherwise(F.col("rho")))
    shaped = (F.col("rho") <= RHO) & (F.col("fill") >= FILL_SHARE) & (F.col("a_leads") >= LEAD_SHARE) & (F.col("b_leads") >= LEAD_SHARE)
    told = told.withColumn("shaped", shaped)
    alike = told.where("shaped").select("input", "block", "low", "high")
    # where each tone really is: of three channels the strongest while it leads, and that one's phase advance
    led = pairs.join(alike, ["input", "block", "low", "high"], "left_semi")
    tone = F.when(F.col("a") - F.col("b") >= LEADS, "low").when(F.col("b") - F.col("a") >= LEADS, "high")
    leads = led.withColumn("tone", tone).where("tone IS NOT NULL").select("input", "block", "low", "high", "hop", "tone", F.when(F.col("tone") == "low", F.col("low")).otherwise(F.col("high")).alias("middle"))
    leads = leads.withColumn("channel", F.explode(F.array(F.col("middle") - 1, F.col("middle"), F.col("middle") + 1)))
    level = leads.join(rows.select("input", "hop", "channel", "snr"), ["input", "hop", "channel"]).groupBy("input", "block", "low", "high", "tone", "channel").agg(F.avg("snr").alias("mean"))
    best = level.groupBy("input", "block", "low", "high", "tone").agg(F.max_by("channel", F.struct("mean", -F.col("channel"))).alias("channel"))
    turns = phase_advance(rows.join(best.select("input", "channel").distinct(), ["input", "channel"], "left_semi"))
    placed = best.join(turns, ["input", "block", "channel"], "left").withColumn("at", F.col("channel") + F.coalesce("turn", F.lit(0.0)))
    placed = placed.groupBy("input", "block", "low", "high").agg(F.max(F.when(F.col("tone") == "low", F.col("at"))).alias("low_at"), F.max(F.when(F.col("tone") == "high", F.col("at"))).alias("high_at"))
    shift = (F.col("high_at") - F.col("low_at")) * CHANNEL_HZ
    standard = F.lit(False)
    for least, most in SHIFTS:
        standard = standard | shift.between(least, most)
    verdict = F.when(F.col("rho") > 0, "contra").when(F.col("shaped") & F.coalesce(standard, F.lit(False)), "pass").otherwise("neutral")
    return told.join(placed, ["input", "block", "low", "high"], "left").select("input", "block", "low", "high", "rho", verdict.alias("verdict"), "low_at", "high_at", "level")


def phase_advance(rows: DataFrame) -> DataFrame:
    """(input, block, hop, channel, snr, re, im) -> input, block, channel, turn: mean phase advance a hop, in channels, over hops at or over PHASE."""
    order = by(["input", "channel"], "hop")
    sign = sign_correction(F.col("hop"), F.col("channel"))
    x = rows.withColumn("x", F.col("re") * sign).withColumn("y", F.col("im") * sign)
    x = x.withColumn("x0", F.lag("x").over(order)).withColumn("y0", F.lag("y").over(order)).where((F.col("snr") >= PHASE) & F.col("x0").isNotNull())
    summed = x.groupBy("input", "block", "channel").agg(F.sum(F.col("x") * F.col("x0") + F.col("y") * F.col("y0")).alias("c"), F.sum(F.col("y") * F.col("x0") - F.col("x") * F.col("y0")).alias("s"))
    turn = F.when((F.col("c") != 0) | (F.col("s") != 0), F.atan2("s", "c") / (2 * 3.141592653589793) * 4)
    return summed.select("input", "block", "channel", F.coalesce(turn, F.lit(0.0)).alias("turn"))


def evidence(judged: DataFrame, dwell: int, hold: int = HOLD) -> DataFrame:
    """judged_blocks() -> input, low, high, block, evidence, marked, passes, low_at, high_at (means over its passes), level, after each block that passes or contradicts.

    A pass adds one, a contradiction takes two; at `dwell` the pair is marked. All of it is forgotten when no block has passed for `hold` blocks, so a mark holds up to block + hold - 1.
    """

    def step(state: dict, block, verdict, low_at, high_at, level) -> list[tuple]:
        if state and block - state["last"] >= hold:
            state.clear()
        if verdict == "pass":
            if not state:
                state.update(evidence=0, passes=0, low=0.0, high=0.0, marked=False)
            state["evidence"] += 1
            state["passes"] += 1
            state["low"] += low_at
            state["high"] += high_at
            state["last"], state["level"] = block, level
            state["marked"] = state["marked"] or state["evidence"] >= dwell
        elif state:
            state["evidence"] = max(state["evidence"] - 2, 0)
        if not state:
            return []
        return [(block, state["evidence"], state["marked"], state["passes"], state["low"] / state["passes"], state["high"] / state["passes"], state["level"])]

    telling = judged.where(F.col("verdict").isin("pass", "contra"))
    outputs = "block bigint, evidence int, marked boolean, passes int, low_at double, high_at double, level double"
    return carried(telling, ["input", "low", "high"], ["block"], ["block", "verdict", "low_at", "high_at", "level"], outputs, dict, step)


def nominal_shift(shift: Column) -> Column:
    """The standard shift nearest to one in Hz, the lower of two as near."""
    return F.array_min(F.transform(F.array(*[F.lit(s) for s in STANDARD]), lambda s: F.struct(F.abs(s - shift).alias("off"), s.alias("shift"))))["shift"]


@dataclass
class Framer:
    """One polarity: a start bit after a bit of mark, five bits, a stop bit, each looked at in its middle."""

    bit: float
    idle: int = 0
    age: int | None = None
    stage: int = 0
    code: int = 0
    figures: bool = False
    good: int = 0
    pending: list[str] = field(default_factory=list)

    def push(self, mark: bool) -> str | None:
        before, self.idle = self.idle, self.idle + 1 if mark else 0
        if self.age is None:
            if not mark and before >= int(self.bit):
                self.age, self.stage, self.code = 0, 0, 0
            return None
        self.age += 1
        if self.age < (self.stage + 0.5) * self.bit:
            return None
        if 1 <= self.stage <= 5:
            self.code |= mark << (self.stage - 1)
        elif mark == (self.stage == 0):  # no start bit, or no stop bit
            self.age, self.good, self.pending = None, 0, []
            return None
        self.stage += 1
        if self.stage < 7:
            return None
        self.age, self.good = None, self.good + 1
        if self.code in (TO_FIGURES, TO_LETTERS):
            self.figures = self.code == TO_FIGURES
            return None
        glyph = (FIGURES if self.figures else LETTERS)[self.code]
        return None if glyph == "\0" else glyph


@dataclass
class Demodulator:
    """Both polarities until one has framed `trusted` characters in a row."""

    bit: float
    trusted: int = 3
    most_pending: int = 128
    believed: int | None = None
    framers: list[Framer] = field(init=False)

    def __post_init__(self):
        self.framers = [Framer(self.bit), Framer(self.bit)]

    def push(self, low: float, high: float) -> list[str]:
        out = []
        for i, framer in enumerate(self.framers):
            glyph = framer.push((high > low) != bool(i))
            if glyph is not None and self.believed == i:
                out.append(glyph)
            elif glyph is not None and self.believed is None:
                framer.pending = [*framer.pending, glyph][: self.most_pending]
        if self.believed is None:
            self.believed = next((i for i, f in enumerate(self.framers) if f.good >= self.trusted), None)
            if self.believed is not None:
                out = self.framers[self.believed].pending
        return out


def framed(tones: DataFrame, keys: list[str], hop: str, low: str, high: str, baud: float = 45.45, hops: float = HOPS) -> DataFrame:
    """tones (keys, hop, power of the lower and of the upper tone) -> keys, hop, n, glyph; n orders the glyphs that one hop released. A null power counts as none; hops have to come without gaps."""

    def step(state: Demodulator, at, x, y) -> list[tuple]:
        return [(at, n, glyph) for n, glyph in enumerate(state.push(x or 0.0, y or 0.0))]

    return carried(tones, keys, [hop], [hop, low, high], "hop bigint, n int, glyph string", lambda: Demodulator(hops / baud), step)
