"""Noise of a channel by the least of its smoothed power, and static crashes against a reference that stands still while they last."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.carried import carried
from spotlake.operators.spectrum import running_minimum

# Hop and time constant (ms), window of the least (hops), corrections of a least of noise (dB), share of the neighbours' level.
HOP_MS, TAU_MS, WINDOW, LEAST_DB, NEIGHBOUR_DB, NEIGHBOUR_SHARE = 1000 / 375, 40.0, 563, 2.16, 1.5, 0.5
# Fixed values of crashes: lift and its offset (dB), hops to enter, to leave and after which the reference moves again, least channels, level of silence, rate of the reference.
LIFT_DB, OFFSET_DB, ENTER, LEAVE, LONGEST, LEAST_CHANNELS, SILENCE_DB, RATE = 6.0, 2.8, 3, 8, 750, 16, -140.0, 0.0645
ALPHA = 1 - math.exp(-HOP_MS / TAU_MS)


def smoothed_power(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """rows (channel, hop, power) -> channel, hop, power: each channel's exponential average, seeded by its first value. Null powers are passed over."""

    def step(state: list, hop: int, power: float) -> list[tuple]:
        state[:] = [power if not state else state[0] + alpha * (power - state[0])]
        return [(hop, state[0])]

    return carried(rows.where(F.col("power").isNotNull()), ["channel"], ["hop"], ["hop", "power"], "hop bigint, power double", list, step)


def noise_levels(rows: DataFrame, window: int = WINDOW, alpha: float = ALPHA, neighbours: DataFrame | None = None) -> DataFrame:
    """rows (channel, hop, power) -> channel, hop, noise: the least smoothed power of the last `window` hops, corrected for being a least.

    neighbours (channel, hop, level): no noise is below NEIGHBOUR_SHARE of their corrected level.
    """
    least = running_minimum(smoothed_power(rows, alpha), window).select("channel", "hop", (F.col("noise") * 10 ** (LEAST_DB / 10)).alias("noise"))
    if neighbours is None:
        return least
    floor = F.col("level") * (NEIGHBOUR_SHARE * 10 ** (NEIGHBOUR_DB / 10))
    return least.join(neighbours.select("channel", "hop", "level"), ["channel", "hop"], "left").select("channel", "hop", F.greatest("noise", floor).alias("noise"))


@dataclass
class Crash:
    """State of an input: reference level by channel and the runs that enter and leave a crash."""

    reference: object = None
    above: int = 0
    inside: bool = False
    below: int = 0
    run: int = 0
    count: int = 0

    def hop(self, levels: list[float], armed: bool) -> tuple[float | None, bool, int, int]:
        import numpy as np

        levels = np.asarray(levels, float)
        if self.reference is None:
            self.reference = levels.copy()
        judged = armed and len(levels) >= LEAST_CHANNELS
        lift = float(np.partition(levels - self.reference, len(levels) // 4)[len(levels) // 4]) + OFFSET_DB if judged else None
        above = lift is not None and lift >= LIFT_DB
        self.above = self.above + 1 if above else 0
        if above and (self.inside or self.above >= ENTER):
            self.below = 0
            if not self.inside:
                self.inside, self.run, self.count = True, 0, self.count + 1
        elif self.inside:
            self.below += 1
            self.inside = self.below < LEAVE
        self.run += self.inside
        # it stands still from the first lifted hop on, until a crash lasts so long that it is a change of level
        if not ((above or self.inside) and not (self.inside and self.run > LONGEST)):
            moved = self.reference + RATE * (levels - self.reference)
            self.reference = np.where(self.reference < SILENCE_DB, levels, moved)
        return lift, self.inside, self.run, self.count


def crash_hops(hops: DataFrame, warm: int = 0) -> DataFrame:
    """hops (input, hop, levels: array of dB by channel) -> input, hop, lift, crash, run, crashes. lift: at rank n // 4 over the channels, null while it isn't judged: in the first `warm` hops, and with too few channels."""

    def step(state: Crash, hop: int, levels: list[float]) -> list[tuple]:
        return [(hop, *state.hop(levels, hop >= warm))]

    return carried(hops.where(F.size("levels") > 0), ["input"], ["hop"], ["hop", "levels"], "hop bigint, lift double, crash boolean, run int, crashes int", Crash, step)
