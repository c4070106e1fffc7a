"""Which set of segments holds at a time, when that changes, and how much of a digital window a receiver covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
NEVER = 2**63 - 1
#: Fixed value: sample rates of digital cycles are multiples of it.
CYCLE_RATE = 12_000


def active_segments(utc: Column, base: str | None, daily: tuple[tuple[int, str], ...] = (), overrides: tuple[tuple[int, int, str], ...] = ()) -> Column:
    """The name of the set that holds at a time in seconds: an override (start, stop, name; half-open), else the last of the day's (minute, name) that has begun, the day's last before its first, else the base."""
    minute = F.floor(F.pmod(utc, F.lit(DAY)) / 60)
    out = F.lit(base).cast("string")
    if daily:
        ordered = sorted(daily)
        out = F.lit(ordered[-1][1])
        for begins, name in ordered:
            out = F.when(minute >= begins, name).otherwise(out)
    for start, stop, name in reversed(overrides):
        out = F.when((utc >= start) & (utc < stop), name).otherwise(out)
    return out


def next_change(utc: Column, daily: tuple[tuple[int, str], ...] = (), overrides: tuple[tuple[int, int, str], ...] = ()) -> Column:
    """The first time after this one at which active_segments() may change; NEVER without any."""
    second = F.pmod(utc, F.lit(DAY))
    until = lambda begins: F.pmod(F.lit(begins * 60) - second, F.lit(DAY))
    times = [utc + F.when(until(m) == 0, DAY).otherwise(until(m)) for m, _ in daily]
    times += [F.when(utc < t, F.lit(t)).otherwise(F.lit(NEVER)) for start, stop, _ in overrides for t in (start, stop)]
    return F.least(*[t.cast("long") for t in times], F.lit(NEVER)) if times else F.lit(NEVER)


def cycle_coverage(low: Column, high: Column, centre: Column, rate: Column, passband: tuple[Column, Column], trusted: tuple[Column, Column] | None = None) -> Column:
    """How a receiver around `centre` holds a window in Hz: inside, partial or outside; no_reference without a centre, unsupported_rate where the rate is no whole multiple of CYCLE_RATE. Bands are offsets from the centre."""
    left, right = passband
    if trusted is not None:
        left, right = F.greatest(left, trusted[0]), F.least(right, trusted[1])
    whole = (rate >= CYCLE_RATE) & (rate % CYCLE_RATE == 0)
    held = F.when((low >= centre + left) & (high <= centre + right), "inside").when((high > centre + left) & (low < centre + right), "partial").otherwise("outside")
    return F.when(F.coalesce(centre, F.lit(0)) == 0, "no_reference").when(~F.coalesce(whole, F.lit(False)), "unsupported_rate").otherwise(held)
