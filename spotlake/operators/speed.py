"""Speed of a sender from the lengths of its marks and gaps: two clusters that follow it, and a bank of competing hypotheses.

Marks are dots or dashes of one speed. The tracker starts from the first BOOTSTRAP marks, parted at the largest ratio between neighbours in order of
length, and gives each further mark to the nearer cluster in log space, whose centre moves towards it. A streak of DRIFT marks in one cluster, alike
but far from where its centre stood before them, is a change of regime: the tracker starts anew from the last few. The bank runs such
trackers side by side: streaks on one side of the first one's border bring challengers, all are scored by how well they explain marks and gaps, and a
challenger takes over once it leads for some marks and explains the gaps better too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.carried import carried

# Rates and bounds of the tracker (milliseconds), then of the bank (nats).
BOOTSTRAP, ALPHA, LEAST_RATIO, MOST_RATIO, SHORTEST, LONGEST = 5, 0.15, 2.2, 6.0, 20.0, 150.0
DRIFT, DRIFT_SPREAD, DRIFT_OFF, SPLIT_RATIO = 12, 0.35, 0.40, 1.8
STREAK, MARK_SIGMA, GAP_SIGMA, FLOOR, DECAY, LEAD, CONFIRM, PAUSE = 4, 0.25, 0.35, 3.0, 0.90, 4.0, 2, 12.0
SAME, YOUNG, RETAINED, BEHIND, OLD = 0.25, 8, 24, 12.0, 64


def clusters(marks: list[float]) -> tuple[float, float]:
    """Centres of dots and dashes from a few marks."""
    marks = sorted(marks)
    ratio, at = max(((b / a, -i) for i, (a, b) in enumerate(zip(marks, marks[1:], strict=False), 1)), default=(1.0, 0))
    if ratio >= SPLIT_RATIO:
        return bounded(sum(marks[:-at]) / -at, sum(marks[-at:]) / (len(marks) + at))
    mean = sum(marks) / len(marks)
    return bounded(mean, 3 * mean) if mean <= LONGEST else bounded(mean / 3, mean)


def bounded(low: float, high: float) -> tuple[float, float]:
    low = min(max(low, SHORTEST), LONGEST)
    return low, high if LEAST_RATIO <= high / low <= MOST_RATIO else 3 * low


@dataclass
class Tracker:
    low: float | None = None
    high: float | None = None
    regime: int = 0
    first: list[float] = field(default_factory=list)
    #: Length, whether a dot, and both centres before it, of the last marks.
    ring: list[tuple[float, bool, float, float]] = field(default_factory=list)

    def mark(self, length: float) -> bool | None:
        """Whether the mark is a dot; null until the tracker has started."""
        if self.low is None:
            self.first.append(length)
            if len(self.first) == BOOTSTRAP:
                self.low, self.high = clusters(self.first)
            return None
        before, dot = (self.low, self.high), length < math.sqrt(self.low * self.high)
        low = self.low + ALPHA * (length - self.low) if dot else self.low
        high = self.high if dot else self.high + ALPHA * (length - self.high)
        self.low, self.high = bounded(low, high)
        self.ring = [*self.ring[1 - DRIFT :], (length, dot, *before)]
        if len(self.ring) == DRIFT and len({d for _, d, _, _ in self.ring}) == 1:
            lengths = [x for x, *_ in self.ring]
            mean = sum(lengths) / DRIFT
            spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / DRIFT) / mean
            centre = self.ring[0][2 if dot else 3]
            if spread < DRIFT_SPREAD and abs(mean - centre) / centre > DRIFT_OFF:
                self.low, self.high = clusters(lengths[-BOOTSTRAP:])
                self.ring, self.regime = [], self.regime + 1
        return dot


def track_speed(marks: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """marks -> keys, order, dot, low, high, regime after each mark; null before the tracker has started. Lengths are positive milliseconds."""

    def step(state: Tracker, *row) -> list[tuple]:
        dot = state.mark(row[-1])
        return [(*row[:-1], dot, state.low, state.high, state.regime)]

    types = dict(marks.dtypes)
    named = ", ".join(f"`{c}` {types[c]}" for c in order)
    return carried(marks, keys, order, [*order, length], f"{named}, dot boolean, low double, high double, regime int", Tracker, step)


def _fit(x: float, centres: tuple[float, ...], sigma: float) -> float:
    """Log-likelihood of a log length under the nearest of some log centres, no worse than the floor."""
    return max(-min((x - c) ** 2 for c in centres) / (2 * sigma * sigma), -FLOOR)


@dataclass
class Hypothesis:
    tracker: Tracker
    score: float = 0.0
    gaps: float = 0.0
    age: int = 0
    lead: int = 0
    retained: int = 0

    def logs(self) -> tuple[float, float]:
        return math.log(self.tracker.low), math.log(self.tracker.high)

    def like(self, other: Hypothesis) -> bool:
        return all(abs(a - b) < SAME for a, b in zip(self.logs(), other.logs(), strict=True))


@dataclass
class Bank:
    """Hypotheses of which the first is believed, at most `width`; width 1 is the single tracker."""

    width: int = 3
    held: list[Hypothesis] = field(default_factory=lambda: [Hypothesis(Tracker())])
    streak: list[float] = field(default_factory=list)
    side: bool | None = None
    switches: int = 0

    def gap(self, length: float) -> None:
        started = [h for h in self.held if h.tracker.low is not None]
        if not started or length >= PAUSE * max(h.tracker.low for h in started):
            return  # before the first marks, and pauses, which tell of no speed
        for h in started:
            unit, fit = math.log(h.tracker.low), 0.0
            fit = _fit(math.log(length), (unit, unit + math.log(3), unit + math.log(7)), GAP_SIGMA)
            h.score, h.gaps = DECAY * h.score + fit, DECAY * h.gaps + fit

    def mark(self, length: float) -> bool | None:
        first = self.held[0]
        if first.tracker.low is None:
            first.tracker.mark(length)
            return None
        # the believed one has learnt the mark when it is scored, the challengers have not
        dot = first.tracker.mark(length)
        for h in self.held:
            h.score = DECAY * h.score + _fit(math.log(length), h.logs(), MARK_SIGMA)
        for h in self.held[1:]:
            h.tracker.mark(length)
            h.age, h.retained = h.age + 1, max(h.retained - 1, 0)
        self._challenge(length)
        first = self.held[0]
        self.held[1:] = [h for h in self.held[1:] if not h.like(first) and (h.retained or (first.score - h.score < BEHIND and h.age < OLD))]
        for h in self.held[1:]:
            h.lead = h.lead + 1 if h.score - first.score >= LEAD else 0
        ready = [h for h in self.held[1:] if h.lead >= CONFIRM and h.age >= CONFIRM and h.gaps > first.gaps]
        if ready:
            best = max(ready, key=lambda h: h.score)
            self.held = [best, *[h for h in self.held if h is not best]]
            first.retained, first.age, first.lead, best.lead = RETAINED, 0, 0, 0
            self.streak, self.side, self.switches = [], None, self.switches + 1
        return dot

    def _challenge(self, length: float) -> None:
        """A streak of marks on one side of the border brings a hypothesis of its own: their own clusters, or, where those are believed already, dashes read as dots."""
        first = self.held[0].tracker
        side = length >= math.sqrt(first.low * first.high)
        self.streak = [*self.streak, length] if side == self.side else [length]
        self.side = side
        if len(self.streak) < STREAK or self.width < 2:
            return
        marks, self.streak = self.streak, []
        for low, high in (clusters(marks), bounded(sum(marks) / STREAK / 3, sum(marks) / STREAK)):
            new = Hypothesis(Tracker(low, high), self.held[0].score, self.held[0].gaps)
            if new.like(self.held[0]):
                continue
            if not any(new.like(h) for h in self.held):
                if len(self.held) < self.width:
                    self.held.append(new)
                elif old := [h for h in self.held[1:] if h.age >= YOUNG and not h.retained]:
                    self.held[self.held.index(min(old, key=lambda h: h.score))] = new
            return


def bank_speed(runs: DataFrame, keys: list[str], order: list[str], mark: str, length: str, width: int = 3) -> DataFrame:
    """runs of marks and gaps -> keys, order, dot, low, high, hypotheses, switches after each mark."""

    def step(state: Bank, *row) -> list[tuple]:
        if not row[-2]:
            state.gap(row[-1])
            return []
        dot = state.mark(row[-1])
        believed = state.held[0].tracker
        return [(*row[:-2], dot, believed.low, believed.high, len(state.held), state.switches)]

    types = dict(runs.dtypes)
    named = ", ".join(f"`{c}` {types[c]}" for c in order)
    sound = runs.where(F.col(length) > 0)
    return carried(sound, keys, order, [*order, mark, length], f"{named}, dot boolean, low double, high double, hypotheses int, switches int", lambda: Bank(width), step)
