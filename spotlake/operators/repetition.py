"""Repetitions of a call as separate messages: the whole gate, with frequency buckets, tracks, spans, moves and orphaned leaders.

A call counts as confirmed by how many separate messages held it in the last while. What is one message is subtle: a call is sent twice in it, two tracks may hear
it at once, a replay decodes the same samples again, and its frequency drifts over the edge of a bucket. The gate keeps an entry per bucket and call; each touch is
judged once, when it comes, and keeps its verdict. A refinement moves a touch from the call first read to the right one. When the touch that
stands for a message grows too old, the oldest touch that had deferred to it takes its place.

One pure step serves batch and stream. A move links two calls, so the keys of the batch form are families of calls that moves link; all others are families of
one. Whether a track was still open is a matter of when it closed, so that time comes with each touch and no state is shared between families.
"""

from __future__ import annotations

import bisect
import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.carried import carried
from spotlake.operators.graph import families


@dataclass(frozen=True)
class Limits:
    """Width of a bucket and of a channel (Hz), words between messages, and times (seconds, in units of `second`) of the window, between messages, and between touches of different tracks."""

    bucket: float = 100.0
    near: float = 93.75
    words: int = 3
    window: int = 90
    apart: int = 60
    between: int = 1
    second: int = 1_000_000

    def ticks(self, seconds: int) -> int:
        return seconds * self.second


@dataclass
class Touch:
    t: int
    word: int
    track: int
    #: Whether it stands for a message, and the time of the touch that stands for its message.
    counts: bool
    leader: int


class Seen:
    """Newest touch of each track, counted or not: time, word, leader; the oldest are forgotten by a heap, which may name a track again."""

    def __init__(self):
        self.of: dict[int, tuple[int, int, int]] = {}
        self.ages: list[tuple[int, int]] = []
        self.newest: int | None = None

    def see(self, track: int, t: int, word: int, leader: int) -> None:
        held = self.of.get(track)
        if held is None or t >= held[0]:
            self.of[track] = (t, word, leader)
            heapq.heappush(self.ages, (t, track))
            self.newest = t if self.newest is None else max(self.newest, t)

    def forget(self, before: int) -> None:
        while self.ages and self.ages[0][0] < before:
            _, track = heapq.heappop(self.ages)
            if track in self.of and self.of[track][0] < before:
                del self.of[track]
        if not self.of:
            self.newest = None


class Touches:
    """Touches in the order in which they came, with those of each track and those that count apart, so that none is looked for among all."""

    def __init__(self):
        self.made, self.counting, self.ages = 0, [], []
        self.held: dict[int, Touch] = {}
        self.own: dict[int, list[int]] = {}
        self.own_counting: dict[int, list[int]] = {}
        #: Touches of each time, those that defer to each leader, and leaders that may have gone.
        self.times: dict[int, int] = {}
        self.led: dict[int, list[int]] = {}
        self.doubtful: set[int] = set()

    def __iter__(self):
        return iter(self.held.values())

    def append(self, touch: Touch) -> None:
        n = self.made
        self.made += 1
        self.held[n] = touch
        heapq.heappush(self.ages, (touch.t, n))
        self.own.setdefault(touch.track, []).append(n)
        self.times[touch.t] = self.times.get(touch.t, 0) + 1
        if touch.counts:
            self._count(n, touch)
        else:
            self.led.setdefault(touch.leader, []).append(n)
            self.doubtful.add(touch.leader)

    def _count(self, n: int, touch: Touch) -> None:
        bisect.insort(self.counting, n)
        bisect.insort(self.own_counting.setdefault(touch.track, []), n)

    def remove(self, n: int) -> None:
        touch = self.held.pop(n)
        _without(self.own, touch.track, n)
        if touch.counts:
            del self.counting[bisect.bisect_left(self.counting, n)]
            _without(self.own_counting, touch.track, n)
        else:
            _without(self.led, touch.leader, n)
        self.times[touch.t] -= 1
        if not self.times[touch.t]:
            del self.times[touch.t]
            self.doubtful.add(touch.t)

    def find(self, track: int, t: int) -> int | None:
        return next((n for n in self.own.get(track, ()) if self.held[n].t == t), None)

    def forget(self, before: int) -> None:
        while self.ages and self.ages[0][0] < before:
            _, n = heapq.heappop(self.ages)
            if n in self.held:
                self.remove(n)
        # as promote(), of the leaders that have gone since
        for leader in self.doubtful:
            if leader not in self.times and leader in self.led:
                group = self.led.pop(leader)
                first = min(group, key=lambda n: (self.held[n].t, n))
                for n in group:
                    self.held[n].leader = self.held[first].t
                self.held[first].counts = True
                self._count(first, self.held[first])
                group.remove(first)
                if group:
                    joined = self.led.setdefault(self.held[first].t, [])
                    joined[:] = sorted(joined + group)
        self.doubtful.clear()

    def last(self, track: int) -> tuple[Touch | None, Touch | None, Touch | None]:
        """The last touch of a track that counts, its last one, and the last of all that counts."""
        of = lambda ns: self.held[ns[-1]] if ns else None
        return of(self.own_counting.get(track)), of(self.own.get(track)), of(self.counting)


def _without(lists: dict[int, list[int]], key: int, n: int) -> None:
    """Take a number out of the sorted list of a key, and an empty list out as well."""
    numbers = lists[key]
    del numbers[bisect.bisect_left(numbers, n)]
    if not numbers:
        del lists[key]


class Entry:
    def __init__(self, freq: float):
        self.freq, self.touches, self.seen, self.made = freq, Touches(), Seen(), 0
        #: (last sample, number, first sample, leader), sorted.
        self.spans: list[tuple[int, int, int, int]] = []

    def newest(self) -> int | None:
        # a touch is never newer than what was seen of its track
        return self.seen.newest

    def see(self, track: int, t: int, word: int, leader: int) -> None:
        self.seen.see(track, t, word, leader)

    def cover(self, span: tuple[int, int], leader: int) -> None:
        bisect.insort(self.spans, (span[1], self.made, span[0], leader))
        self.made += 1

    def covers(self, span: tuple[int, int]) -> bool:
        return any(s[2] == span[0] for s in self.spans[bisect.bisect_left(self.spans, (span[1],)) : bisect.bisect_left(self.spans, (span[1] + 1,))])

    def uncover(self, span: tuple[int, int]) -> None:
        at = slice(bisect.bisect_left(self.spans, (span[1],)), bisect.bisect_left(self.spans, (span[1] + 1,)))
        self.spans[at] = [s for s in self.spans[at] if s[2] != span[0]]

    def forget(self, before: int) -> None:
        self.touches.forget(before)
        self.seen.forget(before)
        if self.spans and self.spans[0][0] < before:
            del self.spans[: bisect.bisect_left(self.spans, (before,))]

    def count(self) -> int:
        return len(self.touches.counting)

    def meeting(self, span: tuple[int, int]) -> int | None:
        """The leader of the first span that shares a sample with this one; only those that end in it or after it are looked at."""
        shared = [(n, leader) for _, n, lo, leader in self.spans[bisect.bisect_left(self.spans, (span[0],)) :] if lo <= span[1]]
        return min(shared)[1] if shared else None


def promote(touches: list[Touch]) -> None:
    """Touches whose leader is gone: the oldest of each such group leads it from now on."""
    held = {t.t for t in touches}
    orphans: dict[int, list[Touch]] = {}
    for t in touches:
        if not t.counts and t.leader not in held:
            orphans.setdefault(t.leader, []).append(t)
    for group in orphans.values():
        first = min(group, key=lambda t: t.t)
        first.counts = True
        for t in group:
            t.leader = first.t


def judged(lead: Touch | None, last_own: Touch | None, other: Touch | None, seen: tuple[int, int, int] | None, word: int, t: int, track: int, open_then, limits: Limits) -> tuple[bool, int]:
    """Whether a new touch is a message of its own, and else whose: judged against its own track's last message (lead), or else its last touch (last_own), then against the newest message of all (other)."""
    close = lambda t0, w0: word < w0 + limits.words and t - t0 < limits.ticks(limits.apart)
    if lead is not None:
        if close(lead.t, lead.word):
            return False, lead.t
    else:
        last = (last_own.t, last_own.word, last_own.leader) if last_own is not None else seen
        if last is not None and close(last[0], last[1]):
            return False, last[2]
    if other is None:
        return True, t
    if other.track == track:
        apart = not close(other.t, other.word)
    else:
        # another track's message is another one if that track had closed, or this track has said a whole message since
        mine = (last_own.t, last_own.word) if last_own is not None else seen
        moved_on = mine is not None and other.t <= mine[0] and word >= mine[1] + limits.words
        apart = not open_then(other.track) or t - other.t >= limits.ticks(limits.apart) or moved_on
    return (True, t) if apart else (False, other.t)


class Gate:
    """Entries of a family of calls."""

    def __init__(self, limits: Limits):
        self.limits, self.entries, self.closes = limits, {}, {}

    def bucket(self, freq: float) -> int:
        return math.floor(freq / self.limits.bucket + 0.5)

    def _entry(self, call: str, freq: float, t: int, before: int) -> Entry:
        """The entry for a touch: that of its bucket, else a neighbour's within a channel, which moves here unless the touch comes late, else a new one."""
        home = self.bucket(freq)
        for b in (home - 1, home, home + 1):
            entry = self.entries.get((b, call))
            if entry is not None and b == home and (entry.newest() is None or entry.newest() < before):
                del self.entries[b, call]
        if (home, call) in self.entries:
            return self.entries[home, call]
        beside = [(e.newest(), b) for b in (home - 1, home + 1) if (e := self.entries.get((b, call))) is not None and abs(freq - e.freq) < self.limits.near and e.newest() is not None]
        if not beside:
            return self.entries.setdefault((home, call), Entry(freq))
        newest, b = max(beside)
        if t >= newest:
            self.entries[home, call] = self.entries.pop((b, call))
            return self.entries[home, call]
        return self.entries[b, call]

    def touch(self, call: str, track: int, t: int, freq: float | None, start: int | None, word: int, closes: int | None) -> int:
        """A decoded call -> its separate messages in the window. closes: when its track closed or will close, if ever."""
        self.closes[track] = closes
        if freq is None or not math.isfinite(freq):
            return 0
        before = t - self.limits.ticks(self.limits.window)
        entry = self._entry(call, freq, t, before)
        if entry.newest() is None or t >= entry.newest():
            entry.freq = freq
        span = None if start is None else (min(start, t), t)
        if span is not None and (leader := entry.meeting(span)) is not None:
            # the same samples decoded again
            entry.see(track, t, word, leader)
            entry.cover(span, leader)
        else:
            quick = track in entry.seen.of and t - entry.seen.of[track][0] < self.limits.ticks(self.limits.between)
            newest = entry.newest()
            alone = quick or newest is None or t - newest >= self.limits.ticks(self.limits.between)
            counts, leader = judged(*entry.touches.last(track), entry.seen.of.get(track), word, t, track, lambda k: self._open(k, t), self.limits)
            entry.see(track, t, word, leader)
            if alone:
                entry.touches.append(Touch(t, word, track, counts, leader))
            if span is not None:
                entry.cover(span, leader)
        entry.forget(before)
        return entry.count()

    def _open(self, track: int, t: int) -> bool:
        closes = self.closes.get(track)
        return closes is None or closes > t

    def move(self, call: str, to: str, track: int, t: int, start: int, at: int) -> bool:
        """Hand the touch of that track and span over to another call, at time `at`; whether it was still held. It counts there only if no message there is the same."""
        span = (min(start, t), t)
        for (b, c), entry in sorted(self.entries.items()):
            if c != call or (n := entry.touches.find(track, t)) is None or not entry.covers(span):
                continue
            found = entry.touches.held[n]
            entry.touches.remove(n)
            entry.uncover(span)
            there = self.entries.setdefault((b, to), Entry(entry.freq))
            leader = there.meeting(span)
            if leader is None:
                counts, leader = found.counts, found.leader
                for x in there.touches:
                    near = abs(found.t - x.t) < self.limits.ticks(self.limits.apart)
                    if near and (abs(found.word - x.word) < self.limits.words if x.track == track else self._open(x.track, at)):
                        counts, leader = False, x.leader
                        break
                there.touches.append(Touch(found.t, found.word, track, counts, leader))
            there.see(track, found.t, found.word, leader)
            there.cover(span, leader)
            return True
        return False

    def sweep(self, t: int) -> None:
        """Forget entries that nothing after t can meet."""
        before = t - self.limits.ticks(self.limits.window)
        self.entries = {k: e for k, e in self.entries.items() if (e.newest() or before - 1) >= before}


def step(gate: Gate, kind: str, row_id: int, call: str, to: str | None, track: int, t: int, freq: float | None, start: int | None, word: int | None, at: int, closes: int | None) -> list[tuple[int, int]]:
    """One row -> (row_id, repetitions) of a touch; of a move 1 if the touch was still held, else 0."""
    if kind == "move":
        return [(row_id, int(gate.move(call, to, track, t, start, at)))]
    out = [(row_id, gate.touch(call, track, t, freq, start, word, closes))]
    if len(gate.entries) > 64:
        gate.sweep(t)
    return out


INPUTS = ["kind", "row_id", "call", "to", "track", "t", "freq", "start", "word", "at", "closes"]


def repetitions(touches: DataFrame, moves: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """touches (row_id, call, track, t, freq, start, word, closes) and moves (row_id, call, to, track, t, start, at) -> family, row_id, repetitions.

    Rows are taken in the order of time (of a move: `at`), touches first, then row_id. t: the end of the decoded word, start: its first sample (null: not known);
    of a move they name the touch. closes: when the touch's track closed, null if never. A frequency that is null or not finite earns no repetition.
    """
    limits = limits or Limits()
    rows = touches.select(F.lit("touch").alias("kind"), "row_id", "call", F.lit(None).cast("string").alias("to"), "track", "t", "freq", "start", "word", F.col("t").alias("at"), "closes")
    if moves is None:
        rows = rows.withColumn("family", F.col("call"))
    else:
        none = F.lit(None).cast("long")
        rows = rows.unionByName(moves.select(F.lit("move").alias("kind"), "row_id", "call", "to", "track", "t", F.lit(None).cast("double").alias("freq"), "start", none.alias("word"), "at", none.alias("closes")))
        member = families(moves, "call", "to").withColumnRenamed("member", "call")
        rows = rows.join(member, "call", "left").withColumn("family", F.coalesce("family", "call"))
    rows = rows.withColumn("later", (F.col("kind") == "move").cast("int"))
    return carried(rows, ["family"], ["at", "later", "row_id"], INPUTS, "row_id bigint, repetitions int", lambda: Gate(limits), step)
