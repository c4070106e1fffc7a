"""Damaged copies of one call, lined up and voted on character by character.

Copies of a call that a station sent again and again on one channel are put into episodes: a copy joins the episode all of whose copies in the window are within a few
edits of it. The copies of an episode are aligned one after another to what has been agreed so far, with gaps and insertions; each votes for its character at a
place, for nothing there, or for unknown, and a listed alternative adds its share. A place is decided by more than half the copies and a clear lead; one
undecided place leaves the call unknown, so no character is made up. Separate messages are counted by the repetition gate's rule.

Copies on channels that no chain of near frequencies joins, and stretches without copies for as long as the window, can't meet; each is one stream that
carries its open episodes. An episode holds all its copies in the window; no two of them share a sample, as one that does is a duplicate.
"""

from __future__ import annotations

import bisect
import heapq
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.carried import carried, stretches
from spotlake.operators.repetition import Limits, Seen, Touch, Touches, judged

# Lead that a place needs, edits within which a copy joins, least letters of a call.
LEAD, EDITS, SHORTEST = 0.5, 2, 3
GAP, UNKNOWN = "", "?"
#: Smallest part of a vote; sums of such parts are exact. Copies looked over at a time, those that hold before that is done again, and moves that are kept.
SHARE, BLOCK, CALM, MOVES = 2.0**-24, 128, 6, 4096


@lru_cache(1 << 16)
def distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def traceback(expected: int, given: int, cost) -> list[tuple[int | None, int | None]]:
    """Pairs of places of a cheapest alignment of two strings of those lengths, null where one has nothing; cost(i, j) of setting i against j. Of equal ones the last step is a pair, then a deletion."""
    table = [[0] * (given + 1) for _ in range(expected + 1)]
    for i in range(expected + 1):
        for j in range(given + 1):
            if i and j:
                table[i][j] = min(table[i - 1][j - 1] + cost(i - 1, j - 1), table[i - 1][j] + 1, table[i][j - 1] + 1)
            else:
                table[i][j] = i + j
    out, i, j = [], expected, given
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + cost(i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


@dataclass
class Copy:
    text: str
    #: Score of each character, and its alternatives with theirs.
    scores: list[float]
    others: list[list[tuple[str, float]]]
    start: int
    stop: int
    track: int
    word: int

    def votes(self, i: int) -> dict[str, float]:
        glyph, top = self.text[i], self.scores[i]
        out = {glyph: 1.0}
        if glyph != UNKNOWN and top > 0:
            for other, score in self.others[i]:
                if other not in (glyph, UNKNOWN) and score > 0:
                    out[other] = out.get(other, 0.0) + round(min(score / top, 1.0) / SHARE) * SHARE
        return out


@lru_cache(1 << 14)
def _steps(tops: tuple[str, ...], text: str) -> list[tuple[int | None, int | None]]:
    """The alignment of a text to places named by their leading votes: copies of a call are few texts, which come again and again."""
    return traceback(len(tops), len(text), lambda i, j: int(text[j] != UNKNOWN and text[j] != tops[i]))


class Aligned:
    """Copies in the order of their start, lined up one after another to what those before have agreed, and the votes before each.

    A copy that comes or goes changes the votes before all later ones by its own; only those are lined up again for which other glyphs then lead at some place, or other
    places are there, and that makes a difference. Votes are whole multiples of SHARE, so sums do not hang on their order, and what comes out is what a new start would give.
    """

    def __init__(self):
        import numpy as np

        self.order: list[tuple[int, int, int]] = []
        self.copies: list[Copy] = []
        #: Place of each character of a copy; null where it is still to be found.
        self.at: list[list[int] | None] = []
        #: In the order in which equal votes lead: letters, gap, unknown.
        self.glyphs = [GAP, UNKNOWN]
        #: By copy (and one row more: after all), place and glyph; row 0 lies at `low`.
        self.votes, self.low = np.zeros((8, 0, 2)), 0
        #: By copy and place the leading glyph before it for which its alignment is known to hold, -1 where no copy before has a letter.
        self.tops = np.zeros((8, 0), np.int16)
        #: First copy from which on alignments are in doubt; what has changed in the votes of rows after the one named.
        self.doubt, self.shift, self.shifted = 0, np.zeros((0, 2)), 0
        self.moves: dict[tuple, tuple] = {}

    def add(self, copy: Copy) -> None:
        import numpy as np

        key = copy.start, copy.track, copy.word
        row, n = bisect.bisect_right(self.order, key), len(self.copies)
        self.order.insert(row, key)
        self.copies.insert(row, copy)
        self.at.insert(row, None)
        if self.low + n + 2 > len(self.votes):
            room = 2 * (n + 2)
            grown, tops = np.zeros((room, *self.votes.shape[1:])), np.zeros((room, self.tops.shape[1]), np.int16)
            grown[: n + 1], tops[: n + 1] = self.votes[self.low : self.low + n + 1], self.tops[self.low : self.low + n + 1]
            self.votes, self.tops, self.low = grown, tops, 0
        for held in (self.votes, self.tops):
            rows = held[self.low :]
            rows[row + 1 : n + 2] = rows[row : n + 1].copy()
        self.tops[self.low + row] = -2
        self.doubt = min(self.doubt, row)

    def remove(self, copy: Copy) -> None:
        row = bisect.bisect_left(self.order, (copy.start, copy.track, copy.word))
        while self.copies[row] is not copy:
            row += 1
        n = len(self.copies)
        del self.order[row], self.copies[row], self.at[row]
        rows, tops = self.votes[self.low :], self.tops[self.low :]
        rows[row + 1 : n + 1] -= rows[row + 1] - rows[row]
        if row == 0:
            self.low += 1
        else:
            rows[row:n], tops[row:n] = rows[row + 1 : n + 1].copy(), tops[row + 1 : n + 1].copy()
        self.doubt = min(self.doubt, row)

    def settle(self) -> None:
        import numpy as np

        n, row, calm = len(self.copies), self.doubt, CALM
        self.shift, self.shifted = np.zeros(self.votes.shape[1:]), row
        while row < n:
            # one by one where some were lined up anew just now, as the next often are too, else in blocks
            stop = row + 1 if calm < CALM else min(row + BLOCK, n)
            if stop > self.shifted:
                self.votes[self.low + self.shifted + 1 : self.low + stop + 1] += self.shift
                self.shifted = stop
            held, known = self.votes[self.low + row : self.low + stop], self.tops[self.low + row : self.low + stop]
            leads = held.argmax(2) if held.shape[1] else known.copy()
            if calm < CALM:
                leads[0, held[0, :, -2] >= row] = -1
                differ = [] if leads.tobytes() == known.astype(leads.dtype).tobytes() else [0]
            else:
                leads[held[:, :, -2] >= np.arange(row, stop)[:, None]] = -1
                # without any place nothing is lined up yet
                differ = (leads != known).any(1).nonzero()[0].tolist() if held.shape[1] else [0]
            failed = next((i for i in differ if not self._holds(row + i, leads[i].tolist())), None)
            if failed is None:
                known[:] = leads
                row, calm = stop, calm + 1
            else:
                known[: failed + 1] = leads[: failed + 1]
                self._line_up(row + failed, leads[failed].tolist())
                row, calm = row + failed + 1, 0
        gone = np.flatnonzero(self.votes[self.low + n, :, -2] >= n)
        for place in gone[::-1].tolist():
            self.moves = {}
            self.votes, self.tops = np.delete(self.votes, place, 1), np.delete(self.tops, place, 1)
            self.at = [[p - (p > place) for p in at] for at in self.at]
        self.doubt = n

    def _steps(self, row: int, leads: list[int]) -> list[tuple[int | None, int | None]]:
        return _steps(tuple([self.glyphs[g] for g in leads if g >= 0]), self.copies[row].text)

    def _key(self, row: int, leads: list[int]) -> tuple | None:
        """What the move of a plain copy hangs on as long as places and glyphs stay."""
        return None if self.at[row] is None or any(self.copies[row].others) else (self.copies[row].text, tuple(leads), tuple(self.at[row]))

    def _holds(self, row: int, leads: list[int]) -> bool:
        """Whether a copy lies as it would if it were lined up to these leading glyphs."""
        if self.at[row] is None or self._key(row, leads) in self.moves:
            return False
        mine, lies, n = {p: j for j, p in enumerate(self.at[row])}, [], 0
        for p, lead in enumerate(leads):
            if lead >= 0 or p in mine:
                lies.append((n if lead >= 0 else None, mine.get(p)))
            n += lead >= 0
        return lies == self._steps(row, leads)

    def _line_up(self, row: int, leads: list[int]) -> None:
        import numpy as np

        copy, before, rows, key = self.copies[row], self.at[row], self.votes[self.low :], self._key(row, leads)
        if key in self.moves:
            at, mine = self.moves[key]
        else:
            there, at, last, made = [p for p, lead in enumerate(leads) if lead >= 0], [], -1, 0
            for i, j in self._steps(row, leads):
                if i is None:
                    last, made = last + 1, made + 1
                    self._place(last)
                else:
                    last = there[i] + made
                if j is not None:
                    at.append(last)
            votes = [copy.votes(j) for j in range(len(at))]
            if before is None:
                for glyph in {g for v in votes for g in v}.difference(self.glyphs):
                    self._glyph(glyph)
            mine, rows = np.zeros(self.votes.shape[1:]), self.votes[self.low :]
            mine[:, -2] = 1.0
            mine[at, -2] = 0.0
            for p, v in zip(at, votes, strict=True):
                for glyph, score in v.items():
                    mine[p, self.glyphs.index(glyph)] = score
            mine -= rows[row + 1] - rows[row]
            if key is not None and not made and len(self.moves) < MOVES:
                self.moves[key] = at, mine
        rows[row + 1 : self.shifted + 1] += mine
        self.shift += mine
        self.at[row] = at

    def _place(self, place: int) -> None:
        """A place at which no copy has a letter so far."""
        import numpy as np

        self.moves = {}
        new = np.zeros((len(self.votes), len(self.glyphs)))
        # a copy that is still to be lined up has no votes
        new[self.low : self.low + len(self.at) + 1, -2] = np.cumsum([0, *[at is not None for at in self.at]])
        self.votes, self.tops, self.shift = np.insert(self.votes, place, new, 1), np.insert(self.tops, place, -1, 1), np.insert(self.shift, place, 0.0, 0)
        self.at = [at and [p + (p >= place) for p in at] for at in self.at]

    def _glyph(self, glyph: str) -> None:
        import numpy as np

        self.moves = {}
        letters = self.glyphs[:-2]
        n = bisect.bisect(letters, glyph)
        self.glyphs.insert(n, glyph)
        self.votes, self.shift = np.insert(self.votes, n, 0.0, 2), np.insert(self.shift, n, 0.0, 1)
        self.tops += self.tops >= n

    def fused(self) -> tuple[str | None, float | None]:
        """The call that the copies agree on and its smallest lead, or nulls: a place holds what more than half vote for, with a clear lead."""
        self.settle()
        call, least, n = "", None, len(self.copies)
        for votes in self.votes[self.low + n].tolist():
            second, top = sorted(votes)[-2:]
            glyph = self.glyphs[votes.index(top)]
            if top <= n / 2 or top - second < LEAD or glyph == UNKNOWN:
                return None, None
            call, least = call + glyph, top - second if least is None else min(least, top - second)
        return call, least


def fused(copies: list[Copy]) -> tuple[str | None, float | None]:
    held = Aligned()
    for copy in copies:
        held.add(copy)
    return held.fused()


class Episode:
    """Copies by the number of their touch, in the order in which they came."""

    def __init__(self, number: int, freq: float):
        self.number, self.freq, self.newest = number, freq, float("-inf")
        self.copies: dict[int, Copy] = {}
        self.aligned, self.touches, self.seen = Aligned(), Touches(), Seen()
        self.texts: dict[str, int] = {}
        self.ages: list[tuple[int, int]] = []
        #: Numbers as they came, some of them gone, and the greatest end up to each.
        self.came: list[int] = []
        self.reach: list[int] = []

    def add(self, copy: Copy, touch: Touch) -> None:
        n = self.touches.made
        self.touches.append(touch)
        self.copies[n] = copy
        self.aligned.add(copy)
        self.texts[copy.text] = self.texts.get(copy.text, 0) + 1
        heapq.heappush(self.ages, (copy.stop, n))
        self.newest = max(self.newest, copy.stop)
        if len(self.came) > 2 * len(self.copies) + 16:
            self.came = list(self.copies)
            self.reach = list(accumulate((c.stop for c in self.copies.values()), max))
        else:
            self.came.append(n)
            self.reach.append(max(self.reach[-1], copy.stop) if self.reach else copy.stop)

    def forget(self, before: int) -> None:
        while self.ages and self.ages[0][0] < before:
            copy = self.copies.pop(heapq.heappop(self.ages)[1])
            self.aligned.remove(copy)
            self.texts[copy.text] -= 1
            if not self.texts[copy.text]:
                del self.texts[copy.text]
        self.touches.forget(before)
        self.seen.forget(before)

    def worst(self, text: str) -> int:
        return max(distance(t, text) for t in self.texts)

    def same(self, copy: Copy) -> Touch | None:
        """The touch of the first copy that shares a sample with this one and is near it; only those from the first that ends in it or after it are looked at."""
        for n in self.came[bisect.bisect_left(self.reach, copy.start) :]:
            c = self.copies.get(n)
            if c is not None and c.start <= copy.stop and copy.start <= c.stop and distance(c.text, copy.text) <= EDITS:
                return self.touches.held[n]
        return None

    def repetitions(self, call: str) -> int:
        """Messages whose copies are near a call."""
        near = {t for t in self.texts if distance(t, call) <= EDITS}
        return len(self.touches.counting) if len(near) == len(self.texts) else sum(self.copies[n].text in near for n in self.touches.counting)


class Lattice:
    def __init__(self, limits: Limits, required: int):
        self.limits, self.required, self.episodes, self.made, self.closes = limits, required, [], 0, {}

    def add(self, copy: Copy, freq: float, closes: int | None) -> tuple[int, str, str | None, int, int, float | None]:
        """A copy -> its episode, verdict (duplicate, unknown, insufficient, confirmed), call, repetitions, copies, smallest lead."""
        self.closes[copy.track] = closes
        before = copy.stop - self.limits.ticks(self.limits.window)
        for e in self.episodes:
            e.forget(before)
        self.episodes = [e for e in self.episodes if e.copies]
        near = [(e.worst(copy.text), -e.newest, e.number, e) for e in self.episodes if abs(freq - e.freq) < self.limits.near]
        for *_, e in sorted(near, key=lambda x: x[2]):
            same = e.same(copy)
            if same is not None:
                e.seen.see(copy.track, copy.stop, copy.word, same.leader)
                return e.number, "duplicate", None, len(e.touches.counting), len(e.copies), None
        joined = [x for x in near if x[0] <= EDITS]
        if joined:
            episode = min(joined, key=lambda x: x[:3])[3]
        else:
            episode = Episode(self.made, freq)
            self.made += 1
            self.episodes.append(episode)
        if copy.stop >= episode.newest:
            episode.freq = freq
        open_then = lambda k: (at := self.closes.get(k)) is None or at > copy.stop
        counts, leader = judged(*episode.touches.last(copy.track), episode.seen.of.get(copy.track), copy.word, copy.stop, copy.track, open_then, self.limits)
        episode.seen.see(copy.track, copy.stop, copy.word, leader)
        episode.add(copy, Touch(copy.stop, copy.word, copy.track, counts, leader))
        episode.forget(before)
        return episode.number, *self._verdict(episode)

    def _verdict(self, e: Episode) -> tuple[str, str | None, int, int, float | None]:
        call, lead = e.aligned.fused()
        if call is None:
            return "unknown", None, 0, len(e.copies), None
        reps = e.repetitions(call)
        enough = len(call) >= SHORTEST and reps >= self.required
        return "confirmed" if enough else "insufficient", call if enough else None, reps, len(e.copies), lead


def channels(df: DataFrame, keys: list[str], freq: str, near: float, out: str = "channel") -> DataFrame:
    """df with a number for each set of frequencies of a key that steps of less than `near` join.

    Cells of a width of `near` are numbered, not rows: a window over the occupied cells, with their least and greatest frequency, finds where the next is out of reach.
    """
    cell = F.floor(F.col(freq) / near)
    cells = df.groupBy(*keys, cell.alias("__cell")).agg(F.min(freq).alias("__low"), F.max(freq).alias("__high"))
    order = Window.partitionBy(*keys).orderBy("__cell")
    opens = F.coalesce(F.col("__low") - F.lag("__high").over(order) >= near, F.lit(False)).cast("int")
    cells = cells.withColumn("__opens", opens).withColumn(out, F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("__cell", cell).join(cells.select(*keys, "__cell", out), [*keys, "__cell"]).drop("__cell")


def evaluate(copies: DataFrame, required: int = 2, limits: Limits | None = None) -> DataFrame:
    """copies (copy_id, input, text, scores, others, start, stop, track, word, freq, closes) -> input, channel, stretch, copy_id, episode, verdict, call, repetitions, copies, lead after each copy.

    scores: array of doubles, a character each (null: all 1); others: for each character an array of (glyph, score) (null: none). Copies without text, frequency or times are
    left out. Taken in the order of stop, then copy_id.
    """
    limits = limits or Limits()
    sound = copies.where((F.length("text") > 0) & F.col("freq").isNotNull() & ~F.isnan("freq") & (F.abs("freq") < float("inf")) & F.col("start").isNotNull() & F.col("stop").isNotNull())
    placed = stretches(channels(sound, ["input"], "freq", limits.near), ["input", "channel"], "stop", limits.ticks(limits.window) + 1)

    def step(lattice: Lattice, copy_id, text, scores, others, start, stop, track, word, freq, closes) -> list[tuple]:
        pairs = [[(o["glyph"], o["score"]) for o in x or []] for x in others] if others else [[] for _ in text]
        copy = Copy(text, scores or [1.0] * len(text), pairs, min(start, stop), stop, track, word)
        return [(copy_id, *lattice.add(copy, freq, closes))]

    return carried(
        placed, ["input", "channel", "stretch"], ["stop", "copy_id"], ["copy_id", "text", "scores", "others", "start", "stop", "track", "word", "freq", "closes"],
        "copy_id bigint, episode int, verdict string, call string, repetitions int, copies int, lead double", lambda: Lattice(limits, required), step,
    )
