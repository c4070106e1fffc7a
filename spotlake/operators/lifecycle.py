"""Lives of tracks: candidates that are confirmed, hangs, sleep and return under the same name, silence and suppression, ownership, and merging of those that meet.

A track owns three channels around a centre that follows its signal. Rows come only for hops at which a channel shows something, so timers are not
counted down: each says at which hop it ends, and all that end before the next row's hop are taken in order (a row at the very hop comes first). Tracks on channels more than a few apart never meet, and nothing outlives
the longest timer, so a recording is as many streams as it has occupied groups of channels and quiet times. A stream's rows are packed before it, a row for the
channels of a hop, since one that never falls quiet is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators.carried import carried, stretches
from spotlake.operators.lattice import channels

#: Fixed values of a track's lives, in hops: to confirm, to hang, to sleep, without a character, to be suppressed after that.
CONFIRM, HANG, SLEEP, MUTE, SUPPRESS = 19, 1875, 3750, 11_250, 22_500
#: Fixed values in channels: least distance of a second signal from the owners' centres, of its phase from theirs (100 Hz), and at which two tracks are one; rate of the centre.
PAIR, PHASE_APART, ONE, FOLLOW = 0.8, 100 / 93.75, 1.0, 0.05
#: Channels between groups that can't meet: both centres may lie a channel beyond their rows' channels, and own one more.
APART = 5
#: A row holds the channels of a hop that are one in all but this many bits.
PACKED = 6


@dataclass(frozen=True)
class Timers:
    confirm: int = CONFIRM
    hang: int = HANG
    sleep: int = SLEEP
    mute: int = MUTE
    suppress: int = SUPPRESS

    def longest(self) -> int:
        return self.confirm + self.hang + max(self.sleep, self.mute) + self.suppress


@dataclass
class Track:
    number: int
    centre: float
    state: str
    #: Rises in a row, and the hop of the last; of a sleeper those of its return.
    rises: int
    risen: int
    #: Last hop at level, of promotion or the last character, at which sleep began.
    level: int = 0
    spoke: int = 0
    slept: int = 0
    decoded: bool = False
    phased: bool = False

    def owns(self, channel: int) -> bool:
        return abs(round(self.centre) - channel) <= 1


class Lives:
    """Tracks of a group of channels; rows of a hop are taken together, by channel."""

    def __init__(self, timers: Timers):
        self.t, self.tracks, self.made, self.muted = timers, [], 0, {}
        self.hop: int | None = None
        self.rows: list[tuple] = []

    def row(self, hop, channel, rise, level, decoded, position) -> list[tuple]:
        out = []
        if self.hop is not None and hop != self.hop:
            out = self._take()
        self.hop = hop
        self.rows.append((channel, bool(rise), bool(level), bool(decoded), position))
        return out

    def end(self) -> list[tuple]:
        out = self._take() if self.rows else []
        out += self._expire((self.hop or 0) + self.t.longest() + 1)
        return out

    def _event(self, hop: int, track: Track, event: str) -> tuple:
        return track.number, hop, event, round(track.centre, 6)

    def _close(self, hop: int, track: Track, reason: str) -> tuple:
        self.tracks.remove(track)
        return self._event(hop, track, reason)

    def _next(self, track: Track) -> tuple[int, int, Track, str]:
        """The hop at which the track's next timer ends, and what then."""
        if track.state == "candidate":
            return track.risen + 1, track.number, track, "lapse"
        if track.state == "dormant":
            return track.slept + self.t.sleep, track.number, track, "hang_expired"
        hang, mute = track.level + self.t.hang, track.spoke + self.t.mute
        return (mute, track.number, track, "silent") if mute <= hang else (hang, track.number, track, "hang")

    def _expire(self, before: int) -> list[tuple]:
        """All timers that end before a hop, in order."""
        out = []
        while self.tracks:
            at, _, track, what = min((self._next(t) for t in self.tracks), key=lambda x: x[:2])
            if at >= before:
                break
            if what == "lapse":
                self.tracks.remove(track)  # never confirmed: it leaves no trace
            elif what == "hang" and track.decoded and self.t.sleep > 0:
                track.state, track.slept, track.rises = "dormant", at, 0
                out.append(self._event(at, track, "dormant"))
            else:
                if what == "silent":
                    self.muted[round(track.centre)] = at + self.t.suppress
                out.append(self._close(at, track, "hang_expired" if what == "hang" else what))
        return out

    def _take(self) -> list[tuple]:
        hop, rows = self.hop, sorted(self.rows)
        self.rows = []
        out = self._expire(hop)
        for channel, rise, level, decoded, position in rows:
            owners = [t for t in self.tracks if t.owns(channel)]
            nearest = min(owners, key=lambda t: (abs(t.centre - channel), t.number), default=None)
            if nearest is not None and not (rise and self._second(channel, position, owners)):
                out += self._feed(nearest, hop, channel, rise, level, decoded, position)
            elif rise:
                self.made += 1
                centre = float(channel) if position is None or abs(position - channel) > 0.6 else position
                track = Track(self.made, centre, "candidate", 1, hop, phased=position is not None)
                self.tracks.append(track)
                if self.muted.get(channel, hop) > hop:
                    out.append(self._event(hop, track, "suppressed"))
                if self.t.confirm <= 1:
                    out.append(self._promote(track, hop))
        return out + self._merge(hop)

    def _second(self, channel: int, position: float | None, owners: list[Track]) -> bool:
        """Whether a rise beside tracks is a signal of its own: far enough from each owner, by its channel and by its phase, and none sleeps."""
        return position is not None and all(t.state != "dormant" and t.phased and abs(t.centre - channel) >= PAIR and abs(t.centre - position) >= PHASE_APART for t in owners)

    def _promote(self, track: Track, hop: int) -> tuple:
        track.state, track.level, track.spoke = "active", hop, hop
        return self._event(hop, track, "promoted")

    def _feed(self, track: Track, hop: int, channel: int, rise: bool, level: bool, decoded: bool, position: float | None) -> list[tuple]:
        out = []
        if rise and track.risen != hop:
            track.rises = track.rises + 1 if track.risen == hop - 1 else 1
            track.risen = hop
        if track.state == "candidate" and track.rises >= self.t.confirm:
            out.append(self._promote(track, hop))
        elif track.state == "dormant":
            if track.rises >= self.t.confirm:
                track.state, track.level, track.spoke = "active", hop, hop
                out.append(self._event(hop, track, "reacquired"))
        elif track.state == "active":
            if level:
                track.level = hop
            if decoded:
                track.spoke, track.decoded = hop, True
        # a sleeper keeps its centre, so that noise can't drag it
        if position is not None and level and track.state != "dormant" and abs(position - channel) <= 1:
            track.centre += FOLLOW * (position - track.centre)
            track.phased = True
        return out

    def _merge(self, hop: int) -> list[tuple]:
        """Of two tracks less than a channel apart the older stays; a candidate gives way to any other."""
        out = []
        while True:
            order = sorted(self.tracks, key=lambda t: (t.state == "candidate", t.number))
            pair = next(((a, b) for i, a in enumerate(order) for b in order[i + 1 :] if abs(a.centre - b.centre) < ONE), None)
            if pair is None:
                return out
            kept, gone = pair
            if kept.state == "active" and gone.state == "active":
                kept.level, kept.spoke, kept.decoded = max(kept.level, gone.level), max(kept.spoke, gone.spoke), kept.decoded or gone.decoded
            self.tracks.remove(gone)
            if gone.state != "candidate":
                out.append(self._event(hop, gone, "merged"))


def lives(rows: DataFrame, timers: Timers | None = None) -> DataFrame:
    """rows (input, hop, channel, rise, level, decoded, position) -> input, group, stretch, track, hop, event, centre.

    rise: the channel rises as a local maximum; level: it is at the level that keeps a track; decoded: a character came from it; position: its exact place in channels, by phase, or null. Rows without any
    of the three may be left out. Events: promoted, dormant, reacquired, suppressed (spawned where one was silent), and the closing ones hang_expired, silent, merged. track counts from 1
    within its group and stretch.
    """
    timers = timers or Timers()
    telling = rows.where(F.coalesce(F.col("rise"), F.lit(False)) | F.coalesce(F.col("level"), F.lit(False)) | F.coalesce(F.col("decoded"), F.lit(False)))
    grouped = channels(telling.withColumn("__c", F.col("channel").cast("double")), ["input"], "__c", float(APART), "group").drop("__c")
    cut = stretches(packed(grouped, ["input", "group", "hop"]), ["input", "group"], "hop", timers.longest())

    def step(state: Lives, hop, block, shown, positions) -> list[tuple]:
        out = []
        for code, position in zip(shown, positions, strict=True):
            out += state.row(hop, (block << PACKED) + (code >> 3), code & 1, code & 2, code & 4, position)
        return out

    return carried(
        cut, ["input", "group", "stretch"], ["hop", "block"], ["hop", "block", "shown", "positions"],
        "track int, hop bigint, event string, centre double", lambda: Lives(timers), step, lambda state: state.end(),
    )


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, channel, rise, level, decoded, position) -> keys, block, shown, positions: a row per block of channels; shown: eight times the channel's place in its block, and 1, 2 and 4 for rise, level and decoded."""
    flag = lambda c, value: F.when(F.col(c), value).otherwise(0)
    code = F.col("channel").bitwiseAND((1 << PACKED) - 1) * 8 + flag("rise", 1) + flag("level", 2) + flag("decoded", 4)
    shown = F.collect_list(F.struct(code.cast("smallint").alias("code"), F.col("position").cast("double").alias("position")))
    blocks = rows.groupBy(*keys, F.shiftright("channel", PACKED).alias("block")).agg(shown.alias("__shown"))
    return blocks.select(*keys, "block", F.col("__shown.code").alias("shown"), F.col("__shown.position").alias("positions"))
