"""Online grading: spots wait until their window is over, reports are kept as long as a window may need them, and the feed's outages are held against them.

One stateful operator with event-time timers (transformWithState, which needs the RocksDB state store). Its keys are shards of calls, so that a busy call
and a quiet one need no state of their own kind; the few rows that say that the feed went up or down go to every shard. A timer fires when the
watermark has passed a window's end, when all that can still arrive lies after it, so a grade doesn't depend on how the rows were cut into
micro-batches, and equals the batch grade of the same rows and spans.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spotlake.functions.numeric import BANDS
from spotlake.functions.text import normal_spotter
from spotlake.operators.grading import NO_BAND, folded, spotter_kept

OUTPUT = "spot_id string, call string, band string, grade string, reports long, skimmers long, modal_freq double, median_wpm double, freq_offset double, disagreements string, bands string, window_close timestamp"


@dataclass(frozen=True)
class Rules:
    """Times in seconds. retained: how long past a window's length reports are kept."""

    window: int = 180
    freq_tol: float = 500.0
    speed_tol: float = 3.0
    speed_share: float = 0.2
    freq_step: float = 100.0
    retained: int = 60
    bands: tuple = BANDS


def grade_one(spot: dict, reports: list[dict], covered: bool, rules: Rules) -> dict:
    """The grade of one spot by the reports of its call in its window, as grading.grade_spots() gives it."""
    order = {name: i for i, (_, _, name) in enumerate(rules.bands)}
    if spot["band"] == NO_BAND:
        same = [r for r in reports if abs(spot["freq"] - r["freq"]) <= rules.freq_tol]
    else:
        same = [r for r in reports if r["band"] == spot["band"]]
    counts = Counter(int(r["freq"] / rules.freq_step + 0.5) * rules.freq_step for r in same)
    modal = min(counts, key=lambda f: (-counts[f], abs(f - spot["freq"]), f)) if counts else None
    speeds = [r["wpm"] for r in same if r["wpm"] is not None]
    speed = float(median(speeds)) if speeds else None
    offset = round(spot["freq"] - modal, 6) if modal is not None else None
    wrong = []
    if offset is not None and abs(offset) > rules.freq_tol:
        wrong.append("frequency")
    if speed is not None and spot["wpm"] is not None and abs(spot["wpm"] - speed) > max(rules.speed_tol, speed * rules.speed_share):
        wrong.append("speed")
    bands = sorted({r["band"] for r in reports}, key=lambda b: (order.get(b, len(order)), b))
    grade = "disagree" if wrong else "match" if same else "unknown" if not covered else "elsewhere" if bands else "none"
    return {
        "spot_id": spot["id"], "call": spot["call"], "band": spot["band"], "grade": grade, "reports": len(same), "skimmers": len({r["spotter"] for r in same}), "modal_freq": modal, "median_wpm": speed,
        "freq_offset": offset, "disagreements": ",".join(wrong), "bands": ",".join(bands),
    }


def covers(feed: list[tuple[int, bool]], low: int, high: int) -> bool:
    """Whether the feed was up from low to high (inclusive), by its rows of (time, up) in any order; of one time, down comes first."""
    since = None
    for t, up in sorted(feed):
        if up and since is None:
            since = t
        elif not up and since is not None:
            if since <= low and high <= t:
                return True
            since = None
    return since is not None and since <= low


class Grader(StatefulProcessor):
    """State of a shard: reports by call, waiting spots by call, and the feed's rows; times in microseconds."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "call string", "spots string, reports string")
        self.feed = handle.getValueState("feed", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple[list, list]] = {}
        feed, window = [], self.rules.window * 1_000_000
        timers = set()
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
            for t, kind, i, call, freq, wpm, band, who in zip(times, *(frame[c].tolist() for c in ("kind", "id", "call", "freq", "wpm", "band", "spotter")), strict=True):
                if kind in ("up", "down"):
                    feed.append((t, kind == "up"))
                    continue
                spots, reports = new.setdefault(call, ([], []))
                speed = None if wpm is None or wpm != wpm else wpm
                if kind == "spot":
                    spots.append({"t": t, "id": i, "call": call, "freq": freq, "wpm": speed, "band": band})
                    timers.add((t + window) // 1000 + 1)
                else:
                    reports.append({"t": t, "freq": freq, "wpm": speed, "band": band, "spotter": who})
        for call, (spots, reports) in new.items():
            old = self._of(call)
            self._put(call, old[0] + spots, old[1] + reports)
        if feed:
            self.feed.update((json.dumps(self._feed() + feed),))
        # reports go at the end of the stretch of time after which no spot can need them
        stretch = self._kept() // 1000
        timers |= {(r["t"] // 1000 // stretch + 2) * stretch for _, reports in new.values() for r in reports}
        for at in timers:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, window = expiredTimerInfo.getExpiryTimeInMs() * 1000, self.rules.window * 1_000_000
        feed, out, least = self._feed(), [], now
        for (call,), _ in list(self.held.iterator()):
            spots, reports = self._of(call)
            due = [s for s in spots if s["t"] + window < now]
            wait = [s for s in spots if s["t"] + window >= now]
            for s in sorted(due, key=lambda s: (s["t"], s["id"])):
                low, high = s["t"] - window, s["t"] + window
                near = [r for r in reports if low <= r["t"] <= high]
                out.append({**grade_one(s, near, covers(feed, low, high), self.rules), "window_close": pd.Timestamp(high, unit="us")})
            cut = min([now - self._kept(), *[s["t"] - window for s in wait]])
            least = min(least, cut)
            kept = [r for r in reports if r["t"] >= cut]
            if len(wait) < len(spots) or len(kept) < len(reports):
                self._put(call, wait, kept)
        # of the feed before every window that may still close, only the last row tells
        past = [f for f in sorted(feed) if f[0] < least]
        if len(past) > 1:
            self.feed.update((json.dumps([past[-1], *[f for f in feed if f[0] >= least]]),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass

    def _kept(self) -> int:
        return (2 * self.rules.window + self.rules.retained) * 1_000_000

    def _of(self, call: str) -> tuple[list, list]:
        if not self.held.containsKey((call,)):
            return [], []
        return tuple(json.loads(x) for x in self.held.getValue((call,)))

    def _put(self, call: str, spots: list, reports: list) -> None:
        if spots or reports:
            self.held.updateValue((call,), (json.dumps(spots), json.dumps(reports)))
        else:
            self.held.removeKey((call,))

    def _feed(self) -> list[tuple[int, bool]]:
        return [tuple(f) for f in json.loads(self.feed.get()[0])] if self.feed.exists() else []


def grade_online(spots: DataFrame, reports: DataFrame, feed: DataFrame, rules: Rules, late: str, shards: int = 64, spotters: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """Streams of spots (spot_id, call, ts, freq, wpm, band), reports (call, ts, freq, wpm, band, spotter) and of the feed (ts, up) -> OUTPUT, a row per spot once its window is over.

    late: how far behind the newest row of its stream a row may come; later ones are dropped. Rows without a call or a time count as absent. A feed that has not said
    that it is up covers nothing.
    """
    call = folded(F.col("call"))
    shard = F.pmod(F.xxhash64("call"), F.lit(shards)).cast("int").alias("shard")
    own = lambda df, kind, i, who: df.where("call IS NOT NULL AND ts IS NOT NULL").withColumn("call", call).withWatermark("ts", late).select(shard, "ts", F.lit(kind).alias("kind"), i.cast("string").alias("id"), "call", F.col("freq").cast("double").alias("freq"), F.col("wpm").cast("double").alias("wpm"), "band", who.alias("spotter"))
    none = F.lit(None).cast("string")
    told = feed.where("ts IS NOT NULL").withWatermark("ts", late).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "ts", F.when(F.col("up"), "up").otherwise("down").alias("kind"), none.alias("id"), none.alias("call"), F.lit(None).cast("double").alias("freq"), F.lit(None).cast("double").alias("wpm"), none.alias("band"), none.alias("spotter"))
    heard = reports.where(spotter_kept(F.col("spotter"), spotters, excluded))
    rows = own(spots, "spot", F.col("spot_id"), none).unionByName(own(heard, "report", none, F.coalesce(normal_spotter(F.col("spotter")), F.lit("")))).unionByName(told)
    return rows.groupBy("shard").transformWithStateInPandas(Grader(rules), OUTPUT, "Append", "EventTime")
