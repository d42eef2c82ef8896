"""Following several objects through the detections of a recording."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Diameters a second at which a hidden track counts as moving.
HIDDEN_MOVING = 0.10


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the least total cost; every row or every column is used.

    Shortest augmenting paths with potentials, one row at a time.
    """
    flip = cost.shape[0] > cost.shape[1]
    a = cost.T if flip else cost
    n, m = a.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, came, used = np.full(m + 1, math.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            row = owner[j]
            free = ~used[1:]
            slack = a[row - 1] - u[row] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j
            nxt = 1 + int(np.argmin(np.where(free, least[1:], math.inf)))
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            owner[j], j = owner[came[j]], came[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


@dataclass
class Track:
    """One object: place, velocity, size and how sure it is."""

    id: int
    label: str
    x: float
    y: float
    t: float
    size: float
    confidence: float
    vx: float = 0.0
    vy: float = 0.0
    hits: int = 1
    hidden: bool = False
    active: bool = True
    colour: float = 0.0
    shape: float = 0.0
    surround: float = 0.0
    path: list = field(default_factory=list)

    def ahead(self, t: float) -> tuple[float, float]:
        return self.x + self.vx * (t - self.t), self.y + self.vy * (t - self.t)

    def speed(self) -> float:
        return 0.0 if self.hidden else math.hypot(self.vx, self.vy)

    def is_ball(self) -> bool:
        """No highlight on players, rails or graphics: round and surrounded by cloth, where that was measured."""
        return (self.shape <= 0 or self.shape >= 0.48) and (self.surround <= 0 or self.surround >= 0.45)


def _label_cost(track: str, seen: str, colour: float) -> float:
    """Part of the gate that a change of label costs; the cue ball is hard to gain and hard to lose."""
    if track == seen:
        return 0.0
    if track == "cue":
        return 0.30 if colour < 0.55 else 0.60
    if seen == "cue":
        return 0.62 if colour >= 0.65 else 0.38
    return 0.20


class Tracker:
    """Tracks over time: predict, gate, assign, update; a track not seen for a second ends."""

    #: Weights of the newest observation, and the positions a track remembers.
    VELOCITY, CONFIDENCE, SIZE, KEEP, LOST_S = 0.55, 0.35, 0.20, 64, 1.0

    def __init__(self) -> None:
        self.tracks: list[Track] = []

    def update(self, t: float, seen: list[tuple]) -> list[Track]:
        """Take the detections (label, x, y, diameter, confidence, colour[, shape, surround]) at `t`; returns the active tracks."""
        live = [k for k in self.tracks if k.active]
        matched, used = set(), set()
        if live and seen:
            cost, gates = self._costs(t, live, seen)
            for i, j in assign(cost):
                if cost[i, j] <= gates[i, j]:
                    self._hit(live[i], t, seen[j])
                    matched.add(i)
                    used.add(j)
        for i, track in enumerate(live):
            if i not in matched:
                track.hidden, track.confidence = True, track.confidence * 0.92
                track.active = t - track.t <= self.LOST_S
        for j, (label, x, y, size, sure, colour, *scores) in enumerate(seen):
            if j not in used:
                shape, surround = scores or (0.0, 0.0)
                white = colour if label == "cue" else 0.0
                self.tracks.append(Track(len(self.tracks) + 1, label, x, y, t, size, sure, colour=white, shape=shape, surround=surround, path=[(x, y)]))
        return [k for k in self.tracks if k.active]

    def _costs(self, t, live, seen):
        cost, gates = np.zeros((len(live), len(seen))), np.zeros((len(live), len(seen)))
        for i, track in enumerate(live):
            px, py = track.ahead(t)
            for j, (label, x, y, size, _, colour, *_) in enumerate(seen):
                scale = max(track.size, size)
                gate = max(40.0, 3.5 * scale) + min(60.0, 0.35 * math.hypot(track.vx, track.vy) * (t - track.t))
                ratio = abs(math.log(max(size, 1e-6) / max(track.size, 1e-6)))
                cost[i, j] = math.hypot(x - px, y - py) + _label_cost(track.label, label, colour) * gate + min(0.45 * gate, ratio * gate * 0.28)
                gates[i, j] = gate
        return cost, gates

    def _hit(self, track: Track, t: float, seen) -> None:
        label, x, y, size, sure, colour, *scores = seen
        dt = max(t - track.t, 1e-6)
        w = 1.0 if track.hits < 2 else self.VELOCITY
        track.vx, track.vy = (w * (b - a) / dt + (1 - w) * v for a, b, v in ((track.x, x, track.vx), (track.y, y, track.vy)))
        track.confidence += self.CONFIDENCE * (sure - track.confidence)
        track.size += self.SIZE * (size - track.size)
        track.x, track.y, track.t, track.hidden = x, y, t, False
        track.hits += 1
        if label == "cue":
            track.colour = max(colour, 0.82 * track.colour + 0.18 * colour)
            if colour >= 0.45:
                track.label = label
        shape, surround = scores or (0.0, 0.0)
        track.shape = shape if track.shape <= 0 else 0.75 * track.shape + 0.25 * shape
        track.surround = surround if track.surround <= 0 else 0.70 * track.surround + 0.30 * surround
        track.path = [*track.path[-self.KEEP + 1 :], (x, y)]


def track_objects(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks of each recording (`keys`): keys, `t`, `track`, `label`, `x`, `y`, `speed`, `size`, `confidence`, `hidden`,
    `pace` (last speed measured, hidden or not), `colour`, `hits`, `seen_at`, `is_ball`.

    detections: keys, `t`, `label`, `x`, `y`, `diameter`, `confidence`, `colour` and, if measured, `shape` and `surround`; rows of one `t` are one picture, and a
    row with a null x is a picture without detections. One recording is one group of an Arrow UDF.
    """
    kinds = dict(detections.dtypes)
    columns = ["label", "x", "y", "diameter", "confidence", "colour", "shape", "surround"]
    for name in columns[-2:]:
        detections = detections.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)) if name in kinds else F.lit(0.0))
    added = ["pace", "colour", "hits", "seen_at", "is_ball"]

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        key, out, tracker = part[keys].iloc[0].tolist(), [], Tracker()
        for t, rows in part.sort_values(["t", "x", "y"], kind="stable").groupby("t"):
            seen = [tuple(r) for r in rows[columns].itertuples(index=False) if r.x == r.x]
            out += [(*key, t, k.id, k.label, k.x, k.y, k.speed(), k.size, k.confidence, k.hidden, math.hypot(k.vx, k.vy), k.colour, k.hits, k.t, k.is_ball()) for k in tracker.update(t, seen)]
        return pd.DataFrame(out, columns=[*keys, "t", "track", "label", "x", "y", "speed", "size", "confidence", "hidden", *added])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t double, track int, label string, x double, y double, speed double, size double, confidence double, hidden boolean, pace double, colour double, hits int, seen_at double, is_ball boolean"
    return detections.select(*keys, "t", *columns).groupBy(*keys).applyInPandas(follow, schema)


def track_statistics(tracks: DataFrame, keys: list[str], moving: float = 0.6) -> DataFrame:
    """Per picture: balls, fastest and mean speed of visible ones (also in diameters), moving and hidden moving ones, and the best cue track.

    Only tracks that look like a ball count for speeds in diameters (from the second hit on), as moving and as hidden.
    """
    c = F.col
    sized = c("is_ball") & (c("size") > 0.5)
    normal = F.when(sized & (c("hits") >= 2), c("speed") / c("size")).otherwise(0.0)
    return tracks.withColumn("n", normal).groupBy(*keys, "t").agg(
        F.count(F.lit(1)).alias("balls"), F.max("speed").alias("max_speed"),
        F.coalesce(F.avg(F.when(~c("hidden"), c("speed"))), F.lit(0.0)).alias("mean_speed"), F.max("n").alias("max_normal"),
        F.count_if(c("n") >= moving).alias("moving"), F.count_if(c("hidden") & sized & (c("pace") / c("size") >= HIDDEN_MOVING)).alias("hidden"),
        F.max_by("track", F.when(c("label") == "cue", F.struct((~c("hidden")).alias("v"), "colour", "confidence", "hits", "seen_at"))).alias("cue_track"),
    )


def robust_diameter(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Median diameter of a recording after dropping those far from a first median."""
    first = detections.groupBy(*keys).agg(F.expr("percentile(diameter, 0.5)").alias("m"))
    near = detections.join(first, keys).where("diameter between 0.55 * m and 1.8 * m")
    return near.groupBy(*keys).agg(F.expr("percentile(diameter, 0.5)").alias("diameter"))
