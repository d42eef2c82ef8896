"""Truly sequential steps: each reads a recording row by row, carrying state.

Everything that depends on a single row is computed as columns beforehand; only times and a few flags reach Python, in
Arrow batches, one recording at a time. The same step functions serve the streaming versions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.config import DEFAULT, Config, State, Stop
from chalkline.functions import predicates as p
from chalkline.operators.folds import in_pieces
from chalkline.operators.pieces import WIDTH_S, by_pieces, cut_pieces, in_piece, numbered, of_recordings
from chalkline.operators.sequence import join_by
from chalkline.operators.timeline import KEYS
from chalkline.session import cut as written

# The phases of a shot.
PHASES = ("WAITING", "CUEING", "STRIKE_CANDIDATE", "STRIKE_CONFIRMED", "BALLS_MOVING", "BALLS_SETTLING", "ALL_BALLS_STOPPED")
WAITING, CUEING, CANDIDATE, CONFIRMED, MOVING, SETTLING, STOPPED = range(7)


@dataclass
class PhaseMemory:
    """What the phase labeller carries from row to row: the phase and since when things hold (NaN: not)."""

    phase: int = WAITING
    quiet: float = math.nan
    candidate: float = math.nan
    movement: float = math.nan
    still: float = math.nan


def phase_step(m: PhaseMemory, t: float, usable: bool, from_rest: bool, moving: bool, stationary: bool, score: float, s: State = DEFAULT.state) -> int:
    """Advance by one row and return its phase. At most one transition a row.

    A row that is not usable (invalid, or with a hidden ball) proves nothing: a shot under way stays open and must show
    stillness anew; otherwise waiting starts over.
    """
    if not usable:
        if m.phase == SETTLING:
            m.still = math.nan
        elif m.phase in (WAITING, CUEING, STOPPED):
            m.phase, m.quiet, m.candidate, m.movement = WAITING, math.nan, math.nan, math.nan
    else:
        _ADVANCE[m.phase](m, t, from_rest, moving, stationary, score, s)
    return m.phase


def _held(since: float, t: float, seconds: float) -> bool:
    return t - since >= seconds  # False for NaN


def _waiting(m, t, from_rest, moving, stationary, score, s):
    if not stationary:
        m.quiet = math.nan
    elif math.isnan(m.quiet):
        m.quiet = t
    elif _held(m.quiet, t, s.quiet_s):
        m.phase = CUEING


def _cueing(m, t, from_rest, moving, stationary, score, s):
    if score >= s.strike_score and _held(m.quiet, t, s.quiet_s):
        m.phase, m.candidate, m.movement = CANDIDATE, t, t if from_rest else math.nan
    elif not (stationary or from_rest):
        m.phase, m.quiet = WAITING, math.nan


def _candidate(m, t, from_rest, moving, stationary, score, s):
    if from_rest:
        if math.isnan(m.movement):
            m.movement = t
        elif _held(m.movement, t, s.sustain_s):
            m.phase = CONFIRMED
        return
    m.movement = math.nan
    if t - m.candidate > s.timeout_s:
        m.phase, m.candidate = (CUEING if stationary else WAITING), math.nan


def _confirmed(m, t, from_rest, moving, stationary, score, s):
    if moving or from_rest:
        m.phase = MOVING
    elif t - m.candidate > s.timeout_s:
        m.phase = WAITING


def _moving(m, t, from_rest, moving, stationary, score, s):
    if not moving:
        m.phase, m.still = SETTLING, t


def _settling(m, t, from_rest, moving, stationary, score, s):
    if moving:
        m.phase, m.still = MOVING, math.nan
    elif math.isnan(m.still):
        m.still = t
    elif _held(m.still, t, s.settle_s):
        m.phase = STOPPED


def _stopped(m, t, from_rest, moving, stationary, score, s):
    m.phase, m.quiet = WAITING, t if stationary else math.nan
    m.candidate = m.movement = m.still = math.nan


_ADVANCE: dict[int, Callable] = {WAITING: _waiting, CUEING: _cueing, CANDIDATE: _candidate, CONFIRMED: _confirmed, MOVING: _moving, SETTLING: _settling, STOPPED: _stopped}


def phase_inputs(tl: DataFrame, s: State = DEFAULT.state) -> DataFrame:
    """The columns the phase labeller reads."""
    return tl.select(
        *KEYS, "t", (p.valid_state(s) & (F.col("occluded_ball_count") == 0)).alias("usable"), p.state_moving(s.start, s.legacy_start).alias("from_rest"),
        p.state_moving(s.stop, s.legacy_stop).alias("moving"), p.cue_stationary(s).alias("stationary"), F.col("strike_score").alias("score"),
    )


def _schema(df: DataFrame, *more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"{k} {kinds[k]}" for k in KEYS] + list(more))


def label_phases(tl: DataFrame) -> DataFrame:
    """The phase of the shot at each row: KEYS, `t`, `state`. A recording begins with WAITING."""
    rows = phase_inputs(tl)

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        memory = PhaseMemory()
        columns = [part[c].tolist() for c in ("t", "usable", "from_rest", "moving", "stationary", "score")]
        phases = [PHASES[phase_step(memory, *row)] for row in zip(*columns)]
        return part[[*KEYS, "t"]].assign(state=phases)

    return rows.groupBy(*KEYS).applyInPandas(label, _schema(rows, "t double", "state string"))


def smoothed(tl: DataFrame, column: str = "motion_raw", alpha: float = DEFAULT.ema_alpha, cut: float = DEFAULT.state.hard_cut) -> DataFrame:
    """Exponential moving average of a series, starting over at each cut: KEYS, `t`, `session`, `smooth`.

    The first row of a session is the series itself; then alpha * x + (1 - alpha) * before.
    """
    rows = numbered(written(tl.select(*KEYS, "t", F.col(column).alias("x"), (F.col("scene_cut_score") >= cut).cast("int").alias("cut")), "rows"))
    # Sessions are counted by shard of the clock, with one row for each shard that goes on to the later ones.
    by = [*KEYS, "_shard"]
    rows = rows.withColumn("_shard", F.floor(F.col("t") / WIDTH_S))
    along = Window.partitionBy(*KEYS).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by).agg(F.sum("cut").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    upto = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = join_by(rows, before, by).withColumn("session", F.col("_base") + F.sum("cut").over(upto)).drop("_base", "_shard")

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        values = part.groupby("session")["x"].transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean())
        return part[[*KEYS, "t", "session", "_halo"]].assign(smooth=values)

    # What lies further back than this weighs less than the last digit of a number.
    memory = math.ceil(math.log(1e-20) / math.log(1 - alpha)) if alpha < 1 else 1
    run = lambda piece: piece.groupBy(*KEYS).applyInPandas(smooth, _schema(rows, "t double", "session bigint", "_halo boolean", "smooth double"))
    return by_pieces(rows, run, 0.0, memory)


@dataclass
class Motion:
    """State of the search for the end of motion after one onset."""

    strike: float
    s: Stop
    started: float = math.nan
    start_confidence: float = 0.0
    last: float = math.nan
    still: float = math.nan
    run: int = 0
    resumed: int = 0
    unknown: float = math.nan
    unknown_total: float = 0.0
    timer: float = math.nan
    stale: bool = False
    tracked: bool = False
    valid_rows: int = 0

    def step(self, t: float, valid: bool, start: bool, on: bool, tracked: bool, calm: bool) -> bool:
        """Take one row; True if it confirms the stop. `calm`: a quiet picture with one or two hidden balls only."""
        if not valid:
            self.unknown = t if math.isnan(self.unknown) else self.unknown
            self.still, self.resumed = math.nan, 0
            return False
        self.valid_rows += 1
        self.tracked |= tracked
        if not math.isnan(self.unknown):
            self.unknown_total += t - self.unknown
            self.unknown = math.nan
        if math.isnan(self.started) or self.run < 2:
            self._wait(t, start, tracked)
            return False
        return self._follow(t, self._believed(t, on, calm))

    def _wait(self, t: float, start: bool, tracked: bool) -> None:
        """Motion begins with the second of two moving rows in a row."""
        if not start:
            self.run, self.started = 0, math.nan
            return
        self.run += 1
        if self.run == 1:
            self.started = max(self.strike, t)
        else:
            self.start_confidence, self.last = (0.92 if tracked else 0.72), t

    def _believed(self, t: float, on: bool, calm: bool) -> bool:
        """A ball hidden for long in a quiet picture no longer counts as moving."""
        if not calm:
            self.timer = math.nan
            return on
        if math.isnan(self.timer):
            self.timer = t
        if t - self.timer + 1e-9 >= self.s.stale_quiet_s:
            self.stale = True
            return False
        return on

    def _follow(self, t: float, moving: bool) -> bool:
        if moving:
            if math.isnan(self.still):
                self.last = t
                return False
            self.resumed += 1
            if self.resumed >= self.s.reopen_samples:
                self.last, self.still = t, math.nan
            return False
        self.resumed = 0
        if t < self.strike + self.s.min_motion_s:
            return False
        if math.isnan(self.still):
            self.still = self.timer if self.stale and not math.isnan(self.timer) else t
        return t - self.still + 1e-9 >= self.s.confirm_s


def find_stop(strike: float, duration: float, t: np.ndarray, flags: dict[str, np.ndarray], baseline: float, s: Stop = DEFAULT.stop) -> tuple:
    """(motion_start, last_motion, stop, confirm, confirmed, start_confidence, confidence, review, reason) of one onset.

    `t` and `flags` (valid, tracked, calm, start, on, activity; start and on are NaN where the activity against the
    baseline decides) are the recording's rows in order.
    """
    strike = min(max(strike, 0.0), duration)
    cap = min(duration, strike + s.max_s)
    a, b = np.searchsorted(t, strike - s.lead_s, "left"), np.searchsorted(t, cap + 1e-6, "right")
    if a == b:
        return math.nan, math.nan, cap, cap, False, 0.10, 0.20, True, "no_motion_observations"
    m = Motion(strike, s)
    start_level, on_level = max(s.start_activity, baseline * s.start_factor), max(s.stop_activity, baseline * s.stop_factor)
    for k in range(max(a, np.searchsorted(t, strike, "left")), b):
        act = flags["activity"][k]
        start = act >= start_level if math.isnan(flags["start"][k]) else bool(flags["start"][k])
        on = act >= on_level if math.isnan(flags["on"][k]) else bool(flags["on"][k])
        if m.step(float(t[k]), bool(flags["valid"][k]), start, on, bool(flags["tracked"][k]), bool(flags["calm"][k])):
            sure = 0.95 if m.tracked else 0.82
            if m.stale:
                sure = min(sure, 0.68)
            if m.unknown_total > 0:
                sure -= min(0.25, 0.08 * m.unknown_total)
            if m.valid_rows < 4:
                sure = min(sure, 0.55)
            reason = "confirmed_stale_occlusion_override" if m.stale else "confirmed_after_unknown_gap" if m.unknown_total > 0 else "confirmed_stationary"
            return m.started, m.last, m.still, float(t[k]), True, m.start_confidence, sure, sure < 0.70 or m.unknown_total >= s.review_unknown_s, reason
    moved = not math.isnan(m.last)
    if cap < duration - 1e-6:
        return m.started, m.last, cap, cap, False, m.start_confidence, 0.20, True, "max_duration_review_cap"
    reason, sure = ("motion_not_confirmed", 0.20) if moved else ("no_sustained_ball_motion", 0.12)
    return m.started, m.last, cap, cap, False, m.start_confidence, sure, True, reason


STOP_SCHEMA = (
    "t double", "motion_start double", "last_motion double", "stop double", "confirm double", "confirmed boolean", "start_confidence double",
    "stop_confidence double", "stop_review boolean", "stop_reason string",
)


def stop_inputs(tl: DataFrame, s: Stop = DEFAULT.stop) -> DataFrame:
    """The columns the search for stops reads."""
    decided_start = F.when((F.col("moving_ball_count") > 0) | p.track_evidence(), p.stop_moving(False, F.lit(0.0)).cast("double"))
    hidden = F.col("occluded_ball_count")
    override = p.quiet_override() & ((hidden == 0) | (hidden >= 8))
    decided_on = F.when(override | (hidden > 0) | (F.col("moving_ball_count") > 0) | p.track_evidence(), p.stop_moving(True, F.lit(0.0)).cast("double"))
    calm = (hidden > 0) & (hidden <= s.stale_max_count) & (F.col("moving_ball_count") == 0) & p.quiet_override()
    return tl.select(
        *KEYS, "t", p.valid_stop().alias("valid"), p.track_evidence().alias("tracked"), calm.alias("calm"), decided_start.alias("start"), decided_on.alias("on"),
        p.stop_activity(s).alias("activity"),
    )


#: Rows of a piece in which stops are sought.
STOP_PIECE = 16_384


def find_stops(tl: DataFrame, onsets: DataFrame, s: Stop = DEFAULT.stop) -> DataFrame:
    """Where motion ends after each onset (KEYS, `t`): KEYS and STOP_SCHEMA. The recording ends with its last row."""
    rows = stop_inputs(tl, s)
    spread, pieces = cut_pieces(rows, s.max_s + s.baseline_s + 1.0, 1, STOP_PIECE)
    ends = pieces.groupBy(*KEYS).agg(F.max("_last").alias("ends"))

    # The two sides may stem from the same table; new names keep them apart.
    own = [f"onset_{k}" for k in KEYS]
    columns = [*KEYS, *[c.split()[0] for c in STOP_SCHEMA]]

    def search(marks: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(marks):
            return pd.DataFrame(columns=columns)
        key = marks[own].iloc[0].tolist()
        part = part.sort_values("t", kind="stable")
        t = part["t"].to_numpy()
        flags = {c: part[c].to_numpy(dtype=float) for c in ("valid", "tracked", "calm", "start", "on", "activity")}
        duration = float(marks["ends"].iloc[0])
        out = []
        for strike in sorted(marks["onset_t"].tolist()):
            a, b = np.searchsorted(t, [strike - s.baseline_s, strike - s.baseline_guard_s], "left")
            calm = np.sort(flags["activity"][a:b][flags["valid"][a:b] > 0])
            baseline = float(np.median(calm[: (len(calm) + 1) // 2])) if len(calm) else min(0.05, s.stop_activity * 0.5)
            out.append((*key, strike, *find_stop(strike, duration, t, flags, baseline, s)))
        return pd.DataFrame(out, columns=columns)

    placed = in_piece(onsets.select(*KEYS, F.col("t").alias("onset_t")).join(ends, KEYS), pieces, "onset_t")
    marks = placed.select(*[F.col(k).alias(o) for k, o in zip(KEYS, own)], "onset_t", "ends").groupBy(*own)
    return of_recordings(marks.cogroup(spread.groupBy(*KEYS)).applyInPandas(search, _schema(rows, *STOP_SCHEMA)))


@dataclass
class Clip:
    """A shot while overlaps are resolved. `stop` may be capped by the mode; `uncapped` is where motion was seen to end."""

    strike: float
    start: float
    end: float
    stop: float
    uncapped: float
    confirmed: bool
    confidence: float
    audio: float
    quiet: float
    review: bool
    minimum: float
    notes: dict = field(default_factory=dict)


def resolve_overlaps(clips: list[Clip], strict: bool, c: Config = DEFAULT) -> list[Clip]:
    """Keep, of shots that cannot both be real, the better supported one; later ones are compared with what is left.

    Shots conflict when they lie within 0.6 s, when the later begins before the earlier's confirmed stop, or (strict)
    when their clips overlap. The later one wins by a clear margin of confidence, else by sound, else by quiet before it.
    """
    kept: list[Clip] = []
    for clip in sorted(clips, key=lambda x: x.strike):
        drop = False
        while kept and not drop:
            last = kept[-1]
            in_motion = last.confirmed and clip.strike <= last.uncapped + 1e-6
            overlap = strict and clip.start < last.end - 1e-6
            if not (clip.strike - last.strike < c.near_duplicate_s or in_motion or overlap):
                break
            if _later_wins(last, clip, c):
                clip.notes["replaced"] = kept.pop().strike
                continue
            last.review |= clip.confidence >= c.high
            last.notes["rejected"] = clip.strike
            drop = True
        if not drop:
            kept.append(clip)
    if strict:
        for clip in kept:
            clip.start = max(0.0, clip.strike - c.modes["strict"].pre_s)
            clip.end = max(clip.stop, clip.minimum)
    return kept


def _later_wins(earlier: Clip, later: Clip, c: Config) -> bool:
    by = later.confidence - earlier.confidence
    if abs(by) > c.conflict_margin:
        return by > 0
    heard = (earlier.audio >= 0.15, later.audio >= 0.15)
    if heard[0] != heard[1]:
        return heard[1]
    return later.quiet - earlier.quiet > 1e-6


SHOT_SCHEMA = (
    "shot_id int", "strike double", "clip_start double", "clip_end double", "stop double", "confidence double", "review boolean", "replaced double", "rejected double",
)


def resolve_shots(clips: DataFrame, strict: bool, reach_s: float = 60.0) -> DataFrame:
    """Resolve the overlaps of each recording's clips (columns of Clip) and number what is left.

    No clip ends, and no motion stops, later than `reach_s` after its strike: clips after a longer pause of strikes are
    resolved by themselves.
    """

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        key = part[KEYS].iloc[0].tolist()
        names = ("strike", "start", "end", "stop", "uncapped", "confirmed", "confidence", "audio", "quiet", "review", "minimum")
        kept = resolve_overlaps([Clip(*row) for row in zip(*[part[n].tolist() for n in names])], strict)
        rows = [(*key, 0, x.strike, x.start, x.end, x.stop, x.confidence, x.review, x.notes.get("replaced"), x.notes.get("rejected")) for x in kept]
        return pd.DataFrame(rows, columns=[*KEYS, *[n.split()[0] for n in SHOT_SCHEMA]])

    kept = in_pieces(clips, KEYS, "strike", reach_s, strictly=True).groupBy(*KEYS, "_piece").applyInPandas(resolve, _schema(clips, *SHOT_SCHEMA))
    # Strikes of one recording differ, so their order is that of the numbers.
    return numbered(written(kept.withColumn("t", F.col("strike")), "shots")).withColumn("shot_id", (F.col("_row") + 1).cast("int")).drop("t", "_row")


def mark_replays(marks: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Candidates that repeat an earlier live one: adds `replay` and `replay_of` (time of the live one matched last).

    `marks`: KEYS, `t`, `confidence`, `signature` (array), `explicit` (a replay view is near), `transition` (a cut is
    near). A candidate is compared with the live ones 2 to 90 s before; it becomes live itself if it is no replay
    and its confidence is 0.40 or more.
    """
    rows = marks.select(*KEYS, "t", "confidence", "signature", "explicit", "transition")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        signatures = np.array(part["signature"].tolist(), np.float64).reshape(len(part), -1)
        norms = np.linalg.norm(signatures, axis=1)
        live: list[int] = []
        replay, match = part["explicit"].tolist(), [None] * len(part)
        t, sure, near = part["t"].tolist(), part["confidence"].tolist(), (part["explicit"] | part["transition"]).tolist()
        for i in range(len(part)):
            for j in live:
                if near[i] and c.replay_min_s <= t[i] - t[j] <= c.replay_max_s and norms[i] > 1e-6 and norms[j] > 1e-6:
                    if signatures[i] @ signatures[j] / (norms[i] * norms[j]) >= c.replay_similarity:
                        replay[i], match[i] = True, t[j]
            if not replay[i] and sure[i] >= 0.40:
                live.append(i)
        return part[[*KEYS, "t"]].assign(replay=replay, replay_of=match)

    # After a longer pause no earlier candidate can be meant.
    placed = in_pieces(rows, KEYS, "t", c.replay_max_s, strictly=True)
    return placed.groupBy(*KEYS, "_piece").applyInPandas(link, _schema(rows, "t double", "replay boolean", "replay_of double"))
