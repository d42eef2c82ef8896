"""The causal operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chalkline.functions import predicates as p
from chalkline.operators.stateful import PHASES, PhaseMemory, phase_step
from chalkline.config import DEFAULT


def stream_phases(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Phase of the shot at each row of a stream of clean timeline rows: key, `t`, `state`.

    The state is one PhaseMemory a key. Rows of a key must come in order of `t` between batches; inside a batch they are
    sorted. A row earlier than one already labelled of an earlier batch is late: it is labelled as the phase then
    holds and does not advance it.
    """
    s = DEFAULT.state
    inputs = rows.select(
        key, "t", (p.valid_state(s) & (F.col("occluded_ball_count") == 0)).alias("usable"), p.state_moving(s.start, s.legacy_start).alias("from_rest"),
        p.state_moving(s.stop, s.legacy_stop).alias("moving"), p.cue_stationary(s).alias("stationary"), F.col("strike_score").alias("score"),
    )

    def label(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *fields = state.get if state.exists else (float("-inf"), 0, *[float("nan")] * 4)
        memory = PhaseMemory(*fields)
        part = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, *flags in part[["t", "usable", "from_rest", "moving", "stationary", "score"]].itertuples(index=False):
            out.append(PHASES[phase_step(memory, t, *flags) if t >= last else memory.phase])
            last = max(last, t)
        state.update((last, memory.phase, memory.quiet, memory.candidate, memory.movement, memory.still))
        yield pd.DataFrame({key: [k[0]] * len(part), "t": part["t"].tolist(), "state": out})

    kind = dict(rows.dtypes)[key]
    return inputs.groupBy(key).applyInPandasWithState(
        label, f"{key} {kind}, t double, state string", "last double, phase int, quiet double, candidate double, movement double, still double", "append", GroupStateTimeout.NoTimeout
    )


def windowed_activity(rows: DataFrame, at: str, lateness: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Mean and largest motion per job and minute of a stream with a TIMESTAMP column `at`; late rows beyond the watermark are dropped."""
    return (
        rows.withWatermark(at, lateness).groupBy("job_id", F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.avg("motion_raw").alias("mean"), F.max("motion_raw").alias("peak"))
        .select("job_id", F.col("window.start").alias("begin"), "n", "mean", "peak")
    )


def session_activity(rows: DataFrame, at: str, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Recordings of a stream: sessions of a job's rows without a pause of `gap`."""
    return rows.withWatermark(at, lateness).groupBy("job_id", F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n")).select(
        "job_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n"
    )
