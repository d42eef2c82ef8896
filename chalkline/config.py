"""Thresholds of the timeline operators. They decide the results and are those of the original defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Strike:
    """Finding event onsets."""

    min_confidence: float = 0.35
    spacing_s: float = 1.2
    radius_s: float = 0.5
    quiet_s: float = 0.50
    quiet_guard_s: float = 0.03
    quiet_max_motion: float = 0.28
    quiet_min_ratio: float = 0.80
    contact_quiet_min_ratio: float = 0.70
    quiet_max_ball_speed: float = 5.0
    ball_quiet_min_ratio: float = 0.60
    fallback_ball_quiet_min_ratio: float = 0.50
    contact_override: float = 0.70
    bridge_min_peak: float = 2.0
    identity_jump: float = 1.5
    stationary_speed: float = 0.65
    stationary_min_ratio: float = 0.70
    motion_start_speed: float = 1.0
    sustained_speed: float = 0.18
    post_s: float = 0.30
    track_confidence: float = 0.45
    track_relaxed: float = 0.315
    norm_rows: int = 20
    sparse_pre_s: float = 1.5
    sparse_guard_s: float = 0.01
    sparse_post_s: float = 1.0
    sparse_activity: float = 0.35
    sparse_min_active: int = 2
    residual_weight: float = 0.40
    view_weight: float = 0.15
    audio_weight: float = 0.12


@dataclass(frozen=True)
class Stop:
    """Finding where motion ends."""

    confirm_s: float = 0.50
    min_motion_s: float = 0.45
    max_s: float = 10.0
    start_speed: float = 0.80
    stop_speed: float = 0.60
    start_activity: float = 0.18
    stop_activity: float = 0.10
    start_factor: float = 2.4
    stop_factor: float = 1.65
    start_residual: float = 0.20
    stop_residual: float = 0.10
    review_unknown_s: float = 0.35
    reopen_samples: int = 2
    stale_max_count: int = 2
    stale_quiet_s: float = 0.50
    baseline_s: float = 1.2
    baseline_guard_s: float = 0.08
    lead_s: float = 0.25


@dataclass(frozen=True)
class State:
    """Labelling rows with the phase of a shot."""

    hard_cut: float = 0.42
    quiet_s: float = 0.30
    strike_score: float = 0.35
    sustain_s: float = 0.12
    timeout_s: float = 0.75
    settle_s: float = 0.50
    start: float = 0.18
    stop: float = 0.08
    legacy_start: float = 0.35
    legacy_stop: float = 0.20
    stationary_speed: float = 0.65
    track_confidence: float = 0.45
    quiet_motion: float = 0.28


@dataclass(frozen=True)
class Mode:
    """How a clip is cut around an event."""

    pre_s: float
    post_s: float
    prep: bool = False
    prep_max_s: float = 0.0
    reaction: bool = False
    reaction_max_s: float = 0.0
    strict: bool = False


@dataclass(frozen=True)
class Config:
    strike: Strike = field(default_factory=Strike)
    stop: Stop = field(default_factory=Stop)
    state: State = field(default_factory=State)
    modes: dict[str, Mode] = field(
        default_factory=lambda: {
            "strict": Mode(2.0, 0.0, strict=True),
            "action_only": Mode(1.5, 1.0),
            "natural": Mode(4.0, 3.0, True, 6.0, True, 4.0),
            "full_sequence": Mode(8.0, 4.0, True, 15.0, True, 6.0),
        }
    )
    high: float = 0.70
    medium: float = 0.50
    strict_after_s: float = 4.0
    strict_max_clip_s: float = 12.0
    fail_safe_s: float = 1.0
    near_duplicate_s: float = 0.60
    conflict_margin: float = 0.05
    replay_similarity: float = 0.92
    replay_min_s: float = 2.0
    replay_max_s: float = 90.0
    refine_backward_s: float = 2.0
    refine_tail_s: float = 2.0
    refine_merge_s: float = 0.25
    ema_alpha: float = 0.60


DEFAULT = Config()
