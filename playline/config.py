"""Analysis parameters.

Every threshold that shapes a result lives in one frozen dataclass so the
operators stay pure functions of (DataFrames, config).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


# Defaults that must equal the analysed application's constants.
#   laning end tick 14, swing threshold 300, corridor width 2500,
#   excursion phase ticks 4..14, excursion load window ticks 3..16,
#   anchor target tick 14 searched in ticks 12..16,
#   season start 2026-01-10 00:00:00 UTC, analysed role MIDDLE,
#   early incident before tick 6, spiral gap <= 3 ticks, rolling window 5 sessions,
#   neutral form 0.5, deviation multiplier 1.5, minimum excursion rows 2,
#   rival position MIDDLE, minimum rival games 2,
#   clustering: 9 features, k = 4, seed 42, 20 restarts,
#   pace-curve support: at least 3 sessions and round(0.5 * cluster size).
FEATURE_COLUMNS = (
    "gold_delta",
    "total_deaths",
    "deaths_while_ahead",
    "tilt_spiral_ratio",
    "max_death_streak",
    "total_roams",
    "avg_cs_sacrifice",
    "roam_impact_rate",
    "tilt_index",
)


@dataclass(frozen=True)
class AnalysisConfig:
    season_start: str = "2026-01-10 00:00:00"   # UTC wall time, inclusive
    role: str = "MIDDLE"
    laning_end: int = 14
    swing_threshold: int = 300
    corridor_width: int = 2500
    phase_start: int = 4
    phase_end: int = 14
    load_start: int = 3
    load_end: int = 16
    anchor_tick: int = 14
    anchor_low: int = 12
    anchor_high: int = 16
    early_tick: int = 6
    spiral_gap: int = 3
    rolling_window: int = 5
    neutral_form: float = 0.5
    std_mult: float = 1.5
    min_excursion_rows: int = 2
    rival_position: str = "MIDDLE"
    min_rival_games: int = 2
    k: int = 4
    seed: int = 42
    restarts: int = 20
    curve_min_count: int = 3
    curve_min_share: float = 0.5
    tick_ms: int = 60_000
    features: tuple = field(default=FEATURE_COLUMNS)

    def with_(self, **kw) -> "AnalysisConfig":
        return replace(self, **kw)


DEFAULT = AnalysisConfig()

# The driver-table adapter maps 6-hour ticks inside 5-day blocks onto the same
# tick numbers, so every tick constant above applies unchanged; only the
# season boundary moves (block >= 1 means start >= 2024-01-06).
ADAPTER = AnalysisConfig(season_start="2024-01-06 00:00:00", tick_ms=21_600_000)
