"""Every threshold in one place; pass another Settings to vary them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """The thresholds are fixed values, as results have to equal those of earlier runs."""

    # rules
    short_periods: tuple[int, ...] = (10, 20, 50)
    long_periods: tuple[int, ...] = (100, 200)
    ma_kinds: tuple[str, ...] = ("sma", "ema")
    cost_bps: float = 0.0
    heatmap_short: tuple[int, int, int] = (5, 60, 5)  # start, inclusive stop, step
    heatmap_long: tuple[int, int, int] = (100, 250, 10)
    trend_period: int = 200
    horizon_years: int = 5
    split_min_years: int = 1
    split_min_oos_months: int = 6
    # snapshots
    rewrite_tolerance: float = 0.0001
    factor_tolerance: float = 0.0001
    session_complete_after: str = "16:30"  # in New York
    stale_after_days: int = 3
    # regimes
    drawdown_regimes: tuple[float, ...] = (-0.05, -0.10, -0.20)
    top_drawdowns: int = 10
    vol_window: int = 20
    # detection, in trading bars
    sigma_window: int = 60
    z_threshold: float = 2.5
    gap_threshold: float = 0.015
    drawdown_threshold: float = 0.05
    rally_threshold: float = 0.08
    rally_window: int = 30
    merge_window: int = 3
    search_pre: int = 2
    search_post: int = 1
    search_half_width: int = 2
    severity_step: float = 0.05
    precedence: tuple[str, ...] = ("drawdown", "rally", "shock", "gap")
    detector_version: int = 1
    # macro calendar
    calendar_start: str = "1993-01-01"
    first_release_by: str = "1993-02-28"
    calendar_horizon_days: int = 800
    policy_release: str = "FOMC"
    policy_per_year: tuple[int, int] = (7, 8)
    monthly_releases: tuple[str, ...] = ("CPI", "payrolls")
    monthly_per_year: tuple[int, int] = (10, 13)
    double_months: tuple[tuple[str, str], ...] = (("CPI", "1996-02"),)
    # enrichment
    confidence_threshold: float = 0.5
    headline_max: int = 90
    prompt_version: str = "v1"
    search_usd_per_1k: float = 10.0
    budget_usd: float = 25.0
    reserve_usd: float = 0.25
    max_failures: int = 5
    strict_ids: bool = True
    max_searches: int = 3
    max_continuations: int = 3


SETTINGS = Settings()
