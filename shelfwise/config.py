"""Thresholds and windows, with the defaults the pipeline runs on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # signals
    undercut_pct: float = 5.0
    overpriced_pct: float = 5.0
    increase_24h_pct: float = 10.0
    movement_pct: float = 10.0
    settle_minutes: int = 10
    # event-time windows
    window: str = "5 minutes"
    price_watermark: str = "10 minutes"
    behavior_watermark: str = "5 minutes"
    signal_watermark: str = "5 minutes"
    # elasticity
    rollup_minutes: int = 60
    elasticity_hours: int = 72
    elasticity_newest: int | None = None
    elasticity_min_obs: int = 20
    high_sensitivity: float = -1.0
    medium_sensitivity: float = -0.3
    # forecast
    forecast_days: int = 14
    forecast_min_rows: int = 8
    mae_limit: float = 0.5
    confidence_floor: float = 0.2
    # proposals
    price_grid_pct: float = 0.05
    grid_points: int = 11
    min_margin_pct: float = 0.05
    target_undercut_pct: float = 0.01
    gap_tolerance_pct: float = 0.003
    demand_minutes: int = 60
    ema_halflife_rows: int = 60
    guard_minutes: int = 720
    guard_rows: int = 100
    proposer: str = "price-proposer"
    applier: str = "price-applier"
    # freshness limits in minutes
    fresh_signals: int = 10
    fresh_trends: int = 20
    fresh_summary: int = 30


DEFAULTS = Settings()
