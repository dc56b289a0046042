"""Thresholds of every operator, in one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerlens import fixed_values as fv


@dataclass(frozen=True)
class LedgerConfig:
    # cleaning
    known_statuses: tuple[str, ...] = fv.STATUS_TOKENS
    iqr_multiplier: float = 3.0
    iqr_min_values: int = 10
    # data quality
    gap_days: int = 14
    valid_pct_pass: float = 97.0
    valid_pct_review: float = 90.0
    completeness_pass: float = 85.0
    completeness_review: float = 65.0
    major_months_allowed: int = 0
    # reconciliation, percent
    match_pct: float = 0.5
    minor_pct: float = 3.0
    major_pct: float = 10.0
    # anomalies
    z_low: float = 2.0
    z_medium: float = 3.0
    z_high: float = 4.0
    z_critical: float = 6.0
    min_observations: int = 14
    rolling_window: int = 7
    mad_floor: float = 0.10
    forest_trees: int = 200
    forest_sample: int = 256
    forest_min_rows: int = 30
    contamination: float = 0.03
    seed: int = 42
    # change points
    change_min_observations: int = 30
    change_penalty: float = 5.0
    change_min_size: int = 5
    change_jump: int = 5
    # health
    health_weights: dict = field(default_factory=lambda: dict(fv.HEALTH_WEIGHTS))
    health_min_observations: int = 10
    repeated_critical: int = 3
    trend_cap_pct: float = 50.0
    # segmentation
    segment_min_observations: int = 14
    segment_min_units: int = 4
    segment_max_k: int = 6
    intermittent_ratio: float = 0.15
    growth_pct: float = 20.0
    segment_starts: int = 10
    # forecasting
    wape_healthy: float = 10.0
    wape_monitor: float = 15.0
    rolling_windows: tuple[int, ...] = (7, 14, 30)
    reliable_horizon: int = 180
    warn_horizon: int = 60
    climatology_days: int = 7
    backtest_days: int = 60
    tree_bins: int = 255
    boosting_leaf_rows: int = 20
    series_bins: int = 64
    training_cutoff: str = "2025-12-31"
    # scenarios
    price_per_unit: float = 6800.0
    saving_target_pct: float = 13.44
    moderate_fraction: float = 0.5
    current_per_throughput: float = 3.05
    target_per_throughput: float = 2.64
    target_throughput: float = 2_241_000.0
    # recommendations
    low_completeness_pct: float = 50.0
    high_anomaly_count: int = 5
    median_excess_ratio: float = 1.5


DEFAULT = LedgerConfig()
