"""Frozen parameters; every operator takes them as arguments, these are the usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    panel_start: str = "2021-01-01"
    train_end: str = "2024-01-01"
    val_end: str = "2025-01-01"
    test_end: str = "2026-01-01"
    min_test_hours: int = 2000
    holdout_m: float = 150.0
    zero_run_hours: int = 48
    speed_kmh: float = 16.0
    match_m: float = 15.0
    match_share: float = 0.6
    sample_m: float = 10.0
    seed: int = 20260930
    base: int = 2012
    target: int = 2024
    min_days: int = 250
    draws: int = 1000
    step_flag: float = 1.25
    revert: float = 1.15
    threshold: float = 1.8
    stable_first: int = 2017
    stable_last: int = 2025
    site_min_days: int = 120
    jump_min_days: int = 150
    swap_days: int = 120
    swap_least: int = 30
    knn: int = 5
    knn_tau_s: float = 300.0
    window_hours: int = 48
    junctions: int = 80
    junction_m: float = 400.0
    routes: int = 10
    betweenness_samples: int = 400
    cutoff_s: float = 900.0


DEFAULT = Settings()
