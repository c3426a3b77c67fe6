"""Tunable thresholds, one frozen dataclass per area."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Measurement:
    sentinels: tuple[float, ...] = (-127.0, -3276.0, 999.0)
    low: float = -40.0
    high: float = 150.0


@dataclass(frozen=True)
class Labelling:
    horizon_hours: int = 24
    sweep_min_channels: int = 20
    sweep_min_share: float = 0.5
    # periods and days taken out of the grid: (first day, last day)
    artifact_periods: tuple[tuple[str, str], ...] = (("2021-04-30", "2021-06-07"),)
    blackout_days: tuple[str, ...] = (
        "2024-04-06", "2024-04-07", "2024-04-08", "2024-04-09", "2026-06-01")

    @property
    def horizon_days(self) -> int:
        return max(1, self.horizon_hours // 24)


@dataclass(frozen=True)
class Modelling:
    train_from: str = "2022-01-01"
    train_to: str = "2024-12-31"
    test_from: str = "2025-01-01"
    test_to: str = "2026-06-30"
    negatives_per_positive: int = 100
    trees: int = 300
    depth: int = 12
    min_leaf: int = 20
    seed: int = 42
    missing: float = -1.0
    target_precision: float = 0.70
    target_recall: float = 0.50
    test_days: float = 547.0


@dataclass(frozen=True)
class Pumping:
    z_threshold: float = 3.0
    min_starts: int = 10
    min_excess: int = 5
    min_ratio: float = 1.5
    min_days: int = 5
    network_hot_min: int = 10
    radius: int = 30


@dataclass(frozen=True)
class Smoke:
    sweep_share: float = 0.5
    sweep_min_pickets: int = 3
    heat_celsius: float = 40.0
    window_minutes: int = 30


@dataclass(frozen=True)
class Guarding:
    stuck_share: float = 0.98
    stuck_min_switches: int = 200
    night_from: int = 0
    night_to: int = 5
    max_triggers: int = 200
    max_hours: float = 4.0
    min_score: float = 0.3


@dataclass(frozen=True)
class Thermal:
    freeze: float = 3.0
    freeze_warning: float = 6.0
    below_norm: float = 5.0
    neighbour_gap: float = 4.0
    min_days: int = 5
    search_pickets: int = 10


@dataclass(frozen=True)
class Cards:
    failure_limit: int = 100
    pump_limit: int = 50
    fire_limit: int = 20
    intrusion_limit: int = 20
    evidence: int = 4
    series_days: int = 90
    cascade_seconds: int = 120
    cascade_points: int = 4
    cascade_pickets: int = 2
    page_size: int = 500
    picket_meters: int = 10


@dataclass(frozen=True)
class Settings:
    measurement: Measurement = field(default_factory=Measurement)
    labelling: Labelling = field(default_factory=Labelling)
    modelling: Modelling = field(default_factory=Modelling)
    pumping: Pumping = field(default_factory=Pumping)
    smoke: Smoke = field(default_factory=Smoke)
    guarding: Guarding = field(default_factory=Guarding)
    thermal: Thermal = field(default_factory=Thermal)
    cards: Cards = field(default_factory=Cards)
