"""Settings of the price analytics, as frozen values."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from types import MappingProxyType as Fixed

from harvestry.errors import ConfigError

# Thresholds, factors and fees.
HORIZONS = (1, 3, 7, 15)
QUANTILES = Fixed({"p10": 0.10, "p50": 0.50, "p90": 0.90})
GRADE_FACTOR = Fixed({"A": 1.10, "B": 1.00, "C": 0.86})
STORAGE_FACTOR = Fixed({"ambient": 1.0, "shed": 0.7, "cold_store": 0.25})
STORAGE_COST = Fixed({"ambient": 0.0, "shed": 0.6, "cold_store": 3.5})
RISK_LAMBDA = Fixed({"cautious": 0.8, "balanced": 0.45, "aggressive": 0.2})
STATE_FEES = Fixed({"Maharashtra": (3.0, 1.05, 0.3), "_default": (2.5, 1.5, 0.5)})  # commission, cess, other
PRICE_UNITS = Fixed({"rupees_per_quintal": 1.0, "rupees_per_kg": 100.0})
ARRIVAL_UNITS = Fixed({"quintal": 1.0, "tonne": 10.0, "kg": 0.01})
HARVEST_WINDOWS = (("kharif", "10-01", "12-15"), ("rabi", "03-01", "05-15"))


@dataclass(frozen=True)
class Cleaning:
    min_modal_price: float = 10
    absurd_multiple: float = 20
    trailing_window: int = 90
    least_history: int = 10
    suspect_zscore: float = 6.0
    suspect_window: int = 30
    max_impute_gap: int = 3


@dataclass(frozen=True)
class Features:
    min_observations: int = 60
    lookback_days: int = 400
    neighbour_k: int = 4
    neighbour_staleness_days: int = 7
    elasticity_window: int = 60
    momentum_window: int = 7
    festival_horizon_days: int = 60
    liquidity_window_days: int = 90
    unseasonal_rain_mm: float = 25
    monsoon_months: tuple[int, ...] = (6, 7, 8, 9)
    label_tolerance_days: int = 2


@dataclass(frozen=True)
class Costs:
    hamali: float = 12
    weighing: float = 3
    packing: float = 8
    truck_qtl: float = 90
    per_km: float = 42
    interest: float = 0.14
    spoilage_rate: float = 0.006


@dataclass(frozen=True)
class Decision:
    sell_fractions: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)
    hold_days: tuple[int, ...] = (3, 7, 15)
    max_hold_days: int = 20
    max_spoilage: float = 0.15
    wide_band: float = 0.35
    viable_load: float = 0.25
    near_km: float = 40
    floor_fraction: float = 0.5
    shock_magnitude: int = 3
    shock_days: int = 3
    weights: tuple[float, float, float] = (0.5, 0.2, 0.3)
    band_scale: float = 0.30


@dataclass(frozen=True)
class Audit:
    usable: tuple[int, float] = (500, 0.60)
    thin: tuple[int, float] = (200, 0.35)


@dataclass(frozen=True)
class Resolving:
    auto: float = 95
    review: float = 90
    prefix_chars: int = 4


@dataclass(frozen=True)
class Settings:
    cleaning: Cleaning = field(default_factory=Cleaning)
    features: Features = field(default_factory=Features)
    costs: Costs = field(default_factory=Costs)
    decision: Decision = field(default_factory=Decision)
    audit: Audit = field(default_factory=Audit)
    resolving: Resolving = field(default_factory=Resolving)


SETTINGS = Settings()


def _like(value, default, name: str):
    """A setting's value in the type of its default."""
    if isinstance(default, tuple) and isinstance(value, (list, tuple)) and (not default or all(isinstance(v, (int, float)) for v in value)):
        return tuple(value)
    if isinstance(default, (int, float)) and isinstance(value, (int, float)) and not isinstance(value, bool) and (isinstance(default, float) or value == int(value)):
        return type(default)(value)
    raise ConfigError(f"{name}: {value!r} isn't a value like {default!r}")


def load(folder: str | None = None, environ: Mapping[str, str] = os.environ, prefix: str = "HARVESTRY") -> Settings:
    """The settings with those of folder/SECTION.yaml, then those of variables like HARVESTRY_COSTS__PER_KM, in place of the defaults.

    A file or variable may leave settings out. Raises ConfigError for a section or setting that there isn't, and for
    values of another kind than the default.
    """
    import yaml  # only who loads files needs it

    found: dict[str, dict] = {}
    sections = {f.name: f for f in fields(Settings)}
    for path in sorted(Path(folder).glob("*.yaml")) if folder else []:
        try:
            values = yaml.safe_load(path.read_text())
        except yaml.YAMLError as e:
            raise ConfigError(f"{path} can't be read: {e}") from e
        if not isinstance(values, dict):
            raise ConfigError(f"{path} must map settings to values")
        found.setdefault(path.stem, {}).update(values)
    for name, text in sorted(environ.items()):
        section, _, setting = name.removeprefix(f"{prefix}_").lower().partition("__")
        if name.startswith(f"{prefix}_") and setting:
            found.setdefault(section, {})[setting] = yaml.safe_load(text)
    changed = {}
    for section, values in found.items():
        if section not in sections:
            raise ConfigError(f"there is no section {section!r}")
        now = getattr(SETTINGS, section)
        names = {f.name for f in fields(now)}
        for setting in values:
            if setting not in names:
                raise ConfigError(f"there is no setting {section}.{setting}")
        changed[section] = replace(now, **{k: _like(v, getattr(now, k), f"{section}.{k}") for k, v in values.items()})
    return replace(SETTINGS, **changed)
