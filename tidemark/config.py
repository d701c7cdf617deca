"""Settings of collection and studies: defaults, a TOML file over them, its template and checks."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from tidemark.operators.evaluate import fnv1a64

# ---- fixed values: names and defaults of the settings, as existing settings files have them


@dataclass
class Candidate:
    imbalance_thresholds: list[float] = field(default_factory=lambda: [0.25, 0.4])
    large_trade_multiples: list[float] = field(default_factory=lambda: [3.0, 5.0])
    trade_rate_multiples: list[float] = field(default_factory=lambda: [2.0, 3.0])


@dataclass
class Validation:
    tuning_days: int = 14
    validation_days: int = 14
    min_validation_signals: int = 50
    horizon_minutes: int = 15
    entry_max_lag_seconds: int = 60
    hit_threshold_pct: float = 0.3
    family_wise_correction: bool = True
    bootstrap_iterations: int = 10_000
    bootstrap_seed: int = 7


@dataclass
class Alert:
    cooldown_seconds: int = 900


@dataclass
class Paper:
    fee_bps: float = 5.0
    slippage_bps: float = 3.0


@dataclass
class Config:
    version: int = 1
    data_root: str = "./data"
    top_market_count: int = 20
    daily_refresh_utc_hour: int = 0
    stall_timeout_seconds: int = 90
    flush_interval_seconds: int = 300
    imbalance_window_seconds: int = 60
    trade_rate_window_seconds: int = 60
    wall_min_krw: float = 10_000_000.0
    candidate: Candidate = field(default_factory=Candidate)
    validation: Validation = field(default_factory=Validation)
    alert: Alert = field(default_factory=Alert)
    paper: Paper = field(default_factory=Paper)

    @property
    def round_trip_pct(self) -> float:
        """Fees and slippage of entry and exit, in percent."""
        return 2 * (self.paper.fee_bps + self.paper.slippage_bps) / 100

    def check(self) -> Config:
        positive = {"stall_timeout_seconds": self.stall_timeout_seconds, "flush_interval_seconds": self.flush_interval_seconds}
        least_zero = {"entry_max_lag_seconds": self.validation.entry_max_lag_seconds, "alert.cooldown_seconds": self.alert.cooldown_seconds}
        for name, value in positive.items():
            if value <= 0:
                raise ValueError(f"{name} must be greater than zero")
        for name, value in least_zero.items():
            if value < 0:
                raise ValueError(f"{name} must be non-negative")
        return self

    def fingerprint(self) -> str:
        """Changes with any setting but those of alerts: a ruleset is good only for the settings it was
        found with."""
        found = {k: v for k, v in asdict(self).items() if k != "alert"}
        return f"fnv1a64:{fnv1a64(json.dumps(found, sort_keys=True)):016x}"


def _fill(kind: type, given: dict):
    known = {f.name: f for f in fields(kind)}
    for name in given:
        if name not in known:
            raise ValueError(f"unknown setting {name}")
    blank = kind()
    return kind(**{k: _fill(type(getattr(blank, k)), v) if is_dataclass(getattr(blank, k)) else v for k, v in given.items()})


def load(path: str | None = None) -> Config:
    """Settings of a TOML file; what it leaves out, or a missing file, has the defaults."""
    if path is None or not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        return _fill(Config, tomllib.load(f))


def template() -> str:
    """The defaults as TOML."""
    lines, tables = [], []
    for name, value in asdict(Config()).items():
        if isinstance(value, dict):
            tables += ["", f"[{name}]", *(f"{k} = {json.dumps(v)}" for k, v in value.items())]
        else:
            lines.append(f"{name} = {json.dumps(value)}")
    return "\n".join(lines + tables) + "\n"
