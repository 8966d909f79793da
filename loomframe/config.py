"""Settings as frozen dataclasses, from YAML and from LOOM_<GROUP>__<FIELD> environment variables."""

from __future__ import annotations

import dataclasses
import datetime
import os
from dataclasses import dataclass, field

import yaml


@dataclass(frozen=True)
class Data:
    # The defaults of the first and last day, the liquidity floors, the sources and the macro series.
    start_date: datetime.date = datetime.date(2000, 1, 1)
    end_date: datetime.date = datetime.date(2025, 12, 31)
    universe_update: str = "quarterly"
    min_price: float = 5.0
    min_dollar_volume: float = 1_000_000.0
    primary_source: str = "yfinance"
    fallback_source: str = "alpha_vantage"
    macro_tickers: tuple[str, ...] = ("^GSPC", "^IXIC", "^RUT", "^VIX", "^TNX", "^MOVE", "DX-Y.NYB", "GLD", "USO", "TLT")


@dataclass(frozen=True)
class Features:
    return_windows: tuple[int, ...] = (5, 10, 21, 63, 126, 252)
    vol_windows: tuple[int, ...] = (63, 252)
    fracdiff_d: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5)
    fracdiff_threshold: float = 1e-5


@dataclass(frozen=True)
class Labels:
    horizon_days: int = 10
    barrier_width: float = 1.5
    vol_lookback: int = 20
    min_return: float = 0.005


@dataclass(frozen=True)
class Validation:
    purge_days: int = 63
    val_days: int = 252
    test_days: int = 252
    roll_days: int = 252


@dataclass(frozen=True)
class Costs:
    trading_bps: float = 7.5
    spread_bps: float = 2.0
    impact_kappa: float = 0.1
    max_position_adv_share: float = 0.05
    capital: float = 10_000_000.0


@dataclass(frozen=True)
class Models:
    """Settings of the two stages' classifiers; those of networks have no user here."""

    kind: str = "logistic"
    stage_one_threshold: float = 0.65
    least_events: int = 100
    lasso_features: int = 40
    lasso_alpha: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class Inference:
    run_time: str = "16:30"
    output_dir: str = "signals"
    ic_floor: float = 0.03
    alert_days: int = 3


@dataclass(frozen=True)
class Settings:
    data: Data = field(default_factory=Data)
    features: Features = field(default_factory=Features)
    labels: Labels = field(default_factory=Labels)
    validation: Validation = field(default_factory=Validation)
    costs: Costs = field(default_factory=Costs)
    models: Models = field(default_factory=Models)
    inference: Inference = field(default_factory=Inference)

    @classmethod
    def from_dict(cls, given: dict) -> Settings:
        """Defaults, then the given values, then the environment. An explicit 0 counts; unknown names are errors."""
        groups = {}
        for f in dataclasses.fields(cls):
            kind = type(f.default_factory())
            own = dict((given or {}).get(f.name) or {})
            for x in dataclasses.fields(kind):
                if (env := os.environ.get(f"LOOM_{f.name}__{x.name}".upper())) is not None:
                    own[x.name] = yaml.safe_load(env)
            groups[f.name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
        unknown = set(given or {}) - set(groups)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**groups)

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f))

    def to_yaml(self, path: str) -> None:
        plain = {k: {n: list(v) if isinstance(v, tuple) else v for n, v in g.items()} for k, g in dataclasses.asdict(self).items()}
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(plain, f, sort_keys=False)
