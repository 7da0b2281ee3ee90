"""Immutable configuration of the feature preparation."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class FeatureConfig:
    """How features are imputed, scaled, selected and reduced."""

    numeric_impute: str = "median"
    scaler: str = "standard"
    selector: str = "mutual_info"
    k_best: int = 10
    mi_bins: int = 4
    n_components: int = 4
    out_range: tuple[float, float] = (0.0, math.pi)
    test_size: float = 0.2
    seed: int = 42

    def __post_init__(self) -> None:
        if self.numeric_impute not in ("median", "mean"):
            raise ValueError(f"unknown numeric_impute {self.numeric_impute!r}")
        if self.scaler not in ("standard", "minmax", "robust"):
            raise ValueError(f"unknown scaler {self.scaler!r}")
        if self.selector not in ("mutual_info", "f_classif"):
            raise ValueError(f"unknown selector {self.selector!r}")
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must lie in (0, 1)")
        if self.k_best < 1 or self.n_components < 1:
            raise ValueError("k_best and n_components must be positive")
        if self.out_range[0] >= self.out_range[1]:
            raise ValueError("out_range must increase")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, path: str) -> "FeatureConfig":
        with open(path, encoding="utf-8") as fh:
            raw = json.load(fh)
        if "out_range" in raw:
            raw["out_range"] = tuple(raw["out_range"])
        return cls(**raw)
