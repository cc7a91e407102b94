"""Settings of a scoring run."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .plans.align import SEQ, TIME, DataValidationError


@dataclass(frozen=True)
class Config:
    """Columns and parameters; an instance is passed along and never changed."""

    sequence_key: str = SEQ
    time_key: str = TIME
    neuro_cols: tuple[str, ...] | None = None
    behavior_parts: tuple[str, ...] | None = None
    center_part: str = "CENTER"
    body_axis: tuple[str, str] = ("NOSE", "TAIL_BASE")
    STATIONARY_THRESHOLD_PERCENTILE: float = 10
    LEAD_LAG_DEFAULT_MAX_LAG: int = 30
    AUTOCORR_MAX_LAG: int = 48
    WELCH_NPERSEG: int = 256
    MI_N_NEIGHBORS: int = 5
    #: Rows of a series, and of all series, that information is estimated from;
    #: null takes all rows.
    MAX_TIME_STEPS_SUBSAMPLE: int | None = 1200
    MI_MAX_POINTS: int | None = 1500
    PCA_VARIANCE_THRESHOLD: float = 0.85
    KMEANS_K_TRAJECTORY: int = 6
    KMEANS_K_SYLLABLE: int = 8

    def updated(self, values: dict) -> Config:
        """With the known names of ``values``; unknown ones are ignored."""
        known = {f.name for f in fields(self)}
        fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
        return replace(self, **fixed)


def load_config(path: str | None) -> Config:
    """From a JSON object in a file; without a path the defaults."""
    if path is None:
        return Config()
    try:
        values = json.loads(Path(path).read_text())
    except json.JSONDecodeError as e:
        raise DataValidationError(f"{path} is not JSON: {e}") from e
    if not isinstance(values, dict):
        raise DataValidationError(f"{path} must hold a JSON object")
    return Config().updated(values)


def parts_of(columns: list[str]) -> list[str]:
    """Body parts: columns ending in _X with a partner in _Y."""
    return [c[:-2] for c in columns if c.endswith("_X") and f"{c[:-2]}_Y" in columns]
