"""Fixed values of the drift policy and the risk index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DriftLimits:
    """PSI above ``low`` is moderate drift, above ``high`` severe drift (both strict)."""

    low: float
    high: float


# The two limit presets, for raw and for preprocessed features.
RAW_LIMITS = DriftLimits(low=0.1, high=0.25)
PROCESSED_LIMITS = DriftLimits(low=0.1, high=0.2)

# Risk index.
DRIFT_WEIGHT = 0.65
CONFIDENCE_WEIGHT = 0.35
LEVEL_SCORES = {"low": 0.2, "medium": 0.6, "high": 1.0}

# Share-based drift level.
SEVERE_SHARE_HIGH = 0.3
SEVERE_SHARE_MEDIUM = 0.1
MODERATE_SHARE_MEDIUM = 0.3

# Defaults.
SEED = 42
PSI_BINS = 10
PSI_EPSILON = 1e-8
HISTORY_LIMIT = 20
TEST_SIZE = 0.2
FOLDS = 5
BACKGROUND_ROWS = 100
CONFIDENCE_ROWS = 50
