"""Parameters of every stage, with the defaults the published data sets were made with."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# File formats, id pattern, bounds and model settings results depend on.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
SOURCE_SYSTEM = "smart_meter_csv"
METER_ID_PATTERN = r"^MTR-\d{3}$"
PHYSICAL_BOUNDS = {
    "energy_consumption": (0.0, 100.0),
    "voltage": (180.0, 270.0),
    "current": (0.0, 100.0),
    "power_factor": (0.5, 1.0),
}
IMPUTED_COLUMNS = (
    "energy_consumption",
    "voltage",
    "current",
    "power_factor",
    "temperature",
    "humidity",
)
PEAK_HOURS = (7, 8, 9, 10, 17, 18, 19, 20, 21)
SEASONS = ("Winter", "Spring", "Summer", "Autumn")
LAGS = (1, 2, 3, 24)
ROLLING_WINDOWS = (3, 24)
TEST_SIZE = 0.2
SEED = 42
ZSCORE_THRESHOLD = 3.0
MAD_SCALE = 1.4826
CONTAMINATION = 0.01
MODEL_VERSION = "1.0.0"
MAX_READ_LIMIT = 5000


@dataclass(frozen=True)
class Settings:
    """One immutable bundle handed to the operators."""

    meter_id_pattern: str = METER_ID_PATTERN
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(PHYSICAL_BOUNDS))
    imputed: tuple[str, ...] = IMPUTED_COLUMNS
    lags: tuple[int, ...] = LAGS
    rolling_windows: tuple[int, ...] = ROLLING_WINDOWS
    test_size: float = TEST_SIZE
    seed: int = SEED
    zscore_threshold: float = ZSCORE_THRESHOLD
    contamination: float = CONTAMINATION
    model_version: str = MODEL_VERSION


DEFAULTS = Settings()
