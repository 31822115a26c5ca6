"""Engine parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of the recommendation framework.
IQR_FACTOR = 1.5
ACTIVITY_LAGS = (24, 48, 72)
USAGE_LAGS = (1, 2, 3)
PROFILE_HOURS = 24
PRICE_HOURS = 48
GRID_THRESHOLDS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
IMPUTE_NEIGHBOURS = 7
WEATHER_COLUMNS = ("temp", "dwpt", "rhum", "wdir", "wspd")
WEATHER_LABELS = {
    "dwpt": "dewing point",
    "rhum": "relative humidity",
    "temp": "temperature",
    "wdir": "wind direction",
    "wspd": "windspeed",
}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
# The first level in alphabetical order is the base level of a dummy coding.
WEEKDAY_DUMMIES = ("Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday")


@dataclass(frozen=True)
class EngineConfig:
    """Settings shared by all households; per-household thresholds come as a table."""

    shiftable_devices: tuple[str, ...] = ("Tumble Dryer", "Washing Machine", "Dishwasher")
    active_appliances: tuple[str, ...] = (
        "Tumble Dryer", "Washing Machine", "Dishwasher",
        "Toaster", "Television", "Microwave", "Kettle",
    )
    activity_threshold: float = 0.01
    device_threshold: float = 0.01
    load_threshold: float | None = None  # None: same as device_threshold
    factor: float = IQR_FACTOR
    fill: str = "null"
    activity_lags: tuple[int, ...] = ACTIVITY_LAGS
    usage_lags: tuple[int, ...] = USAGE_LAGS
