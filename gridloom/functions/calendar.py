"""Calendar, tariff, season and temperature-band expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.settings import PEAK_HOURS

# Upper limits of the temperature bands.
TEMPERATURE_BANDS = ((5, "Very Cold"), (15, "Cold"), (25, "Mild"), (32, "Warm"))
HOTTEST_BAND = "Hot"


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def weekend_flag(when: Column) -> Column:
    return flag(F.dayofweek(when).isin(1, 7))


def peak_hour_flag(when: Column) -> Column:
    return flag(F.hour(when).isin(*PEAK_HOURS))


def season(month: Column) -> Column:
    """December to February is Winter, then three months each."""
    quarter = F.floor(F.pmod(month, F.lit(12)) / F.lit(3))
    return (
        F.when(quarter == 0, "Winter").when(quarter == 1, "Spring").when(quarter == 2, "Summer").otherwise("Autumn")
    )


def temperature_band(temperature: Column) -> Column:
    """A missing temperature ends in the last band, like any value above every limit."""
    (limit, label), *others = TEMPERATURE_BANDS
    band = F.when(temperature < limit, label)
    for limit, label in others:
        band = band.when(temperature < limit, label)
    return band.otherwise(HOTTEST_BAND)


def tariff_period(peak: Column) -> Column:
    return F.when(peak == 1, "peak").otherwise("off_peak")
