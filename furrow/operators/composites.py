"""Monthly, weekly and seasonal composites of pixel observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import (
    MONTHS, S2_BANDS, SEASON_TOTAL_MONTHS, SEASONAL_WINDOWS, WEATHER_MONTHS, WEATHER_VARIABLES, weather_columns,
)
from furrow.functions import indices


def add_calendar(obs: DataFrame, ts: str = "ts") -> DataFrame:
    return obs.withColumns({"year": F.year(ts), "month": F.month(ts)})


def monthly_median(obs: DataFrame, keys: list[str], bands: list[str], *,
                   max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Median of unmasked observations per key, year and month."""
    return scale.group_quantiles(obs, keys + ["year", "month"], {b: (F.col(b), 0.5) for b in bands},
                                 max_group=max_group)


def monthly_s2(obs: DataFrame, keys: list[str], bands: list[str] = S2_BANDS, **options) -> DataFrame:
    """Optical composite: medians first, then indices of the medians."""
    medians = monthly_median(obs, keys, bands, **options)
    return medians.withColumns(indices.composite_indices({b: F.col(b) for b in bands}))


def monthly_s1(obs: DataFrame, keys: list[str], **options) -> DataFrame:
    medians = monthly_median(obs, keys, ["VV", "VH"], **options)
    return medians.withColumn("VV_minus_VH", indices.radar_difference(F.col("VV"), F.col("VH")))


def monthly_sum(obs: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return obs.groupBy(*keys, "year", "month").agg(F.sum(value).alias(name))


def stack_composites(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Composites of one pixel-month side by side; a missing sensor leaves NULLs.

    Parts are stacked as rows and folded in one aggregate, so any number of
    sensors costs one shuffle instead of a chain of outer joins.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    keys = keys + ["year", "month"]
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])


def months_wide(df: DataFrame, keys: list[str], values: dict[str, Column],
                months: dict[int, str] = MONTHS, prefix: str = "") -> DataFrame:
    """One row per key with <name>_<month> columns; months are listed, so none goes missing."""
    return df.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("month") == number, value)).alias(f"{prefix}{name}_{label}")
        for number, label in months.items() for name, value in values.items()])


def weather_months(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly weather of daily rows: rain, temperatures, degree days above 5 °C, soil water.

    Input columns: date parts plus precip_m, t_k, tmax_k, tmin_k, soil_water.
    """
    return daily.groupBy(*keys, "year", "month").agg(
        F.sum(indices.metres_to_mm(F.col("precip_m"))).alias("precip"),
        F.avg(indices.kelvin_to_celsius(F.col("t_k"))).alias("tmean"),
        F.avg(indices.kelvin_to_celsius(F.col("tmax_k"))).alias("tmax"),
        F.sum(indices.growing_degrees(F.col("tmax_k"), F.col("tmin_k"))).alias("gdd5"),
        F.avg("soil_water").alias("soilwater"))


def weather_wide(monthly: DataFrame, keys: list[str]) -> DataFrame:
    wide = months_wide(monthly, keys + ["year"], {v: F.col(v) for v in WEATHER_VARIABLES},
                       WEATHER_MONTHS, prefix="w_")
    return wide.select(*keys, "year", *weather_columns())


def season_weather_totals(df: DataFrame) -> DataFrame:
    """May–August rain and degree days, NULL unless all four months are present."""
    totals = {}
    for variable in ("precip", "gdd5"):
        value = F.lit(0.0)
        for month in SEASON_TOTAL_MONTHS:
            value = value + F.col(f"w_{variable}_{month}")
        totals[f"w_{variable}_may_aug"] = value
    return df.withColumns(totals)


def seasonal_window(ts: Column) -> Column:
    """Name of the seasonal window holding a date, or NULL; both end days count."""
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    name = F.lit(None).cast("string")
    for label, m1, d1, m2, d2 in SEASONAL_WINDOWS:
        name = F.when(day.between(m1 * 100 + d1, m2 * 100 + d2), label).otherwise(name)
    return name


def parcel_years(parcels: DataFrame, years: list[int]) -> DataFrame:
    """Every parcel with every year, by exploding a literal list rather than a join."""
    return parcels.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))


def weekly_means(obs: DataFrame, keys: list[str], bands: list[str], week: Column) -> DataFrame:
    return obs.groupBy(*keys, week.alias("week")).agg(*[F.avg(b).alias(b) for b in bands])


def weekly_wide(weekly: DataFrame, keys: list[str], bands: list[str], weeks: int) -> DataFrame:
    """Weekly band means and indices as <name>_wNN columns."""
    rows = weekly.withColumns(indices.weekly_indices({b: F.col(b) for b in bands}))
    names = bands + list(indices.weekly_indices({b: F.col(b) for b in bands}))
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("week") == w, F.col(n))).alias(f"{n.lower()}_w{w:02d}")
        for w in range(1, weeks + 1) for n in names])
