"""Row-wise season shapes: monthly deltas, extremes, weekly summaries and seasonal signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.columns import CLASSIFIER_IDS, INFERRED_CROP_ORDER, INVENTORY_CLASS_NAMES, MONTHS
from furrow.functions.scalars import parse_float, parse_int


def present(values: list[Column]) -> Column:
    """The non-NULL values of several columns as an array."""
    return F.array_compact(F.array(*values))


def array_mean(values: Column) -> Column:
    """Mean of an array without NULLs; NULL when it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def array_median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def row_max(values: list[Column]) -> Column:
    return F.array_max(F.array(*values))


def row_min(values: list[Column]) -> Column:
    return F.array_min(F.array(*values))


def row_mean(values: list[Column]) -> Column:
    return array_mean(present(values))


def monthly_groups(columns: list[str], months: list[str] | None = None,
                   exclude: list[str] = CLASSIFIER_IDS) -> dict[str, list[str]]:
    """Columns named <base>_<month>, grouped by base in calendar order."""
    calendar = [m for m in MONTHS.values() if months is None or m in months]
    bases: dict[str, set[str]] = {}
    for column in columns:
        base, _, month = column.rpartition("_")
        if base and month in calendar and column not in exclude:
            bases.setdefault(base, set()).add(month)
    return {base: [f"{base}_{m}" for m in calendar if m in found] for base, found in bases.items()}


def add_season_shape(df: DataFrame, months: list[str] | None = None,
                     exclude: list[str] = CLASSIFIER_IDS) -> DataFrame:
    """Month-to-month deltas and season max, min and range for bases with two or more months."""
    added = {}
    for base, ordered in monthly_groups(df.columns, months, exclude).items():
        if len(ordered) < 2:
            continue
        for earlier, later in zip(ordered, ordered[1:]):
            span = f"{earlier.rpartition('_')[2]}_{later.rpartition('_')[2]}"
            added[f"{base}_delta_{span}"] = F.col(later) - F.col(earlier)
        values = [F.col(c) for c in ordered]
        added[f"{base}_season_max"] = row_max(values)
        added[f"{base}_season_min"] = row_min(values)
        added[f"{base}_season_range"] = row_max(values) - row_min(values)
    return df.select("*", *[expr.alias(name) for name, expr in added.items()])


def weekly_summary(base: str, weeks: list[Column]) -> dict[str, Column]:
    """Ten season summaries of weekly values; NULL weeks are skipped, all-NULL gives NULL."""
    n = len(weeks)
    early, mid, late = weeks[:max(1, n // 3)], weeks[n // 3:2 * n // 3], weeks[2 * n // 3:]
    peak = row_max(weeks)
    means = {name: (row_mean(part) if part else F.lit(None).cast("double"))
             for name, part in (("early", early), ("mid", mid), ("late", late))}
    return {
        f"{base}_mean": row_mean(weeks), f"{base}_max": peak, f"{base}_min": row_min(weeks),
        f"{base}_amplitude": peak - row_min(weeks),
        f"{base}_peak_week": F.nullif(F.array_position(F.array(*weeks), peak), F.lit(0).cast("bigint")),
        f"{base}_early_mean": means["early"], f"{base}_mid_mean": means["mid"],
        f"{base}_late_mean": means["late"], f"{base}_greenup_delta": means["mid"] - means["early"],
        f"{base}_senescence_delta": means["late"] - means["mid"]}


def monthly_row_stats(df: DataFrame, prefix: str = "ndvi_m", integral: str = "ndvi_integral") -> DataFrame:
    """Row-wise NDVI max, min, median over monthly columns, plus the exported integral."""
    monthly = sorted(c for c in df.columns if c.startswith(prefix))
    if not monthly:
        raise ValueError(f"Expected monthly columns like {prefix}04.")
    values = [F.col(c) for c in monthly]
    return df.withColumns({
        "NDVI_max": row_max(values), "NDVI_min": row_min(values),
        "NDVI_median": array_median(present(values)), "NDVI_integral_proxy": F.col(integral)})


def infer_crop(fractions: list[tuple[str, Column]], threshold: float = 0.6) -> Column:
    """The crop with the largest fraction, the first on ties; NULL below the threshold."""
    values = F.array(*[F.coalesce(value, F.lit(0.0)) for _, value in fractions])
    best = F.array_max(values)
    name = F.get(F.array(*[F.lit(crop) for crop, _ in fractions]),
                 (F.array_position(values, best) - 1).cast("int"))
    raw_best = F.get(F.array(*[value for _, value in fractions]),
                     (F.array_position(values, best) - 1).cast("int"))
    return F.when(raw_best >= threshold, name)


def seasonal_signals(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per parcel-year with an inferred crop and its seasonal signals."""
    windows = ["may_jun", "late_jun_jul", "aug", "sep"]

    def across(suffix: str) -> list[Column]:
        return [parse_float(F.col(f"{w}_{suffix}")) for w in windows]

    dominant = parse_int(F.col("aafc_dominant_class"))
    names = F.create_map(*[F.lit(v) for pair in INVENTORY_CLASS_NAMES.items() for v in pair])
    peak = row_max(across("NDVI_mean"))
    crop = infer_crop([(c, parse_float(F.col(f"aafc_{c}_fraction"))) for c in INFERRED_CROP_ORDER], threshold)
    return df.select(
        "quarter_id", parse_int(F.col("year")).alias("year"), crop.alias("crop_guess"),
        dominant.alias("aafc_dominant_class"),
        F.coalesce(F.try_element_at(names, dominant), F.lit("Unknown")).alias("aafc_dominant_crop_name"),
        peak.alias("peak_ndvi"), row_max(across("EVI_mean")).alias("peak_evi"),
        row_max(across("NDRE1_mean")).alias("peak_ndre1"), row_mean(across("NDMI_mean")).alias("seasonal_ndmi"),
        row_mean(across("MSI_mean")).alias("seasonal_msi"),
        (peak - parse_float(F.col("sep_NDVI_mean"))).alias("late_decline"),
        row_mean(across("smap_soil_moisture_am_mean")).alias("mean_smap_moisture"),
        row_mean(across("obs_count")).alias("coverage_score"),
    ).where(F.col("crop_guess").isNotNull())
