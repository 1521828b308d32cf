"""Row filters, masks and column selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import (
    CLASSIFIER_IDS, CLOUD_SCL_CLASSES, LANDSAT_CLOUD_BITS, MAX_CLOUD_PERCENT, MONTHS, PRECIP_SIGNALS,
    PUBLISHED_CROPS, PUBLISHED_DISPOSITION, QA60_CLOUD_BITS, S1_BANDS, S2_BANDS, S2_INDICES,
)
from furrow.functions.geometry import first_coordinate

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def quoted(column: str) -> Column:
    return F.col(f"`{column}`")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


# --- rows -----------------------------------------------------------------

def filter_bbox(parcels: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """Parcels whose first coordinate lies in a closed box."""
    start = first_coordinate(F.col("polys"))
    return parcels.where(start[0].between(lon_min, lon_max) & start[1].between(lat_min, lat_max))


def filter_farmland(parcels: DataFrame, column: str = "ra", null_text: bool = True) -> DataFrame:
    """Drop road allowances; the word 'null' counts as no allowance unless ``null_text`` is off."""
    return parcels.where(F.coalesce(F.col(column), F.lit("")).isin("", *(["null"] if null_text else [])))


def keep_parcel_id(parcels: DataFrame) -> DataFrame:
    return parcels.select("pid", "polys")


def filter_scenes(obs: DataFrame, max_cloud: float = MAX_CLOUD_PERCENT, inclusive: bool = False,
                  cloud: str = "scene_cloud") -> DataFrame:
    return obs.where(F.col(cloud) <= max_cloud if inclusive else F.col(cloud) < max_cloud)


def filter_radar(obs: DataFrame, mode: str = "IW", polarisations: tuple[str, ...] = ("VV", "VH"),
                 resolution_m: int | None = None) -> DataFrame:
    rule = F.col("instrument_mode") == mode
    for name in polarisations:
        rule &= F.array_contains("polarisations", name)
    if resolution_m is not None:
        rule &= F.col("resolution_m") == resolution_m
    return obs.where(rule)


def mask_scl(obs: DataFrame, column: str = "scl") -> DataFrame:
    return obs.where(~F.col(column).isin(CLOUD_SCL_CLASSES))


def mask_qa60(obs: DataFrame, column: str = "qa") -> DataFrame:
    return obs.where(F.col(column).bitwiseAND(F.lit(QA60_CLOUD_BITS)) == 0)


def mask_landsat(obs: DataFrame, pixel: str = "qa", saturation: str = "radsat") -> DataFrame:
    return obs.where((F.col(pixel).bitwiseAND(F.lit(LANDSAT_CLOUD_BITS)) == 0) & (F.col(saturation) == 0))


def filter_purity(labels: DataFrame, min_purity: float = 0.0, keep_other: bool = False) -> DataFrame:
    rule = (F.col("crop_label") != "no_data") & (F.col("label_purity") >= min_purity)
    return labels.where(rule if keep_other else rule & (F.col("crop_label") != "other"))


def complete_cases(df: DataFrame, features: list[str], labels: list[str], keep_missing: bool = False) -> DataFrame:
    """Rows without any NULL; or, keeping gaps, rows with every label and at least one feature."""
    if not keep_missing:
        return scale.complete(df, features + labels)
    return scale.complete(df, labels).dropna(how="all", subset=features)


def dropped_by_crop(before: DataFrame, after: DataFrame, crop: str = "crop_label") -> DataFrame:
    kept = after.groupBy(crop).agg(F.count("*").alias("kept"))
    all_rows = before.groupBy(crop).agg(F.count("*").alias("rows"))
    return all_rows.join(kept, crop, "left").select(
        crop, "rows", (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def min_group_size(df: DataFrame, group: list[str], minimum: int, distinct: str | None = None) -> DataFrame:
    """Rows of groups with at least ``minimum`` rows, or distinct values of one column."""
    size = F.count_distinct(distinct) if distinct else F.count("*")
    return scale.with_group_stats(df, group, {"__size": size}).where(
        F.col("__size") >= minimum).drop("__size")


def drop_low_coverage(df: DataFrame, min_share: float = 0.25, pixels: str = "pixels",
                      keys: tuple[str, ...] = ("region", "crop")) -> DataFrame:
    """Rows with at least ``min_share`` of their region-crop's median pixel count."""
    medians = scale.group_quantiles(df, list(keys), {"__median": (F.col(pixels), 0.5)})
    return scale.attach(df, medians, list(keys)).where(
        F.col(pixels) >= min_share * F.col("__median")).drop("__median")


def filter_coverage_years(parcels: DataFrame, required: int = 2) -> DataFrame:
    return parcels.where(F.col("coverage_eligible_year_count") >= required)


def published_yields(rows: DataFrame, regions: list[str], first_year: int = 2015) -> DataFrame:
    """Published regional yields in bushels per acre, one row per region, crop and year."""
    names = F.create_map(*[F.lit(v) for pair in PUBLISHED_CROPS.items() for v in pair])
    value = F.nullif(F.trim("VALUE"), F.lit(""))
    return rows.where(F.col("GEO").isin(regions) & (F.col("`Harvest disposition`") == PUBLISHED_DISPOSITION)
                      & F.col("`Type of crop`").isin(list(PUBLISHED_CROPS))).select(
        F.col("GEO").alias("region"), F.substring("REF_DATE", 1, 4).cast("int").alias("year"),
        names[F.col("`Type of crop`")].alias("crop"), value.cast("double").alias("regional_yield"),
        F.lit("bu/ac").alias("unit"), F.trim(F.coalesce("STATUS", F.lit(""))).alias("status"),
    ).where((F.col("year") >= first_year) & F.col("regional_yield").isNotNull())


def year_window(df: DataFrame, *, before: int | None = None, only: int | None = None, without: int | None = None,
                year: str = "year") -> DataFrame:
    """Development, test or leave-out rows by season."""
    for limit, rule in ((before, F.col(year) < F.lit(before)), (only, F.col(year) == F.lit(only)),
                        (without, F.col(year) != F.lit(without))):
        df = df if limit is None else df.where(rule)
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


# --- columns --------------------------------------------------------------

def select_months(df: DataFrame, months: list[str], exclude: list[str] = CLASSIFIER_IDS) -> DataFrame:
    """Keep identifiers, columns without '_', and columns whose last token is a wanted month."""
    if not months:
        return df
    keep = [c for c in df.columns if c in exclude or "_" not in c or c.rpartition("_")[2] in months]
    return df.select(*[quoted(c) for c in keep])


def signal_base(column: str) -> str:
    """The signal a monthly, delta or season column was derived from."""
    for marker in ("_delta_", "_season_"):
        if marker in column:
            return column.split(marker, 1)[0]
    base, _, month = column.rpartition("_")
    return base if base and month in MONTHS.values() else column


def feature_family(column: str) -> str:
    base = signal_base(column)
    families = (("s2", S2_BANDS + S2_INDICES), ("s1", S1_BANDS), ("precip", PRECIP_SIGNALS))
    return next((name for name, signals in families if base in signals), "other")


def drop_qa(df: DataFrame, exclude: list[str] = CLASSIFIER_IDS) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c in exclude or signal_base(c) != "SCL"])


def select_families(df: DataFrame, families: list[str], exclude: list[str] = CLASSIFIER_IDS) -> DataFrame:
    if not families or "all" in families:
        return df
    return df.select(*[quoted(c) for c in df.columns if c in exclude or feature_family(c) in families])


def pixel_feature_sets(df: DataFrame) -> dict[str, list[str]]:
    """Feature sets of a pixel table by column name, without identifiers and targets."""
    # Identifier and target columns, satellite signals, terrain and soil columns.
    excluded = ["system:index", "crop", "province", "quarter_section", "row_id", "yield_bu_ac",
                "yield_original", "yield_original_unit", ".geo"]
    signals = ["CIgreen", "CIrededge", "EVI", "MSI", "NDMI", "NDRE", "NDRE1", "NDRE2", "NDVI", "VH", "VV"]
    terrain = ["elevation", "latitude", "longitude", "slope", "soil_moisture_am_mean", "soil_oc",
               "soil_ph", "soil_sand"]
    numeric = [name for name, kind in df.dtypes if kind in NUMERIC and name not in excluded]
    satellite = [c for c in numeric if any(c.startswith(s) or f"_{s}" in c for s in signals)]
    return {"ndvi_only": [c for c in numeric if c.startswith("NDVI") or "_NDVI_" in c],
            "satellite": satellite, "nonleaky": satellite + [c for c in numeric if c in terrain],
            "all": numeric}


def numeric_features(df: DataFrame, identifiers: list[str]) -> list[str]:
    return [name for name, kind in df.dtypes if kind in NUMERIC | {"boolean"} and name not in identifiers]


def coerce_numeric(df: DataFrame, features: list[str]) -> DataFrame:
    """Cast features to double; refuse when a non-NULL value is not a number."""
    bad = df.agg(*[F.count_if(quoted(c).isNotNull() & quoted(c).cast("string").try_cast("double").isNull())
                   .alias(f"b{i}") for i, c in enumerate(features)]).first()
    wrong = [c for i, c in enumerate(features) if bad[i]]
    if wrong:
        raise ValueError(f"Non-numeric values found in feature columns: {wrong}")
    return df.withColumns({c: quoted(c).cast("double") for c in features})


def year_constant_columns(df: DataFrame, columns: list[str], year: str = "year") -> list[str]:
    """Columns with at most one distinct value in every year.

    Compared through min and max, which combine map-side, rather than distinct sets.
    """
    per_year = df.groupBy(year).agg(*[
        (F.coalesce(F.min(quoted(c)) == F.max(quoted(c)), F.lit(True))).alias(f"c{i}")
        for i, c in enumerate(columns)])
    row = per_year.agg(*[F.bool_and(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def null_sentinel(df: DataFrame, sentinel: float = -9999.0,
                  keep: tuple[str, ...] = ("aci_crop_code", "is_target_crop", "year")) -> DataFrame:
    """NULL for NaN and the missing sentinel in numeric columns."""
    changed = {}
    for name, kind in df.dtypes:
        if kind in NUMERIC and name not in keep:
            value = quoted(name)
            clean = F.nanvl(value, F.lit(None).cast(kind)) if kind in ("float", "double") else value
            changed[name] = F.nullif(clean, F.lit(sentinel).cast(kind) if kind not in ("tinyint", "smallint")
                                     else F.lit(int(sentinel)))
    return df.withColumns(changed) if changed else df


def drop_export_metadata(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c not in ("system:index", ".geo")])


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [quoted(c).isNull() for c in columns])


def missing_by_family(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with a missing feature, per feature family."""
    families: dict[str, list[str]] = {}
    for column in features:
        families.setdefault(feature_family(column), []).append(column)
    counts = df.agg(*[F.count_if(any_null(cols)).alias(name) for name, cols in sorted(families.items())])
    return counts.unpivot([], sorted(families), "family", "rows_missing").where("rows_missing > 0")


def family_counts(features: list[str]) -> dict[str, int]:
    names = [feature_family(c) for c in features]
    return {name: names.count(name) for name in sorted(set(names))}
