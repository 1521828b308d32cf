"""Crop labels from inventory pixels, and the joins that build training tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import CODE_TO_CROP
from furrow.functions.scalars import normalise_quarter_id, parse_float, parse_int, row_id


def map_codes(code: Column, names: dict[int, str] = CODE_TO_CROP, default: str = "other") -> Column:
    """Crop of a code through a constant map: no join, no shuffle."""
    mapping = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(F.try_element_at(mapping, code), F.lit(default))


def majority_label(pixels: DataFrame, parcel: str, code: str,
                   names: dict[int, str] = CODE_TO_CROP) -> DataFrame:
    """Most frequent non-zero code of each parcel with its share; ties take the lowest code.

    Counted per (parcel, code) first, so even a parcel holding most pixels
    reaches the second step as a handful of rows.
    """
    counts = pixels.groupBy(parcel, code).agg(F.count("*").alias("n"))
    valid = F.col(code) != 0
    picked = counts.groupBy(parcel).agg(
        F.max_by(F.when(valid, F.col(code)), F.when(valid, F.struct(F.col("n"), -F.col(code)))).alias("aafc_code"),
        F.max(F.when(valid, F.col("n"))).alias("__top"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("aafc_pixel_count"))
    return picked.select(
        parcel, "aafc_code",
        F.when(F.col("aafc_code").isNull(), "no_data").otherwise(map_codes(F.col("aafc_code"), names)).alias("crop_label"),
        F.try_divide(F.col("__top"), F.col("aafc_pixel_count")).alias("label_purity"), "aafc_pixel_count")


def join_labels(features: DataFrame, labels: DataFrame, key: str = "pid") -> DataFrame:
    return scale.skew_join(features, labels, [key], "inner")


def unmatched(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right, key, "left_anti")


def join_label_years(weekly: DataFrame, labels: DataFrame, parcel: str = "quarter_section") -> DataFrame:
    return scale.skew_join(weekly, labels, [parcel, "year"])


def load_yield_reference(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Field yields with normalised quarter ids and crop names; incomplete rows are dropped."""
    crop = F.trim(F.col("`crop type`"))
    mapping = F.create_map(*[F.lit(v) for pair in names.items() for v in pair]) if names else None
    crop = F.coalesce(F.try_element_at(mapping, crop), crop) if names else crop
    value = parse_float(F.col("`yield (bu/ac)`"), sentinel=None)
    return raw.select(
        normalise_quarter_id(F.col("`quarter section id`")).alias("quarter_section"), crop.alias("crop"),
        parse_int(F.col("year")).alias("year"), value.alias("yield_bu_ac"), value.alias("yield_original"),
        F.lit("bu/ac").alias("yield_original_unit")).dropna()


def distinct_lookup(pixels: DataFrame) -> DataFrame:
    """Distinct field-year yields found in a pixel table, with defaults for missing columns."""
    value = F.col("yield_bu_ac").cast("double")
    original = F.col("yield_original") if "yield_original" in pixels.columns else value
    unit = F.col("yield_original_unit") if "yield_original_unit" in pixels.columns else F.lit("bu/ac")
    return pixels.select(
        normalise_quarter_id(F.col("quarter_section")).alias("quarter_section"), F.trim("crop").alias("crop"),
        F.col("year").cast("int").alias("year"), value.alias("yield_bu_ac"),
        original.alias("yield_original"), unit.alias("yield_original_unit")).distinct().dropna(
        subset=["quarter_section", "crop", "year", "yield_bu_ac"])


def join_pixel_yield(pixels: DataFrame, yields: DataFrame, match_crop: str | None = None) -> DataFrame:
    """Pixels with every yield reported for their quarter that year, and the row id.

    A quarter with two crops doubles its pixels; name a pixel crop column to match crops too.
    """
    joined = scale.skew_join(pixels, yields, ["quarter_section", "year"], "inner")
    if match_crop:
        joined = joined.where(F.col(match_crop) == F.col("crop"))
    return joined.withColumn("row_id", row_id(F.col("quarter_section"), F.col("crop"), F.col("year")))


def feature_units(matches: DataFrame, parcels: DataFrame) -> DataFrame:
    """One unit per eligible parcel and year: its crop and operations; clashes are refused."""
    rows = matches.where("boundary_pilot_eligible").select(
        F.explode("pids").alias("pid"), F.col("year").cast("int").alias("year"), "crop", "operation_id")
    units = scale.cut_lineage(rows.groupBy("pid", "year").agg(
        F.min("crop").alias("crop"), F.min("crop").eqNullSafe(F.max("crop")).alias("__one"),
        F.array_sort(F.collect_set("operation_id")).alias("operation_ids")))
    clash = units.where(~F.col("__one")).select("pid", "year").first()
    if clash:
        raise ValueError(f"{clash.pid}: more than one crop to use in {clash.year}")
    lost = units.join(parcels, "pid", "left_anti").select("pid").first()
    if lost:
        raise ValueError(f"{lost.pid}: no polygon for a parcel to use")
    return units.drop("__one").join(parcels.select("pid", "polys"), "pid")


def wanted_parcels(parcels: DataFrame, wanted: DataFrame) -> DataFrame:
    return parcels.join(wanted.select("pid").distinct(), "pid", "left_semi")


def missing_parcels(wanted: DataFrame, parcels: DataFrame) -> DataFrame:
    return wanted.select("pid").distinct().join(parcels, "pid", "left_anti")


def exclude_sampled(parcels: DataFrame, sampled: DataFrame, key: str = "pid") -> DataFrame:
    return parcels.join(sampled.select(key).distinct(), key, "left_anti")


def require_features(items: DataFrame, features: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Groups whose every parcel has a feature row."""
    marked = scale.skew_join(items, features.select(*keys, F.lit(True).alias("__found")).distinct(), keys)
    return marked.groupBy(*group).agg(F.bool_and(F.coalesce("__found", F.lit(False))).alias("complete")).where(
        "complete").drop("complete")
