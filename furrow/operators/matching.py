"""Match staged operations to land parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.functions.geometry import multipolygon_acres
from furrow.functions.scalars import parse_legal
from furrow.operators.selection import require_columns

# Area rules of a match.
AREA_TOLERANCE = 1.05
LOW_COVERAGE = 0.5
REQUIRED = ["operation_id", "source_file", "source_row", "year", "crop", "crop_raw", "field_name_raw",
            "legal_description_raw", "area_ac", "yield_value", "yield_unit", "processing_status"]


def parcel_sharing(operations: DataFrame, *, pids: str = "pids", year: str = "year", crop: str = "crop",
                   area: str = "area_ac", key: str = "operation_id") -> DataFrame:
    """Per operation: how many operations touch any of its parcels that year, their crops and area.

    An operation has one or two parcels, so the union over both follows from
    |A| + |B| − |A and B|: three aggregates instead of a self-join that would list
    every pair on a crowded parcel.
    """
    # Written once, as every aggregate and join below reads it; each aggregate also tells which keys are hot.
    ops = scale.cut_lineage(operations.select(key, year, crop, F.coalesce(F.col(area), F.lit(0.0)).alias("__area"),
                                              F.array_sort(F.array_distinct(F.col(pids))).alias("__pids")), wide=True)
    if not ops.where(F.size("__pids") > 2).isEmpty():
        raise ValueError("An operation may touch at most two parcels.")
    single = ops.select(year, crop, "__area", F.explode("__pids").alias("__pid"))
    per_crop = single.groupBy("__pid", year, crop).agg(F.count("*").alias("n"), F.sum("__area").alias("a"))
    usage = scale.cut_lineage(per_crop.groupBy("__pid", year).agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.collect_set(crop).alias("crops")), wide=True)
    # Of all parcel lists, so that hot ones are known; only pairs are subtracted.
    pair = F.size("__pids") == 2
    both = ops.groupBy("__pids", year).agg(F.count("*").alias("__rows"), F.count(F.when(pair, 1)).alias("__nab"), F.sum(F.when(pair, F.col("__area"))).alias("__aab"))
    out = ops.withColumns({"__p1": F.get("__pids", F.lit(0)), "__p2": F.get("__pids", F.lit(1))})
    for side in ("1", "2"):
        at = f"__p{side}"
        none_there = ops.where(F.get("__pids", F.lit(int(side) - 1)).isNull()).withColumn(at, F.lit(None).cast("string")).groupBy(at, year).count().where(F.col("count") > scale.HOT_KEY_ROWS)
        out = scale.skew_join(out, usage.select(F.col("__pid").alias(at), year, F.col("n").alias(f"__n{side}"), F.col("a").alias(f"__a{side}"),
                                                F.col("crops").alias(f"__c{side}"), F.col("n").alias("__rows")),
                              [at, year], rows="__rows", hot=scale.cut_lineage(none_there))
    out = scale.attach(out, both, ["__pids", year], rows="__rows")
    zero, none = F.lit(0), F.array().cast("array<string>")
    count = F.coalesce("__n1", zero) + F.coalesce("__n2", zero) - F.coalesce("__nab", zero)
    total = F.coalesce("__a1", F.lit(0.0)) + F.coalesce("__a2", F.lit(0.0)) - F.coalesce("__aab", F.lit(0.0))
    crops = F.array_sort(F.array_union(F.coalesce("__c1", none), F.coalesce("__c2", none)))
    return out.select(key, count.alias("quarter_year_operation_count"), crops.alias("quarter_year_crops"),
                      total.alias("quarter_year_area_ac"))


def sharing_status(count, crops):
    return (F.when(count <= 1, "single_operation").when(F.size(crops) == 1, "shared_same_crop")
            .otherwise("shared_multiple_crops"))


def match_operations(operations: DataFrame, parcels: DataFrame) -> DataFrame:
    """Candidate parcels of pending operations with sharing status, area share, flags and eligibility.

    Every operation with a readable land description counts for sharing,
    including excluded ones. Parcels with a road-allowance code are ignored.
    """
    require_columns(operations, REQUIRED)
    legal = parse_legal(F.col("legal_description_raw"))
    ops = operations.withColumn("__legal", legal).withColumns({
        "legal_description": F.coalesce("__legal.label", F.lit("")),
        "pids": F.coalesce("__legal.pids", F.array().cast("array<string>")),
        "__what": F.coalesce("crop", F.lower("crop_raw"))})
    ops = scale.cut_lineage(ops.drop("__legal"), wide=True)
    sharing = parcel_sharing(ops, crop="__what")
    pending = ops.where(F.col("processing_status") == "pending_boundary_review").drop("__what")
    usable = parcels.where(F.coalesce("ra", F.lit("")) == "")
    wanted = pending.select(F.explode("pids").alias("pid")).distinct()
    # The first feature of a pid counts; without a file position any one is taken.
    at = F.col("position") if "position" in parcels.columns else F.col("pid")
    acres = scale.cut_lineage(usable.join(wanted, "pid", "left_semi").groupBy("pid").agg(
        F.min_by(multipolygon_acres(F.col("polys")), at).alias("acres")))
    per_op = scale.attach(pending.select("operation_id", F.explode("pids").alias("pid")), acres, ["pid"]).groupBy(
        "operation_id").agg(F.count("acres").alias("__matched"), F.sum("acres").alias("__acres"))
    out = scale.attach(scale.attach(pending, sharing, ["operation_id"]), per_op, ["operation_id"])
    matched, wanted_n = F.coalesce("__matched", F.lit(0)), F.size("pids")
    out = out.withColumn("match_status", F.when(wanted_n == 0, "unparsed").when(matched == wanted_n, "matched")
                         .when(matched > 0, "partial").otherwise("unmatched"))
    out = out.withColumns({
        "parcel_acres": F.when(F.col("match_status") == "matched", F.col("__acres")),
        "quarter_year_status": sharing_status(F.col("quarter_year_operation_count"), F.col("quarter_year_crops"))})
    out = out.withColumn("area_fraction", F.try_divide("area_ac", "parcel_acres"))
    share, status = F.col("area_fraction"), F.col("quarter_year_status")
    oversize = F.coalesce(share > AREA_TOLERANCE, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("match_status") == "unparsed", "unparsed_legal_description"),
        F.when(F.col("match_status").isin("partial", "unmatched"), "parcel_not_found"),
        F.when(status != "single_operation", status),
        F.when(oversize, "area_exceeds_parcel").when(share < LOW_COVERAGE, "low_parcel_coverage"),
        F.when((F.col("quarter_year_operation_count") > 1)
               & (F.col("quarter_year_area_ac") > F.col("parcel_acres") * AREA_TOLERANCE),
               "quarter_year_area_exceeds_parcel")))
    return out.select(
        *REQUIRED[:-4], "legal_description", "pids", "match_status", "parcel_acres", "area_ac", "area_fraction",
        "yield_value", "yield_unit", "quarter_year_status", "quarter_year_operation_count", "quarter_year_crops",
        "quarter_year_area_ac",
        ((F.col("match_status") == "matched") & (status != "shared_multiple_crops") & ~oversize)
        .alias("boundary_pilot_eligible"), flags.alias("flags"))


def field_boundaries(parcels: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched parcels with their acres, ready to write as features."""
    wanted = matches.select(F.explode("pids").alias("pid")).distinct()
    return parcels.where(F.coalesce("ra", F.lit("")) == "").join(wanted, "pid", "left_semi").withColumns({
        "parcel_acres": F.round(multipolygon_acres(F.col("polys")), 1),
        "boundary_source": F.lit("ats_quarter_section")})
