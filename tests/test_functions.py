"""Column selection, season shapes and null handling."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.functions import indices, scalars, temporal
from furrow.operators import groups, selection, training_table


def test_month_and_family_selection(spark):
    df = spark.createDataFrame([("1", 1.0, 2.0, 3.0, 4.0, 5.0, 6)], "pid string, NDVI_jul double, NDVI_aug double, VV_jul double, PRECIP_jun double, slope double, SCL_jul int")
    assert selection.select_months(df, ["jul"]).columns == ["pid", "NDVI_jul", "VV_jul", "slope", "SCL_jul"]
    assert selection.drop_qa(df).columns == ["pid", "NDVI_jul", "NDVI_aug", "VV_jul", "PRECIP_jun", "slope"]
    assert selection.select_families(df, ["s1", "precip"]).columns == ["pid", "VV_jul", "PRECIP_jun"]
    assert [selection.feature_family(c) for c in ("NDVI_delta_jun_jul", "VV_minus_VH_season_max", "B8A_oct", "slope", "VV_minus_VH_aug")] == [
        "s2", "s1", "s2", "other", "s1"]
    out, features = training_table.classifier_table(df, ["jul", "aug"], ["s2"])
    assert features == ["NDVI_jul", "NDVI_aug", "NDVI_delta_jul_aug", "NDVI_season_max", "NDVI_season_min", "NDVI_season_range"]
    assert out.first().NDVI_delta_jul_aug == 1.0
    with pytest.raises(ValueError, match="No feature"):
        training_table.classifier_table(df, ["aug"], ["s1"])
    with pytest.raises(ValueError, match="Non-numeric"):
        selection.coerce_numeric(spark.createDataFrame([("x",)], "a string"), ["a"])


def test_pixel_feature_sets(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 1, "x", 1.0)], "NDVI_max double, may_NDVI_mean double, VV_p10 double, slope double, year int, crop string, yield_bu_ac double")
    sets = selection.pixel_feature_sets(df)
    assert sets == {"ndvi_only": ["NDVI_max", "may_NDVI_mean"], "satellite": ["NDVI_max", "may_NDVI_mean", "VV_p10"],
                    "nonleaky": ["NDVI_max", "may_NDVI_mean", "VV_p10", "slope"], "all": ["NDVI_max", "may_NDVI_mean", "VV_p10", "slope", "year"]}


def test_year_constant_columns(spark):
    df = spark.createDataFrame([(2020, 1.0, 1.0), (2020, 1.0, 2.0), (2021, 5.0, None), (2021, None, None)], "year int, a double, b double")
    assert selection.year_constant_columns(df, ["a", "b"]) == ["a"]


def test_complete_cases(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, "b"), (1.0, 2.0, None), (1.0, 2.0, "c")], "x double, y double, l string")
    assert [r.l for r in selection.complete_cases(df, ["x", "y"], ["l"]).collect()] == ["c"]
    assert [r.l for r in selection.complete_cases(df, ["x", "y"], ["l"], keep_missing=True).collect()] == ["a", "c"]


def test_weekly_summary_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None, None, None), (1.0, None, 3.0)], "a double, b double, c double")
    exprs = temporal.weekly_summary("n", [F.col(c) for c in "abc"])
    first, second = df.select(*[e.alias(k) for k, e in exprs.items()]).collect()
    assert all(v is None for v in first)
    assert (second.n_mean, second.n_peak_week, second.n_early_mean, second.n_mid_mean, second.n_late_mean) == (2.0, 3, 1.0, None, 3.0)


def test_inferred_crop(spark):
    df = spark.createDataFrame([(0.7, 0.7), (0.2, None), (None, 0.6), (None, None), (0.59, 0.1)], "a double, b double")
    crop = temporal.infer_crop([("a", F.col("a")), ("b", F.col("b"))])
    assert [r[0] for r in df.select(crop).collect()] == ["a", None, "b", None, None]


def test_scaling_edges(spark):
    df = spark.createDataFrame([("g", None), ("g", None), ("h", 2.0), ("h", 2.0), ("h", None), (None, 0.0), (None, 10.0)], "k string, v double")
    out = groups.scale_within_group(df, ["v"], "k", 0.0, 1.0)
    assert sorted((str(r.k), r.v_field_scaled) for r in out.collect()) == [
        ("None", 0.0), ("None", 1.0), ("g", 0.5), ("g", 0.5), ("h", 0.5), ("h", 0.5), ("h", 0.5)]
    with pytest.raises(ValueError):
        groups.redistribute_yield(df.withColumnsRenamed({"k": "row_id"}), weights={"v": 1.0}, target="v", lower=0.9, upper=0.1)


numbers = st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(float("nan")), st.just(-9999.0), st.just(0.0))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=30))
def test_indices_never_raise(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    clean = df.select(*[scalars.parse_float(F.col(c)).alias(c) for c in "ab"])
    for (a, b), got in zip(pairs, clean.select(indices.normalised_difference(F.col("a"), F.col("b"))).collect()):
        missing = any(v is None or math.isnan(v) or v == -9999.0 for v in (a, b))
        if missing or a + b == 0:
            assert got[0] is None
        else:
            assert got[0] == pytest.approx((a - b) / (a + b), rel=1e-9, abs=1e-12)
