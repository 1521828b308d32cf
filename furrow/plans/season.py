"""Two-part yield model: a season level and each field's deviation from its season."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import (
    HISTORY_FEATURE, SEASON_OPTION_ROWS, SEASON_OPTIONS, deviation_feature_columns, option_columns, season_readings_of,
    quarter_column, season_feature_columns,
)
from furrow.operators import groups
from furrow.operators.metrics import regression_metrics
from furrow.operators.selection import drop_low_coverage, min_group_size, require_columns
from furrow.plans import linear

DEVELOPMENT_YEARS = (2020, 2021, 2022, 2023, 2024)
READINGS = ("fields", "quarter", "local")
VARIANTS = ["baseline", "season_model", "baseline_plus_field", "season_model_plus_field", "known_season",
            "known_season_plus_field"]
# Fixed value: rows of other sensors below this share of the median pixel count are dropped.
LANDSAT_MIN_SHARE = 0.25
MAX_SEASONS = 200


@dataclass(frozen=True)
class SeasonEvaluation:
    metrics: DataFrame
    seasons: DataFrame
    predictions: DataFrame


def region_table(yields: DataFrame, monthly_features: list[DataFrame], option: str | None = None) -> DataFrame:
    """Regional yields with each month's features; the first month's pixel count is kept."""
    keys = ["region", "year", "crop"]
    out = yields.select(*keys, "regional_yield")
    for i, features in enumerate(monthly_features):
        out = out.join(features if i == 0 else features.drop("pixels"), keys)
    out = scale.complete(out, ["regional_yield", *[c for c in out.columns if c.startswith("field_")]])
    if option and any(sensor == "landsat" for _, sensor in season_readings_of(option)):
        out = drop_low_coverage(out, LANDSAT_MIN_SHARE)
    return out


def cross_sensor_scale(landsat: DataFrame, s2: DataFrame, columns: list[str]) -> dict[str, float]:
    keys = ["region", "year", "crop"]
    left = drop_low_coverage(landsat, LANDSAT_MIN_SHARE).select(*keys, *[F.col(c).alias(f"{c}_landsat") for c in columns])
    both = left.join(s2.select(*keys, *[F.col(c).alias(f"{c}_s2") for c in columns]), keys)
    return groups.cross_sensor_slope(both, columns).first().asDict()


def regional_models(table: DataFrame, features: str | list[str], scope: tuple[str, ...] = (),
                    crops: list[str] | None = None) -> DataFrame:
    """Ridge per crop from region-year anomalies to relative yield, for crops with three or more years.

    ``scope`` columns (such as a held-out year) separate independent fits. Crops
    that use the same feature columns are fitted together; each row of the result
    names its ``features``.
    """
    scope = list(scope)
    by_columns: dict[tuple[str, ...], list[str]] = {}
    if isinstance(features, str):
        special = list(dict.fromkeys(crop for option, crop, *_ in SEASON_OPTION_ROWS if option == features and crop != "*"))
        by_columns[tuple(option_columns(features, "*"))] = []
        for crop in special:
            by_columns.setdefault(tuple(option_columns(features, crop)), []).append(crop)
    else:
        special, by_columns = [], {tuple(features): []}
    out = None
    for columns, named in by_columns.items():
        rows = table.where(F.col("crop").isin(named)) if named else (
            table.where(~F.col("crop").isin(special)) if special else table)
        anomalies = groups.region_anomaly(rows, rows, list(columns), keys=(*scope, "region", "crop"))
        anomalies = scale.cut_lineage(anomalies.select(*scope, "crop", "year", "relative_mean", *columns))
        fit = linear.season_ridge(anomalies, scope + ["crop"], list(columns), "relative_mean", min_years=3)
        fit = fit.withColumn("features", F.array(*[F.lit(c) for c in columns]))
        out = fit if out is None else out.unionByName(fit)
    return scale.cut_lineage(out)


def regional_relative(current: DataFrame, reference: DataFrame, models: DataFrame, features: str | list[str],
                      keys: list[str]) -> DataFrame:
    """Relative season yield per key from the anomaly of current readings; NULL when anything is missing."""
    columns = option_columns(features) if isinstance(features, str) else list(features)
    ref = reference.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns])
    rows = scale.attach(scale.attach(current, ref, keys), models.select(
        *keys, "intercept", "coef", "features"), keys)
    value = F.col("intercept")
    for c in columns:
        place = F.array_position("features", c).cast("int")
        weight = F.get(F.col("coef"), place - 1)
        value = value + F.when(F.col("features").isNull(), F.lit(None).cast("double")).when(place == 0, 0.0).otherwise(
            weight * (F.col(c) - F.col(f"__r_{c}")))
    return rows.select(*keys, value.alias("predicted_relative"))


def evaluate_regional_models(table: DataFrame, features: str | list[str] = "regional_satellite") -> DataFrame:
    """Leave one year out over all region-years: skill of the satellite anomaly per crop."""
    columns = option_columns(features) if isinstance(features, str) else list(features)
    years = season_list(table)
    stacked = table.withColumn("held_out", F.explode(F.array(*[F.lit(y) for y in years])))
    train, test = stacked.where("year <> held_out"), stacked.where("year = held_out")
    models = regional_models(train, features, ("held_out",))
    anomalies = groups.region_anomaly(test, train, columns, keys=("held_out", "region", "crop"))
    rows = scale.attach(anomalies, models.select("held_out", "crop", "intercept", "coef", "features"),
                        ["held_out", "crop"], how="inner")
    value = F.col("intercept")
    for c in columns:
        place = F.array_position("features", c).cast("int")
        value = value + F.when(place == 0, 0.0).otherwise(F.get(F.col("coef"), place - 1) * F.col(c))
    scored = rows.select("crop", F.abs(value - F.col("relative_mean")).alias("e"),
                         F.abs(1 - F.col("relative_mean")).alias("b"))
    return scored.groupBy("crop").agg(
        F.count("*").alias("region_years"), F.avg("e").alias("relative_mae"), F.avg("b").alias("baseline_relative_mae"),
        (1 - F.try_divide(F.avg("e"), F.avg("b"))).alias("skill"))


def season_list(df: DataFrame, year: str = "year") -> list[int]:
    years = [row[0] for row in df.select(year).distinct().limit(MAX_SEASONS + 1).collect()]
    if len(years) > MAX_SEASONS:
        raise ValueError(f"More than {MAX_SEASONS} seasons; check the year column.")
    return sorted(years)


def season_readings(df: DataFrame, reading: str, columns: list[str], local: DataFrame | None = None,
                    sensor_scale: dict[str, float] | None = None) -> DataFrame:
    """Season features per crop and year: over fields, whole quarters or a fixed area."""
    if reading == "fields":
        out = df.groupBy("crop", "year").agg(*[F.avg(c).alias(c) for c in columns])
    elif reading == "quarter":
        out = df.groupBy("crop", "year").agg(*[F.avg(quarter_column(c)).alias(c) for c in columns])
    elif reading == "local":
        out = df.select("crop", "year").distinct().join(local.select("crop", "year", *columns), ["crop", "year"], "left")
    else:
        raise ValueError(f"Unknown season reading {reading!r}; choose from {READINGS}.")
    factors = sensor_scale or {}
    return out.withColumns({c: F.col(c) * factors[c] for c in columns if c in factors}) if factors else out


def fit_deviation(train: DataFrame, centred: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deviation ridge per key and the medians it imputes with; keys need five rows in seasons with contrast."""
    return _fit_contrast(groups.seasons_with_contrast(train, keys=(*keys, "year")), centred, keys, centred)


def _fit_contrast(contrast: DataFrame, centred: list[str], keys: list[str], gappy: list[str]) -> tuple[DataFrame, DataFrame]:
    """As fit_deviation, from rows with their departure; only ``gappy`` features have medians."""
    contrast = scale.cut_lineage(min_group_size(contrast, keys, 5).select(*keys, "departure", *centred), wide=True)
    specs = {f"__med_{i}": (F.col(c), 0.5) for i, c in enumerate(centred) if c in gappy}
    medians = scale.cut_lineage(scale.group_quantiles(contrast, keys, specs) if specs else contrast.select(*keys).distinct())
    filled = _impute(contrast, medians, centred, keys)
    return linear.ridge_loo(filled, keys, centred, "departure"), medians


def _impute(df: DataFrame, medians: DataFrame, centred: list[str], keys: list[str]) -> DataFrame:
    known = {f"__med_{i}": c for i, c in enumerate(centred) if f"__med_{i}" in medians.columns}
    if not known:
        return df
    out = scale.attach(df, medians, keys)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(m)) for m, c in known.items()}).drop(*known)


def predict_deviation(rows: DataFrame, fitted: tuple[DataFrame, DataFrame], centred: list[str],
                      keys: list[str], name: str = "predicted_deviation") -> DataFrame:
    """Predicted departure from the season mean; 0 for keys without a model."""
    params, medians = fitted
    filled = _impute(rows, medians, centred, keys)
    out = linear.predict_linear(filled, params, keys, centred, name)
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def evaluate_season_field(table: DataFrame, *, years: tuple[int, ...] = DEVELOPMENT_YEARS, min_rows: int = 10,
                          deviation_features: str = "indices", season_features: str = "weather",
                          published: DataFrame | None = None, regions: DataFrame | None = None,
                          season_reading: str = "fields", local: DataFrame | None = None,
                          sensor_scale: dict[str, float] | None = None) -> SeasonEvaluation:
    """Leave one season out; score six variants per crop.

    All held-out seasons are evaluated in the same pass: each row is repeated for
    every held-out season (a handful), as training or test row, and every fit is
    keyed by that season.
    """
    deviation = deviation_feature_columns(deviation_features)
    satellite = [c for c in deviation if c != HISTORY_FEATURE]
    season = season_feature_columns(season_features)
    from_regions = season_features in SEASON_OPTIONS
    if season_reading not in READINGS or (season_reading != "fields" and not from_regions):
        raise ValueError(f"Season reading {season_reading!r} needs a regional satellite option.")
    if from_regions and regions is None or season_features == "regional" and published is None:
        raise ValueError(f"Season option {season_features!r} needs its regional table.")
    if season_reading == "local" and local is None:
        raise ValueError("The local reading needs a table of local features.")
    require_columns(table, [*season, *satellite, *[quarter_column(c) for c in season if season_reading == "quarter"]])

    source = scale.cut_lineage(table.where(F.col("year").isin(list(years))), wide=True)
    rows = min_group_size(source, ["crop", "yield_unit"], min_rows)
    rows = scale.cut_lineage(groups.centre(rows, satellite), wide=True)
    seasons = season_list(rows)
    each_season = F.explode(F.array(*[F.lit(y) for y in seasons]))
    centred = [f"centred_{c}" for c in deviation]
    # What does not depend on the held-out season is put to a row before it is copied, and copies have only what fits and scores read.
    slim = scale.with_group_stats(rows, ["crop", "year"], {"__n": F.count("*"), "__mean": F.avg("yield")})
    slim = slim.withColumns({"__contrast": F.col("__n") >= 2, "departure": F.col("yield") - F.col("__mean")})
    own = ["field_key", "year", "crop", "yield_unit", "yield", "__contrast", "departure", *[f"centred_{c}" for c in satellite]]
    if HISTORY_FEATURE in deviation:
        slim = groups.with_departures(slim.select(*own), source).withColumn("held_out", each_season)
        history = groups.history_without(F.col("__departures"), F.col("held_out"), F.col("year"))
        slim = scale.cut_lineage(slim.withColumn(HISTORY_FEATURE, history).drop("__departures"), wide=True)
        stacked = groups.centre(slim, [HISTORY_FEATURE], ("held_out", "crop", "year"))
    else:
        stacked = slim.select(*own).withColumn("held_out", each_season)
    train, test = stacked.where("year <> held_out"), stacked.where("year = held_out")
    gaps = stacked.agg(F.lit(0), *[F.count_if(F.col(c).isNull()).alias(c) for c in centred]).first()

    by_crop = ["held_out", "crop"]
    amount = F.col("yield").cast("double")
    means = [F.avg("yield").alias("season_mean"), F.count("*").alias("fields"), *[F.avg(c).alias(c) for c in season]]
    levels = scale.cut_lineage(rows.groupBy("crop", "year").agg(*means, F.sum(amount).alias("__sum"), F.count(amount).alias("__rows")))
    others = levels.withColumn("held_out", each_season).where("year <> held_out")
    crop_means = scale.cut_lineage(others.groupBy(*by_crop).agg(F.try_divide(F.sum("__sum"), F.sum("__rows")).alias("baseline_mean")))
    season_train = scale.cut_lineage(scale.attach(others.drop("__sum", "__rows"), crop_means, by_crop)
                                     .withColumn("relative_mean", F.col("season_mean") / F.col("baseline_mean")))
    season_test = scale.attach(levels.withColumnRenamed("year", "held_out").drop("__sum", "__rows"), crop_means, by_crop)
    modelled = _season_level(season_features, season, rows, season_train, season_test, published, regions,
                             season_reading, local, sensor_scale, seasons)
    modelled = scale.cut_lineage(modelled)

    fitted = _fit_contrast(train.where("__contrast"), centred, by_crop, [c for c in centred if gaps[c]])
    out = predict_deviation(test, fitted, centred, by_crop)
    out = scale.attach(out, modelled.select(*by_crop, "baseline_mean", "modelled_mean", "season_alpha"), by_crop)
    out = groups.others_mean(out, fallback=F.col("baseline_mean"))
    base, level, known, dev = [F.col(c) for c in ("baseline_mean", "modelled_mean", "others_mean", "predicted_deviation")]
    predictions = scale.cut_lineage(out.select(
        "field_key", "year", "crop", "yield_unit", "yield", "predicted_deviation", "season_alpha",
        base.alias("pred_baseline"), level.alias("pred_season_model"), (base + dev).alias("pred_baseline_plus_field"),
        (level + dev).alias("pred_season_model_plus_field"), known.alias("pred_known_season"),
        (known + dev).alias("pred_known_season_plus_field")), wide=True)
    long = predictions.withColumn("pred", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(f"pred_{v}").alias("predicted")) for v in VARIANTS]))).select(
        "crop", "yield_unit", "year", "yield", "pred_baseline", "pred.*")
    keys = ["crop", "yield_unit", "variant"]
    scores = regression_metrics(long, keys, baseline="pred_baseline").select(
        *keys, F.col("n").alias("field_years"), "mae", "bias", "skill")
    counts = predictions.groupBy("crop", "yield_unit").agg(F.count_distinct("year").alias("seasons"))
    return SeasonEvaluation(scores.join(counts, ["crop", "yield_unit"]), modelled, predictions)


def _season_level(option, season, rows, season_train, season_test, published, regions, reading, local,
                  sensor_scale, seasons) -> DataFrame:
    """Modelled season mean per held-out season and crop, falling back to the training mean."""
    by_crop = ["held_out", "crop"]
    base = F.col("baseline_mean")
    none = F.lit(None).cast("double")
    if option == "regional":
        known = scale.attach(season_train, published.select("crop", "year", "regional_yield"), ["crop", "year"])
        ratios = groups.ratio_of_sums(known, by_crop, "season_mean", "regional_yield", "farm_to_region_ratio")
        now = published.select("crop", F.col("year").alias("held_out"), "regional_yield")
        out = scale.attach(scale.attach(season_test, ratios, by_crop), now, by_crop)
        return out.withColumns({"modelled_mean": F.coalesce(F.col("farm_to_region_ratio") * F.col("regional_yield"), base),
                                "season_alpha": none})
    if option in SEASON_OPTIONS:
        training = regions.withColumn("held_out", F.explode(F.array(*[F.lit(y) for y in seasons]))).where(
            "year <> held_out")
        models = regional_models(training, option, ("held_out",))
        readings = scale.cut_lineage(season_readings(rows, reading, season, local, sensor_scale))
        reference = scale.attach(season_train.select(*by_crop, "year"), readings, ["crop", "year"]).groupBy(
            *by_crop).agg(*[F.avg(c).alias(c) for c in season])
        current = readings.withColumnRenamed("year", "held_out").select(*by_crop, *season)
        relative = regional_relative(current, reference, models, option, by_crop)
        out = scale.attach(season_test, relative, by_crop)
        return out.withColumns({"modelled_mean": F.coalesce(F.col("predicted_relative") * base, base),
                                "season_alpha": none})
    reference = scale.cut_lineage(season_train.groupBy(*by_crop).agg(*[F.avg(c).alias(f"__r_{c}") for c in season]))
    less = {c: F.col(c) - F.col(f"__r_{c}") for c in season}
    train = scale.attach(season_train, reference, by_crop).withColumns(less)
    params = linear.season_ridge(scale.cut_lineage(train.select("held_out", "year", "relative_mean", *season)),
                                 ["held_out"], season, "relative_mean")
    test = scale.attach(season_test, reference, by_crop).select(*season_test.columns, *[
        e.alias(f"__d_{c}") for c, e in less.items()])
    scored = scale.attach(test, params.select("held_out", "intercept", "coef", F.col("alpha").alias("season_alpha")),
                          ["held_out"])
    relative = linear.linear_value([f"__d_{c}" for c in season])
    return scored.withColumn("modelled_mean", relative * base).drop("intercept", "coef", *[f"__d_{c}" for c in season])
