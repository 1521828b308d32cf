"""Locked season models: choose, fit, save, load, predict and score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import PEAK_FEATURES
from furrow.operators import groups
from furrow.operators.metrics import with_pooled
from furrow.operators.selection import require_columns
from furrow.plans import season

SCHEMA_VERSION = 1
OPTION, DEVIATION = "regional_satellite", "peak"
MODEL_VARIANT = "season_model_plus_field"
# Fixed value: a model must beat the training mean's error by this share.
MIN_IMPROVEMENT = 0.1
CENTRED = [f"centred_{c}" for c in PEAK_FEATURES]
IDS = ["field_key", "year", "crop", "yield_unit"]


@dataclass(frozen=True)
class Bundle:
    """One row per crop: choice, training mean, references, both models; and the settings as JSON-ready values."""

    crops: DataFrame
    settings: dict


def fit_bundle(table: DataFrame, regions: DataFrame, *, test_year: int, min_improvement: float = MIN_IMPROVEMENT,
               min_rows: int = 10) -> Bundle:
    """Per crop, keep the model only if it clears the margin on held-out seasons; refit on all of them."""
    if not 0 <= min_improvement < 1:
        raise ValueError("min_improvement is a share from 0 to below 1")
    years = [y for y in season.season_list(table) if y < test_year]
    if len(years) < 3:
        raise ValueError(f"only {len(years)} seasons before {test_year} to choose a model on, not 3: {years}")
    regions = regions.where(F.col("year") < test_year)
    selection = season.evaluate_season_field(
        table, years=tuple(years), min_rows=min_rows, deviation_features=DEVIATION, season_features=OPTION,
        regions=regions).metrics
    errors = scale.cut_lineage(selection.groupBy("crop", "yield_unit").agg(
        F.max(F.when(F.col("variant") == "baseline", F.col("mae"))).alias("dev_mae_baseline"),
        F.max(F.when(F.col("variant") == MODEL_VARIANT, F.col("mae"))).alias("dev_mae_model")))

    dev = table.where(F.col("year").isin(years)).join(errors.select("crop").distinct(), "crop", "left_semi")
    dev = scale.cut_lineage(groups.centre(dev, PEAK_FEATURES))
    facts = dev.groupBy("crop", "yield_unit").agg(F.count("*").alias("dev_field_years"),
                                                  F.count_distinct("year").alias("dev_seasons"))
    crop_mean = dev.groupBy("crop").agg(F.avg("yield").alias("training_mean"))
    reference = season.season_readings(dev, "fields", PEAK_FEATURES).groupBy("crop").agg(
        *[F.avg(c).alias(f"reference_{c}") for c in PEAK_FEATURES])
    levels = season.regional_models(regions, OPTION).select(
        "crop", F.col("alpha").alias("season_alpha"), F.col("intercept").alias("season_intercept"),
        F.col("coef").alias("season_coef"))
    params, medians = season.fit_deviation(dev, CENTRED, ["crop"])
    deviations = params.select("crop", F.col("alpha").alias("deviation_alpha"),
                               F.col("intercept").alias("deviation_intercept"), F.col("coef").alias("deviation_coef"))
    fills = medians.select("crop", F.array(*[f"__med_{i}" for i in range(len(CENTRED))]).alias("deviation_fill"))
    out = errors.join(facts, ["crop", "yield_unit"])
    for part in (crop_mean, reference, levels, deviations, fills):
        out = out.join(part, "crop", "left")
    better = F.col("dev_mae_model") < (1 - min_improvement) * F.col("dev_mae_baseline")
    out = out.withColumns({"variant": F.when(better, MODEL_VARIANT).otherwise("baseline"),
                           "dev_skill": 1 - F.try_divide("dev_mae_model", "dev_mae_baseline")})
    later = {str(r.year): r["count"] for r in table.where(F.col("year") >= test_year).groupBy("year").count().collect()}
    settings = {"schema_version": SCHEMA_VERSION, "test_year": test_year, "training_years": years,
                "region_training_years": season.season_list(regions), "min_improvement": min_improvement,
                "min_rows": min_rows, "season_features": OPTION, "deviation_features": DEVIATION,
                "model_variant": MODEL_VARIANT, "feature_columns": list(PEAK_FEATURES), "later_rows_at_fit": later,
                "inputs": {"field_table": table_digest(table.select(*IDS, "yield", *PEAK_FEATURES)),
                           "regions": table_digest(regions)}}
    return Bundle(scale.cut_lineage(out), settings)


def table_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order: row hashes are summed, then hashed."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    total = df.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return total.select(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(4)]), 256)).first()[0]


def save_bundle(bundle: Bundle, path: str, overwrite: bool = False) -> dict:
    """Write crops and a manifest that holds their digest; an existing bundle is refused."""
    mode = "overwrite" if overwrite else "errorifexists"
    bundle.crops.write.mode(mode).parquet(f"{path}/crops")
    manifest = bundle.settings | {"model_digest": table_digest(bundle.crops)}
    spark = bundle.crops.sparkSession
    import json
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode(mode).text(f"{path}/manifest")
    return manifest


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    import json
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    crops = spark.read.parquet(f"{path}/crops")
    if table_digest(crops) != manifest.pop("model_digest"):
        raise ValueError(f"{path}: the crops table is not the one that was saved")
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"{path}: written with layout {manifest['schema_version']}, this is {SCHEMA_VERSION}")
    return Bundle(crops, manifest)


def predict_bundle(bundle: Bundle, table: DataFrame) -> DataFrame:
    """Chosen, baseline and model predictions per row with a status; observed yields are never used."""
    require_columns(table, IDS + bundle.settings["feature_columns"])
    rows = scale.cut_lineage(groups.centre(table, PEAK_FEATURES))
    crops = bundle.crops.withColumnRenamed("yield_unit", "__unit")
    stats = rows.groupBy("crop", "year").agg(
        F.count("*").alias("__fields"), F.array_sort(F.collect_set("yield_unit")).alias("__units"),
        *[F.avg(c).alias(f"__now_{c}") for c in PEAK_FEATURES])
    out = scale.attach(scale.attach(rows, stats, ["crop", "year"]), crops, ["crop"])
    status = (F.when(F.col("__unit").isNull(), "no model for this crop")
              .when(F.col("__units") != F.array("__unit"), F.concat(
                  F.lit("unit "), F.array_join("__units", ", "), F.lit(" differs from training unit "), "__unit"))
              .otherwise("ok"))
    ok = F.col("status") == "ok"
    relative = F.col("season_intercept")
    deviation = F.col("deviation_intercept")
    for i, c in enumerate(PEAK_FEATURES):
        relative = relative + F.get("season_coef", F.lit(i)) * (F.col(f"__now_{c}") - F.col(f"reference_{c}"))
        deviation = deviation + F.get("deviation_coef", F.lit(i)) * F.coalesce(
            F.col(f"centred_{c}"), F.get("deviation_fill", F.lit(i)))
    out = out.withColumn("status", status).withColumns({
        "chosen_variant": F.when(ok, F.col("variant")).otherwise(""),
        "season_fields": F.when(ok, F.col("__fields")).otherwise(F.lit(0)),
        "predicted_relative": F.when(ok, relative),
        "predicted_deviation": F.when(ok, F.coalesce(deviation, F.lit(0.0))),
        "pred_baseline": F.when(ok, F.col("training_mean"))})
    out = out.withColumns({
        "season_source": F.when(~ok, "").when(F.col("predicted_relative").isNull(), "training mean").otherwise(OPTION),
        "predicted_season_mean": F.coalesce(F.col("predicted_relative"), F.lit(1.0)) * F.col("pred_baseline")})
    out = out.withColumn(f"pred_{MODEL_VARIANT}", F.col("predicted_season_mean") + F.col("predicted_deviation"))
    out = out.withColumn("predicted", F.when(F.col("chosen_variant") == MODEL_VARIANT, F.col(f"pred_{MODEL_VARIANT}"))
                         .otherwise(F.col("pred_baseline")))
    keep = IDS + (["yield"] if "yield" in table.columns else [])
    return out.select(*keep, "status", "chosen_variant", "season_source", "season_fields", "predicted_relative",
                      "predicted_season_mean", "predicted_deviation", "pred_baseline", f"pred_{MODEL_VARIANT}", "predicted")


def score_bundle(predictions: DataFrame) -> DataFrame:
    """Error of the chosen prediction against the training mean per crop, plus a pooled bu/ac row."""
    require_columns(predictions, ["yield"])
    scored = predictions.where((F.col("status") == "ok") & F.col("yield").isNotNull())
    keys = ["crop", "yield_unit"]
    out = with_pooled(scored, keys, baseline="pred_baseline")
    model = with_pooled(scored, keys, predicted=f"pred_{MODEL_VARIANT}").select(*keys, F.col("mae").alias("model_mae"))
    chosen = scored.groupBy(*keys).agg(F.min("chosen_variant").alias("chosen_variant"))
    return out.join(model, keys).join(chosen, keys, "left").select(
        *keys, F.col("n").alias("field_years"), F.coalesce("chosen_variant", F.lit("per crop")).alias("chosen_variant"),
        "mae", "baseline_mae", "model_mae", "bias", "rmse", "skill")
