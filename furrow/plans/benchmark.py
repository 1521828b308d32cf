"""Field-yield benchmarks, the margin holdout and pixel-yield cross-validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import BENCHMARK_FEATURE_SETS
from furrow.operators import folds
from furrow.operators.metrics import regression_metrics
from furrow.operators.selection import min_group_size, pixel_feature_sets, year_constant_columns
from furrow.plans import boosting, linear, models

CROP = ["crop", "yield_unit"]
IDS = ["field_key", "section_key", "year", "crop", "yield_unit", "yield"]


def candidate_list(kinds: tuple[str, ...], sets: dict[str, list[str]]) -> list[tuple[str, str, list[str]]]:
    """Baseline first, then every model on every feature set."""
    return [("mean_baseline", "none", [])] + [(kind, name, columns) for name, columns in sets.items() for kind in kinds]


def with_candidate(rows: DataFrame, kind: str, columns: list[str], fold: str, name: str) -> DataFrame:
    """Add ``name``: predictions of a baseline or ridge that is fitted, within crop and unit, on rows of the folds other than the row's own.

    Rows of the fold ``boosting.TEST`` teach nothing. Fits are small tables that are put on the rows; rows are not copied for them.
    """
    if kind == "mean_baseline":
        learn = F.when(F.col(fold) != boosting.TEST, F.col("yield"))
        sums = scale.cut_lineage(rows.groupBy(*CROP, fold).agg(F.coalesce(F.sum(learn), F.lit(0.0)).alias("__s"), F.count(learn).alias("__n")))
        means = scale.attach(sums, sums.groupBy(*CROP).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn")), CROP)
        means = means.select(*CROP, fold, F.try_divide(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")).alias(name))
        return scale.attach(rows, means, [*CROP, fold])
    if kind == "ridge":
        fits = linear.ridge_loo_held(rows, CROP, fold, columns, "yield", test=boosting.TEST)
        values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.get("__fill", F.lit(i))).alias(f"__x{i}") for i, c in enumerate(columns)]
        out = scale.attach(rows.withColumn("__held", F.col(fold).cast("int")), fits.select(*CROP, "__held", "intercept", "coef", "__fill"), [*CROP, "__held"])
        out = out.select("*", *values).withColumn(name, linear.linear_value([f"__x{i}" for i in range(len(columns))]))
        return out.drop("__held", "intercept", "coef", "__fill", *[f"__x{i}" for i in range(len(columns))])
    raise ValueError(f"Unknown model {kind!r}.")


def with_candidates(rows: DataFrame, kinds: tuple[str, ...], sets: dict[str, list[str]], fold: str, prefix: str) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Rows with a column for each baseline or ridge candidate, and those columns by (model, feature set)."""
    names = {}
    for kind, name, columns in candidate_list([k for k in kinds if k != "gbm"], sets):
        names[kind, name] = f"{prefix}_{len(names)}"
        rows = with_candidate(rows, kind, columns, fold, names[kind, name])
    return rows, names


def told(rows: DataFrame, names: dict[tuple[str, str], str], *more: str) -> DataFrame:
    """IDS, ``more``, model, feature_set and predicted: a row for each candidate's column."""
    each = F.array(*[F.struct(F.lit(kind).alias("model"), F.lit(name).alias("feature_set"), F.col(column).alias("predicted")) for (kind, name), column in names.items()])
    return rows.select(*IDS, *more, F.explode(each).alias("e")).select(*IDS, *more, "e.*")


def once(sets: dict[str, list[str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The first feature set of each list of columns, and all names of each: sets of the same columns are fitted, predicted and scored once."""
    first: dict[tuple, str] = {}
    alike: dict[str, list[str]] = {}
    for name, columns in sets.items():
        alike.setdefault(first.setdefault(tuple(columns), name), []).append(name)
    return {name: sets[name] for name in alike}, alike


def for_all_names(rows: DataFrame, alike: dict[str, list[str]]) -> DataFrame:
    """Rows of a feature set again under each name of the same columns."""
    names = [F.struct(F.lit(a).alias("of"), F.lit(name).alias("name")) for a, found in {**alike, "none": ["none"]}.items() for name in found]
    mine = F.transform(F.filter(F.array(*names), lambda n: n["of"] == F.col("feature_set")), lambda n: n["name"])
    others = [c for c in rows.columns if c != "feature_set"]
    return rows.select(*others, F.explode(mine).alias("feature_set")).select(*rows.columns)


def slim(table: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """The columns that models and scores read."""
    columns = dict.fromkeys(c for names in sets.values() for c in names)
    return table.select(*IDS, *[F.col(f"`{c}`") for c in columns if c not in IDS])


def add_fold(table: DataFrame, split: str, name: str = "fold", folds_n: int = 5) -> DataFrame:
    """Rows with the fold that holds them out: whole seasons, or whole sections spread over five folds per crop.

    Rows of a crop with one season, or one section, only have no fold: there is nothing to hold out.
    """
    group = "year" if split == "year" else "section_key"
    sized = scale.with_group_stats(table, CROP, {"__groups": F.count_distinct(group)})
    usable = F.col("__groups") >= 2
    if split == "year":
        return sized.withColumn(name, F.when(usable, F.col("year").cast("int"))).drop("__groups")
    keyed = sized.withColumns({"__g": F.concat_ws("\x01", *CROP, "section_key"), "__c": F.concat_ws("\x01", *CROP)})
    dealt = folds.fold_table(keyed.where(usable), "__g", folds_n, stratify="__c").withColumnRenamed("fold", name)
    return scale.attach(keyed, dealt, ["__g"]).drop("__g", "__c", "__groups")


def benchmark_field_yield(table: DataFrame, *, min_rows: int = 10, kinds: tuple[str, ...] = ("ridge", "gbm"),
                          sets: dict[str, list[str]] = BENCHMARK_FEATURE_SETS,
                          splits: tuple[str, ...] = ("year", "section"), **options) -> tuple[DataFrame, DataFrame]:
    """Scores and predictions of baseline and models per crop, unit, split and feature set.

    Boosted trees of all crops, folds, splits and feature sets are grown together (see ``boosting``); ``options`` are theirs.
    """
    sets, alike = once(sets)
    rows = min_group_size(scale.cut_lineage(slim(table, sets), wide=True), CROP, min_rows)
    for split in splits:
        rows = add_fold(rows, split, f"__{split}")
    rows = scale.cut_lineage(rows, wide=True)
    for split in splits:
        rows = with_candidate(rows, "mean_baseline", [], f"__{split}", f"__base_{split}")
    parts, counts = [], []
    for split in splits:
        usable = rows.where(F.col(f"__{split}").isNotNull())
        counts.append(usable.groupBy(*CROP).agg(F.count_distinct(f"__{split}").alias("folds"), F.count_distinct("year").alias("years"),
                                                F.count_distinct("section_key").alias("sections")).withColumn("split", F.lit(split)))
        fitted, names = with_candidates(usable, kinds, sets, f"__{split}", "__p")
        parts.append(told(fitted, names, f"__base_{split}").withColumnRenamed(f"__base_{split}", "pred_baseline").withColumn("split", F.lit(split)))
    if "gbm" in kinds:
        bases = [f"__base_{s}" for s in splits]
        grown = boosting.boosted_folds(rows, CROP, "yield", [*IDS, *bases], [f"__{s}" for s in splits], sets, **options)
        of = reduce(lambda rest, s: F.when(F.col("split") == f"__{s}", F.col(f"__base_{s}")).otherwise(rest), splits, F.lit(None).cast("double"))
        parts.append(grown.withColumns({"pred_baseline": of, "split": F.substring("split", 3, 100), "model": F.lit("gbm")}).drop(*bases))
    scored = reduce(DataFrame.unionByName, parts)
    keys = CROP + ["split", "feature_set", "model"]
    metrics = for_all_names(scale.cut_lineage(regression_metrics(scored, keys, baseline="pred_baseline")), alike)
    facts = reduce(DataFrame.unionByName, counts)
    out = metrics.join(facts, [*CROP, "split"]).withColumnsRenamed({"n": "field_years", "skill": "mae_skill"})
    predictions = for_all_names(scored, alike).select(*IDS, "predicted", "split", "feature_set", "model")
    return out.select(*CROP, "split", *[c for c in out.columns if c not in (*CROP, "split", *facts.columns)], "years", "sections", "folds"), predictions


def holdout_with_margin(table: DataFrame, *, test_year: int, min_rows: int = 10, min_improvement: float = 0.0,
                        kinds: tuple[str, ...] = ("ridge", "gbm"), sets: dict[str, list[str]] = BENCHMARK_FEATURE_SETS,
                        **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choose per crop on earlier seasons, refit, and score the test season once.

    Returns development errors, results with status, and test predictions. The
    baseline stays unless a model's error is below (1 − margin) times its own.
    """
    if not 0 <= min_improvement < 1:
        raise ValueError("min_improvement is a share from 0 to below 1")
    listed = candidate_list(kinds, sets)
    sets, alike = once(sets)
    rows = scale.cut_lineage(min_group_size(scale.cut_lineage(slim(table, sets), wide=True), CROP, min_rows), wide=True)
    status = scale.cut_lineage(rows.groupBy(*CROP).agg(
        F.count_if(F.col("year") < test_year).alias("dev_field_years"),
        F.count_distinct(F.when(F.col("year") < test_year, F.col("year"))).alias("dev_years"),
        F.count_if(F.col("year") == test_year).alias("test_field_years")).withColumn("status", F.when(
            (F.col("test_field_years") == 0) | (F.col("dev_years") < 2),
            "skipped: no test rows or under two development years").otherwise("scored")))
    usable = rows.join(F.broadcast(status.where("status = 'scored'").select(*CROP)), CROP, "left_semi")
    # One run gives both: rows of the test season teach nothing and are predicted from all others.
    dev, test = add_fold(usable.where(F.col("year") < test_year), "year"), usable.where(F.col("year") == test_year)
    both = scale.cut_lineage(dev.unionByName(test.withColumn("fold", F.lit(boosting.TEST))), wide=True)
    fitted, names = with_candidates(both, kinds, sets, "fold", "__p")
    scored = told(fitted, names)
    if "gbm" in kinds:
        grown = boosting.boosted_folds(both, CROP, "yield", IDS, ["fold"], sets, **options)
        scored = scored.unionByName(grown.drop("split").withColumn("model", F.lit("gbm")))
    candidates = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(kind).alias("model"), F.lit(name).alias("feature_set")) for i, (kind, name, _) in enumerate(listed)])

    def placed(rows: DataFrame) -> DataFrame:
        """``position`` of the candidate."""
        same = F.filter(candidates, lambda c: (c["model"] == F.col("model")) & (c["feature_set"] == F.col("feature_set")))
        return rows.withColumn("position", F.get(same, F.lit(0))["position"])

    errors = scale.cut_lineage(regression_metrics(scored.where(F.col("year") < test_year), [*CROP, "model", "feature_set"]))
    selection = scale.cut_lineage(placed(for_all_names(errors, alike)).select(*CROP, F.col("mae").alias("dev_mae"), "position", "model", "feature_set"))
    model_rows = F.col("position") > 0
    best = selection.groupBy(*CROP).agg(
        F.max(F.when(~model_rows, F.col("dev_mae"))).alias("dev_mae_baseline"),
        F.min(F.when(model_rows, F.struct("dev_mae", "position", "model", "feature_set"))).alias("b"))
    wins = F.col("b.dev_mae") < (1 - min_improvement) * F.col("dev_mae_baseline")
    choice = scale.cut_lineage(best.select(
        *CROP, "dev_mae_baseline", F.col("b.dev_mae").alias("dev_mae_best_model"),
        F.concat_ws(" / ", "b.model", "b.feature_set").alias("best_model"),
        F.when(wins, F.col("b.position")).otherwise(0).alias("chosen"),
        F.when(wins, F.col("b.model")).otherwise("mean_baseline").alias("chosen_model"),
        F.when(wins, F.col("b.feature_set")).otherwise("none").alias("chosen_feature_set"),
        F.when(wins, F.col("b.dev_mae")).otherwise(F.col("dev_mae_baseline")).alias("dev_mae_chosen")))
    finals = placed(for_all_names(scored.where(F.col("year") == test_year), alike)).drop("model", "feature_set").join(F.broadcast(choice), CROP)
    finals = finals.where((F.col("position") == 0) | (F.col("position") == F.col("chosen")))
    keys = [c for c in IDS if c != "section_key"]
    predictions = scale.cut_lineage(finals.groupBy(*keys, "section_key", "chosen_model", "chosen_feature_set").agg(
        F.max(F.when(F.col("position") == F.col("chosen"), F.col("predicted"))).alias("predicted_chosen"),
        F.max(F.when(F.col("position") == 0, F.col("predicted"))).alias("predicted_baseline")), wide=True)
    final = regression_metrics(predictions, CROP, predicted="predicted_chosen", baseline="predicted_baseline").select(
        *CROP, F.col("mae").alias("test_mae_chosen"), F.col("baseline_mae").alias("test_mae_baseline"),
        F.col("rmse").alias("test_rmse_chosen"), F.col("bias").alias("test_bias_chosen"),
        F.col("skill").alias("test_mae_skill"))
    results = status.join(choice.drop("chosen"), CROP, "left").join(final, CROP, "left") \
        .withColumn("min_improvement", F.lit(float(min_improvement)))
    return selection, results, predictions


def pixel_yield_cv(df: DataFrame, *, feature_set: str = "nonleaky", alpha: float = 1.0, split: str = "field_year",
                   drop_year_constant: bool = False, include_baseline: bool = False, target: str = "yield_bu_ac",
                   crop: str = "crop", group: str = "row_id") -> tuple[DataFrame, DataFrame, list[str]]:
    """Per crop OLS, ridge and baseline under grouped folds, scored per pixel and per field-year.

    Returns metrics, predictions (out of fold and fitted on all rows) and the
    features used. Medians are learned inside each training part.
    """
    if split not in ("field_year", "year"):
        raise ValueError(f"Unknown split {split!r}.")
    features = pixel_feature_sets(df)[feature_set]
    if drop_year_constant:
        constant = year_constant_columns(df, features)
        features = [c for c in features if c not in constant]
        if not features:
            raise ValueError(f"no column of {feature_set!r} varies within a year")
    by = "year" if split == "year" else group
    slim = df.select(crop, group, "year", "quarter_section", F.col(target).cast("double").alias("__y"),
                     *[F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(features)])
    used = [f"f_{i}" for i in range(len(features))]
    crops = models.class_list(slim, crop)
    # Folds are set per crop, on the crop's own groups.
    tables = []
    for name in crops:
        own = slim.where(F.col(crop) == name)
        k = min(5, own.select(by).distinct().limit(6).count())
        tables.append(folds.fold_table(own, by, max(k, 1)).withColumns({crop: F.lit(name), "__k": F.lit(k)}))
    table = reduce(DataFrame.unionByName, tables)
    rows = scale.cut_lineage(scale.attach(slim, table, [crop, by]))
    specs = ([("mean_baseline", None)] if include_baseline else []) + [("ols", 0.0), ("ridge", alpha)]
    out = folds.training_mean(rows, [crop], "fold", "__y", "pred_mean_baseline")
    out = scale.with_group_stats(out, [crop], {"fitted_mean_baseline": F.avg("__y")})
    # All training parts in one pass: the rows that do not lie in a held-out fold, and under ALL_ROWS every row.
    held = F.explode(F.array(*[F.lit(f) for f in (*range(5), ALL_ROWS)])).alias("__held")
    train = rows.select(crop, "fold", "__y", *used, held).where((F.col("__held") == ALL_ROWS) | (F.col("fold") != F.col("__held")))
    params, fills = _linear_fits(train, used, [crop, "__held"], alpha)
    out = out.where("fold IS NOT NULL")
    for prefix, of in (("pred", F.col("fold")), ("fitted", F.lit(ALL_ROWS))):
        out = _linear_predictions(out.withColumn("__held", of), params, fills, used, [crop, "__held"], prefix).drop("__held")
    predictions = scale.cut_lineage(out, wide=True)
    long = predictions.withColumn("e", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.when(F.col("__k") >= 2, F.col(f"pred_{m}")).alias("predicted"))
        for m, _ in specs]))).select(crop, group, "fold", "__k", "__y", "e.*")
    keys = [crop, "model"]
    per_fold = regression_metrics(long, [*keys, "fold"], actual="__y").groupBy(*keys).agg(
        F.avg("mae").alias("mean_mae"), F.avg("rmse").alias("mean_rmse"), F.avg("r2").alias("mean_r2"))
    field = long.groupBy(*keys, group).agg(F.avg("__y").alias("__y"), F.avg("predicted").alias("predicted"))
    field = regression_metrics(field, keys, actual="__y").select(
        *keys, F.col("mae").alias("field_mae"), F.col("r2").alias("field_r2"))
    facts = long.groupBy(*keys).agg(F.count("*").alias("pixel_count"), F.count_distinct(group).alias("field_year_count"),
                                    F.max("__k").alias("cv_splits"))
    metrics = facts.join(per_fold, keys).join(field, keys).withColumns({
        "feature_set": F.lit(feature_set), "split": F.lit(split), "feature_count": F.lit(len(features))})
    keep = [c for m, _ in specs for c in (f"pred_{m}", f"fitted_{m}")]
    return metrics, predictions.select(crop, group, "year", "quarter_section", F.col("__y").alias(target), *keep), features


#: Stands for a held-out fold where no row is held out.
ALL_ROWS = -1


def _linear_fits(train: DataFrame, used: list[str], keys: list[str], alpha: float) -> tuple[DataFrame, DataFrame]:
    """OLS and ridge parameters per key from one set of moments, and the medians that fill gaps. Features without gaps need none."""
    gaps = train.agg(F.lit(0), *[F.count_if(F.col(c).isNull()).alias(c) for c in used]).first()
    gappy = [c for c in used if gaps[c]]
    fills = scale.cut_lineage(scale.group_quantiles(train, keys, {f"__{c}": (F.col(c), 0.5) for c in gappy}) if gappy else train.select(*keys).distinct())
    filled = scale.attach(train, fills, keys).select(*keys, "__y", *_filled(used, gappy))
    gram = scale.cut_lineage(linear.moments(filled, keys, used, "__y"))
    params = None
    for name, penalty in (("ols", 0.0), ("ridge", alpha)):
        fit = linear.fit_linear(gram, keys, len(used), penalty).select(*keys, F.col("intercept").alias(f"__i_{name}"), F.col("coef").alias(f"__c_{name}"))
        params = fit if params is None else scale.attach(params, fit, keys)
    return scale.cut_lineage(params), fills


def _filled(used: list[str], gappy: list[str]) -> list:
    return [F.coalesce(F.col(c), F.col(f"__{c}"), F.lit(0.0)).alias(c) if c in gappy else F.col(c) for c in used]


def _linear_predictions(rows: DataFrame, params: DataFrame, fills: DataFrame, used: list[str], keys: list[str], prefix: str) -> DataFrame:
    both = scale.attach(scale.attach(rows, params, keys), fills, keys)
    gappy = [c for c in used if f"__{c}" in fills.columns]
    value = dict(zip(used, _filled(used, gappy)))
    both = both.withColumns({f"__v_{c}": v for c, v in value.items()})
    out = both.withColumns({f"{prefix}_{m}": linear.linear_value([f"__v_{c}" for c in used], f"__i_{m}", f"__c_{m}") for m in ("ols", "ridge")})
    return out.drop(*[f"__v_{c}" for c in used], *[f"__{k}_{m}" for k in "ic" for m in ("ols", "ridge")], *[f"__{c}" for c in gappy])
