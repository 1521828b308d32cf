"""Fitted models on MLlib: classifiers, regressors, cross-validation and prediction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.operators import folds, metrics
from furrow.operators.selection import feature_family
from furrow.plans import boosting, linear


#: Fits that run at the same time; each is many short jobs that leave most cores idle.
FITS_AT_ONCE = 4
#: Nodes of trees that a fit keeps on the driver (some 400 bytes each while they grow); larger forests are grown in lots.
NODES_AT_ONCE = 330_000


def at_once(spark, jobs: list[Callable]) -> list:
    """The results of independent jobs, in their order, a bounded number of which runs at the same time."""
    if not jobs:
        return []
    with ThreadPool(min(FITS_AT_ONCE, len(jobs))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


# --- preparation ----------------------------------------------------------

def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in features])))


def flag_missing(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Missing values as 0 with a flag column per feature, for trees, which take no gaps."""
    out = df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in features})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return out, features + [f"{c}__missing" for c in features]


def index_labels(df: DataFrame, label: str, classes: list[str], name: str = "label") -> DataFrame:
    """Class positions from a fixed sorted list, so every fold numbers classes alike."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    return df.withColumn(name, place.cast("double"))


def class_list(df: DataFrame, label: str, limit: int = 1000) -> list[str]:
    found = [r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct()
             .limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{label} has more than {limit} classes.")
    return sorted(found)


def one_hot(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Category vectors; the most frequent value fills gaps and unseen values encode as all zeros."""
    filled = df
    for column in columns:
        top = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).first()
        filled = filled.withColumn(column, F.coalesce(F.col(column), F.lit(top[0] if top else "")))
    indexer = StringIndexer(inputCols=columns, outputCols=[f"{c}__i" for c in columns], handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}__v" for c in columns],
                            handleInvalid="keep", dropLast=False)
    return Pipeline(stages=[indexer, encoder]).fit(filled).transform(filled), [f"{c}__v" for c in columns]


# --- estimators -----------------------------------------------------------

def classifier(kind: str, *, rows: int = 0, classes: int = 2, seed: int = 42, **options):
    """An MLlib classifier with the reference settings of its kind, weighted by ``weight``."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "decision_tree":
        return DecisionTreeClassifier(**common, weightCol="weight", seed=seed, maxDepth=options.get("max_depth", 6),
                                      minInstancesPerNode=options.get("min_leaf", 5))
    if kind == "logistic":
        # MLlib penalises the mean loss, so C times the summed loss is regParam = 1 / (C · rows).
        return LogisticRegression(**common, weightCol="weight", maxIter=options.get("max_iter", 200),
                                  standardization=False, regParam=1.0 / (options.get("c", 1.0) * max(rows, 1)))
    if kind == "random_forest":
        return RandomForestClassifier(**common, weightCol="weight", seed=seed, numTrees=options.get("trees", 300),
                                      maxDepth=options.get("max_depth", 12))
    if kind == "boosted":
        binary = GBTClassifier(**common, weightCol="weight", seed=seed, maxIter=options.get("iterations", 100),
                               maxDepth=options.get("max_depth", 5), stepSize=options.get("learning_rate", 0.1))
        return binary if classes == 2 else OneVsRest(classifier=binary, weightCol="weight", **common)
    raise ValueError(f"Unknown model {kind!r}.")


def regressor(kind: str, *, seed: int = 42, label: str = "label", **options):
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "predicted"}
    makers: dict[str, Callable] = {
        "linear": lambda: LinearRegression(**common, solver="normal", regParam=0.0),
        "random_forest": lambda: RandomForestRegressor(**common, seed=seed, numTrees=options.get("trees", 100),
                                                       maxDepth=options.get("max_depth", 12)),
        "boosted": lambda: GBTRegressor(**common, seed=seed, maxIter=options.get("iterations", 100), stepSize=0.1, maxDepth=3),
        "shallow_boosted": lambda: GBTRegressor(**common, seed=seed, maxIter=options.get("iterations", 150),
                                                stepSize=0.05, maxDepth=2, minInstancesPerNode=3),
        "tree": lambda: DecisionTreeRegressor(**common, seed=seed, maxDepth=options.get("max_depth", 12)),
        "bagging": lambda: RandomForestRegressor(**common, seed=seed, numTrees=options.get("trees", 150),
                                                 featureSubsetStrategy="all", maxDepth=options.get("max_depth", 12))}
    if kind not in makers:
        raise ValueError(f"Unknown model {kind!r}.")
    return makers[kind]()


#: Feature values up to which a split's rows meet in one task that grows its boosted trees.
BOOSTED_VALUES = 16_000_000
#: Bins of a feature, as MLlib's trees have them.
TREE_BINS = 32


def _thresholds(values: np.ndarray, bins: int = TREE_BINS) -> np.ndarray:
    """Where MLlib cuts a feature: between all its values, or between those nearest to even shares of the rows."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < bins:
        return between
    stride, target, at, seen = len(values) / bins, len(values) / bins, [], np.cumsum(counts)
    for i in range(1, len(found)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            at.append(i - 1)
            target += stride
    return between[at]


def boosted_in_tasks(splits: dict[int, DataFrame], *, iterations: int = 100, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """(part, __id, label, predicted) of the test rows of each split, by the trees that ``regressor("boosted")`` grows: a task for each split, and no job for a tree.

    A split has __id, __train, label and features. The first tree counts whole, the others learn from twice the residual, as MLlib's gradient of the squared error is.
    """
    def fit(rows: pa.Table) -> pa.Table:
        learns, label = (rows.column(c).to_numpy() for c in ("__train", "label"))
        x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(len(label), -1)
        learns = learns.astype(bool)
        codes = np.empty(x.shape[::-1], dtype=np.int64)
        for j in range(x.shape[1]):
            codes[j] = np.searchsorted(_thresholds(x[learns, j]), x[:, j])
        codes = codes[codes.max(axis=1) > 0]
        own, others, y = np.ascontiguousarray(codes[:, learns]), np.ascontiguousarray(codes[:, ~learns].T), label[learns]
        if not len(codes) or not len(y):
            predicted = np.full(len(others), y.mean() if len(y) else np.nan)
        else:
            predicted, count = np.zeros(len(others)), np.ones(len(y))
            for trees, step in ((1, 1.0), (iterations - 1, 2 * rate)):
                # After the first tree its residuals are labels of the rest, which begin at 0 and not at the mean.
                start, *grown = boosting.grow(own, count, y, trees, step, depth, 1, TREE_BINS, start=0.0)
                if trees:
                    predicted = predicted + boosting.through((start, *grown), others, depth, TREE_BINS)
                    y = y - boosting.through((start, *grown), np.ascontiguousarray(own.T), depth, TREE_BINS)
        out = rows.filter(pa.array(~learns)).select(["part", "__id", "label"])
        return out.append_column("predicted", pa.array(predicted, pa.float64(), mask=np.isnan(predicted)))

    each = [rows.select(F.lit(part).alias("part"), "__id", "__train", "label", vector_to_array("features").alias("features")) for part, rows in splits.items()]
    whole = reduce(DataFrame.unionByName, each)
    return whole.groupBy("part").applyInArrow(fit, f"part int, __id {whole.schema['__id'].dataType.simpleString()}, label double, predicted double")


def prepare_fold(train: DataFrame, test: DataFrame, features: list[str], kind: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Features as the model needs them, learned on training rows only."""
    if kind == "logistic":
        both = train.withColumn("__train", F.lit(True)).unionByName(test.withColumn("__train", F.lit(False)))
        both = linear.impute_median(both, [], features, training=F.col("__train"), keep_empty=True)
        both = scale.cut_lineage(linear.standardise(both, [], features, training=F.col("__train")))
        parts = [both.where(F.col("__train") == flag).drop("__train") for flag in (True, False)]
        return parts[0], parts[1], features
    filled, used = flag_missing(train, features)
    return filled, flag_missing(test, features)[0], used


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, classes: list[str], kind: str,
                **options) -> DataFrame:
    """Test rows with ``predicted`` and ``probabilities`` (in class order)."""
    train, test, used = prepare_fold(train, test, features, kind)
    rows = assemble(index_labels(folds.class_weights(train, label), label, classes), used).persist()
    try:
        n = rows.count()
        lots = forest_lots(classifier(kind, **options), n) if kind == "random_forest" else []
        if len(lots) > 1:
            return lot_predictions(rows, assemble(test, used), lots, classes, **options)
        model = classifier(kind, rows=n, classes=len(classes), **options).fit(rows)
    finally:
        rows.unpersist()
    return label_predictions(model, assemble(test, used), classes)


def forest_lots(forest, rows: int) -> list[int]:
    """Trees of each lot of a forest, so that a lot's nodes fit the driver. A bagged tree has some 0.63 of the rows to part."""
    trees = forest.getNumTrees()
    nodes = min(2 ** (forest.getMaxDepth() + 1), int(1.27 * max(rows, 1)))
    lots = -(-trees // max(1, NODES_AT_ONCE // nodes))
    return [trees // lots + (i < trees % lots) for i in range(lots)]


def lot_predictions(rows: DataFrame, test: DataFrame, lots: list[int], classes: list[str], *, seed: int = 42, **options) -> DataFrame:
    """As ``label_predictions`` of one forest that has the trees of all lots: its probabilities are the trees' mean. A lot is let go before the next one grows."""
    out = test.withColumn("__sum", F.array_repeat(F.lit(0.0), len(classes)))
    for place, trees in enumerate(lots):
        # Seeds of lots lie apart, as callers count seeds up by one.
        model = classifier("random_forest", seed=seed + 1_000_003 * place, **{**options, "trees": trees}).fit(rows)
        told = label_predictions(model, out, classes, keep=("features",))
        out = scale.cut_lineage(told.withColumn("__sum", F.zip_with("__sum", "probabilities", lambda total, p: total + trees * p)).select(*out.columns))
    probs = F.transform("__sum", lambda p: p / sum(lots))
    names = F.array(*[F.lit(c) for c in classes])
    out = out.withColumn("probabilities", probs)
    return out.withColumn("predicted", F.get(names, (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))) \
        .select(*[c for c in test.columns if c != "features"], "predicted", "probabilities")


def label_predictions(model, rows: DataFrame, classes: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    out = model.transform(rows)
    names = F.array(*[F.lit(c) for c in classes])
    if "probability" in out.columns:
        probs = vector_to_array("probability")
        # A class absent from training leaves a shorter vector; pad so positions line up.
        probs = F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), len(classes))), 1, len(classes))
        predicted = F.get(names, (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    else:
        # One boosted model per class: the probability of each from its margin, made to add up to 1.
        each = F.transform(vector_to_array("rawPrediction"), lambda margin: 1 / (1 + F.exp(-2 * margin)))
        sum_of = F.aggregate(each, F.lit(0.0), lambda total, p: total + p)
        probs = F.transform(each, lambda p: p / sum_of)
        probs = F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), len(classes))), 1, len(classes))
        predicted = F.get(names, (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    return out.withColumns({"predicted": predicted, "probabilities": probs}).drop(
        *[c for c in ("features", "rawPrediction", "probability", "prediction") if c not in keep])


# --- evaluation -----------------------------------------------------------

def out_of_fold(df: DataFrame, features: list[str], label: str, kind: str, *, fold: str = "fold",
                classes: list[str] | None = None, require_both: bool = False, **options) -> tuple[DataFrame, int]:
    """Predictions of every row from models that never saw its fold, and the number of folds skipped.

    A fold is skipped when a test class is missing from training or, with
    ``require_both``, when either side has a single class.
    """
    classes = classes or class_list(df, label)
    present = df.groupBy(fold, label).agg(F.count("*").alias("n")).collect()
    test_sets: dict = {}
    for row in present:
        test_sets.setdefault(row[fold], set()).add(str(row[label]))
    fits, skipped = [], 0
    for value in sorted(test_sets):
        train_set = set().union(*[s for f, s in test_sets.items() if f != value]) if len(test_sets) > 1 else set()
        one_sided = require_both and (len(train_set) < 2 or len(test_sets[value]) < 2)
        if one_sided or len(train_set) < 2 or not test_sets[value] <= train_set:
            skipped += 1
            continue
        fits.append(lambda value=value: fit_predict(df.where(F.col(fold) != value), df.where(F.col(fold) == value), features, label,
                                                    classes, kind, **options))
    parts = at_once(df.sparkSession, fits)
    if not parts:
        return df.limit(0).withColumns({"predicted": F.lit(None).cast("string"),
                                        "probabilities": F.array().cast("array<double>")}), skipped
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), skipped


def cross_validate(df: DataFrame, features: list[str], label: str, kind: str, *, pid: str = "pid", prefix: int = 6,
                   folds_n: int = 5, repeats: int = 3, seed: int = 42, **options) -> dict[str, DataFrame]:
    """Repeated grouped, class-balanced CV: fold scores and summaries for rows and fields, and first-repeat predictions."""
    rows = df.withColumn("group", folds.spatial_group(pid, prefix))
    folds.check_group_count(rows, "group", folds_n)
    classes = class_list(rows, label)
    parts = []
    for repeat in range(repeats):
        table = folds.fold_table(rows, "group", folds_n, seed=seed + repeat, stratify=label)
        predicted, _ = out_of_fold(folds.assign_folds(rows, table, "group"), features, label, kind, classes=classes,
                                   seed=seed, **options)
        parts.append(predicted.select(pid, label, "fold", "predicted", "probabilities").withColumn("repeat", F.lit(repeat)))
    scored = scale.cut_lineage(reduce(DataFrame.unionByName, parts))
    keys = ["repeat", "fold"]
    matrix = metrics.confusion(scored, label, "predicted", keys)
    fields = scale.cut_lineage(metrics.field_vote(scored, pid, label, "probabilities", classes, keys))
    field_matrix = metrics.confusion(fields, "truth", "predicted", keys)
    out = {"predictions": scored.where("repeat = 0").drop("probabilities"), "field_predictions": fields.where("repeat = 0")}
    for name, m in (("row", matrix), ("field", field_matrix)):
        out[f"{name}_folds"] = metrics.overall_metrics(m, keys)
        out[f"{name}_summary"] = metrics.fold_summary(out[f"{name}_folds"], [], ["accuracy", "macro_f1"])
        out[f"{name}_class_summary"] = metrics.fold_summary(
            metrics.class_metrics(m, keys).where("support > 0"), ["class"], ["f1"])
        first = m.where("repeat = 0").groupBy("truth", "predicted").agg(F.sum("n").alias("n"))
        out[f"{name}_report"] = metrics.class_metrics(first)
    return out


def holdout(df: DataFrame, features: list[str], label: str, kind: str, *, pid: str = "pid", prefix: int = 6,
            test_share: float = 0.25, seed: int = 42, **options) -> tuple[DataFrame, DataFrame]:
    """Predictions and class report on whole held-out groups."""
    rows = folds.grouped_holdout(df.withColumn("group", folds.spatial_group(pid, prefix)), "group", test_share, seed=seed)
    predicted = scale.cut_lineage(fit_predict(rows.where(~F.col("is_test")), rows.where("is_test"), features, label,
                                              class_list(rows, label), kind, seed=seed, **options))
    return predicted, metrics.class_metrics(metrics.confusion(predicted, label, "predicted"))


def evaluate(df: DataFrame, features: list[str], label: str, kind: str, **options) -> dict[str, DataFrame]:
    """Grouped holdout plus repeated grouped cross-validation."""
    split = {k: options[k] for k in ("pid", "prefix", "seed") if k in options}
    rest = {k: v for k, v in options.items() if k not in ("folds_n", "repeats", *split)}
    predicted, report = holdout(df, features, label, kind, **split, **rest)
    return {"holdout": predicted, "holdout_report": report, **cross_validate(df, features, label, kind, **options)}


def feature_scores(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, or by mean absolute coefficient, highest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    return sorted(zip(features, map(float, values)), key=lambda pair: (-pair[1], pair[0]))


def one_vs_rest(df: DataFrame, features: list[str], label: str, kind: str, *, pid: str = "pid", min_fields: int = 10,
                **options) -> tuple[dict[str, PipelineModel], DataFrame]:
    """A model per class against the rest, and a manifest of trained and skipped classes."""
    counts = {r[label]: r["fields"] for r in metrics.class_field_counts(df.where(F.col(label).isNotNull()), label, pid).collect()}
    fitted, manifest = {}, []
    for crop in sorted(counts):
        trained = counts[crop] >= min_fields and len(counts) > 1
        if trained:
            fitted[crop] = _fit_binary(df, features, label, crop, kind, **options)
        manifest.append((crop, counts[crop], "trained" if trained else "skipped: too few fields"))
    return fitted, df.sparkSession.createDataFrame(manifest, "crop string, fields long, status string")


def _fit_binary(df, features, label, crop, kind, **options):
    rows = df.withColumn("__side", F.when(F.col(label) == crop, crop).otherwise("other"))
    rows = index_labels(folds.class_weights(rows, "__side"), "__side", ["other", crop])
    if kind == "logistic":
        steps = [*_filled_and_scaled(rows, features), classifier(kind, rows=rows.count(), **options)]
        return Pipeline(stages=steps).fit(rows)
    filled, used = flag_missing(rows, features)
    rows = assemble(filled, used).persist()
    try:
        return classifier(kind, rows=rows.count(), **options).fit(rows)
    finally:
        rows.unpersist()


def _filled_and_scaled(train: DataFrame, features: list[str]) -> list:
    """Stages that fill gaps with the training median and standardise by training mean and deviation; numbers are kept in the stages."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features]
    medians = [0.0 if m is None else m for m in train.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(clean)]).first()]
    filled = [F.coalesce(c, F.lit(m)) for c, m in zip(clean, medians)]
    stats = train.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(filled) for k, e in (("a", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    values = ", ".join(f"(coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), CAST('{medians[i]!r}' AS DOUBLE)) - CAST('{stats[f'a{i}']!r}' AS DOUBLE))"
                       f" / CAST('{stats[f's{i}'] or 1.0!r}' AS DOUBLE) AS `__in{i}`" for i, c in enumerate(features))
    return [SQLTransformer(statement=f"SELECT *, {values} FROM __THIS__"),
            VectorAssembler(inputCols=[f"__in{i}" for i in range(len(features))], outputCol="features")]


def predict_one_vs_rest(models: dict, df: DataFrame, features: list[str], kind: str) -> DataFrame:
    """Positive probability per trained crop and the crop with the highest, the first by name on ties."""
    rows = df
    if kind != "logistic":
        rows, used = flag_missing(df, features)
        rows = assemble(rows, used)
    for crop, model in sorted(models.items()):
        model = model.copy()
        last = model.stages[-1] if kind == "logistic" else model
        last.setPredictionCol("__p").setProbabilityCol("__q").setRawPredictionCol("__r")
        rows = model.transform(rows).withColumn(f"prob_{crop}", vector_to_array("__q")[1]).drop("__p", "__q", "__r")
        if kind == "logistic":
            rows = rows.drop("features", *[f"__in{i}" for i in range(len(features))])
    names = sorted(models)
    probs = F.array(*[F.col(f"prob_{c}") for c in names])
    best = F.get(F.array(*[F.lit(c) for c in names]), (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    return rows.withColumns({"predicted": best, "confidence": F.array_max(probs)}).drop("features")


def save_one_vs_rest(models: dict, manifest: DataFrame, features: list[str], path: str) -> None:
    """Models and the list of crops they were trained for; an existing folder is refused."""
    manifest.withColumn("features", F.array(*[F.lit(c) for c in features])).write.mode("errorifexists").parquet(f"{path}/manifest")
    for crop, model in models.items():
        model.write().save(f"{path}/models/{crop}")


def load_one_vs_rest(spark, path: str) -> tuple[dict, list[str]]:
    """Saved models of the crops the manifest lists as trained; other folders are ignored."""
    from pyspark.ml.util import DefaultParamsReader
    rows = spark.read.parquet(f"{path}/manifest").collect()
    trained = [r.crop for r in rows if r.status == "trained"]
    return {crop: DefaultParamsReader.loadParamsInstance(f"{path}/models/{crop}", spark.sparkContext)
            for crop in trained}, list(rows[0].features)


def top_importances(scores: list[tuple[str, float]], n: int = 10) -> list[tuple[str, float]]:
    return scores[:n]


def one_vs_rest_ranked(df: DataFrame, candidates: list[str], label: str, *, group: str, folds_n: int = 5,
                       top_k: int = 32, c: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per class: the best-correlated features, grouped CV of a balanced logistic model, and its scores."""
    classes = class_list(df, label)
    chosen: dict[str, list[str]] = {}
    for row in metrics.rank_features(df, candidates, label, top_k).orderBy("rank").collect():
        chosen.setdefault(row["class"], []).append(row["feature"])
    parts = []
    for crop in classes:
        rows = df.withColumn("is_crop", F.when(F.col(label) == crop, "yes").otherwise("no"))
        table = folds.fold_table(rows, group, folds_n, seed=seed, stratify="is_crop")
        predicted, _ = out_of_fold(folds.assign_folds(rows, table, group), chosen[crop], "is_crop", "logistic",
                                   classes=["no", "yes"], require_both=True, c=c)
        parts.append(predicted.select(group, F.lit(crop).alias("crop_name"), "is_crop",
                                      F.get("probabilities", F.lit(1)).alias("probability")))
    scored = scale.cut_lineage(reduce(DataFrame.unionByName, parts)).withColumn(
        "predicted_label", F.when(F.coalesce("probability", F.lit(0.0)) >= 0.5, "yes").otherwise("no"))
    keys = ["crop_name"]
    yes = metrics.class_metrics(metrics.confusion(scored, "is_crop", "predicted_label", keys), keys).where("class = 'yes'")
    curve = metrics.ranking_metrics(scored.withColumn("y", (F.col("is_crop") == "yes").cast("int")), "y", "probability", keys)
    return yes.drop("class").join(curve, keys), scored


def compare_feature_sets(df: DataFrame, features: list[str], label: str, kind: str, sets: dict[str, list[str]],
                         **options) -> DataFrame:
    """Per class and family set: out-of-fold precision, recall, F1, support and fold F1."""
    parts = []
    for name, families in sets.items():
        used = [c for c in features if "all" in families or feature_family(c) in families]
        result = cross_validate(df, used, label, kind, **options)
        parts.append(result["row_report"].join(result["row_class_summary"], "class").withColumn("experiment", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("class", "crop")


def pixel_classifier(df: DataFrame, features: list[str], *, label: str = "crop", group: str = "row_id",
                     kinds: tuple[str, ...] = ("logistic", "random_forest"), seed: int = 42,
                     **options) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Grouped, class-balanced CV scores of pixel classifiers with a note on skipped folds."""
    classes = class_list(df, label)
    groups_n = df.select(group).distinct().count()
    predictions, rows = {}, []
    for kind in kinds:
        splits, skipped, row = 0, 0, None
        if groups_n >= 2 and len(classes) >= 2:
            splits = min(5, groups_n)
            table = folds.fold_table(df, group, splits, seed=seed, stratify=label)
            predicted, skipped = out_of_fold(folds.assign_folds(df, table, group), features, label, kind,
                                             classes=classes, seed=seed, **options)
            predictions[kind] = scale.cut_lineage(predicted)
            row = metrics.overall_metrics(metrics.confusion(predictions[kind], label, "predicted")).first()
        scored = row is not None and row["rows"]
        note = ("" if scored and not skipped else f"Skipped {skipped} fold(s): a held-out class was absent from training."
                if scored else "No fold could be evaluated.")
        rows.append((kind, groups_n, len(classes), len(features), splits, row["accuracy"] if scored else None,
                     row["balanced_accuracy"] if scored else None, row["macro_f1"] if scored else None,
                     row["rows"] if scored else 0, note))
    return df.sparkSession.createDataFrame(
        rows, "model string, field_year_count long, class_count long, feature_count long, cv_splits long, "
              "grouped_accuracy double, grouped_balanced_accuracy double, grouped_macro_f1 double, "
              "evaluated_pixels long, notes string"), predictions


# --- regression benchmarks ------------------------------------------------

def knn_regress(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, *,
                block: int = 10_000, pivots: int = 256) -> DataFrame:
    """Mean label of the k nearest training rows by Euclidean distance, ties by key.

    Training rows belong to the nearest of some pivots, drawn by a hash (at most ``pivots``). A cell's radius, and its rows nearest to the
    pivot, bound by the triangle inequality how near its rows can be to a test row and how far the k-th nearest is at most, so a test row meets only cells that may hold one of
    its k. Cells are cut into blocks of bounded size, test rows into blocks by their own cell; a pair of blocks that has anything to compare meets in one task as two matrices. A task returns only the best k of
    each test row, which are merged; pairs of rows are never written out. Rows without a vector are left out.
    """
    import pandas as pd

    kind = test.schema[key].dataType.simpleString()
    train = train.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"),
                         F.col(label).cast("double").alias("y")).where("v is not null")
    test = test.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v")).where("__v is not null")
    wanted = min(pivots, 4 * max(1, -(-train.count() // block)))
    chosen = [r.v for r in train.orderBy(F.xxhash64("k"), "k").limit(wanted).select("v").collect()]
    if not chosen:
        return test.select(F.col("__key").alias(key), F.lit(None).cast("double").alias("predicted"))
    centres = np.array(chosen)

    def apart(column: pa.ListArray) -> np.ndarray:
        """Distances of an Arrow column of vectors to all pivots."""
        v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return np.sqrt(np.maximum((v ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)[None, :] - 2 * v @ centres.T, 0.0))

    def in_cells(batches):
        for batch in batches:
            if batch.num_rows:
                distance = apart(batch.column("v"))
                cell = distance.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance.min(axis=1))], names=["k", "v", "y", "cell", "r"])

    def reach(batches):
        """Per cell of a task: rows, largest distance to the pivot and the k smallest ones."""
        sizes, near = np.zeros(len(centres), dtype=np.int64), [np.zeros(0)] * len(centres)
        far = np.zeros(len(centres))
        for batch in batches:
            cell, r = batch.column("cell").to_numpy(), batch.column("r").to_numpy()
            for c in np.unique(cell):
                own = r[cell == c]
                sizes[c] += len(own)
                far[c] = max(far[c], own.max())
                near[c] = np.sort(np.concatenate([near[c], own]))[:k]
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sizes[some]), pa.array(far[some]), pa.array([near[c] for c in some], pa.list_(pa.float64()))], names=["cell", "n", "far", "near"])

    celled = scale.cut_lineage(train.mapInArrow(in_cells, f"k {kind}, v array<double>, y double, cell int, r double"))
    summary = celled.select("cell", "r").mapInArrow(reach, "cell int, n bigint, far double, near array<double>").groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    cells = {r.cell: r for r in summary.collect()}  # a row for each pivot at most
    places = np.array(sorted(cells))
    far = np.array([cells[c].far for c in places])
    blocks = {int(c): -(-cells[c].n // block) for c in places}
    spread = np.full((len(places), k), np.inf)
    for i, c in enumerate(places):
        spread[i, :len(cells[c].near)] = cells[c].near

    def to_cells(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                distance = apart(part.column("__v"))[:, places]
                # The k-th smallest of what the triangle inequality allows at most.
                upper = (distance[:, :, None] + spread[None]).reshape(part.num_rows, -1)
                bound = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
                may = distance - far <= (bound * (1 + 1e-9) + 1e-9)[:, None]
                meets = [[{"cell": int(c), "sub": sub} for c in places[row] for sub in range(blocks[int(c)])] for row in may]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places[distance.argmin(axis=1)].astype(np.int32)), pa.array(meets, pa.list_(pa.struct([("cell", pa.int32()), ("sub", pa.int32())])))],
                                                 names=["__key", "__v", "home", "meets"])

    asked = scale.cut_lineage(test.mapInArrow(to_cells, f"__key {kind}, __v array<double>, home int, meets array<struct<cell:int,sub:int>>"))
    homes = asked.groupBy("home").agg(F.ceil(F.count("*") / block).alias("__parts"))
    asked = asked.join(F.broadcast(homes), "home").withColumn("lot", F.pmod(F.xxhash64("__key"), F.col("__parts")).cast("int"))
    pair = ["home", "lot", "cell", "sub"]
    asked = asked.select("__key", "__v", "home", "lot", F.explode("meets").alias("m")).select("__key", "__v", "home", "lot", "m.*")
    of = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]), F.col("cell"))
    known = celled.withColumn("sub", F.pmod(F.xxhash64("k"), of).cast("int"))
    met = asked.select(*[F.col(c).alias(f"b_{c}") for c in pair]).distinct()
    known = known.join(met, (F.col("cell") == F.col("b_cell")) & (F.col("sub") == F.col("b_sub"))).select("k", "v", "y", *[f"b_{c}" for c in pair])

    def nearest(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(base):
            return pd.DataFrame({"__key": [], "k": [], "d": [], "y": []})
        base = base.sort_values("k", kind="stable")
        matrix, q = np.stack(base["v"].to_numpy()), np.stack(queries["__v"].to_numpy())
        parts = []
        names, keys, labels, norms = queries["__key"].to_numpy(), base["k"].to_numpy(), base["y"].to_numpy(), (matrix ** 2).sum(axis=1)
        least = min(k, len(matrix))
        for rows in np.array_split(np.arange(len(q)), max(1, len(q) // 100)):
            d = ((q[rows] ** 2).sum(axis=1)[:, None] + norms[None, :] - 2 * q[rows] @ matrix.T)
            # Only what may round to the k-th least distance is put in order: by distance, ties by key.
            row, at = np.nonzero(d <= np.maximum(np.partition(d, least - 1, axis=1)[:, least - 1:least], 0.0) + 1e-11)
            near = d[row, at]
            order = np.lexsort((at, np.round(np.maximum(near, 0.0), 12), row))
            row, at, near = row[order], at[order], near[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < least
            parts.append(pd.DataFrame({"__key": names[rows][row[best]], "k": keys[at[best]], "d": near[best], "y": labels[at[best]]}))
        return pd.concat(parts, ignore_index=True)

    pairs = asked.groupBy(*pair).cogroup(known.groupBy(*[f"b_{c}" for c in pair]))
    found = pairs.applyInPandas(nearest, f"__key {kind}, k {kind}, d double, y double")
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.round("d", 12).alias("d"), "k", "y"))), 1, k)
    total = F.aggregate("n", F.lit(0.0), lambda a, e: a + e["y"])
    return found.groupBy(F.col("__key").alias(key)).agg(best.alias("n")).select(
        key, (total / F.size("n")).alias("predicted"))


def historical_benchmark(df: DataFrame, *, label: str = "hg/ha_yield", categorical: tuple[str, ...] = ("Area", "Item"),
                         key: str | None = None, test_size: float = 0.3, folds_n: int = 5, seed: int = 42,
                         kinds: tuple[str, ...] = ("linear", "random_forest", "boosted", "knn", "tree", "bagging"),
                         **options) -> DataFrame:
    """Regressors on one split and shuffled folds, best test R² first.

    Preprocessing is learned on each training part: medians, deviations and
    categories never see test rows.
    """
    numeric = [c for c in df.columns if c not in (*categorical, label, key)]
    rows = df.withColumn("label", F.col(f"`{label}`").cast("double"))
    rows = rows.withColumn("__id", scale.row_hash(df)) if key is None else rows.withColumn("__id", F.col(key))
    draw = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(10_000)) / 10_000
    rows = scale.cut_lineage(folds.shuffled_folds(rows.withColumn("__test", draw < test_size), "__id", folds_n, seed=seed + 1))

    def prepared(test_rows):
        """Encoded rows of one split, shared by all models."""
        both = rows.withColumn("__train", ~test_rows).where(F.col("__train").isNotNull())
        both = linear.impute_median(both, [], numeric, training=F.col("__train"))
        both = linear.standardise(both, [], numeric, training=F.col("__train"))
        stages = [StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"),
                  OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical]),
                  VectorAssembler(inputCols=[*numeric, *[f"{c}__v" for c in categorical]], outputCol="features")]
        encoder = Pipeline(stages=stages).fit(both.where("__train"))
        return scale.cut_lineage(encoder.transform(both).select("__id", "__train", "label", "features"))

    def scored(kind, part, ready):
        """Scores of a model on a split; the model itself is let go."""
        train, test = ready.where("__train"), ready.where("NOT __train")
        if kind == "knn":
            near = knn_regress(train.withColumn("v", vector_to_array("features")),
                               test.withColumn("v", vector_to_array("features")), "__id", "v", "label")
            predicted = test.select("__id", "label").join(near, "__id")
        elif kind in ("random_forest", "bagging"):
            lots = forest_lots(regressor(kind, **options), sizes[part])
            predicted = test.select("__id", "label", "features", F.lit(0.0).alias("__sum"))
            for place, trees in enumerate(lots):
                model = regressor(kind, seed=seed + 1_000_003 * place, **{**options, "trees": trees}).fit(train)
                predicted = model.transform(predicted).select("__id", "label", "features", (F.col("__sum") + trees * F.col("predicted")).alias("__sum"))
                predicted = scale.cut_lineage(predicted) if len(lots) > 1 else predicted
            predicted = predicted.select("__id", "label", (F.col("__sum") / sum(lots)).alias("predicted"))
        else:
            predicted = regressor(kind, seed=seed, **options).fit(train).transform(test).select("__id", "label", "predicted")
        predicted = predicted.withColumns({"model": F.lit(kind), "part": F.lit(part)})
        return scale.cut_lineage(metrics.regression_metrics(predicted, ["model", "part"], actual="label"))

    splits = {-1: F.col("__test"), **{f: F.col("fold") == f for f in range(folds_n)}}
    ready = dict(zip(splits, at_once(df.sparkSession, [lambda t=t: prepared(t) for t in splits.values()])))
    n = rows.count()
    sizes = {p: n - test for p, test in zip(splits, rows.agg(*[F.count_if(t) for t in splits.values()]).first())}
    width = ready[-1].select(F.max(F.size(vector_to_array("features")))).first()[0] or 0
    together = "boosted" in kinds and width * n <= BOOSTED_VALUES and not rows.where(F.col("label").isNull()).limit(1).count()

    def boosted():
        predicted = boosted_in_tasks(ready, **{k: v for k, v in options.items() if k == "iterations"}).withColumn("model", F.lit("boosted"))
        return scale.cut_lineage(metrics.regression_metrics(predicted, ["model", "part"], actual="label"))

    fits = [lambda k=k, p=p: scored(k, p, ready[p]) for k in kinds for p in splits if k != "boosted" or not together]
    parts = at_once(df.sparkSession, [*([boosted] if together else []), *fits])
    per_part = scale.cut_lineage(reduce(DataFrame.unionByName, parts))
    test_part, fold_part = F.col("part") == -1, F.col("part") >= 0
    return per_part.groupBy("model").agg(
        F.max(F.when(test_part, F.col("r2"))).alias("test_r2"),
        F.max(F.when(test_part, F.col("rmse") * F.col("rmse"))).alias("mse"),
        F.max(F.when(test_part, F.col("mae"))).alias("mae"), F.max(F.when(test_part, F.col("mape"))).alias("mape"),
        F.avg(F.when(fold_part, F.col("r2"))).alias("cv_mean_r2")).orderBy(F.desc("test_r2"))
