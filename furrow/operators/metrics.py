"""Regression and classification scores as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale


def regression_metrics(df: DataFrame, keys: list[str], actual: str = "yield", predicted: str = "predicted",
                       baseline: str | None = None) -> DataFrame:
    """Rows, MAE, RMSE, bias, R², MAPE and skill against a baseline prediction, per group."""
    y, error = F.col(actual), F.col(predicted) - F.col(actual)
    spread = F.var_pop(y) * F.count(y)
    aggs = [F.count(error).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(error).alias("bias"),
            F.when(F.min(y) != F.max(y), 1 - F.try_divide(F.sum(error * error), spread)).alias("r2"),
            F.avg(F.abs(F.try_divide(error, y))).alias("mape")]
    if baseline:
        aggs.append(F.avg(F.abs(F.col(baseline) - y)).alias("baseline_mae"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn("skill", 1 - F.try_divide("mae", "baseline_mae")) if baseline else out


def with_pooled(df: DataFrame, keys: list[str], unit: str = "yield_unit", pooled: str = "bu/ac",
                crop: str = "crop", **options) -> DataFrame:
    """Scores per crop and unit, plus one row over all crops reported in the pooled unit."""
    both = F.array(F.col(crop), *[F.when(F.col(unit) == pooled, F.lit(f"all {pooled} crops"))])
    rows = df.withColumn(crop, F.explode(F.array_compact(both)))
    return regression_metrics(rows, keys, **options)


def confusion(df: DataFrame, truth: str, predicted: str, keys: list[str] = []) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, keys: list[str] = []) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction."""
    hit = F.col("truth") == F.col("predicted")
    sides = F.array(F.struct(F.col("truth").alias("class"), F.lit(True).alias("is_truth")),
                    F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_truth")))
    long = matrix.select(*keys, "n", hit.alias("hit"), F.explode(sides).alias("s")).select(*keys, "n", "hit", "s.*")
    zero = F.lit(0)
    counts = long.groupBy(*keys, "class").agg(
        F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), zero).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("is_truth"), F.col("n"))), zero).alias("predicted_n"),
        F.coalesce(F.sum(F.when(F.col("is_truth") & F.col("hit"), F.col("n"))), zero).alias("tp"))
    precision = F.coalesce(F.try_divide("tp", "predicted_n"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted_n")), F.lit(0.0))
    return counts.select(*keys, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def overall_metrics(matrix: DataFrame, keys: list[str] = []) -> DataFrame:
    """Accuracy, balanced accuracy and macro-F1 over the classes present in truth."""
    classes = class_metrics(matrix, keys).where("support > 0")
    return classes.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("rows"))


def ranking_metrics(df: DataFrame, label: str, score: str, keys: list[str] = [], *,
                    max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """ROC AUC (average ranks) and average precision of a score, per group.

    Scores are counted first; running totals over distinct scores replace a sort of the rows.
    """
    y = F.col(label).cast("int")
    points = scale.cut_lineage(df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    down = scale.prefix_sums(points, keys, [F.col(score).desc()], {
        "pos_above": F.col("pos"), "neg_above": F.col("neg")}, max_group=max_group)
    total_p, total_n = F.sum("pos"), F.sum("neg")
    # Negatives at or above a score lose to it: below = all − above, ties count half.
    area = F.sum(F.col("pos") * (F.col("neg_above") - F.col("neg") / 2))
    precision = F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))
    return down.groupBy(*keys).agg(
        (1 - F.try_divide(area, (total_p * total_n).cast("double"))).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), total_p.cast("double")).alias("average_precision"),
        total_p.alias("positives"), (total_p + total_n).alias("evaluated_rows"))


def fold_summary(folds: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean, population deviation and count over folds."""
    return folds.groupBy(*keys).agg(*[e for v in values for e in (
        F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_folds"))])


def field_vote(rows: DataFrame, pid: str, truth: str, probabilities: str, classes: list[str],
               keys: list[str] = []) -> DataFrame:
    """Field labels: class with the highest mean probability, and the majority true label.

    Ties go to the smallest class in both.
    """
    means = F.array(*[F.avg(F.get(F.col(probabilities), F.lit(i))) for i in range(len(classes))])
    voted = rows.groupBy(*keys, pid).agg(means.alias("__p")).withColumn(
        "predicted", F.get(F.array(*[F.lit(c) for c in classes]),
                           (F.array_position("__p", F.array_max("__p")) - 1).cast("int"))).drop("__p")
    labels = rows.groupBy(*keys, pid, truth).agg(F.count("*").alias("__n")).groupBy(*keys, pid).agg(
        F.min_by(truth, F.struct(-F.col("__n"), F.col(truth))).alias("truth"))
    return voted.join(labels, keys + [pid])


def class_field_counts(df: DataFrame, label: str = "crop_label", pid: str = "pid") -> DataFrame:
    return df.groupBy(label).agg(F.count_distinct(pid).alias("fields"))


def feature_correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """|Pearson r| of each feature with membership of each class, over rows where the feature is finite.

    One aggregate per class holds count, mean and variance of every feature; the
    correlation with a class indicator follows from those, so all classes cost one
    pass. Undefined correlations are 0.
    """
    def finite(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)

    per_class = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(*[
        F.struct(F.lit(f).alias("feature"), F.count(finite(f)).alias("n"), F.avg(finite(f)).alias("mean"),
                 F.var_pop(finite(f)).alias("var")).alias(f"__f{i}") for i, f in enumerate(features)])
    # One row per class and feature from here on.
    long = scale.cut_lineage(per_class.select("class", F.explode(F.array(*[f"__f{i}" for i in range(len(features))])).alias("s"))
                             .select("class", "s.*"))
    total = long.groupBy("feature").agg(F.sum("n").alias("all_n"), F.try_divide(
        F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("all_mean"))
    rows = scale.attach(long, total, ["feature"])
    spread = rows.groupBy("feature").agg((F.try_divide(F.sum(
        F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("all_mean"), 2))), F.first("all_n"))).alias("all_var"))
    rows = scale.attach(rows, spread, ["feature"])
    share = F.try_divide("n", "all_n")
    r = F.try_divide(share * (F.col("mean") - F.col("all_mean")), F.nullif(F.sqrt(F.col("all_var") * share * (1 - share)), F.lit(0.0)))
    return rows.select("class", "feature", F.coalesce(F.abs(r), F.lit(0.0)).alias("abs_r"))


def rank_features(df: DataFrame, features: list[str], label: str, k: int) -> DataFrame:
    """The k features most correlated with each class against the rest; ties keep column order."""
    from pyspark.sql import Window
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    # One row per class and feature, so a window group is bounded by the feature list.
    position = F.row_number().over(Window.partitionBy("class").orderBy(F.col("abs_r").desc(), order))
    return feature_correlations(df, features, label).withColumn("rank", position).where(F.col("rank") <= k).select(
        "class", "rank", "feature", "abs_r")
