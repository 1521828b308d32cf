"""Train/test splits, fold tables and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow import scale

# Draws of a class and size are ranked in so many cells (a power of two), which are then counted.
CELL_BITS = 12


def spatial_group(pid: str = "pid", prefix: int = 6) -> Column:
    return F.substring(F.col(pid), 1, prefix)


def _hash(column: str, seed: int) -> Column:
    """A seeded draw per key that any engine can repeat: 60 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def fold_table(df: DataFrame, group: str, folds: int, *, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """(group, fold): whole groups spread so folds, and classes within folds, stay even.

    A group that is larger than an even share of what the larger ones leave has a fold of its own; there are fewer of these than folds. All others are dealt
    out within their main class, largest first and in the order of a draw among equals, to and fro over the remaining folds; a class begins at a fold drawn by its name.
    Only group counts are looked at. Their ranks come from counted cells of (class, size, draw), so no class meets in one task.
    """
    if stratify:
        name = F.col(stratify).cast("string")
        counts = df.groupBy(group, stratify).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("rows"), F.max_by(name, F.struct("n", name)).alias("__class"))
    else:
        counts = df.groupBy(group).agg(F.count("*").alias("rows"), F.lit("").alias("__class"))
    counts = scale.cut_lineage(counts.withColumns({"draw": _hash(group, seed), "__class": F.coalesce("__class", F.lit(""))}))
    total = F.lit(counts.agg(F.sum("rows")).first()[0] or 0)
    largest = Window.partitionBy(F.lit(0)).orderBy(F.desc("rows"), "draw", group)
    above = largest.rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as folds.
    top = counts.orderBy(F.desc("rows"), "draw", group).limit(folds).withColumns({"fold": F.row_number().over(largest) - 1, "__before": F.coalesce(F.sum("rows").over(above), F.lit(0))})
    fits = F.col("rows") * (folds - F.col("fold")) < total - F.col("__before")
    own = scale.cut_lineage(top.withColumn("__fits", F.max(fits).over(largest)).where(~F.col("__fits")).select(group, F.col("fold").cast("int").alias("fold")))
    alone = own.count()
    marked = counts.join(F.broadcast(own.select(F.col(group).alias("__own"))), F.col(group).eqNullSafe(F.col("__own")), "left_anti") \
        .withColumn("__cell", F.shiftright("draw", 60 - CELL_BITS))
    cell = ["__class", "rows", "__cell"]
    before = Window.partitionBy("__class").orderBy(F.desc("rows"), "__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(*cell).agg(F.count("*").alias("__n")).select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = scale.attach(marked.withColumn("__at", F.row_number().over(Window.partitionBy(*cell).orderBy("draw", group))), starts, cell)
    left = max(1, folds - alone)
    place = F.col("__start") + F.col("__at") - 1 + F.pmod(F.conv(F.substring(F.md5("__class"), 1, 15), 16, 10).cast("bigint"), F.lit(left))
    step = F.pmod(place, F.lit(left))
    forward = F.pmod(F.floor(place / left), F.lit(2)) == 0
    dealt = ranked.select(group, (alone + F.when(forward, step).otherwise(left - 1 - step)).cast("int").alias("fold"))
    return own.unionByName(dealt)


def assign_folds(df: DataFrame, table: DataFrame, group: str) -> DataFrame:
    return scale.attach(df, table, [group])


def repeated_folds(df: DataFrame, group: str, folds: int, repeats: int, *, seed: int = 42,
                   stratify: str | None = None) -> DataFrame:
    """Fold tables of several repeats, each drawn with its own seed."""
    parts = [fold_table(df, group, folds, seed=seed + r, stratify=stratify).withColumn("repeat", F.lit(r))
             for r in range(repeats)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, *, seed: int = 42,
                     max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Row folds with every class dealt out in turn, in hash order."""
    rows = scale.ranked(df.withColumn("__draw", _hash(key, seed)), [label], [F.col("__draw"), F.col(key)], "__r",
                        max_group=max_group)
    return rows.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(folds)).cast("int")).drop("__r", "__draw")


def shuffled_folds(df: DataFrame, key: str, folds: int, *, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(_hash(key, seed), F.lit(folds)).cast("int"))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    return df.withColumn("fold", F.col(group))


def grouped_holdout(df: DataFrame, group: str, test_share: float = 0.25, *, seed: int = 42,
                    max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Mark whole groups as test: the first share of groups in hash order."""
    groups = df.select(group).distinct().withColumn("__draw", _hash(group, seed))
    placed = scale.ranked(groups, [], [F.col("__draw"), F.col(group)], "__r", max_group=max_group)
    total = groups.count()
    marked = placed.select(group, (F.col("__r") <= F.ceil(F.lit(test_share * total))).alias("is_test"))
    return scale.attach(df, marked, [group])


def stratified_holdout(df: DataFrame, label: str, key: str, test_share: float = 0.25, *, seed: int = 42,
                       max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    rows = scale.ranked(df.withColumn("__draw", _hash(key, seed)), [label], [F.col("__draw"), F.col(key)], "__r",
                        max_group=max_group)
    rows = scale.with_group_stats(rows, [label], {"__n": F.count("*")})
    return rows.withColumn("is_test", F.col("__r") <= F.round(F.col("__n") * test_share)).drop("__r", "__n", "__draw")


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights: rows / (classes × rows of the class)."""
    counts = scale.cut_lineage(df.groupBy(label).agg(F.count("*").alias("__n")))
    totals = counts.agg(F.sum("__n").alias("__rows"), F.count("*").alias("__k"))
    weights = scale.attach(counts, totals, []).select(
        label, (F.col("__rows") / (F.col("__k") * F.col("__n"))).alias(name))
    return scale.attach(df, weights, [label])


def training_mean(df: DataFrame, keys: list[str], fold: str, value: str, name: str = "pred_baseline") -> DataFrame:
    """Mean of the other folds for every row: (all − own fold) / (n − own n), from one aggregate."""
    sums = scale.cut_lineage(df.groupBy(*keys, fold).agg(F.sum(value).alias("__s"), F.count(value).alias("__n")))
    totals = sums.groupBy(*keys).agg(F.sum("__s").alias("__ts"), F.sum("__n").alias("__tn"))
    means = scale.attach(sums, totals, keys)
    means = means.select(*keys, fold, F.try_divide(F.col("__ts") - F.col("__s"), F.col("__tn") - F.col("__n")).alias(name))
    return scale.attach(df, means, [*keys, fold])


def check_group_count(df: DataFrame, group: str, folds: int) -> None:
    found = df.select(group).distinct().limit(folds).count()
    if found < folds:
        raise ValueError(f"Need at least {folds} groups for grouped folds, but found {found}.")
