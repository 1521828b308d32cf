"""Unions, de-duplication, batches, samples and status tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return scale.first_per_key(df, keys, order)


def concat_dedupe(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union with the first row per key; a part's position comes before its row order."""
    numbered = [part.withColumn("__part", F.lit(i)) for i, part in enumerate(parts)]
    return scale.first_per_key(union_all(numbered), keys, [F.col("__part"), *order]).drop("__part")


def batch_ranges(df: DataFrame, order: list[Column], batches: int, assignees: list[str], *,
                 max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Contiguous, near-equal batches in source order, with a round-robin assignee."""
    rows = scale.attach(scale.ranked(df, [], order, "__rank", max_group=max_group),
                        df.agg(F.count("*").alias("__total")), [])
    number = F.floor((F.col("__rank") * batches - 1) / F.col("__total"))
    names = F.array(*[F.lit(a) for a in assignees])
    return rows.withColumns({
        "feature_index": F.col("__rank") - 1,
        "batch_id": F.format_string("batch_%02d", number + 1),
        "assignee": F.get(names, F.pmod(number, F.lit(len(assignees))).cast("int"))}).drop("__rank", "__total")


def fixed_batches(df: DataFrame, order: list[Column], size: int, *,
                  max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    rows = scale.ranked(df, [], order, "__rank", max_group=max_group)
    return rows.withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def select_batch(df: DataFrame, batch_id: str) -> DataFrame:
    rows = df.where(F.col("batch_id") == batch_id)
    if rows.isEmpty():
        raise ValueError(f"Unknown batch {batch_id}")
    return rows


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Seeded sample without replacement: the n smallest hashes, independent of partitioning."""
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("__draw", draw).orderBy("__draw").limit(n).drop("__draw")


def upsert_status(table: DataFrame, changes: DataFrame, key: str = "batch_id", notes: str = "notes") -> DataFrame:
    """Write changed cells over a status table; notes are appended with ' | '."""
    changed = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    base = table.withColumns({c: F.lit(None).cast(changes.schema[c].dataType)
                              for c in changed if c not in table.columns})
    joined = base.join(renamed, key, "left")
    out = {}
    for c in changed:
        if c == notes:
            out[c] = F.concat_ws(" | ", F.nullif(F.col(c), F.lit("")), F.nullif(F.col(f"__{c}"), F.lit("")))
        else:
            out[c] = F.coalesce(F.col(f"__{c}"), F.col(c))
    return joined.withColumns(out).select(*base.columns)


def dataset_summary(df: DataFrame, area: str = "Area", item: str = "Item", year: str = "Year") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.count_distinct(area).alias("areas"), F.count_distinct(item).alias("items"),
                  F.min(year).alias("year_min"), F.max(year).alias("year_max"))


def clean_history(raw: DataFrame) -> DataFrame:
    """Historical records with seven typed columns; the exported index column is dropped."""
    kinds = {"Area": "string", "Item": "string", "Year": "int", "hg/ha_yield": "double",
             "average_rain_fall_mm_per_year": "double", "pesticides_tonnes": "double", "avg_temp": "double"}
    return raw.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def status_counts(df: DataFrame, counters: dict[str, Column], kind: str = "counter") -> DataFrame:
    """Row counts of several columns in one pass: (counter, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias(kind), value.cast("string").alias("value"))
                                for name, value in counters.items()]))
    return df.select(pairs.alias("__p")).select("__p.*").groupBy(kind, "value").agg(F.count("*").alias("n"))


def flag_counts(df: DataFrame, flags: str = "qa_flags") -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def experiment_pivot(metrics: DataFrame, experiments: list[str], value: str, key: str = "crop") -> DataFrame:
    """One row per crop with an experiment per column and the last less the first."""
    wide = metrics.groupBy(key).agg(*[F.max(F.when(F.col("experiment") == e, F.col(value))).alias(e)
                                      for e in experiments])
    return wide.withColumn("delta", F.col(experiments[-1]) - F.col(experiments[0]))


def identical_experiments(metrics: DataFrame, experiments: list[str], value: str) -> bool:
    """True when every crop scores the same in all experiments: the feature sets did not differ."""
    wide = experiment_pivot(metrics, experiments, value)
    return wide.where(F.greatest(*experiments) != F.least(*experiments)).isEmpty()
