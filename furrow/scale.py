"""Building blocks that keep one oversized group from landing in one task.

Every operator that looks at a whole group (means, quantiles, ranks, running
totals) goes through one of these. Group statistics are aggregated first, so
map-side combining shrinks a hot group before any shuffle, and are joined back
by broadcast only after their size has been checked. Ordered work is cut into
range chunks when a group is larger than one task should hold.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000
SALTS = 32


def cut_lineage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives lost executors.

    Group statistics and loop states are reliable checkpoints. ``wide`` facts that
    several branches read are written as a columnar table, so that each branch
    reads only its own columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not wide:
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over all cores, for costly work on each row of a table that a few tasks read; else left as they are."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * most, *keys) if df.rdd.getNumPartitions() < most else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="furrow-checkpoint-"))
    else:
        raise ValueError("Set spark.checkpoint.dir to a folder every executor can reach.")


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """What a value takes, about: the real length of text and arrays."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("bigint"), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            each = F.transform(value, lambda x: _value_bytes(x, kind.elementType))
            return F.coalesce(F.aggregate(each, F.lit(8).cast("bigint"), lambda total, x: total + x), F.lit(8))
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("bigint") * (8 * fields) + 8
    if isinstance(kind, T.MapType):
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("bigint") * 64 + 8
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    return F.lit(8).cast("bigint")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL in ``columns``.

    One condition per column: a single many-column test (as dropna makes) multiplies
    the optimizer's constraints with every later alias.
    """
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])) if columns else df


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the summed sizes of a bounded number of rows show the table is small; else leave it alone."""
    most = max(1, max_bytes // (16 + 8 * len(df.columns)))
    width = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("bigint"))
    rows, size = df.select(width.alias("__width")).limit(most + 1).agg(F.count("*"), F.sum("__width")).first()
    small = rows <= most and (size or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small


def row_hash(df: DataFrame) -> Column:
    """A hash of the row's content: the same after a retried task, unlike generated ids."""
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*hashable)


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows. There are at most total / rows of them, so they broadcast."""
    rows = HOT_KEY_ROWS if rows is None else rows
    return cut_lineage(df.groupBy(*keys).count().where(F.col("count") > rows).select(*keys))


def skew_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", *,
              condition: Column | None = None, small: bool | None = None,
              max_bytes: int = MAX_BROADCAST_BYTES, hot_rows: int | None = None, rows: str | None = None,
              hot: DataFrame | None = None) -> DataFrame:
    """Join ``dim`` to ``facts`` on NULL-safe keys so that no hot key meets in one task.

    A small ``dim`` (checked, or vouched for by the caller) is broadcast. Otherwise
    both sides shuffle by key, and only keys that are hot in ``facts`` are spread:
    their facts over salted tasks, their ``dim`` rows copied to each. Hot keys are counted in
    ``facts``, unless ``dim`` has a column ``rows`` with (at least) each key's rows there; it is dropped.
    ``hot`` then adds keys that ``dim`` lacks.
    """
    if rows is not None:
        counted = dim.where(F.col(rows) > (HOT_KEY_ROWS if hot_rows is None else hot_rows)).select(*keys)
        hot = counted if hot is None else counted.union(hot.select(*keys)).distinct()
        dim = dim.drop(rows)
    dim = dim.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    if small is None:
        dim, small = broadcast_if_small(dim, max_bytes)
    elif small:
        dim = F.broadcast(dim)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if condition is not None:
        on.append(condition)
    drop = [f"__k_{k}" for k in keys]
    if not small and keys:
        hot = hot_keys(facts, keys, hot_rows) if hot is None else hot
        if not hot.isEmpty():
            mark = F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))

            def marked(df: DataFrame, prefix: str) -> DataFrame:
                same = [F.col(f"{prefix}{k}").eqNullSafe(F.col(f"__h_{k}")) for k in keys]
                return df.join(mark, reduce(lambda a, b: a & b, same), "left").drop(*[f"__h_{k}" for k in keys])

            salt = F.when(F.col("__hot"), F.pmod(row_hash(facts), F.lit(SALTS))).otherwise(F.lit(0))
            facts = marked(facts, "").withColumn("__salt", salt.cast("int")).drop("__hot")
            copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            dim = marked(dim, "__k_").withColumn("__copy", F.explode(copies)).drop("__hot")
            on.append(F.col("__salt") == F.col("__copy"))
            drop += ["__salt", "__copy"]
    return facts.join(dim, reduce(lambda a, b: a & b, on or [F.lit(True)]), how).drop(*drop)


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "left", *, small: bool | None = None,
           max_bytes: int = MAX_BROADCAST_BYTES, hot_rows: int | None = None, rows: str | None = None) -> DataFrame:
    """Put a table with one row per key onto the rows of ``df``; NULL keys match NULL keys.

    ``stats`` is written to the checkpoint folder once, so chained statistics do
    not recompute each other; then see ``skew_join``, also for ``rows``. A caller that has already
    checked a bound on the size passes ``small``. Without keys the one row becomes constants.
    """
    if not keys:
        row = stats.first()
        return df.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in stats.schema.fields})
    if small is None:
        stats = cut_lineage(stats)
    return skew_join(df, stats, keys, how, small=small, max_bytes=max_bytes, hot_rows=hot_rows, rows=rows)


def with_group_stats(df: DataFrame, keys: list[str], aggs: dict[str, Column], **options) -> DataFrame:
    """Aggregate over ``keys`` and put the results on every row; the same pass counts each key's rows, which tells the hot ones."""
    named = [expr.alias(name) for name, expr in aggs.items()]
    if not keys:
        return attach(df, df.agg(*named), keys, **options)
    return attach(df, df.groupBy(*keys).agg(*named, F.count("*").alias("__key_rows")), keys, rows="__key_rows", **options)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the biggest group (0 when empty); counting combines map-side."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], *,
                max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """Inclusive running totals in ``order`` within ``keys``.

    Groups that fit one task use a plain window. Otherwise rows are range
    partitioned on (keys, order), each chunk is summed, and chunk offsets (one
    row per chunk) are added to within-chunk totals.
    """
    def running(rows: DataFrame, part: list[str]) -> DataFrame:
        frame = Window.partitionBy(*(part or [F.lit(0)])).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(expr).over(frame).alias(name) for name, expr in sums.items()])

    if largest_group(df, keys) <= max_group:
        return running(df, keys)

    chunked = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order, row_hash(df))
        .withColumn("__chunk", F.spark_partition_id()), wide=True)
    part = keys + ["__chunk"]
    totals = chunked.groupBy(*part).agg(*[F.sum(expr).alias(f"__{name}") for name, expr in sums.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}")
                                     for name in sums])
    out = attach(running(chunked, part), offsets, part)
    out = out.withColumns({name: F.col(name) + F.col(f"__{name}") for name in sums})
    return out.drop("__chunk", *[f"__{name}" for name in sums])


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", *,
           max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """Row number from 1 within ``keys``; ``order`` should decide every tie."""
    return prefix_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, max_group=max_group)


def group_quantiles(df: DataFrame, keys: list[str], specs: dict[str, tuple[Column, float]], *,
                    aggs: dict[str, Column] | None = None,
                    max_group: int = MAX_GROUP_ROWS) -> DataFrame:
    """Exact interpolated quantiles per group, with other aggregates alongside.

    ``specs`` maps an output name to (value, probability); NULLs are ignored.
    Oversized groups are ranked through (value, count) pairs in range chunks
    instead of one in-memory histogram.
    """
    others = [expr.alias(name) for name, expr in (aggs or {}).items()]
    if largest_group(df, keys) <= max_group:
        # Quantiles of one value share a histogram.
        shared: dict[str, list[str]] = {}
        for name, (value, _) in specs.items():
            shared.setdefault(str(value), []).append(name)
        made = [F.percentile(specs[names[0]][0], F.array(*[F.lit(specs[n][1]) for n in names])).alias(f"__q{i}")
                for i, names in enumerate(shared.values())]
        place = {n: F.get(f"__q{i}", F.lit(j)) for i, names in enumerate(shared.values()) for j, n in enumerate(names)}
        return df.groupBy(*keys).agg(*made, *others).select(
            *keys, *[place[n].alias(n) for n in specs], *(aggs or {}))

    rows = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("__name"), F.lit(p).alias("__p"), value.cast("double").alias("__v"))
        for name, (value, p) in specs.items()])).alias("__e")).select(*keys, "__e.*")
    pairs = cut_lineage(rows.where(F.col("__v").isNotNull()).groupBy(*keys, "__name", "__p", "__v")
                        .agg(F.count("*").alias("__n")))
    part = keys + ["__name"]
    placed = prefix_sums(pairs, part, [F.col("__v")], {"__cum": F.col("__n")}, max_group=max_group)
    placed = with_group_stats(placed, part, {"__total": F.sum("__n")})
    at = (F.col("__total") - 1) * F.col("__p")
    picked = placed.groupBy(*part).agg(
        F.min(F.when(F.col("__cum") > F.floor(at), F.col("__v"))).alias("__lo"),
        F.min(F.when(F.col("__cum") > F.ceil(at), F.col("__v"))).alias("__hi"),
        F.first(at - F.floor(at)).alias("__w"))
    picked = picked.withColumn("__q", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__w"))
    wide = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name) for name in specs])
    base = df.groupBy(*keys).agg(*(others or [F.count("*").alias("__rows")]))
    joined = attach(base, wide, keys).drop("__rows")
    return joined.select(*keys, *specs, *(aggs or {}))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, found by a map-side combined aggregate."""
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*").select(
        *[F.col(f"`{c}`") for c in df.columns])


def fill_forward(df: DataFrame, keys: list[str], position: str, marks: dict[str, Column], *,
                 chunk_rows: int = 100_000, keep_chunk: bool = False) -> DataFrame:
    """Carry the last non-NULL value of each mark over later rows of the same key.

    ``position`` is an integer row number. Rows are cut into chunks of the
    position, so a file of any length is filled by many tasks; one summary row
    per chunk carries the value across chunk borders. With ``keep_chunk`` a
    following call finds the rows already partitioned and sorted.
    """
    chunked = df if "__chunk" in df.columns else df.withColumn("__chunk", F.floor(F.col(position) / F.lit(chunk_rows)))
    part = keys + ["__chunk"]
    within = Window.partitionBy(*part).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    summary = chunked.groupBy(*part).agg(*[
        F.max_by(mark, F.when(mark.isNotNull(), F.col(position))).alias(f"__{name}")
        for name, mark in marks.items()])
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*part, *[F.last(f"__{name}", ignorenulls=True).over(before).alias(f"__{name}")
                                      for name in marks])
    filled = chunked.select("*", *[F.last(mark, ignorenulls=True).over(within).alias(name)
                                   for name, mark in marks.items()])
    filled = attach(filled, carried, part)
    filled = filled.withColumns({name: F.coalesce(F.col(name), F.col(f"__{name}")) for name in marks})
    return filled.drop(*([] if keep_chunk else ["__chunk"]), *[f"__{name}" for name in marks])
