"""Linear models from moments: one distributed aggregate per fit, small solves on its rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import scale

# Penalty grids.
LOO_ALPHAS = [float(a) for a in np.logspace(-2, 5, 29)]
SEASON_ALPHAS = [0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]
# Wider tables switch from generated sum expressions to Arrow-batched matrix products.
MAX_EXPRESSION_FEATURES = 14
FANIN = 64
#: Rows of a key that meet its eigenvectors at once.
LOO_CHUNK_ROWS = 4_096


def impute_median(df: DataFrame, keys: list[str], features: list[str], *, training: Column | None = None,
                  keep_empty: bool = False, max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Fill NULLs with the training rows' exact median per key; all-empty features become 0 if kept."""
    rows = df if training is None else df.where(training)
    medians = scale.group_quantiles(rows, keys, {f"__m{i}": (F.col(c).cast("double"), 0.5)
                                                 for i, c in enumerate(features)}, max_group=max_group)
    out = scale.attach(df, medians, keys)
    last = [F.lit(0.0)] if keep_empty else []
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m{i}"), *last)
                            for i, c in enumerate(features)}).drop(*[f"__m{i}" for i in range(len(features))])


def standardise(df: DataFrame, keys: list[str], features: list[str], *, training: Column | None = None) -> DataFrame:
    """(x − mean) / population deviation of the training rows; constant features become 0."""
    rows = df if training is None else df.where(training)
    stats = rows.groupBy(*keys).agg(*[e for i, c in enumerate(features) for e in (
        F.avg(c).alias(f"__a{i}"), F.stddev_pop(c).alias(f"__s{i}"))])
    out = scale.attach(df, stats, keys)
    return out.withColumns({c: (F.col(c) - F.col(f"__a{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(
        F.col(f"__s{i}")) for i, c in enumerate(features)}).drop(
        *[f"__{k}{i}" for i in range(len(features)) for k in "as"])


def moments(df: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """Per key the flattened matrix ΣzzT of z = (1, features…, label), over complete rows."""
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([*features, label])])
    width = len(features) + 2
    names = [f"__x{i}" for i in range(width - 1)]
    rows = scale.complete(rows, names)
    if len(features) <= MAX_EXPRESSION_FEATURES:
        z = [F.lit(1.0)] + [F.col(n) for n in names]
        upper = {(i, j): F.sum(z[i] * z[j]) for i in range(width) for j in range(i, width)}
        sums = rows.groupBy(*keys).agg(*[e.alias(f"m{i}_{j}") for (i, j), e in upper.items()])
        full = F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)])
        return sums.select(*keys, full.alias("moments"))

    if not keys:
        return moments(df.withColumn("__one", F.lit(0)), ["__one"], features, label).drop("__one")
    key_fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = key_fields + ", __slot int, moments array<double>"

    def partial(batches):
        total: dict = {}
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                z = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float)])
                key = key if isinstance(key, tuple) else (key,)
                total[key] = total.get(key, 0.0) + z.T @ z
        if total:
            slot = abs(hash(next(iter(total.values())).tobytes())) % FANIN
            yield pd.DataFrame([[*key, slot, m.ravel().tolist()] for key, m in total.items()],
                               columns=[*keys, "__slot", "moments"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        out = part.iloc[[0]].copy()
        out["moments"] = [np.sum(np.stack(part["moments"].to_list()), axis=0).tolist()]
        return out

    # Partial sums meet in two steps, so no task holds one row per input partition.
    parts = rows.mapInPandas(partial, schema)
    halfway = parts.groupBy(*keys, "__slot").applyInPandas(add, schema)
    return halfway.groupBy(*keys).applyInPandas(add, schema).drop("__slot")


def centred_moments(flat, p: int):
    """(n, feature means, label mean, deviations, standardised Gram, standardised cross products)."""
    m = np.asarray(flat, dtype=float).reshape(p + 2, p + 2)
    n = m[0, 0]
    mean_x, mean_y = m[0, 1:p + 1] / n, m[0, p + 1] / n
    cov = m[1:p + 1, 1:p + 1] - n * np.outer(mean_x, mean_x)
    var = np.clip(np.diag(cov) / n, 0, None)
    flat_columns = var <= 1e-14 * (1 + mean_x ** 2)
    sd = np.where(flat_columns, 1.0, np.sqrt(var))
    cross = (m[1:p + 1, p + 1] - n * mean_x * mean_y) / sd
    gram = cov / np.outer(sd, sd)
    gram[flat_columns, :] = 0.0
    gram[:, flat_columns] = 0.0
    cross[flat_columns] = 0.0
    return n, mean_x, mean_y, sd, gram, cross


def solve_ridge(flat, p: int, alpha: float) -> tuple[float, list[float]]:
    """Intercept and raw-scale coefficients of ridge on standardised features (alpha 0 is least squares)."""
    n, mean_x, mean_y, sd, gram, cross = centred_moments(flat, p)
    if alpha > 0:
        w = np.linalg.solve(gram + alpha * np.eye(p), cross)
    else:
        w = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ cross
    coef = w / sd
    return float(mean_y - coef @ mean_x), coef.tolist()


def fit_linear(gram: DataFrame, keys: list[str], p: int, alpha: float | str = 0.0) -> DataFrame:
    """Parameters (intercept, coef, n) for every moments row; ``alpha`` is a number or a column."""
    key_fields = "".join(f"`{k}` {gram.schema[k].dataType.simpleString()}, " for k in keys)
    source = gram.withColumn("__alpha", F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha)))

    def solve(batches):
        for batch in batches:
            fits = [solve_ridge(m, p, a) for m, a in zip(batch["moments"], batch["__alpha"])]
            out = batch[keys].copy()
            out["alpha"] = batch["__alpha"].to_numpy()
            out["n"] = [float(m[0]) for m in batch["moments"]]
            out["intercept"] = [f[0] for f in fits]
            out["coef"] = [f[1] for f in fits]
            yield out

    return source.select(*keys, "moments", "__alpha").mapInPandas(
        solve, key_fields + "alpha double, n double, intercept double, coef array<double>")


def linear_value(features: list[str], intercept: str = "intercept", coef: str = "coef") -> Column:
    """intercept + Σ coef·x as one expression; NULL when any feature is NULL."""
    if len(features) <= MAX_EXPRESSION_FEATURES:
        out = F.col(intercept)
        for i, c in enumerate(features):
            out = out + F.get(F.col(coef), F.lit(i)) * F.col(c)
        return out
    terms = F.zip_with(F.array(*[F.col(c).cast("double") for c in features]), F.col(coef), lambda x, w: x * w)
    return F.col(intercept) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def predict_linear(df: DataFrame, params: DataFrame, keys: list[str], features: list[str], name: str) -> DataFrame:
    out = scale.attach(df, params.select(*keys, "intercept", "coef"), keys)
    return out.withColumn(name, linear_value(features)).drop("intercept", "coef")


def ridge_loo(df: DataFrame, keys: list[str], features: list[str], label: str,
              alphas: list[float] = LOO_ALPHAS) -> DataFrame:
    """Ridge per key with the penalty of lowest leave-one-out squared error.

    Moments give each key's eigenvectors, solved in tasks. Complete rows meet them in chunks of a bounded size, so a key of
    any size is many rows and its eigenvectors are copied once a chunk; one pass gives the errors of all penalties. NULL keys are a key.
    """
    if not keys:
        return ridge_loo(df.withColumn("__one", F.lit(0)), ["__one"], features, label, alphas).drop("__one")
    p = len(features)
    gram = scale.cut_lineage(moments(df, keys, features, label))
    spectra = scale.cut_lineage(_spectra(gram.withColumn("__n", F.get("moments", F.lit(0))), keys, p))
    names = [f"__x{i}" for i in range(p + 1)]
    rows = scale.complete(df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip([*features, label], names)]), names)
    place = F.pmod(F.xxhash64(*names), F.ceil(F.col("__n") / LOO_CHUNK_ROWS))
    chunks = scale.attach(rows, spectra.select(*keys, "__n"), keys).groupBy(*keys, place.alias("__chunk")) \
        .agg(F.flatten(F.collect_list(F.array(*names))).alias("__z"))
    errors = _loo_errors(scale.attach(chunks, spectra, keys), keys, p, alphas)
    # Rounded so that penalties with equal error tie, whatever the summation order.
    sums = errors.groupBy(*keys, "__alpha").agg(F.sum("__sse").alias("__sse"))
    best = sums.groupBy(*keys).agg(F.min_by("__alpha", F.struct(F.round("__sse", 9), "__alpha")).alias("__best"))
    return fit_linear(scale.attach(gram, best, keys), keys, p, "__best")


def _spectra(gram: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Per key n, and in one array: label mean, feature means and deviations, eigenvalues, projected cross products, eigenvectors."""
    def decompose(batches):
        for batch in batches:
            out = []
            for flat in batch.column("moments").to_pylist():
                n, mean_x, mean_y, sd, inner, cross = centred_moments(flat, p)
                lam, vec = np.linalg.eigh(inner)
                out.append(np.concatenate([[mean_y], mean_x, sd, np.clip(lam, 0, None), vec.T @ cross, vec.ravel()]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("__n"), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "__n", "__spectrum"])
    schema = T.StructType([*[gram.schema[k] for k in keys], T.StructField("__n", T.DoubleType()), T.StructField("__spectrum", T.ArrayType(T.DoubleType()))])
    return gram.select(*keys, "moments", "__n").mapInArrow(decompose, schema)


def _loo_errors(chunks: DataFrame, keys: list[str], p: int, alphas: list[float]) -> DataFrame:
    """(keys, __alpha, __sse) for each chunk of rows (__z: features and label, row after row)."""
    penalties = np.asarray(alphas, dtype=float)

    def errors(batches):
        for batch in batches:
            out = []
            for z, n, spectrum in zip(batch.column("__z"), batch.column("__n").to_pylist(), batch.column("__spectrum")):
                out.append(_left_out(z.values.to_numpy().reshape(-1, p + 1), n, spectrum.values.to_numpy(), p, penalties))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "__sse"])
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("__sse", T.ArrayType(T.DoubleType()))])
    each = chunks.select(*keys, "__z", "__n", "__spectrum").mapInArrow(errors, schema)
    listed = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("__alpha"), F.col("__sse"))
    return each.select(*keys, F.explode(listed).alias("e")).select(*keys, F.col("e.__alpha").alias("__alpha"), F.col("e.__sse").alias("__sse"))


def _left_out(z: np.ndarray, n: float, spectrum: np.ndarray, p: int, penalties: np.ndarray) -> np.ndarray:
    """Summed squared leave-one-out errors of rows (features and label) for each penalty."""
    mean_y, (mean_x, sd, lam, proj), vec = spectrum[0], spectrum[1:1 + 4 * p].reshape(4, p), spectrum[1 + 4 * p:].reshape(p, p)
    q = ((z[:, :p] - mean_x) / sd) @ vec
    shrink = 1.0 / (lam[:, None] + penalties[None, :])
    leverage = 1.0 / n + (q * q) @ shrink
    residual = z[:, p:] - mean_y - q @ (proj[:, None] * shrink)
    return ((residual / np.maximum(1.0 - leverage, 1e-12)) ** 2).sum(axis=0)


def ridge_loo_held(df: DataFrame, keys: list[str], fold: str, features: list[str], label: str, *, test: int | None = None,
                   alphas: list[float] = LOO_ALPHAS) -> DataFrame:
    """``ridge_loo`` for each key and each of its folds, which is held out as ``__held``, and ``__fill``: what gaps are filled with.

    Gaps are filled with the median of the other folds' rows, 0 where a feature has no value there. Rows of the fold ``test`` teach no model.
    Only rows with gaps are copied to held-out folds: moments of the others are added up by fold, and a chunk of rows meets the
    eigenvectors of all folds of its key at once. NULL keys are a key.
    """
    p, own = len(features), [*keys, "__held"]
    x = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)]
    df = df.select(*keys, F.col(fold).cast("int").alias("__fold"), *x, F.col(label).cast("double").alias("__y")).where("__fold IS NOT NULL")
    names = [f"__x{i}" for i in range(p)]
    lists = scale.cut_lineage(df.groupBy(*keys).agg(F.array_sort(F.collect_set("__fold")).alias("__folds"), F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(f"__g{c}") for c in names]))
    totals = lists.agg(F.lit(0), *[F.sum(f"__g{c}").alias(c) for c in names]).first()
    gappy = [c for c in names if totals[c]]
    train = df if test is None else df.where(F.col("__fold") != test)

    def copied(rows: DataFrame) -> DataFrame:
        """Rows once for each fold of their key that is not theirs."""
        out = scale.attach(rows, lists.select(*keys, "__folds"), keys).withColumn("__held", F.explode("__folds"))
        return out.where(F.col("__fold") != F.col("__held")).drop("__folds")

    helds = lists.select(*keys, F.explode("__folds").alias("__held"))
    fills = helds.withColumn("__fill", F.array(*[F.lit(0.0)] * p))
    holed = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in gappy], F.lit(False))
    parts = copied(scale.cut_lineage(moments(train.where(~holed), [*keys, "__fold"], names, "__y"))).select(*own, "moments")
    if gappy:
        medians = scale.group_quantiles(copied(train.select(*keys, "__fold", *gappy)), own, {f"__m{c}": (F.col(c), 0.5) for c in gappy})
        fills = scale.attach(helds, medians, own).select(*own, F.array(*[F.coalesce(f"__m{c}", F.lit(0.0)) if c in gappy else F.lit(0.0) for c in names]).alias("__fill"))
        fills = scale.cut_lineage(fills)
        filled = scale.attach(copied(train.where(holed)), fills, own).select(*own, "__y", *[F.coalesce(c, F.get("__fill", F.lit(i))).alias(c) for i, c in enumerate(names)])
        parts = parts.unionByName(moments(filled, own, names, "__y"))
    sums = parts.select(*own, F.posexplode("moments").alias("__at", "__v")).groupBy(*own, "__at").agg(F.sum("__v").alias("__v"))
    sums = sums.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__v"))), lambda e: e["__v"]).alias("moments"))
    gram = scale.cut_lineage(scale.attach(sums, fills, own))
    spectra = scale.attach(_spectra(gram.withColumn("__n", F.get("moments", F.lit(0))), own, p), fills, own)
    spectra = scale.cut_lineage(spectra.groupBy(*keys).agg(F.collect_list(F.struct("__held", "__n", "__spectrum", "__fill")).alias("__fits")))
    known = train.where(F.col("__y").isNotNull())
    place = F.pmod(F.xxhash64(*names, "__y"), F.ceil(F.col("__rows") / LOO_CHUNK_ROWS))
    row = F.array(F.col("__fold").cast("double"), *names, "__y")
    chunks = scale.attach(known, lists.select(*keys, "__rows"), keys).groupBy(*keys, place.alias("__chunk")).agg(F.flatten(F.collect_list(row)).alias("__z"))
    errors = _held_errors(scale.attach(chunks, spectra, keys, "inner"), keys, p, alphas)
    totalled = errors.groupBy(*own, "__alpha").agg(F.sum("__sse").alias("__sse"))
    best = totalled.groupBy(*own).agg(F.min_by("__alpha", F.struct(F.round("__sse", 9), "__alpha")).alias("__best"))
    fits = fit_linear(scale.attach(gram.select(*own, "moments"), best, own), own, p, "__best")
    return scale.cut_lineage(scale.attach(fits, fills, own))


def _held_errors(chunks: DataFrame, keys: list[str], p: int, alphas: list[float]) -> DataFrame:
    """(keys, __held, __alpha, __sse) for each chunk of rows (__z: fold, features and label, row after row) and fit of its key that doesn't hold all of it out."""
    penalties = np.asarray(alphas, dtype=float)

    def errors(batches):
        for batch in batches:
            at, held, sums = [], [], []
            for i, (z, fits) in enumerate(zip(batch.column("__z"), batch.column("__fits"))):
                z = z.values.to_numpy(zero_copy_only=False).reshape(-1, p + 2)
                gaps = np.isnan(z[:, 1:-1])
                for fit in fits.as_py():
                    rows = z[:, 0] != fit["__held"]
                    own = z[rows, 1:]
                    if gaps.any():
                        own[:, :p] = np.where(gaps[rows], fit["__fill"], own[:, :p])
                    at.append(i)
                    held.append(fit["__held"])
                    sums.append(_left_out(own, fit["__n"], np.asarray(fit["__spectrum"]), p, penalties))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at, pa.int64())) for k in keys], pa.array(held, pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=[*keys, "__held", "__sse"])
    schema = T.StructType([*[chunks.schema[k] for k in keys], T.StructField("__held", T.IntegerType()), T.StructField("__sse", T.ArrayType(T.DoubleType()))])
    each = chunks.select(*keys, "__z", "__fits").mapInArrow(errors, schema)
    listed = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("__alpha"), F.col("__sse"))
    return each.select(*keys, "__held", F.explode(listed).alias("e")).select(*keys, "__held", F.col("e.__alpha").alias("__alpha"), F.col("e.__sse").alias("__sse"))


def season_ridge(df: DataFrame, keys: list[str], features: list[str], label: str, year: str = "year",
                 alphas: list[float] = SEASON_ALPHAS, min_years: int = 1) -> DataFrame:
    """Ridge per key; penalty by leaving each year out and comparing mean absolute error.

    Training moments of a fold are total less year, so every (penalty, year) fit
    comes from one aggregate. Under three years the largest penalty is used.
    """
    if not keys:
        return season_ridge(df.withColumn("__one", F.lit(0)), ["__one"], features, label, year, alphas, min_years).drop("__one")
    p = len(features)
    by_year = scale.cut_lineage(moments(df, keys + [year], features, label))
    fields = "".join(f"`{k}` {by_year.schema[k].dataType.simpleString()}, " for k in keys + [year])
    total_fields = "".join(f"`{k}` {by_year.schema[k].dataType.simpleString()}, " for k in keys)

    def fold_fits(part: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(part["moments"].to_list()), axis=0)
        out = []
        for _, row in part.iterrows() if len(part) > 1 else ():
            rest = total - np.asarray(row["moments"])
            for alpha in alphas:
                intercept, coef = solve_ridge(rest, p, alpha)
                out.append([*[row[k] for k in keys], row[year], alpha, intercept, coef])
        return pd.DataFrame(out, columns=[*keys, year, "alpha", "intercept", "coef"])

    def total_moments(part: pd.DataFrame) -> pd.DataFrame:
        out = part[keys].iloc[[0]].copy()
        out["moments"] = [np.sum(np.stack(part["moments"].to_list()), axis=0).tolist()]
        out["years"] = len(part)
        return out

    fits = by_year.groupBy(*keys).applyInPandas(fold_fits, fields + "alpha double, intercept double, coef array<double>")
    totals = scale.cut_lineage(by_year.groupBy(*keys).applyInPandas(
        total_moments, total_fields + "moments array<double>, years int"))
    folded = fits.groupBy(*keys, year).agg(F.collect_list(F.struct("alpha", "intercept", "coef")).alias("__fits"))
    scored = scale.attach(scale.complete(df, [*features, label]), folded, keys + [year]).select(
        *keys, year, *features, label, F.explode("__fits").alias("__f")).select("*", "__f.*")
    error = F.abs(linear_value(features) - F.col(label))
    # Rounded so that penalties with equal error tie, and the smaller wins, whatever the summation order.
    means = scored.groupBy(*keys, "alpha").agg(F.round(F.avg(error), 12).alias("__e"))
    best = means.groupBy(*keys).agg(F.min_by("alpha", F.struct("__e", "alpha")).alias("__best"))
    chosen = scale.attach(totals, best, keys)
    chosen = chosen.where(F.col("years") >= min_years).withColumn("__alpha_used", F.when(
        (F.col("years") >= 3) & F.col("__best").isNotNull(), F.col("__best")).otherwise(F.lit(alphas[-1])))
    return fit_linear(chosen, keys, p, "__alpha_used")
