"""Linear and season models against direct NumPy fits, planted signals and leak detectors."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from furrow.columns import PEAK_FEATURES, monthly, S2_INDICES
from furrow.operators import folds, groups, metrics
from furrow.plans import benchmark, bundle, linear, models, season


def brute_loo(x, y, alphas):
    """Best penalty by actually leaving each row out (fixed scaling), then the fit."""
    mean, sd = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
    z = (x - mean) / sd
    best = None
    for a in alphas:
        errors = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            zi, yi = z[keep], y[keep]
            c, m = zi - zi.mean(0), yi.mean()
            w = np.linalg.solve(c.T @ c + a * np.eye(z.shape[1]), c.T @ (yi - m))
            errors.append((y[i] - m - (z[i] - zi.mean(0)) @ w) ** 2)
        if best is None or np.mean(errors) < best[0]:
            best = (np.mean(errors), a)
    a = best[1]
    w = np.linalg.solve(z.T @ z + a * np.eye(z.shape[1]), z.T @ (y - y.mean())) / sd
    return a, w, y.mean() - w @ mean


@pytest.mark.parametrize("width", [3, 20])
def test_ridge_loo_matches_leaving_rows_out(spark, monkeypatch, width):
    monkeypatch.setattr(linear, "LOO_CHUNK_ROWS", 7)
    rng = np.random.default_rng(width)
    rows, want = [], {}
    for crop in ("a", "b", None):
        x = rng.normal(size=(40, width)) * rng.uniform(0.5, 3, width)
        y = 10 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=40)
        want[crop] = brute_loo(x, y, linear.LOO_ALPHAS)
        rows += [(crop, *map(float, r), float(t)) for r, t in zip(x, y)]
    names = [f"x{i}" for i in range(width)]
    df = spark.createDataFrame(rows, "crop string, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(3)
    got = linear.ridge_loo(df, ["crop"], names, "y").collect()
    assert len(got) == 3
    for r in got:
        alpha, coef, intercept = want[r.crop]
        assert r.alpha == pytest.approx(alpha)
        assert np.allclose(r.coef, coef) and r.intercept == pytest.approx(intercept)


def test_ridge_of_held_out_folds_is_ridge_on_the_others(spark, monkeypatch):
    """Gaps, a feature that is empty outside a fold, a NULL key, a missing label and rows that teach nothing."""
    rng = np.random.default_rng(5)
    rows = []
    for key in ("a", None):
        for i in range(60):
            x = rng.normal(size=2)
            gap = (key == "a" and i % 7 == 0) or (key is None and i % 4 != 1)
            rows.append((key, -5 if i % 10 == 9 else i % 4, None if gap else float(x[0]), float(x[1]), None if i == 8 else float(3 * x[0] - x[1] + rng.normal())))
    df = spark.createDataFrame(rows, "crop string, fold int, x double, z double, y double")
    monkeypatch.setattr(linear, "LOO_CHUNK_ROWS", 16)
    got = {(r.crop, r["__held"]): r for r in linear.ridge_loo_held(df, ["crop"], "fold", ["x", "z"], "y", test=-5).collect()}
    assert set(got) == {(k, f) for k in ("a", None) for f in (0, 1, 2, 3, -5)}
    for (key, held), fit in got.items():
        others = df.where(F.col("crop").eqNullSafe(F.lit(key)) & ~F.col("fold").isin(held, -5))
        median = others.agg(F.median("x")).first()[0] or 0.0
        want = linear.ridge_loo(others.fillna({"x": median}), ["crop"], ["x", "z"], "y").first()
        assert fit["__fill"] == pytest.approx([median, 0.0])
        assert (fit.alpha, fit.n, fit.intercept, *fit.coef) == pytest.approx((want.alpha, want.n, want.intercept, *want.coef))


def test_ols_with_a_constant_column(spark):
    df = spark.createDataFrame([(float(i), 1.0, 3.0 + 2.0 * i) for i in range(10)], "x double, c double, y double")
    row = linear.fit_linear(linear.moments(df, [], ["x", "c"], "y"), [], 2).first()
    assert row.intercept == pytest.approx(3.0) and row.coef == pytest.approx([2.0, 0.0])


def test_field_history_leaves_own_year_out(spark):
    rows = [("A", 2020, "wheat", 60.0), ("B", 2020, "wheat", 40.0), ("A", 2021, "canola", 30.0), ("B", 2021, "canola", 30.0), ("C", 2021, "oats", 90.0)]
    df = spark.createDataFrame(rows, "field_key string, year int, crop string, yield double")
    got = {(r.field_key, r.year): r.field_history for r in groups.field_history(df, df, True).collect()}
    assert got == pytest.approx({("A", 2020): 0.0, ("B", 2020): 0.0, ("A", 2021): 0.2, ("B", 2021): -0.2, ("C", 2021): 0.0})
    means = {r.field_key: r.field_history for r in groups.field_history_means(df).collect()}
    assert means == pytest.approx({"A": 0.1, "B": -0.1})


def test_grouped_folds(spark):
    rng = random.Random(1)
    rows = [(f"g{rng.randrange(30)}" if i % 3 else "hot", rng.choice("ab")) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, crop string")
    for stratify in (None, "crop"):
        table = folds.fold_table(df, "g", 4, stratify=stratify)
        assert table.select("g").distinct().count() == table.count() == df.select("g").distinct().count()
        sizes = {r.fold: r["count"] for r in folds.assign_folds(df, table, "g").groupBy("fold").count().collect()}
        assert set(sizes) == {0, 1, 2, 3}
        # The hot group sits alone; the rest is spread evenly over the other folds.
        assert max(sizes.values()) == 300 and min(sizes.values()) >= 150
    held = folds.grouped_holdout(df, "g", 0.25)
    assert held.groupBy("g").agg(F.count_distinct("is_test").alias("k")).where("k > 1").count() == 0
    assert held.where("is_test").select("g").distinct().count() == -(-df.select("g").distinct().count() // 4)


@pytest.mark.parametrize("bits", [12, 1])
def test_folds_are_dealt_within_classes(spark, monkeypatch, bits):
    monkeypatch.setattr(folds, "CELL_BITS", bits)
    rows = [(f"g{i % 40}", "ab"[i % 40 % 2]) for i in range(200)]
    rows += [(None, "a")] * 3 + [("g1", None)]
    df = spark.createDataFrame(rows, "g string, crop string")
    table = folds.fold_table(df, "g", 4, stratify="crop")
    got = {r.g: r.fold for r in table.collect()}
    assert len(got) == table.count() == 41
    for crop in "ab":
        sizes = [sum(got[f"g{i}"] == k for i in range(40) if "ab"[i % 2] == crop) for k in range(4)]
        assert max(sizes) - min(sizes) <= 2
    assert folds.fold_table(df.limit(0), "g", 4, stratify="crop").count() == 0
    few = folds.fold_table(spark.createDataFrame([("x",), ("y",), ("y",)], "g string"), "g", 5)
    assert few.select("fold").distinct().count() == 2


def test_ranking_scores(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), float(rng.randrange(12))) for _ in range(120)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    for limit in (10**6, 3):
        got = metrics.ranking_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s", max_group=limit).first()
        assert got.roc_auc == pytest.approx(auc) and got.evaluated_rows == 120


def test_margin_keeps_the_baseline():
    with pytest.raises(ValueError):
        benchmark.holdout_with_margin(None, test_year=2025, min_improvement=1.0)


def planted(spark, seed=0, leak=None):
    """Season level follows rain; deviations follow July NDVI."""
    rng = np.random.default_rng(seed)
    rows = []
    for crop, base in (("barley", 80.0), ("canola", 45.0)):
        for year in range(2019, 2026):
            rain = 150 + 40 * ((year * 7 + len(crop)) % 5)
            level = 0.3 + 0.002 * (rain - 250)
            for f in range(6):
                dev = float(rng.normal(0, 0.1))
                y = base * (1 + 0.004 * (rain - 250)) + 40 * dev + float(rng.normal(0, 0.5))
                if leak == year:
                    y = 1e6
                ndvi = level + dev
                rows.append((f"{crop}{f}", f"s{f}", year, crop, "bu/ac", y, ndvi, ndvi * 0.8, ndvi * 1.1, float(rain), 1000.0 + rain / 10, 24.0))
    names = ("field_key string, section_key string, year int, crop string, yield_unit string, yield double, field_NDVI_jul double, field_NDRE_jul double, "
             "field_EVI_jul double, w_precip_may_aug double, w_gdd5_may_aug double, w_tmax_jul double")
    df = spark.createDataFrame(rows, names)
    return df.withColumns({c.replace("field_", "quarter_"): F.col(c) for c in PEAK_FEATURES}).cache()


def regional(spark):
    rng = np.random.default_rng(4)
    rows = []
    for r in range(8):
        for crop, scale_ in (("barley", 70.0), ("canola", 40.0)):
            for year in range(2019, 2026):
                a = float(rng.normal(0, 0.1))
                rows.append((f"r{r}", year, crop, scale_ * (1 + 2 * a) + float(rng.normal(0, 0.3)), 500, 0.6 + a, 0.4 + a, 0.5 + a))
    return spark.createDataFrame(rows, "region string, year int, crop string, regional_yield double, pixels long, field_NDVI_jul double, field_NDRE_jul double, field_EVI_jul double").cache()


def skills(result):
    return {(r.crop, r.variant): r.skill for r in result.metrics.collect()}


def test_both_parts_add_skill_and_later_years_do_not_leak(spark):
    years = (2020, 2021, 2022, 2023, 2024)
    result = season.evaluate_season_field(planted(spark), years=years, deviation_features="peak")
    got = skills(result)
    for crop in ("barley", "canola"):
        assert got[crop, "baseline"] == pytest.approx(0.0)
        assert got[crop, "season_model"] > 0.2 and got[crop, "season_model_plus_field"] > got[crop, "season_model"] + 0.02
    leaked = season.evaluate_season_field(planted(spark, leak=2025), years=years, deviation_features="peak")
    assert skills(leaked) == pytest.approx(got)


def test_held_out_yields_change_nothing_predicted_for_them(spark):
    years = (2020, 2021, 2022, 2023, 2024)
    columns = ["pred_baseline", "pred_season_model_plus_field"]
    pick = lambda t: sorted((r.field_key, *[round(r[c], 6) for c in columns]) for r in season.evaluate_season_field(
        t, years=years, deviation_features="peak_history").predictions.where("year = 2022").collect())
    assert pick(planted(spark)) == pick(planted(spark, leak=2022))


def test_regional_models(spark):
    got = {r.crop: r.skill for r in season.evaluate_regional_models(regional(spark)).collect()}
    assert min(got.values()) > 0.8 and set(got) == {"barley", "canola"}


def test_readings_agree_when_identical(spark):
    table = planted(spark)
    local = season.season_readings(table, "fields", PEAK_FEATURES)
    runs = [skills(season.evaluate_season_field(table, deviation_features="peak", season_features="regional_satellite",
                                                regions=regional(spark), season_reading=reading, local=local))
            for reading in ("fields", "quarter", "local")]
    assert runs[0] == pytest.approx(runs[1]) and runs[0] == pytest.approx(runs[2])
    with pytest.raises(ValueError, match="reading"):
        season.evaluate_season_field(table, season_reading="quarter")


def test_published_regional_level(spark):
    table = planted(spark)
    published = table.groupBy("crop", "year").agg((F.avg("yield") * 2).alias("regional_yield")).where("crop = 'barley'")
    result = season.evaluate_season_field(table, deviation_features="peak", season_features="regional", published=published)
    rows = {(r.crop, r.held_out): r for r in result.seasons.collect()}
    assert rows["barley", 2021].modelled_mean == pytest.approx(rows["barley", 2021].season_mean)
    assert rows["canola", 2021].modelled_mean == pytest.approx(rows["canola", 2021].baseline_mean)


def test_canola_option_uses_its_own_months(spark):
    rows = regional(spark).withColumns({f"field_{i}_aug": F.col(f"field_{i}_jul") for i in ("NDVI", "NDRE", "EVI")})
    models_ = {r.crop: list(r.features) for r in season.regional_models(rows, "regional_satellite_canola_jul_aug").collect()}
    assert len(models_["barley"]) == 3 and len(models_["canola"]) == 6


def test_sensor_slope(spark):
    rows = regional(spark)
    landsat = rows.withColumns({"field_NDVI_jul": F.col("field_NDVI_jul") * 0.8 + 3, "field_EVI_jul": F.col("field_EVI_jul") * 0.9})
    got = season.cross_sensor_scale(landsat, rows, ["field_NDVI_jul", "field_EVI_jul"])
    assert got == pytest.approx({"field_NDVI_jul": 0.8, "field_EVI_jul": 0.9})


def test_bundle(spark, tmp_path):
    table, regions = planted(spark), regional(spark)
    fitted = bundle.fit_bundle(table, regions, test_year=2025)
    path = str(tmp_path / "bundle")
    bundle.save_bundle(fitted, path)
    with pytest.raises(Exception, match="exist"):
        bundle.save_bundle(fitted, path)
    loaded = bundle.load_bundle(spark, path)
    test = table.where("year = 2025").drop("quarter_NDVI_jul")
    extra = test.limit(1).withColumn("crop", F.lit("rye")).unionByName(
        test.where("crop = 'canola'").withColumns({"year": F.lit(2026), "yield_unit": F.lit("lb/ac")}))
    key = ["field_key", "year", "crop"]
    pick = lambda b: {tuple(r[k] for k in key): r for r in bundle.predict_bundle(b, test.unionByName(extra)).collect()}
    got, again = pick(fitted), pick(loaded)
    assert got == again
    assert {r.status for r in got.values()} == {"ok", "no model for this crop", "unit lb/ac differs from training unit bu/ac"}
    # A yield column is carried along and never used.
    blind = {tuple(r[k] for k in key): r.predicted for r in bundle.predict_bundle(loaded, test.drop("yield")).collect()}
    assert all(blind[k] == pytest.approx(got[k].predicted) for k in blind)
    # Leaving a season out by hand reproduces the evaluation.
    dev = table.where("year < 2025")
    evaluated = {(r.field_key, r.crop): r.pred_season_model_plus_field for r in season.evaluate_season_field(
        dev, years=tuple(range(2019, 2025)), deviation_features="peak", season_features="regional_satellite",
        regions=regions.where("year < 2025")).predictions.where("year = 2024").collect()}
    without = bundle.fit_bundle(dev.where("year <> 2024"), regions.where("year < 2024"), test_year=2025)
    for r in bundle.predict_bundle(without, dev.where("year = 2024")).collect():
        assert r.pred_season_model_plus_field == pytest.approx(evaluated[r.field_key, r.crop], abs=1e-9)
    scores = {r.crop: r for r in bundle.score_bundle(bundle.predict_bundle(loaded, test)).collect()}
    assert set(scores) == {"barley", "canola", "all bu/ac crops"} and scores["all bu/ac crops"].field_years == 12
    with pytest.raises(ValueError, match="Missing"):
        bundle.predict_bundle(loaded, test.drop("field_EVI_jul"))
    loaded.crops.withColumn("training_mean", F.col("training_mean") + 1).write.mode("overwrite").parquet(str(tmp_path / "c"))
    spark.read.parquet(str(tmp_path / "c")).write.mode("overwrite").parquet(f"{path}/crops")
    with pytest.raises(ValueError, match="crops"):
        bundle.load_bundle(spark, path)
    with pytest.raises(ValueError, match="only 2 seasons"):
        bundle.fit_bundle(table.where("year > 2022"), regions, test_year=2025)


def test_field_benchmark_finds_a_planted_signal(spark):
    rng = np.random.default_rng(0)
    columns = monthly("field_", S2_INDICES, ["jun", "jul"])
    rows = [(f"f{i}", f"s{i % 8}", 2020 + i % 5, "wheat", "bu/ac", *map(float, (x := rng.normal(0.5, 0.1, len(columns)))),
             float(10 + 50 * x[0] + rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "field_key string, section_key string, year int, crop string, yield_unit string, "
                               + ", ".join(f"{c} double" for c in columns) + ", yield double")
    scores, predictions = benchmark.benchmark_field_yield(df, kinds=("ridge",), sets={"ndvi": columns[:1], "all": columns})
    got = {(r.split, r.feature_set): r.mae_skill for r in scores.collect()}
    assert got["year", "ndvi"] > 0.5 and got["section", "ndvi"] > 0.5 and got["year", "all"] > 0.5 and got["year", "none"] == 0.0
    assert predictions.count() == 60 * 2 * 3
    selection, results, final = benchmark.holdout_with_margin(df, test_year=2024, min_improvement=0.1, kinds=("ridge",), sets={"ndvi": columns[:1]})
    row = results.first()
    assert row.status == "scored" and row.chosen_model == "ridge" and row.test_mae_skill > 0.5 and final.count() == 12
    noise = df.withColumn(columns[0], F.rand(3))
    assert benchmark.holdout_with_margin(noise, test_year=2024, min_improvement=0.1, kinds=("ridge",), sets={"ndvi": columns[:1]})[1].first().chosen_model == "mean_baseline"


def test_shallow_boosted_candidate(spark):
    rows = [(f"f{i}", f"s{i % 4}", 2020 + i % 3, "oats", "bu/ac", float(i % 10) if i % 9 else None, 5.0 * (i % 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "field_key string, section_key string, year int, crop string, yield_unit string, x double, yield double")
    scores, _ = benchmark.benchmark_field_yield(df, kinds=("gbm",), sets={"x": ["x"]}, splits=("year",), iterations=30)  # every tree counts 0.05, also the first
    assert {r.model: r.mae_skill for r in scores.collect()}["gbm"] > 0.3


def test_pixel_yield_by_year(spark):
    rows = [("wheat", f"r{i // 6}", 2020 + (i // 6) % 2, f"q{i // 6}", 60.0 + 10 * ((i // 6) % 2) + (i // 12), float(i % 6) / 10 + (i // 12) / 5, 1.0 * ((i // 6) % 2)) for i in range(48)]
    df = spark.createDataFrame(rows, "crop string, row_id string, year int, quarter_section string, yield_bu_ac double, NDVI_max double, soil_oc double")
    scores, predictions, used = benchmark.pixel_yield_cv(df, split="year", drop_year_constant=True, include_baseline=True)
    assert used == ["NDVI_max"]
    base = {r.model: r for r in scores.collect()}["mean_baseline"]
    # Each year is predicted by the other year's mean.
    by_year = {r.year: r.m for r in predictions.groupBy("year").agg(F.avg("pred_mean_baseline").alias("m")).collect()}
    truth = {r.year: r.m for r in df.groupBy("year").agg(F.avg("yield_bu_ac").alias("m")).collect()}
    assert by_year == pytest.approx({2020: truth[2021], 2021: truth[2020]}) and base.cv_splits == 2 and base.pixel_count == 48
    with pytest.raises(ValueError, match="nonleaky"):
        benchmark.pixel_yield_cv(df.drop("NDVI_max"), split="year", drop_year_constant=True)


def test_knn_blocks(spark):
    rng = np.random.default_rng(2)
    x, y, q = rng.normal(size=(50, 3)), rng.normal(size=50), rng.normal(size=(11, 3))
    train = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double")
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>")
    want = {i: y[np.argsort(((x - p) ** 2).sum(1))[:4]].mean() for i, p in enumerate(q)}
    for block in (7, 1000):
        got = {r.id: r.predicted for r in models.knn_regress(train, test, "id", "v", "y", 4, block=block).collect()}
        assert got == pytest.approx(want)


def test_knn_meets_near_cells_only(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 4)) * 50
    x = np.concatenate([c + rng.normal(size=(40, 4)) for c in centre] + [np.tile(centre[0], (60, 1))])
    y = rng.normal(size=len(x))
    q = np.concatenate([c + rng.normal(size=(3, 4)) for c in centre] + [rng.normal(size=(3, 4)) * 200])
    train = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(10_000, None, 1.0)], "id long, v array<double>, y double")
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(900, None)], "id long, v array<double>")
    want = {i: y[np.argsort(np.round(((x - p) ** 2).sum(1), 12), kind="stable")[:5]].mean() for i, p in enumerate(q)}
    out = models.knn_regress(train, test, "id", "v", "y", block=20, pivots=64)
    assert {r.id: r.predicted for r in out.collect()} == pytest.approx(want)
    assert models.knn_regress(train.limit(0), test, "id", "v", "y").where("predicted is not null").count() == 0


def separable(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        crop = ["barley", "canola", "wheat"][i % 3]
        x = rng.normal(size=2) * 0.3 + [i % 3, -(i % 3)]
        rows.append((f"{i // 6 % 20:06d}{i:04d}", f"{i // 6}", crop, float(x[0]), float(x[1]) if i % 17 else None))
    return spark.createDataFrame(rows, "pid string, row_id string, crop string, a double, b double")


def test_classifiers_separate_planted_classes(spark):
    df = separable(spark)
    for kind in ("decision_tree", "logistic"):
        out = models.cross_validate(df, ["a", "b"], "crop", kind, folds_n=3, repeats=1)
        summary = out["row_summary"].first()
        assert summary.macro_f1_mean > 0.75 and summary.accuracy_folds == 3
        assert out["predictions"].count() == 240
    with pytest.raises(ValueError, match="at least 50 groups"):
        models.cross_validate(df, ["a", "b"], "crop", "decision_tree", folds_n=50, repeats=1)


def test_large_forests_grow_in_lots(spark, monkeypatch):
    """The driver never holds more trees than a lot has; all lots' trees count alike."""
    assert models.forest_lots(models.classifier("random_forest"), 400) == [300]
    lots = models.forest_lots(models.classifier("random_forest"), 100_000)
    assert sum(lots) == 300 and max(lots) * 2 ** 13 <= models.NODES_AT_ONCE and max(lots) - min(lots) <= 1
    rng = np.random.default_rng(3)
    rows = [(i, float(x := rng.normal()), float(rng.normal()), "a" if x > 0.3 else "b" if x > -0.5 else "c") for i in range(240)]
    df = spark.createDataFrame(rows, "pid int, x double, z double, crop string")
    grown, real = [], models.classifier
    monkeypatch.setattr(models, "classifier", lambda kind, **options: (grown.append(options.get("trees")), real(kind, **options))[1])
    monkeypatch.setattr(models, "NODES_AT_ONCE", 5 * int(1.27 * 160))
    out = models.fit_predict(df.where("pid % 3 > 0"), df.where("pid % 3 = 0"), ["x", "z"], "crop", ["a", "b", "c"], "random_forest", trees=12, max_depth=8).collect()
    assert grown == [12, 4, 4, 4] and len(out) == 80
    assert all(sum(r.probabilities) == pytest.approx(1) for r in out) and sum(r.predicted == r.crop for r in out) > 70


def test_one_vs_rest(spark, tmp_path):
    df = separable(spark)
    fitted, manifest = models.one_vs_rest(df, ["a", "b"], "crop", "decision_tree", min_fields=2)
    assert {r.status for r in manifest.collect()} == {"trained"}
    scored = models.predict_one_vs_rest(fitted, df, ["a", "b"], "decision_tree")
    assert scored.where("predicted = crop").count() > 200
    path = str(tmp_path / "ovr")
    models.save_one_vs_rest(fitted, manifest, ["a", "b"], path)
    loaded, features = models.load_one_vs_rest(spark, path)
    again = models.predict_one_vs_rest(loaded, df, features, "decision_tree")
    assert features == ["a", "b"] and scored.select("pid", "predicted").exceptAll(again.select("pid", "predicted")).isEmpty()
    scores, rows = models.one_vs_rest_ranked(df, ["a", "b"], "crop", group="row_id", folds_n=3, top_k=1)
    assert {r.crop_name for r in scores.collect()} == {"barley", "canola", "wheat"} and rows.count() <= 720


def test_one_vs_rest_scores_a_row_alone_as_in_its_table(spark, tmp_path):
    df = separable(spark).withColumn("a", F.when(F.crc32("pid") % 7 != 0, F.col("a")))
    fitted, manifest = models.one_vs_rest(df, ["a", "b"], "crop", "logistic", min_fields=2)
    columns = ["pid", *[f"prob_{c}" for c in sorted(fitted)], "predicted"]
    table = {r.pid: r for r in models.predict_one_vs_rest(fitted, df, ["a", "b"], "logistic").select(columns).collect()}
    path = str(tmp_path / "ovr")
    models.save_one_vs_rest(fitted, manifest, ["a", "b"], path)
    loaded, features = models.load_one_vs_rest(spark, path)
    for row in [df.where("a is null").first(), df.where("a is not null").first()]:
        alone = models.predict_one_vs_rest(loaded, df.where(F.col("pid") == row.pid), features, "logistic").select(columns).first()
        assert alone.predicted == table[row.pid].predicted
        assert [alone[c] for c in columns[1:-1]] == pytest.approx([table[row.pid][c] for c in columns[1:-1]])


def test_boosted_multiclass_probabilities_are_soft(spark):
    df = separable(spark)
    out = models.fit_predict(df, df, ["a", "b"], "crop", ["barley", "canola", "wheat"], "boosted", iterations=3, max_depth=2).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out)
    assert any(0.01 < p < 0.99 for r in out for p in r.probabilities)
    assert sum(r.predicted == r.crop for r in out) > 180


def test_compare_feature_sets(spark):
    df = separable(spark).withColumnsRenamed({"a": "NDVI_jul", "b": "VV_jul"})
    out = models.compare_feature_sets(df, ["NDVI_jul", "VV_jul"], "crop", "decision_tree", {"s2": ["s2"], "s2+s1": ["all"]}, folds_n=3, repeats=1)
    assert out.count() == 6 and set(out.columns) >= {"crop", "precision", "recall", "f1", "support", "f1_mean", "experiment"}


def test_one_hot(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    out, names = models.one_hot(df, ["k"])
    assert [r[0].toArray()[:2].tolist() for r in out.select(names[0]).collect()] == [[1, 0], [1, 0], [0, 1], [1, 0]]


def test_season_ridge_without_keys(spark):
    df = spark.createDataFrame([(2000 + i % 4, float(i), 1.0 + 2 * i + (i % 3)) for i in range(40)], "year int, x double, y double")
    fit = linear.season_ridge(df, [], ["x"], "y")
    assert fit.count() == 1
    error = linear.predict_linear(df, fit, [], ["x"], "p").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert fit.first().alpha == 0.1 and error < 1.0


def test_fits_run_side_by_side(spark):
    """Independent fits wait for each other here, so one after another they would not end."""
    meet = threading.Barrier(2, timeout=30)
    assert models.at_once(spark, [lambda k=k: (meet.wait(), k)[1] for k in range(4)]) == list(range(4))
    assert models.at_once(spark, []) == []


def test_historical_splits_are_prepared_once(spark, monkeypatch):
    rows = spark.createDataFrame([("a" if k % 2 else "b", "x", k % 7, k, float(k % 9), float(k)) for k in range(60)], "Area string, Item string, Year int, k int, `hg/ha_yield` double, t double")
    calls = []
    real = models.linear.standardise
    monkeypatch.setattr(models.linear, "standardise", lambda *a, **b: (calls.append(1), real(*a, **b))[1])
    out = models.historical_benchmark(rows, key="k", folds_n=2, kinds=("linear", "tree"))
    assert {r.model for r in out.collect()} == {"linear", "tree"}
    assert len(calls) == 3  # one for each split, not one for each model and split


def test_boosted_trees_of_splits_grow_in_tasks(spark):
    """As MLlib's trees, with fewer and with more values than bins, in a job for all trees and splits."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 3 > 0, float(rng.normal() + 3 * (x > 0) + 2 * (c == 1)), [float(x), float(c), 1.0]) for i, (x, c) in enumerate(zip(rng.normal(size=300), rng.integers(0, 3, 300)))]
    ready = spark.createDataFrame(rows, "__id long, __train boolean, label double, features array<double>").select("__id", "__train", "label", array_to_vector("features").alias("features"))
    splits = {-1: ready, 2: ready.withColumn("__train", ~F.col("__train"))}
    spark.sparkContext.setJobGroup("boosted-splits", "")
    got = {(r.part, r["__id"]): r.predicted for r in models.boosted_in_tasks(splits, iterations=8).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted-splits"))
    spark.sparkContext.setJobGroup("", "")
    want = {(part, r["__id"]): r.predicted for part, rows in splits.items()
            for r in models.regressor("boosted", iterations=8).fit(rows.where("__train")).transform(rows.where("NOT __train")).collect()}
    assert len(got) == 300 and got == pytest.approx(want) and jobs <= 3


def test_nearest_rows_among_equal_distances(spark):
    """Ties go to the lower key, also where most rows are equally far and where fewer than k rows are."""
    points = [(i, [float(i % 3), 0.0], float(i)) for i in range(200)]
    train = spark.createDataFrame(points, "id long, v array<double>, y double")
    test = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((0.0, 1.0, 0.5, 9.0))], "id long, v array<double>")
    for own, block in ((train, 1000), (train, 30), (train.where("id < 3"), 1000)):
        kept = [p for p in points if own is train or p[0] < 3]
        want = {r.id: np.mean([p[2] for p in sorted(kept, key=lambda p: (abs(p[1][0] - r.v[0]), p[0]))[:4]]) for r in test.collect()}
        assert {r.id: r.predicted for r in models.knn_regress(own, test, "id", "v", "y", 4, block=block).collect()} == pytest.approx(want)


def test_pixel_yield_reads_rows_once_for_all_folds(spark, monkeypatch):
    rows = [("a", f"f{k % 9}", 2000 + k % 3, f"q{k % 9}", float(3 * (k % 11) + k % 2), float(k % 11), None if k % 6 == 0 else float(k % 5)) for k in range(90)] + [("b", "only", 2000, "q", 1.0, 2.0, 3.0)] * 3
    df = spark.createDataFrame(rows, "crop string, row_id string, year int, quarter_section string, yield_bu_ac double, NDVI_max double, VV_mean double")
    calls = []
    real = benchmark.linear.moments
    monkeypatch.setattr(benchmark.linear, "moments", lambda *a, **b: (calls.append(1), real(*a, **b))[1])
    scores, predictions, used = benchmark.pixel_yield_cv(df)
    assert len(calls) == 1 and len(used) == 2
    got = predictions.where("crop = 'a'").toPandas()
    assert len(got) == 90 and got["pred_ols"].notna().all() and got["fitted_ols"].notna().all()
    x = np.array([[1, r[5], r[6] if r[6] is not None else np.nan] for r in rows[:90]], dtype=float)
    y = np.array([r[4] for r in rows[:90]])
    x[np.isnan(x[:, 2]), 2] = np.nanmedian(x[:, 2])
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert sorted(np.round(got["fitted_ols"], 6)) == sorted(np.round(want, 6))
    assert predictions.where("crop = 'b' AND pred_ols IS NULL").count() == 3


def test_history_from_a_map_is_field_history(spark):
    draw = random.Random(3)
    rows = [(f"f{k % 7}" if k % 29 else None, "ab"[k % 2], 2000 + draw.randrange(4), draw.random() + 1 if k % 31 else None) for k in range(150)]
    source = spark.createDataFrame(rows, "field_key string, crop string, year int, yield double")
    stacked = groups.with_departures(source, source).withColumn("held_out", F.explode(F.array(*[F.lit(y) for y in range(2000, 2004)])))
    mine = stacked.withColumn("mine", groups.history_without(F.col("__departures"), F.col("held_out"), F.col("year"))).drop("__departures")
    past = source.withColumn("held_out", F.explode(F.array(*[F.lit(y) for y in range(2000, 2004)]))).where("year <> held_out")
    for part, own in ((mine.where("year <> held_out"), True), (mine.where("year = held_out"), False)):
        got = groups.field_history(past, part, own, extra=("held_out",)).select("mine", "field_history").collect()
        assert got and all(abs(r.mine - r.field_history) < 1e-12 for r in got)


def test_season_copies_hold_only_what_fits_read(spark, monkeypatch):
    rows = [(f"f{k % 12}", "a", 2000 + k % 4, "bu/ac", float(50 + k % 12 + k % 7), *[None if c == 0 and k % 10 == 0 else float((k * (c + 3)) % 17) for c in range(len(PEAK_FEATURES))], "x" * 50)
            for k in range(96)]
    table = spark.createDataFrame(rows, "field_key string, crop string, year int, yield_unit string, yield double, " + ", ".join(f"{c} double" for c in PEAK_FEATURES) + ", unused string")
    regions = table.select(F.col("field_key").alias("region"), "year", "crop", F.col("yield").alias("regional_yield"), *PEAK_FEATURES).withColumn("pixels", F.lit(1))
    seen = []
    real = season._fit_contrast
    monkeypatch.setattr(season, "_fit_contrast", lambda train, centred, keys, gappy: (seen.append((train.columns, gappy)), real(train, centred, keys, gappy))[1])
    out = season.evaluate_season_field(table, years=(2000, 2001, 2002, 2003), deviation_features="peak_history", season_features="regional_satellite", regions=regions)
    assert out.predictions.count() == 96 and out.predictions.where("pred_season_model_plus_field IS NULL").count() == 0
    (columns, gappy), = seen
    assert "unused" not in columns and gappy == [f"centred_{PEAK_FEATURES[0]}"]
