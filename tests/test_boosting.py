import numpy as np
import pytest

from furrow.plans import benchmark, boosting
from furrow.plans.boosting import TEST, boosted_folds

SCHEMA = "key string, id int, fold int, half int, a double, b double, y double"


def table_of(seed, keys=("k", "l", None), n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for key in keys:
        for i in range(n):
            a, b = float(np.round(rng.normal(), 1)), float(rng.integers(0, 5))
            rows.append((key, i, i % 4, i % 2 if key != "l" else None, None if i % 9 == 0 else a, b, float(3 * a + (b > 2) * 5 + rng.normal() * 0.1)))
    return rows


def single(rows, fold_at, used, held, iterations, rate=0.05, depth=2, least=3):
    """One model by trying every cut of the rows' own values; nothing is below a missing value."""
    x = np.array([[-np.inf if r[4 + j] is None else r[4 + j] for j in used] for r in rows])
    y, folds = np.array([r[6] for r in rows]), [r[fold_at] for r in rows]
    learn = np.array([f is not None and f != held and f != TEST for f in folds])
    out = np.full(len(rows), y[learn].mean())

    def grow(at, residual, left):
        mine = at & learn
        best = None
        if left:
            for j in range(len(used)):
                for cut in np.unique(x[:, j])[:-1]:
                    side = x[:, j] <= cut
                    a, b = residual[mine & side], residual[mine & ~side]
                    if len(a) >= least and len(b) >= least:
                        gain = round(a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - residual[mine].sum() ** 2 / mine.sum(), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, side)
        if best is None:
            return np.where(at, residual[mine].mean() if mine.any() else 0.0, 0.0)
        return grow(at & best[1], residual, left - 1) + grow(at & ~best[1], residual, left - 1)
    for _ in range(iterations):
        out = out + rate * grow(np.ones(len(rows), dtype=bool), y - out, depth)
    return out


def predictions(spark, rows, iterations, sets, splits=("fold", "half"), **options):
    out = boosted_folds(spark.createDataFrame(rows, SCHEMA), ["key"], "y", ["key", "id"], list(splits), sets, iterations=iterations, **options)
    got = out.collect()
    return {(r.key, r.id, r.split, r.feature_set): r.predicted for r in got}, got


@pytest.mark.parametrize("refresh", [10, 3])
def test_agrees_with_single_fits(spark, monkeypatch, refresh):
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 16 if refresh == 3 else 4_096)
    monkeypatch.setattr(boosting, "CHUNKS_A_TASK", 2 if refresh == 3 else 4)
    rows = table_of(1)
    got, listed = predictions(spark, rows, 8, {"both": ["a", "b"], "a": ["a"], "again": ["a"]})
    assert len(got) == len(listed) == 60 * 3 * 3 + 60 * 2 * 3
    for key in ("k", "l", None):
        mine = [r for r in rows if r[0] == key]
        for split, at in (("fold", 2), ("half", 3)):
            for held in {r[at] for r in mine} - {None}:
                for name, used in (("both", [0, 1]), ("a", [0]), ("again", [0])):
                    want = single(mine, at, used, held, 8)
                    for r, w in zip(mine, want):
                        if r[at] == held:
                            assert got[key, r[1], split, name] == pytest.approx(w, abs=1e-6)


def test_keys_do_not_change_one_another(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEYS_AT_ONCE", 2)
    rows = table_of(2)
    together, _ = predictions(spark, rows, 5, {"both": ["a", "b"]}, ["fold"])
    alone, _ = predictions(spark, [r for r in rows if r[0] == "l"], 5, {"both": ["a", "b"]}, ["fold"])
    assert alone == pytest.approx({k: v for k, v in together.items() if k[0] == "l"})


def test_test_rows_teach_nothing(spark):
    rows = table_of(3, ("k",))
    rows = [(*r[:2], TEST if r[1] >= 50 else r[2], *r[3:]) for r in rows]
    spoilt = [(*r[:6], 1e6 if r[2] == TEST else r[6]) for r in rows]
    first, second = (predictions(spark, x, 5, {"both": ["a", "b"]}, ["fold"])[0] for x in (rows, spoilt))
    assert first == pytest.approx(second)
    want = single(rows, 2, [0, 1], TEST, 5)
    assert all(first["k", r[1], "fold", "both"] == pytest.approx(w, abs=1e-6) for r, w in zip(rows, want) if r[2] == TEST)


def test_odd_rows(spark):
    rows = [("k", 1, 0, None, None, None, 1.0), ("k", 1, 0, None, float("nan"), 1.0, 2.0), ("k", 2, 1, None, 1.0, 1.0, None), ("m", 3, 0, None, 1.0, 1.0, 1.0)] + table_of(4, ("k",), 20)
    got, listed = predictions(spark, rows, 3, {"both": ["a", "b"], "none": []})
    assert got["m", 3, "fold", "both"] is None and sum(r.id == 1 and r.split == "fold" for r in listed) == 3
    assert predictions(spark, [], 3, {"a": ["a"]})[1] == []


def test_jobs_do_not_follow_keys(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(keys):
        spark.sparkContext.setJobGroup(f"boost-{keys}", "")
        predictions(spark, table_of(5, tuple(f"k{i}" for i in range(keys)), 12), 2, {"a": ["a"]}, ["fold"])
        return len(tracker.getJobIdsForGroup(f"boost-{keys}"))
    try:
        assert jobs(12) <= jobs(2) + 4
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_cells_and_rows_grow_the_same_trees(spark, monkeypatch):
    """Also where more rows than cells share their bins, and the held-out folds of a split are dealt to several tasks."""
    rows, sets = table_of(6, n=200), {"both": ["b", "a"], "b": ["b"]}
    cells, listed = predictions(spark, rows, 6, sets, bins=8)
    monkeypatch.setattr(boosting, "FOLDS_A_TASK", 1)
    assert predictions(spark, rows, 6, sets, bins=8)[0] == pytest.approx(cells)
    monkeypatch.setattr(boosting, "MAX_CELLS", 8)
    mixed, listed_too = predictions(spark, rows, 6, sets, bins=8)
    assert len(listed) == len(listed_too) == len(cells) == 200 * 3 * 2 + 200 * 2 * 2 and mixed == pytest.approx(cells)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


FIELDS = "field_key string, section_key string, year int, crop string, yield_unit string, x double, yield double"
FIELD_ROWS = [(f"f{i}", f"s{i % 4}", 2020 + i % 3, "oats", "bu/ac", float(i % 10) if i % 9 else None, 5.0 * (i % 10)) for i in range(60)]


def test_field_benchmark_jobs_do_not_follow_trees(spark):
    rows = spark.createDataFrame(FIELD_ROWS, FIELDS)
    few, many = (jobs_of(spark, f"field-{n}", lambda n=n: benchmark.benchmark_field_yield(rows, kinds=("gbm",), sets={"x": ["x"]}, splits=("year",), iterations=n)[0].collect()) for n in (2, 12))
    assert many <= few + 4


def test_margin_holdout_jobs_do_not_follow_trees(spark):
    rows = spark.createDataFrame(FIELD_ROWS, FIELDS)
    few, many = (jobs_of(spark, f"margin-{n}", lambda n=n: benchmark.holdout_with_margin(rows, test_year=2022, kinds=("gbm",), sets={"x": ["x"]}, iterations=n)[1].collect()) for n in (2, 12))
    assert many <= few + 4
