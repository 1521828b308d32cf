"""The queries on fitted models are bound to the operators' own settings, and queries to whole tables."""

import datetime

import duckdb
import pytest

from furrow.bindings import fields
from furrow.bindings import models as bound
from furrow.columns import BENCHMARK_FEATURE_SETS, PEAK_FEATURES

WHOLE = {"decision_tree": "holdout", "logistic_regression": "holdout", "random_forest": "holdout", "boosted": "holdout", "cross_validation": "cross_validate",
         "one_vs_rest": "one_vs_rest", "one_vs_rest_ranked": "one_vs_rest_ranked", "pixel_classifier": "pixel_classifier", "historical_benchmark": "historical_benchmark"}
SHORTER = {"trees", "max_depth", "iterations", "folds_n", "repeats", "top_k", "kinds"}


class Called(Exception):
    pass


def called_with(monkeypatch, module, name, run):
    def record(*args, **options):
        raise Called(args, options)
    monkeypatch.setattr(module, name, record)
    with pytest.raises(Called) as seen:
        run()
    return seen.value.args


@pytest.mark.parametrize("query", WHOLE)
def test_own_settings_and_all_values(spark, sf, monkeypatch, query):
    args, options = called_with(monkeypatch, bound.models, WHOLE[query], lambda: bound.QUERIES[query](spark, sf))
    assert not SHORTER & set(options)
    if query != "historical_benchmark":
        assert args[1] == [f"e{i}" for i in range(64)]
        assert set(args[1]) <= set(args[0].columns)


@pytest.mark.parametrize("query, operator", [("field_benchmark", "benchmark_field_yield"), ("margin_holdout", "holdout_with_margin")])
def test_all_candidates(spark, sf, monkeypatch, query, operator):
    _, options = called_with(monkeypatch, bound.benchmark, operator, lambda: bound.QUERIES[query](spark, sf))
    assert "kinds" not in options
    assert list(options["sets"]) == list(BENCHMARK_FEATURE_SETS)
    assert {c for columns in options["sets"].values() for c in columns} == set(PEAK_FEATURES)


@pytest.mark.parametrize("query", ["season_field_evaluation", "season_field_evaluation_regional"])
def test_seasons_are_those_of_the_table(spark, sf, monkeypatch, query):
    later = bound.field_table(spark, sf).selectExpr("* EXCEPT (year)", "year + 30 AS year").limit(50)
    monkeypatch.setattr(bound, "field_table", lambda spark, sf: later)
    _, options = called_with(monkeypatch, bound.season, "evaluate_season_field", lambda: bound.QUERIES[query](spark, sf))
    assert list(options["years"]) == sorted(r.year for r in later.select("year").distinct().collect())


def test_connected_groups_share_any_parcel(spark, tmp_path):
    """Operations meet on a part that is neither the least nor the greatest of their lines; one without parcels counts too."""
    day = datetime.date(1995, 5, 1)
    orders = [(1, day, "1-URGENT"), (2, day, "1-URGENT"), (3, day, "1-URGENT"), (4, day, "5-LOW"), (5, day, "1-URGENT"), (6, day, "1-URGENT")]
    lines = [(1, 10), (1, 50), (1, 90), (2, 20), (2, 50), (2, 80), (3, 30), (3, 70), (4, 5), (4, 50), (4, 95), (6, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.root, r.operations) for r in fields.connected_groups(spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (3, 1), (4, 1), (5, 1), (6, 1)}
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert set(con.execute(fields.ORACLES["connected_groups"]).fetchall()) == got
