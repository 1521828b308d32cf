"""Oversized groups take another path; its results must be the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from furrow import scale
from furrow.operators import field_years, groups, harvest, matching, tables, zonal


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None, i, float(rng.randrange(200)) / 4) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, id long, v double").repartition(4).cache()


def test_ranks_of_a_hot_group(skewed):
    plain = scale.ranked(skewed, ["key"], [F.col("v"), F.col("id")])
    cut = scale.ranked(skewed, ["key"], [F.col("v"), F.col("id")], max_group=50)
    assert rows_of(plain.select("key", "id", "rank")) == rows_of(cut.select("key", "id", "rank"))


def test_descending_running_totals_without_keys(skewed):
    plain = scale.prefix_sums(skewed, [], [F.col("v").desc(), F.col("id")], {"s": F.col("v")})
    cut = scale.prefix_sums(skewed, [], [F.col("v").desc(), F.col("id")], {"s": F.col("v")}, max_group=100)
    assert rows_of(plain.select("id", "s")) == rows_of(cut.select("id", "s"))


def test_quantiles_of_a_hot_group(skewed):
    rows = skewed.withColumn("v", F.when(F.col("id") % 11 != 0, F.col("v")))
    specs = {"lo": (F.col("v"), 0.05), "mid": (F.col("v"), 0.5), "id_hi": (F.col("id"), 0.95)}
    aggs = {"n": F.count("*")}
    plain = scale.group_quantiles(rows, ["key"], specs, aggs=aggs)
    cut = scale.group_quantiles(rows, ["key"], specs, aggs=aggs, max_group=20)
    for a, b in zip(rows_of(plain), rows_of(cut), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_quantile_of_an_all_null_group_is_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "key string, v double")
    for limit in (100, 1):
        out = {r.key: r.q for r in scale.group_quantiles(df, ["key"], {"q": (F.col("v"), 0.5)}, max_group=limit).collect()}
        assert out == {"a": None, "b": 1.0}


def test_skew_join_salts_only_hot_keys(skewed):
    dim = skewed.groupBy("key").agg(F.avg("v").alias("m")).where("key <> 'k3' OR key IS NULL")
    plain = scale.attach(skewed, dim, ["key"])
    salted = scale.attach(skewed, dim, ["key"], max_bytes=0, hot_rows=100)
    unsalted = scale.attach(skewed, dim, ["key"], small=False, hot_rows=10**6)
    assert rows_of(plain) == rows_of(salted) == rows_of(unsalted)
    inner = scale.attach(skewed, dim, ["key"], how="inner", max_bytes=0, hot_rows=100)
    assert inner.count() == skewed.where("key IS NULL OR key <> 'k3'").count()
    assert salted.columns == ["key", "id", "v", "m"]


def test_skew_join_with_many_rows_per_key(skewed, spark):
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "key string, w int")
    plain = scale.skew_join(skewed, dim, ["key"], "inner")
    salted = scale.skew_join(skewed, dim, ["key"], "inner", max_bytes=0, hot_rows=50)
    assert rows_of(plain) == rows_of(salted)


def test_fill_forward_across_chunks(spark):
    rows = [("f", i, "x%d" % i if i % 37 == 5 else None) for i in range(400)] + [("g", i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "file string, n int, mark string")
    for chunk in (7, 1000):
        out = scale.fill_forward(df, ["file"], "n", {"last": F.col("mark")}, chunk_rows=chunk)
        for r in out.collect():
            start = (r.n - 5) // 37 * 37 + 5
            assert r["last"] == (None if r.file == "g" or r.n < 5 else f"x{start}")


def test_redistribution_of_a_hot_field(skewed):
    rows = skewed.withColumns({"NDVI_max": F.col("v"), "NDVI_min": F.col("v") % 7, "NDVI_integral_proxy": F.col("id") % 13,
                               "yield_bu_ac": F.lit(40.0)})
    plain = groups.redistribute_yield(rows, group="key").select("key", "id", F.round("pixel_yield_factor", 9).alias("f"))
    cut = groups.redistribute_yield(rows, group="key", max_group=30).select("key", "id", F.round("pixel_yield_factor", 9).alias("f"))
    assert rows_of(plain) == rows_of(cut)


def test_batches_of_a_table_larger_than_a_task(skewed):
    plain = tables.batch_ranges(skewed, [F.col("id")], 7, ["a", "b"])
    cut = tables.batch_ranges(skewed, [F.col("id")], 7, ["a", "b"], max_group=100)
    assert rows_of(plain.select("id", "batch_id", "assignee")) == rows_of(cut.select("id", "batch_id", "assignee"))
    sizes = [r["count"] for r in cut.groupBy("batch_id").count().collect()]
    assert sorted(sizes) == [428, 428, 428, 429, 429, 429, 429]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "hub", "random"])
def test_components_match_brute_force(spark, shape):
    rng = random.Random(3)
    edges = {"chain": [(i, i + 1) for i in range(60)] + [(100, 100)], "hub": [(500, i) for i in range(1, 200)],
             "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]}[shape]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in field_years.connected_components(df).collect()}
    assert got == brute_components(edges)


def test_zonal_join_of_a_crowded_cell(spark, monkeypatch):
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]],
               [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]]]
    parcels = spark.createDataFrame([("p", square)], "pid string, polys array<array<array<array<double>>>>")
    points = spark.createDataFrame([(i, 0.05 + 0.1 * (i % 12), 0.05 + 0.1 * (i // 12)) for i in range(144)], "id int, lon double, lat double")
    want = [i for i in range(144) if i % 12 < 10 and i // 12 < 10 and not (i % 12 in (4, 5) and i // 12 in (4, 5))]
    assert sorted(r.id for r in zonal.zonal_join(points, parcels, cell=(0.3, 0.3)).collect()) == want
    monkeypatch.setattr(scale, "broadcast_if_small", lambda df, max_bytes=0: (df, False))
    monkeypatch.setattr(scale, "HOT_KEY_ROWS", 3)
    assert sorted(r.id for r in zonal.zonal_join(points, parcels, cell=(0.3, 0.3)).collect()) == want


def test_zonal_join_of_parcels_of_all_sizes(spark):
    rng = random.Random(4)
    polys, want = [], set()
    points = [(i, round(rng.uniform(-3, 12), 3), round(rng.uniform(-3, 12), 3)) for i in range(700)]
    for name, x, y, w, h, hole in (("large", -2.0, -1.0, 11.0, 12.0, 3.0), ("thin", 0.0, 4.005, 9.0, 0.07, 0.0), ("small", 1.0, 1.0, 0.2, 0.2, 0.0), ("dot", 5.0, 5.0, 0.004, 0.004, 0.0)):
        rings = [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]
        if hole:
            rings.append([[x + 2, y + 2], [x + 2 + hole, y + 2], [x + 2 + hole, y + 2 + hole], [x + 2, y + 2 + hole], [x + 2, y + 2]])
        polys.append((name, [rings]))
        for i, a, b in points:
            if x < a < x + w and y < b < y + h and not (hole and x + 2 < a < x + 2 + hole and y + 2 < b < y + 2 + hole):
                want.add((i, name))
    parcels = spark.createDataFrame([*polys, ("none", None)], "pid string, polys array<array<array<array<double>>>>")
    df = spark.createDataFrame([*points, (999, None, 1.0)], "id int, lon double, lat double")
    got = [(r.id, r.pid) for r in zonal.zonal_join(df, parcels, cell=(0.1, 0.05)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_broadcasts_go_by_real_sizes(spark):
    few = spark.range(50).selectExpr("id", "array_repeat(id, 20000) v", "repeat('x', 1000) s", "array(struct(id a, 'b' b)) t", "map(id, 's') m")
    assert not scale.broadcast_if_small(few, 2_000_000)[1]
    assert scale.broadcast_if_small(few.drop("v"), 2_000_000)[1]
    assert scale.broadcast_if_small(spark.range(0), 10)[1] and not scale.broadcast_if_small(spark.range(5000), 2_000)[1]


def test_checkpoint_folder_comes_from_the_session(spark):
    scale.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def no_pass_over_facts(monkeypatch):
    """Nothing is broadcast, and hot keys may not be counted in a pass of their own."""
    def refused(*args, **kwargs):
        raise AssertionError("the facts were read again to count hot keys")
    monkeypatch.setattr(scale, "broadcast_if_small", lambda df, max_bytes=0: (df, False))
    monkeypatch.setattr(scale, "hot_keys", refused)
    monkeypatch.setattr(scale, "HOT_KEY_ROWS", 3)


def test_group_stats_know_their_hot_keys(spark, monkeypatch):
    df = spark.createDataFrame([(k, i) for k, n in ((None, 6), ("a", 9), ("b", 2)) for i in range(n)], "key string, v long")
    no_pass_over_facts(monkeypatch)
    got = scale.with_group_stats(df, ["key"], {"n": F.count("*"), "top": F.max("v")})
    assert got.columns == ["key", "v", "n", "top"]
    assert sorted((r.key or "", r.v, r.n, r.top) for r in got.collect()) == sorted(
        (k, i, n, n - 1) for k, n in (("", 6), ("a", 9), ("b", 2)) for i in range(n))


def test_parcel_sharing_reads_operations_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"o{i}", 2000 + i % 2, f"c{i % 3}", float(i), [f"p{rng.randrange(6)}" for _ in range(1 + i % 2)] if i % 10 else []) for i in range(60)]
    df = spark.createDataFrame(rows, "operation_id string, year int, crop string, area_ac double, pids array<string>")
    no_pass_over_facts(monkeypatch)
    got = {r.operation_id: (r.quarter_year_operation_count, r.quarter_year_crops, r.quarter_year_area_ac) for r in matching.parcel_sharing(df).collect()}
    for key, year, _, _, pids in rows:
        others = [r for r in rows if r[1] == year and set(r[4]) & set(pids)]
        assert got[key] == (len(others), sorted({r[2] for r in others}), sum(r[3] for r in others))


def test_operations_grouped_without_parcel_nodes(spark, monkeypatch):
    """Chains, a crowded parcel, repeated ids and rows that share nothing."""
    rows = [(f"o{i:03}", "x" if i % 7 else "y", 2000, [f"p{i}", f"p{i + 1}"] if i % 3 else [f"p{i}"]) for i in range(60)]
    rows += [(f"h{i:03}", "x", 2001, ["hub"]) for i in range(20)] + [("h000", "x", 2001, ["far"]), ("k", "x", 2001, ["far"]), ("alone", "x", 2001, ["own"])]
    df = spark.createDataFrame(rows, "operation_id string, crop string, year int, pids array<string>")
    no_pass_over_facts(monkeypatch)
    nodes = {}
    edges = [(("o", c, y, k), ("p", c, y, p)) for k, c, y, pids in rows for p in pids]
    for pair in edges:
        for n in pair:
            nodes.setdefault(n, len(nodes))
    roots = brute_components([(nodes[a], nodes[b]) for a, b in edges])
    least = {}
    for (_, c, y, k), n in ((n, i) for n, i in nodes.items() if n[0] == "o"):
        least[roots[n]] = min(least.get(roots[n], "~"), "\x01".join(["o", c, str(y), k]))
    got = field_years.group_operations(df).collect()
    assert len(got) == len(rows)
    assert {(r.operation_id, r.crop, r.year, r.group_id) for r in got} == {(k, c, y, least[roots[nodes["o", c, y, k]]]) for k, c, y, _ in rows}


def test_shared_flags_know_their_hot_headings(spark, monkeypatch):
    rows = [("", 2000, "oats", i) for i in range(8)] + [("A", 2000, "oats" if i else "rye", i) for i in range(6)] + [("B", 2000, "oats", 0), ("C", 2000, "oats", 0), ("c ", 2000, "oats", 1)]
    df = spark.createDataFrame(rows, "field_heading_raw string, year int, crop string, i int").withColumn("crop_raw", F.col("crop"))
    no_pass_over_facts(monkeypatch)
    got = {(r.field_heading_raw, r.shared_flag) for r in harvest.shared_field_flags(df).collect()}
    one, many = "multiple_operations_same_field_year", "multiple_crops_same_field_year"
    assert got == {("", None), ("A", many), ("B", None), ("C", one), ("c ", one)}
