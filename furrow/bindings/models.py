"""Scores, folds, linear and fitted models over orders, documents and embeddings.

Stand-ins: orders with their line items are field-years (crop from the customer's
market segment, season from the date); nation-years are region-years; embeddings
with their label are pixel rows of a crop.
"""

from __future__ import annotations



from pyspark.sql import functions as F

from furrow import scale
from furrow.bindings.common import rounded, rounded_sql, table
from furrow.columns import BENCHMARK_FEATURE_SETS, PEAK_FEATURES
from furrow.operators import folds, metrics, tables
from furrow.plans import benchmark, bundle, linear, models, season

QUERIES, ORACLES = {}, {}


def yields(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("crop"), F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("yield"), F.when(F.col("c_mktsegment") == "BUILDING", "lb/ac").otherwise("bu/ac").alias("yield_unit"))


YIELDS = """SELECT o_orderkey, c_mktsegment AS crop, c_nationkey AS nation, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS yield,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'lb/ac' ELSE 'bu/ac' END AS yield_unit FROM orders JOIN customer ON o_custkey = c_custkey"""


# --- scores ---------------------------------------------------------------------------

def regression_metrics(spark, sf):
    rows = folds.training_mean(yields(spark, sf), ["crop"], "year", "yield", "predicted")
    rows = scale.with_group_stats(rows, ["crop"], {"baseline": F.avg("yield")})
    return rounded(metrics.with_pooled(rows, ["crop", "yield_unit"], baseline="baseline"), 3)


def _scores(source):
    return f"""SELECT crop, yield_unit, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) AS bias,
      1 - sum(e * e) / (var_pop(yield) * count(*)) AS r2, avg(abs(e / yield)) AS mape, avg(abs(baseline - yield)) AS baseline_mae,
      1 - avg(abs(e)) / avg(abs(baseline - yield)) AS skill FROM {source} GROUP BY crop, yield_unit"""


QUERIES["regression_metrics"] = regression_metrics
ORACLES["regression_metrics"] = rounded_sql(f"""WITH y AS ({YIELDS}), s AS (SELECT *, (sum(yield) OVER c - sum(yield) OVER f) / (count(*) OVER c - count(*) OVER f) - yield AS e,
   avg(yield) OVER c AS baseline FROM y WINDOW c AS (PARTITION BY crop), f AS (PARTITION BY crop, year)),
 p AS (SELECT * REPLACE ('all bu/ac crops' AS crop) FROM s WHERE yield_unit = 'bu/ac')
 {_scores('s')} UNION ALL {_scores('p')}""", ["mae", "rmse", "bias", "r2", "mape", "baseline_mae", "skill"], 3)


def training_mean(spark, sf):
    return rounded(folds.training_mean(yields(spark, sf), ["nation"], "year", "yield").select("o_orderkey", "pred_baseline"), 3)


QUERIES["mean_baseline"] = training_mean
ORACLES["mean_baseline"] = rounded_sql(f"""SELECT o_orderkey, (sum(yield) OVER c - sum(yield) OVER f) / nullif(count(*) OVER c - count(*) OVER f, 0) AS pred_baseline
 FROM ({YIELDS}) WINDOW c AS (PARTITION BY nation), f AS (PARTITION BY nation, year)""", ["pred_baseline"], 3)


def _judged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumns({
        "truth": F.when(F.col("quality") == 1, "good").otherwise("bad"), "guess": F.when(F.col("n_chars") > 600, "good").when(F.col("lang") == "de", "odd").otherwise("bad")})


JUDGED = """SELECT doc_id, source, lang, n_chars, quality, toxic, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS truth,
 CASE WHEN n_chars > 600 THEN 'good' WHEN lang = 'de' THEN 'odd' ELSE 'bad' END AS guess FROM documents JOIN labels USING (doc_id)"""
QUERIES["confusion"] = lambda spark, sf: metrics.confusion(_judged(spark, sf), "truth", "guess", ["lang"])
ORACLES["confusion"] = f"SELECT lang, truth, guess AS predicted, count(*) AS n FROM ({JUDGED}) GROUP BY ALL"


def class_f1(spark, sf):
    return rounded(metrics.class_metrics(metrics.confusion(_judged(spark, sf), "truth", "guess")))


CLASS_F1 = f"""WITH j AS ({JUDGED}), c AS (SELECT truth AS class FROM j UNION SELECT guess FROM j), k AS (SELECT class, count(*) FILTER (truth = class) AS support,
   count(*) FILTER (guess = class) AS pn, count(*) FILTER (truth = class AND guess = class) AS tp FROM c, j GROUP BY class),
 m AS (SELECT class, coalesce(tp / nullif(pn, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + pn, 0), 0) AS f1, support FROM k)"""
QUERIES["class_f1"] = class_f1
ORACLES["class_f1"] = rounded_sql(f"{CLASS_F1} SELECT * FROM m", ["precision", "recall", "f1"])


def overall_scores(spark, sf):
    return rounded(metrics.overall_metrics(metrics.confusion(_judged(spark, sf), "truth", "guess")))


QUERIES["overall_scores"] = overall_scores
ORACLES["overall_scores"] = rounded_sql(f"""{CLASS_F1} SELECT sum(recall * support) / sum(support) AS accuracy, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1,
 CAST(sum(support) AS BIGINT) AS rows FROM m WHERE support > 0""", ["accuracy", "balanced_accuracy", "macro_f1"])


def ranking_scores(spark, sf):
    return rounded(metrics.ranking_metrics(_judged(spark, sf), "quality", "n_chars", ["lang"]))


QUERIES["ranking_scores"] = ranking_scores
ORACLES["ranking_scores"] = rounded_sql(f"""WITH p AS (SELECT lang, n_chars, sum(quality) AS pos, sum(1 - quality) AS neg FROM ({JUDGED}) GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER d AS pa, sum(neg) OVER d AS na, sum(neg) OVER a - neg AS below FROM p WINDOW d AS (PARTITION BY lang ORDER BY n_chars DESC), a AS (PARTITION BY lang ORDER BY n_chars))
 SELECT lang, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, sum(pos * (pa / (pa + na))) / nullif(sum(pos), 0) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives,
   CAST(sum(pos + neg) AS BIGINT) AS evaluated_rows FROM c GROUP BY lang""", ["roc_auc", "average_precision"])


def field_vote(spark, sf):
    share = F.least(F.col("n_chars") / 2000, F.lit(1.0))
    rows = _judged(spark, sf).withColumn("p", F.array(1 - share, share))
    return metrics.field_vote(rows, "source", "truth", "p", ["bad", "good"], ["lang"])


QUERIES["field_vote"] = field_vote
ORACLES["field_vote"] = f"""SELECT lang, source, CASE WHEN 1 - avg(least(n_chars / 2000, 1.0)) >= avg(least(n_chars / 2000, 1.0)) THEN 'bad' ELSE 'good' END AS predicted,
 CASE WHEN count(*) FILTER (truth = 'good') > count(*) FILTER (truth = 'bad') THEN 'good' ELSE 'bad' END AS truth FROM ({JUDGED}) GROUP BY ALL"""


def fold_summary(spark, sf):
    rows = folds.training_mean(yields(spark, sf), ["crop"], "year", "yield", "predicted")
    per_fold = metrics.regression_metrics(rows, ["crop", "year"])
    return rounded(metrics.fold_summary(per_fold, ["crop"], ["mae", "bias"]), 3)


QUERIES["fold_summary"] = fold_summary
ORACLES["fold_summary"] = rounded_sql(f"""WITH s AS (SELECT crop, year, (sum(yield) OVER c - sum(yield) OVER f) / (count(*) OVER c - count(*) OVER f) - yield AS e FROM ({YIELDS})
   WINDOW c AS (PARTITION BY crop), f AS (PARTITION BY crop, year)), k AS (SELECT crop, year, avg(abs(e)) AS mae, avg(e) AS bias FROM s GROUP BY ALL)
 SELECT crop, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, count(*) AS mae_folds, avg(bias) AS bias_mean, stddev_pop(bias) AS bias_std, count(*) AS bias_folds FROM k GROUP BY crop""",
    ["mae_mean", "mae_std", "bias_mean", "bias_std"], 3)


def class_field_counts(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("crop_label"), F.col("l_orderkey").alias("pid"))
    return metrics.class_field_counts(rows)


QUERIES["class_field_counts"] = class_field_counts
ORACLES["class_field_counts"] = "SELECT l_returnflag AS crop_label, count(DISTINCT l_orderkey) AS fields FROM lineitem GROUP BY 1"


def class_weights(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag")
    return rounded(folds.class_weights(rows, "l_returnflag").groupBy("l_returnflag").agg(F.max("weight").alias("weight"), F.count("*").alias("n")))


QUERIES["class_weights"] = class_weights
ORACLES["class_weights"] = rounded_sql("""SELECT l_returnflag, (SELECT count(*) / count(DISTINCT l_returnflag) FROM lineitem) / count(*) AS weight, count(*) AS n FROM lineitem GROUP BY 1""", ["weight"])

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def rank_features(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"l_tax": F.when(F.col("l_tax") > 0, F.col("l_tax")), "constant": F.lit(1.0)})
    out = metrics.rank_features(rows, [*FEATURES, "constant"], "l_returnflag", 4)
    return rounded(out.select("class", F.col("rank").cast("bigint").alias("rank"), "feature", "abs_r"))


QUERIES["rank_features"] = rank_features
ORACLES["rank_features"] = rounded_sql("WITH f AS (" + " UNION ALL ".join(
    f"SELECT c AS class, '{f}' AS feature, {i} AS pos, coalesce(abs(corr({'nullif(l_tax, 0)' if f == 'l_tax' else f}, (l_returnflag = c)::INT)), 0) AS abs_r FROM lineitem, (VALUES ('A'), ('N'), ('R')) v(c) GROUP BY c"
    for i, f in enumerate(FEATURES)) + """) SELECT class, rank, feature, abs_r FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs_r DESC, pos) AS rank FROM f) WHERE rank <= 4""", ["abs_r"])


def experiment_pivot(spark, sf):
    rows = yields(spark, sf).groupBy("crop", F.when(F.col("year") < 1998, "s2").otherwise("s2+s1").alias("experiment")).agg(F.avg("yield").alias("f1"))
    return rounded(tables.experiment_pivot(rows, ["s2", "s2+s1"], "f1"), 3)


QUERIES["experiment_pivot"] = experiment_pivot
ORACLES["experiment_pivot"] = rounded_sql(f"""SELECT crop, avg(yield) FILTER (year < 1998) AS s2, avg(yield) FILTER (year >= 1998) AS "s2+s1",
 avg(yield) FILTER (year >= 1998) - avg(yield) FILTER (year < 1998) AS delta FROM ({YIELDS}) GROUP BY crop""", ["s2", "s2+s1", "delta"], 3)


# --- linear models -----------------------------------------------------------------------

def impute_standardise(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("a"), "l_quantity",
                                               (F.year("l_shipdate") < 1999).alias("train"))
    filled = linear.impute_median(rows, ["l_returnflag"], ["a"], training=F.col("train"))
    return rounded(linear.standardise(filled, ["l_returnflag"], ["a", "l_quantity"], training=F.col("train")).drop("train"), 5)


QUERIES["impute_standardise"] = impute_standardise
ORACLES["impute_standardise"] = rounded_sql("""WITH r AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_tax > 0.02 THEN l_tax END AS a, l_quantity, year(l_shipdate) < 1999 AS train FROM lineitem),
 m AS (SELECT l_returnflag, median(a) FILTER (train) AS med FROM r GROUP BY 1), f AS (SELECT l_orderkey, l_returnflag, coalesce(a, med) AS a, l_quantity, train FROM r JOIN m USING (l_returnflag)),
 s AS (SELECT l_returnflag, avg(a) FILTER (train) AS ma, stddev_pop(a) FILTER (train) AS sa, avg(l_quantity) FILTER (train) AS mq, stddev_pop(l_quantity) FILTER (train) AS sq FROM f GROUP BY 1)
 SELECT l_orderkey, l_returnflag, (a - ma) / sa AS a, (l_quantity - mq) / sq AS l_quantity FROM f JOIN s USING (l_returnflag)""", ["a", "l_quantity"], 5)


def ols_ridge(spark, sf):
    gram = linear.moments(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    out = linear.fit_linear(gram, ["l_returnflag"], 1, 5000.0).withColumn("model", F.lit("ridge")).unionByName(
        linear.fit_linear(gram, ["l_returnflag"], 1, 0.0).withColumn("model", F.lit("ols")))
    return rounded(out.select("l_returnflag", "model", "intercept", F.get("coef", F.lit(0)).alias("slope")), 3)


QUERIES["ols_ridge"] = ols_ridge
ORACLES["ols_ridge"] = rounded_sql("""WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx,
   covar_pop(l_quantity, l_extendedprice) AS cxy FROM lineitem GROUP BY 1), m AS (SELECT *, 'ols' AS model, cxy / vx AS slope FROM s
   UNION ALL SELECT *, 'ridge', n * cxy / (n + 5000.0) / vx FROM s) SELECT l_returnflag, model, my - slope * mx AS intercept, slope FROM m""", ["intercept", "slope"], 3)


def gram_sums(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    gram = linear.moments(table(spark, sf, "lineitem"), ["l_linestatus"], cols, "l_linenumber")
    return rounded(gram.select("l_linestatus", F.posexplode("moments").alias("place", "value")), 2)


_z = ["1.0", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
QUERIES["gram_sums"] = gram_sums
ORACLES["gram_sums"] = rounded_sql(" UNION ALL ".join(
    f"SELECT l_linestatus, CAST({i * 5 + j} AS INT) AS place, CAST(sum({a} * {b}) AS DOUBLE) AS value FROM lineitem GROUP BY l_linestatus" for i, a in enumerate(_z) for j, b in enumerate(_z)), ["value"], 2)


def field_table(spark, sf):
    """Field-years with satellite-like columns that partly explain the yield."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("q"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.groupBy(F.col("o_custkey").cast("string").alias("field_key"), F.col("c_mktsegment").alias("crop"), F.col("c_nationkey").cast("string").alias("section_key"),
                        F.year("o_orderdate").alias("year")).agg(
        F.avg("price").alias("yield"), F.avg("q").alias("field_NDVI_jul"), F.avg("d").alias("field_NDRE_jul"), F.avg("t").alias("field_EVI_jul"),
        F.sum("q").alias("w_precip_may_aug"), F.count("*").cast("double").alias("w_gdd5_may_aug"), F.max("q").alias("w_tmax_jul"))
    return rows.withColumn("yield_unit", F.lit("bu/ac")).withColumns({c.replace("field_", "quarter_"): F.col(c) * 0.9 for c in PEAK_FEATURES})


def region_rows(spark, sf):
    rows = field_table(spark, sf)
    return rows.groupBy(F.col("section_key").alias("region"), "year", "crop").agg(
        F.avg("yield").alias("regional_yield"), F.count("*").alias("pixels"), *[F.avg(c).alias(c) for c in PEAK_FEATURES])


def ridge_loo(spark, sf):
    params = linear.ridge_loo(scale.cut_lineage(field_table(spark, sf)), ["crop"], PEAK_FEATURES, "yield")
    return params.select("crop", "alpha", "n", "intercept", F.to_json("coef").alias("coef"))


QUERIES["ridge_loo"] = ridge_loo


def ridge_loo_one_feature(spark, sf):
    """One feature has a closed form; a NULL key and incomplete rows among them."""
    rows = table(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("A")).alias("crop"), F.when(F.col("l_tax") < 0.07, F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))
    params = linear.ridge_loo(rows, ["crop"], ["x"], "y")
    return rounded(params.select("crop", "alpha", F.col("n").cast("bigint").alias("n"), "intercept", F.get("coef", F.lit(0)).alias("slope")), 3)


QUERIES["ridge_loo_one_feature"] = ridge_loo_one_feature
ORACLES["ridge_loo_one_feature"] = rounded_sql(f"""WITH r AS (SELECT nullif(l_returnflag, 'A') AS crop, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem WHERE l_tax < 0.07 AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
 m AS (SELECT crop, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd FROM r GROUP BY crop),
 z AS (SELECT r.crop, n, mx, my, sd, (x - mx) / sd AS z, y - my AS e FROM r JOIN m ON r.crop IS NOT DISTINCT FROM m.crop),
 c AS (SELECT crop, sum(z * e) AS zy, sum(z * z) AS zz FROM z GROUP BY crop),
 s AS (SELECT z.crop, alpha, sum(((e - z * zy / (zz + alpha)) / (1 - 1.0 / n - z * z / (zz + alpha))) ** 2) AS sse
       FROM z JOIN c ON z.crop IS NOT DISTINCT FROM c.crop, (SELECT unnest([{', '.join(f'{a!r}e0' for a in linear.LOO_ALPHAS)}]) AS alpha) GROUP BY 1, 2),
 b AS (SELECT crop, arg_min(alpha, (round(sse, 9), alpha)) AS alpha FROM s GROUP BY 1)
 SELECT m.crop, b.alpha, n, my - zy / (zz + b.alpha) / sd * mx AS intercept, zy / (zz + b.alpha) / sd AS slope
 FROM m JOIN c ON m.crop IS NOT DISTINCT FROM c.crop JOIN b ON m.crop IS NOT DISTINCT FROM b.crop""", ["alpha", "intercept", "slope"], 3)


def season_ridge(spark, sf):
    params = linear.season_ridge(scale.cut_lineage(field_table(spark, sf)), ["crop"], PEAK_FEATURES, "yield")
    return params.select("crop", "alpha", "n", "intercept", F.to_json("coef").alias("coef"))


QUERIES["season_ridge"] = season_ridge


DRAW = "CAST('0x' || substr(md5({key} || ':' || '{seed}'), 1, 15) AS BIGINT)"


def grouped_folds(spark, sf):
    rows = field_table(spark, sf)
    return folds.fold_table(rows, "field_key", 5, stratify="crop")


QUERIES["grouped_fold_table"] = grouped_folds
ORACLES["grouped_fold_table"] = f"""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS field_key, c_mktsegment AS crop, count(DISTINCT year(o_orderdate)) AS n
   FROM orders JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY ALL),
 c AS (SELECT field_key, sum(n) AS size, arg_max(crop, (n, crop)) AS class FROM f GROUP BY 1),
 d AS (SELECT *, {DRAW.format(key='field_key', seed=42)} AS draw FROM c),
 o AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d WINDOW w AS (ORDER BY size DESC, draw, field_key)),
 t AS (SELECT *, i < 5 AND bool_and(i < 5 AND size * (5 - i) >= total - before) OVER (ORDER BY i) AS alone FROM o),
 k AS (SELECT count(*) FILTER (alone) AS own, greatest(1, 5 - count(*) FILTER (alone)) AS rest FROM t),
 p AS (SELECT t.*, own, rest, row_number() OVER (PARTITION BY class ORDER BY size DESC, draw, field_key) - 1 + CAST('0x' || md5(class)[1:15] AS BIGINT) % rest AS place FROM t, k WHERE NOT alone)
 SELECT field_key, CAST(i AS INT) AS fold FROM t WHERE alone
 UNION ALL SELECT field_key, CAST(own + CASE WHEN (place // rest) % 2 = 0 THEN place % rest ELSE rest - 1 - place % rest END AS INT) FROM p"""


def grouped_holdout(spark, sf):
    return folds.grouped_holdout(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


QUERIES["grouped_holdout"] = grouped_holdout
ORACLES["grouped_holdout"] = f"""WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY {DRAW.format(key='c_nationkey', seed=42)}, c_nationkey) AS r, count(*) OVER () AS n
   FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, c_nationkey, r <= ceil(0.25 * n) AS is_test FROM customer JOIN g USING (c_nationkey)"""


def stratified_folds(spark, sf):
    return folds.stratified_folds(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5)


QUERIES["stratified_folds"] = stratified_folds
ORACLES["stratified_folds"] = f"""SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format(key='c_custkey', seed=42)}, c_custkey) - 1) % 5 AS INT) AS fold
 FROM customer"""


def stratified_holdout(spark, sf):
    return folds.stratified_holdout(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.3)


QUERIES["stratified_holdout"] = stratified_holdout
ORACLES["stratified_holdout"] = f"""SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format(key='c_custkey', seed=42)}, c_custkey)
   <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.3) AS is_test FROM customer"""
QUERIES["shuffled_folds"] = lambda spark, sf: folds.shuffled_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)
ORACLES["shuffled_folds"] = f"SELECT o_orderkey, CAST({DRAW.format(key='o_orderkey', seed=42)} % 5 AS INT) AS fold FROM orders"


def seasons_of(rows):
    """Every season of the table."""
    return tuple(season.season_list(rows.where("year IS NOT NULL")))


def season_evaluation(spark, sf):
    rows = scale.cut_lineage(field_table(spark, sf))
    return season.evaluate_season_field(rows, years=seasons_of(rows), deviation_features="peak_history").metrics


def season_evaluation_regional(spark, sf):
    rows = scale.cut_lineage(field_table(spark, sf))
    return season.evaluate_season_field(rows, years=seasons_of(rows), deviation_features="peak",
                                        season_features="regional_satellite", regions=region_rows(spark, sf)).metrics


def season_variants(spark, sf):
    """The variants of the evaluation that have a closed form."""
    return rounded(season_evaluation(spark, sf).where("variant IN ('baseline', 'known_season')"), 3)


QUERIES["season_field_evaluation"] = season_evaluation
QUERIES["season_closed_form_variants"] = season_variants
ORACLES["season_closed_form_variants"] = rounded_sql("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1),
 f AS (SELECT o_custkey, c_mktsegment AS crop, year(o_orderdate) AS year, avg(price) AS y FROM orders JOIN l ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 b AS (SELECT *, (sum(y) OVER c - sum(y) OVER s) / (count(*) OVER c - count(*) OVER s) AS base, (sum(y) OVER s - y) / nullif(count(*) OVER s - 1, 0) AS others FROM f
   WINDOW c AS (PARTITION BY crop), s AS (PARTITION BY crop, year)),
 v AS (SELECT crop, year, y, base, 'baseline' AS variant, base AS p FROM b UNION ALL SELECT crop, year, y, base, 'known_season', coalesce(others, base) FROM b)
 SELECT crop, 'bu/ac' AS yield_unit, variant, count(*) AS field_years, avg(abs(p - y)) AS mae, avg(p - y) AS bias, 1 - avg(abs(p - y)) / avg(abs(base - y)) AS skill,
   count(DISTINCT year) AS seasons FROM v GROUP BY crop, variant""", ["mae", "bias", "skill"], 3)
QUERIES["season_field_evaluation_regional"] = season_evaluation_regional
QUERIES["regional_model_evaluation"] = lambda spark, sf: season.evaluate_regional_models(region_rows(spark, sf))


def season_bundle(spark, sf):
    rows = scale.cut_lineage(field_table(spark, sf))
    last = rows.agg(F.max("year")).first()[0]
    fitted = bundle.fit_bundle(rows, region_rows(spark, sf), test_year=last)
    return bundle.score_bundle(bundle.predict_bundle(fitted, rows.where(F.col("year") == last)))


QUERIES["season_bundle_scores"] = season_bundle
#: The benchmark's own feature sets, with those of their columns that the table has.
SETS = {name: [c for c in columns if c in PEAK_FEATURES] for name, columns in BENCHMARK_FEATURE_SETS.items()}


def field_benchmark(spark, sf):
    return benchmark.benchmark_field_yield(field_table(spark, sf), sets=SETS)[0]


def margin_holdout(spark, sf):
    rows = scale.cut_lineage(benchmark.slim(field_table(spark, sf), SETS), wide=True)
    last = rows.agg(F.max("year")).first()[0]
    return benchmark.holdout_with_margin(rows, test_year=last, min_improvement=0.1, sets=SETS)[1]


QUERIES["field_benchmark"] = field_benchmark
QUERIES["margin_holdout"] = margin_holdout


def pixel_yield(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("crop"), F.col("l_suppkey").cast("string").alias("row_id"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").cast("string").alias("quarter_section"),
        F.col("l_extendedprice").alias("yield_bu_ac"), F.col("l_quantity").alias("NDVI_max"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("VV_mean"), F.col("l_tax").alias("slope"))
    return benchmark.pixel_yield_cv(rows, include_baseline=True)[0]


QUERIES["pixel_yield_cv"] = pixel_yield


# --- fitted models -------------------------------------------------------------------------

WIDTH = 64


def pixels(spark, sf):
    """Embeddings as pixel rows: all their values as features, three crops and a field per ten rows."""
    rows = table(spark, sf, "embeddings")
    return rows.select(F.format_string("%06d", F.floor(F.col("vec_id") / 10)).alias("pid"), F.floor(F.col("vec_id") / 10).cast("string").alias("row_id"), "vec_id",
                       F.element_at(F.array(F.lit("barley"), F.lit("canola"), F.lit("wheat")), (F.col("label") % 3 + 1).cast("int")).alias("crop"),
                       *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(WIDTH)])


COLUMNS = [f"e{i}" for i in range(WIDTH)]


def knn_regress(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    out = models.knn_regress(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "vec_id", "embedding", "y")
    return rounded(out, 4)


QUERIES["knn_regress"] = knn_regress
ORACLES["knn_regress"] = rounded_sql("""SELECT vec_id, avg(y) AS predicted FROM (SELECT a.vec_id, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY
   round(array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])), 9), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0) WHERE r <= 5 GROUP BY vec_id""",
    ["predicted"], 4)


def _classify(kind, **options):
    def run(spark, sf):
        rows = pixels(spark, sf)
        predicted, report = models.holdout(rows, COLUMNS, "crop", kind, **options)
        return report
    return run


QUERIES["decision_tree"] = _classify("decision_tree")
QUERIES["logistic_regression"] = _classify("logistic")
QUERIES["random_forest"] = _classify("random_forest")
QUERIES["boosted"] = _classify("boosted")


def cross_validation(spark, sf):
    return models.cross_validate(pixels(spark, sf), COLUMNS, "crop", "decision_tree")["field_class_summary"]


def one_vs_rest(spark, sf):
    rows = pixels(spark, sf)
    fitted, _ = models.one_vs_rest(rows, COLUMNS, "crop", "decision_tree")
    scored = models.predict_one_vs_rest(fitted, rows, COLUMNS, "decision_tree")
    return scored.select("vec_id", "crop", "predicted", "confidence")


def one_vs_rest_ranked(spark, sf):
    return models.one_vs_rest_ranked(pixels(spark, sf), COLUMNS, "crop", group="row_id")[0]


def pixel_classifier(spark, sf):
    return models.pixel_classifier(pixels(spark, sf), COLUMNS)[0]


def historical_benchmark(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("Area"), F.col("p_type").alias("Item"), F.col("p_size").alias("Year"), "p_partkey",
                                           F.col("p_retailprice").alias("hg/ha_yield"), (F.col("p_partkey") / 100).alias("avg_temp"))
    return models.historical_benchmark(rows, key="p_partkey")


QUERIES["cross_validation"] = cross_validation
QUERIES["one_vs_rest"] = one_vs_rest
QUERIES["one_vs_rest_ranked"] = one_vs_rest_ranked
QUERIES["pixel_classifier"] = pixel_classifier
QUERIES["historical_benchmark"] = historical_benchmark
