"""Training tables, group-relative values, field-years and regional statistics over the order tables.

Stand-ins: an order is a field-year (field o_custkey, crop o_orderpriority,
season of o_orderdate, yield o_totalprice); a nation-year is a region-year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import scale
from furrow.bindings.common import rounded, rounded_sql, table
from furrow.functions import scalars
from furrow.operators import field_years, groups, labels, matching, selection, tables

QUERIES, ORACLES = {}, {}


def seasons(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("field_key"), F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("crop"), F.col("o_totalprice").alias("yield"), F.lit("bu/ac").alias("yield_unit"))
    return orders


SEASONS = """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS field_key, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS crop,
 o_totalprice AS yield, 'bu/ac' AS yield_unit FROM orders"""


# --- training tables ----------------------------------------------------------

def join_labels_complete(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") > 400, F.col("n_chars")).alias("n_chars"))
    marks = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return selection.complete_cases(labels.join_labels(docs, marks, "doc_id"), ["n_chars"], ["quality", "toxic"])


QUERIES["join_labels_complete"] = join_labels_complete
ORACLES["join_labels_complete"] = """SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars > 400"""


def dropped_by_crop(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("crop_label"), F.when(F.col("n_chars") > 400, F.col("n_chars")).alias("x"))
    return selection.dropped_by_crop(docs, selection.complete_cases(docs, ["x"], ["crop_label"]))


QUERIES["dropped_by_crop"] = dropped_by_crop
ORACLES["dropped_by_crop"] = """SELECT lang AS crop_label, count(*) AS rows, count(*) FILTER (n_chars <= 400) AS dropped FROM documents GROUP BY lang HAVING count(*) > 0"""


def unmatched_labels(spark, sf):
    docs = table(spark, sf, "documents")
    return labels.unmatched(docs, table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("unmatched"))


QUERIES["unmatched_labels"] = unmatched_labels
ORACLES["unmatched_labels"] = "SELECT lang, count(*) AS unmatched FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"


def pixel_yield_join(spark, sf):
    quarter = F.concat(F.lit("NW-"), F.col("l_suppkey").cast("string"))
    pixels = table(spark, sf, "lineitem").select(quarter.alias("quarter_section"), F.year("l_shipdate").alias("year"), "l_quantity")
    raw = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority").agg(
        F.avg("o_totalprice").alias("y"))
    raw = raw.select(F.concat(F.lit(" nw-"), "o_custkey").alias("quarter section id"), F.col("o_orderpriority").alias("crop type"),
                     "year", F.col("y").cast("string").alias("yield (bu/ac)"))
    yields = labels.load_yield_reference(raw, {"1-URGENT": "hard wheat", "5-LOW": "oats"})
    joined = labels.join_pixel_yield(pixels, yields)
    return rounded(joined.groupBy("row_id", "quarter_section", "year", "crop").agg(
        F.count("*").alias("pixels"), F.avg("l_quantity").alias("mean_quantity"), F.max("yield_bu_ac").alias("yield_bu_ac")), 2)


QUERIES["pixel_yield_join"] = pixel_yield_join
ORACLES["pixel_yield_join"] = rounded_sql("""WITH p AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, count(*) AS pixels, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY ALL),
 y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CASE o_orderpriority WHEN '1-URGENT' THEN 'hard wheat' WHEN '5-LOW' THEN 'oats' ELSE o_orderpriority END AS crop,
   avg(o_totalprice) AS yield_bu_ac FROM orders GROUP BY ALL)
 SELECT 'NW-' || l_suppkey || '_' || replace(crop, ' ', '') || '_' || p.year AS row_id, 'NW-' || l_suppkey AS quarter_section, p.year, crop, pixels, mean_quantity, yield_bu_ac
 FROM p JOIN y ON l_suppkey = o_custkey AND p.year = y.year""", ["mean_quantity", "yield_bu_ac"], 2)


def require_features(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    usable = table(spark, sf, "part").where("p_size <= 40").select("p_partkey")
    return labels.require_features(items, usable, ["l_orderkey"], ["p_partkey"])


QUERIES["require_features"] = require_features
ORACLES["require_features"] = """SELECT l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 40
 GROUP BY l_orderkey HAVING count(*) = count(p_partkey)"""


def exclude_sampled(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), "c_name")
    return labels.exclude_sampled(customers, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("pid")))


QUERIES["exclude_sampled"] = exclude_sampled
ORACLES["exclude_sampled"] = "SELECT c_custkey AS pid, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def wanted_parcels(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity > 49").select((F.col("l_partkey") + 5).alias("pid"))
    parcels = table(spark, sf, "part").select(F.col("p_partkey").alias("pid"))
    found = labels.wanted_parcels(parcels, wanted).withColumn("status", F.lit("found"))
    return found.unionByName(labels.missing_parcels(wanted, parcels).withColumn("status", F.lit("missing")))


QUERIES["wanted_parcels"] = wanted_parcels
ORACLES["wanted_parcels"] = """SELECT pid, CASE WHEN pid IN (SELECT p_partkey FROM part) THEN 'found' ELSE 'missing' END AS status
 FROM (SELECT DISTINCT l_partkey + 5 AS pid FROM lineitem WHERE l_quantity > 49)"""


def label_years(spark, sf):
    weekly = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("quarter_section"), F.year("l_shipdate").alias("year")).agg(
        F.count("*").alias("n"))
    marks = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("quarter_section"), F.year("o_orderdate").alias("year")).agg(
        F.min("o_orderpriority").alias("crop"))
    return labels.join_label_years(weekly, marks)


QUERIES["join_label_years"] = label_years
ORACLES["join_label_years"] = """SELECT w.quarter_section, w.year, n, crop FROM (SELECT l_suppkey AS quarter_section, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n FROM lineitem GROUP BY ALL) w
 LEFT JOIN (SELECT o_custkey AS quarter_section, CAST(year(o_orderdate) AS INT) AS year, min(o_orderpriority) AS crop FROM orders GROUP BY ALL) m
 ON w.quarter_section = m.quarter_section AND w.year = m.year"""


def distinct_lookup(spark, sf):
    pixels = table(spark, sf, "lineitem").select(F.concat(F.lit("w-"), "l_suppkey").alias("quarter_section"), F.col("l_returnflag").alias("crop"),
                                                 F.year("l_shipdate").alias("year"), F.floor("l_quantity").alias("yield_bu_ac"))
    return labels.distinct_lookup(pixels)


QUERIES["distinct_lookup"] = distinct_lookup
ORACLES["distinct_lookup"] = """SELECT DISTINCT 'SW-' || l_suppkey AS quarter_section, l_returnflag AS crop, CAST(year(l_shipdate) AS INT) AS year,
 floor(l_quantity) AS yield_bu_ac, floor(l_quantity) AS yield_original, 'bu/ac' AS yield_original_unit FROM lineitem"""


def feature_units(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.min("l_shipdate").alias("d"))
    matches = rows.select(F.col("l_orderkey").cast("string").alias("operation_id"), F.year("d").alias("year"), F.lit("wheat").alias("crop"),
                          F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("pids"), (F.col("l_orderkey") % 2 == 0).alias("boundary_pilot_eligible"))
    parcels = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("pid"), F.lit(None).cast("array<array<array<array<double>>>>").alias("polys"))
    return labels.feature_units(matches, parcels).select("pid", "year", "crop", F.array_join("operation_ids", "|").alias("operation_ids"))


QUERIES["feature_units"] = feature_units
ORACLES["feature_units"] = """WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS op, CAST(year(min(l_shipdate)) AS INT) AS year, min(l_partkey) AS a, max(l_partkey) AS b
   FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey), u AS (SELECT a AS pid, op, year FROM o UNION SELECT b, op, year FROM o)
 SELECT CAST(pid AS VARCHAR) AS pid, year, 'wheat' AS crop, string_agg(op, '|' ORDER BY op) AS operation_ids FROM u GROUP BY pid, year"""


# --- operations on parcels ------------------------------------------------------

def operations(spark, sf):
    """Operations on two parcels each."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    orders = table(spark, sf, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("operation_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("crop"),
        F.col("q").alias("area_ac"), F.col("p").alias("production"),
        F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("pids"))


OPERATIONS = """SELECT o_orderkey AS operation_id, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS crop, q AS area_ac, p AS production, a, b
 FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1)
 ON o_orderkey = l_orderkey"""


def quarter_year_sharing(spark, sf):
    out = matching.parcel_sharing(operations(spark, sf))
    status = matching.sharing_status(F.col("quarter_year_operation_count"), F.col("quarter_year_crops"))
    return rounded(out.select("operation_id", "quarter_year_operation_count", F.array_join("quarter_year_crops", "|").alias("quarter_year_crops"),
                              "quarter_year_area_ac", status.alias("quarter_year_status")), 3)


QUERIES["quarter_year_sharing"] = quarter_year_sharing
ORACLES["quarter_year_sharing"] = rounded_sql(f"""WITH o AS ({OPERATIONS}), u AS (SELECT operation_id, year, a AS pid FROM o UNION SELECT operation_id, year, b FROM o),
 s AS (SELECT DISTINCT x.operation_id, y.operation_id AS other FROM u x JOIN u y ON x.pid = y.pid AND x.year = y.year),
 g AS (SELECT s.operation_id, count(*) AS quarter_year_operation_count, string_agg(DISTINCT crop, '|' ORDER BY crop) AS quarter_year_crops,
   sum(area_ac) AS quarter_year_area_ac, count(DISTINCT crop) AS k FROM s JOIN o ON o.operation_id = s.other GROUP BY s.operation_id)
 SELECT * EXCLUDE (k), CASE WHEN quarter_year_operation_count <= 1 THEN 'single_operation' WHEN k = 1 THEN 'shared_same_crop' ELSE 'shared_multiple_crops' END AS quarter_year_status FROM g""",
    ["quarter_year_area_ac"], 3)


COMPONENTS = f"""o AS ({OPERATIONS}), u AS (SELECT operation_id, year, crop, a AS pid FROM o UNION SELECT operation_id, year, crop, b FROM o),
 e AS (SELECT DISTINCT x.operation_id AS s, y.operation_id AS d FROM u x JOIN u y ON x.pid = y.pid AND x.year = y.year AND x.crop = y.crop),
 r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
 c AS (SELECT s AS operation_id, min(d) AS root FROM r GROUP BY s)"""


def grouped_operations(ops):
    ops = ops.withColumn("operation_id", F.format_string("%010d", "operation_id"))
    return scale.cut_lineage(field_years.group_operations(ops), wide=True)


def whole_operations(spark, sf):
    """Every order as an operation on the parcels of all its line items; one without a known parcel is on land of its own."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("pids"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("operation_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("crop"))
    own = F.array(F.concat(F.lit("of "), F.col("operation_id").cast("string")))
    return orders.join(lines, F.col("operation_id") == F.col("l_orderkey"), "left").select(
        *orders.columns, F.when(F.size("pids") > 0, F.col("pids")).otherwise(own).alias("pids"))


def connected_groups(spark, sf):
    rows = grouped_operations(whole_operations(spark, sf))
    return rows.groupBy("group_id").agg(F.min("operation_id").cast("bigint").alias("root"), F.count("*").alias("operations")).drop("group_id")


QUERIES["connected_groups"] = connected_groups
ORACLES["connected_groups"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS operation_id, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS crop FROM orders),
 u AS (SELECT DISTINCT operation_id, year, crop, l_partkey AS pid FROM o JOIN lineitem ON l_orderkey = operation_id),
 l AS (SELECT operation_id AS s, min(operation_id) OVER (PARTITION BY year, crop, pid) AS d FROM u WHERE pid IS NOT NULL),
 e AS (SELECT s, d FROM l UNION SELECT d, s FROM l UNION SELECT operation_id, operation_id FROM o),
 r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
 c AS (SELECT s AS operation_id, min(d) AS root FROM r GROUP BY s)
 SELECT root, count(*) AS operations FROM c GROUP BY root"""


def field_year(spark, sf):
    rows = grouped_operations(operations(spark, sf))
    pids = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pids")))), "|")
    out = rows.groupBy("group_id", "year", "crop").agg(
        (F.sum("production") / F.sum("area_ac")).alias("yield"), F.sum("area_ac").alias("area_ac"), F.count("*").alias("operation_count"),
        field_years.sorted_join(F.col("operation_id").cast("bigint").cast("string")).alias("operation_ids"), pids.alias("pids"))
    return rounded(out.drop("group_id"), 4)


QUERIES["field_year"] = field_year
ORACLES["field_year"] = rounded_sql(f"""WITH RECURSIVE {COMPONENTS}, p AS (SELECT root, string_agg(DISTINCT CAST(pid AS VARCHAR), '|' ORDER BY CAST(pid AS VARCHAR)) AS pids
   FROM c JOIN u USING (operation_id) GROUP BY root), g AS (SELECT root, year, crop, sum(production) / sum(area_ac) AS yield, sum(area_ac) AS area_ac, count(*) AS operation_count,
   string_agg(CAST(operation_id AS VARCHAR), '|' ORDER BY CAST(operation_id AS VARCHAR)) AS operation_ids FROM c JOIN o USING (operation_id) GROUP BY ALL)
 SELECT year, crop, yield, area_ac, operation_count, operation_ids, pids FROM g JOIN p USING (root)""", ["yield", "area_ac"], 4)


def weighted_means(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("value", F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")))
    return rounded(rows.groupBy(F.substring(F.col("l_suppkey").cast("string"), 1, 2).alias("section_key")).agg(
        field_years.weighted_mean(F.col("value"), F.col("l_quantity") - 5).alias("value"),
        field_years.sorted_join(F.col("l_returnflag")).alias("flags")), 3)


QUERIES["weighted_mean"] = weighted_means
ORACLES["weighted_mean"] = rounded_sql("""SELECT substr(CAST(l_suppkey AS VARCHAR), 1, 2) AS section_key,
 sum(l_extendedprice * (l_quantity - 5)) FILTER (l_discount > 0.02 AND l_quantity > 5) / sum(l_quantity - 5) FILTER (l_discount > 0.02 AND l_quantity > 5) AS value,
 string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1""", ["value"], 3)


# --- group-relative values ------------------------------------------------------

def pixels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("row_id"), "l_orderkey", F.col("l_quantity").alias("NDVI_max"), F.col("l_discount").alias("NDVI_min"),
        F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("NDVI_integral_proxy"),
        (F.col("l_suppkey") * 2.0 + 10.0).alias("yield_bu_ac"))


SCALED = """s AS (SELECT l_suppkey AS row_id, l_orderkey, l_quantity AS a, l_discount AS b, CASE WHEN l_tax > 0.01 THEN l_extendedprice END AS c,
   l_suppkey * 2.0::DOUBLE + 10.0 AS y FROM lineitem),
 q AS (SELECT row_id, quantile_cont(a, 0.05) AS al, quantile_cont(a, 0.95) AS ah, quantile_cont(b, 0.05) AS bl, quantile_cont(b, 0.95) AS bh,
   quantile_cont(c, 0.05) AS cl, quantile_cont(c, 0.95) AS ch FROM s GROUP BY row_id),
 f AS (SELECT row_id, l_orderkey, a, b, c, y, coalesce((least(greatest(a, al), ah) - al) / nullif(ah - al, 0), 0.5) AS sa,
   coalesce((least(greatest(b, bl), bh) - bl) / nullif(bh - bl, 0), 0.5) AS sb,
   CASE WHEN c IS NULL THEN 0.5 ELSE coalesce((least(greatest(c, cl), ch) - cl) / nullif(ch - cl, 0), 0.5) END AS sc FROM s JOIN q USING (row_id)),
 g AS (SELECT *, 0.25 + 0.75 * (0.5 * sa + 0.3 * sc + 0.2 * sb) AS score FROM f),
 h AS (SELECT *, least(greatest(score / avg(score) OVER (PARTITION BY row_id), 0.5), 1.5) AS f0 FROM g),
 e AS (SELECT *, f0 / avg(f0) OVER (PARTITION BY row_id) AS factor FROM h)"""


def scale_within_group(spark, sf):
    out = groups.scale_within_group(pixels(spark, sf), ["NDVI_max", "NDVI_min", "NDVI_integral_proxy"], "row_id")
    return rounded(out.select("row_id", "l_orderkey", "NDVI_max_field_scaled", "NDVI_min_field_scaled", "NDVI_integral_proxy_field_scaled"))


QUERIES["scale_within_group"] = scale_within_group
ORACLES["scale_within_group"] = rounded_sql(f"""WITH {SCALED} SELECT row_id, l_orderkey, sa AS "NDVI_max_field_scaled", sb AS "NDVI_min_field_scaled",
 sc AS "NDVI_integral_proxy_field_scaled" FROM f""", ["NDVI_max_field_scaled", "NDVI_min_field_scaled", "NDVI_integral_proxy_field_scaled"])


def redistribute_yield(spark, sf):
    out = groups.redistribute_yield(pixels(spark, sf))
    return rounded(out.select("row_id", "l_orderkey", "ndvi_score", "pixel_yield_factor", "pixel_yield_est_bu_ac",
                              "field_mean_pixel_yield_est_bu_ac", F.abs(F.round("field_yield_balance_error_bu_ac", 6)).alias("balance")), 4)


QUERIES["redistribute_yield"] = redistribute_yield
ORACLES["redistribute_yield"] = rounded_sql(f"""WITH {SCALED} SELECT row_id, l_orderkey, score AS ndvi_score, factor AS pixel_yield_factor, y * factor AS pixel_yield_est_bu_ac,
 avg(y * factor) OVER (PARTITION BY row_id) AS field_mean_pixel_yield_est_bu_ac, abs(round(avg(y * factor) OVER (PARTITION BY row_id) - y, 6)) AS balance FROM e""",
    ["ndvi_score", "pixel_yield_factor", "pixel_yield_est_bu_ac", "field_mean_pixel_yield_est_bu_ac", "balance"], 4)


def pixel_summary(spark, sf):
    out = groups.pixel_summary(groups.redistribute_yield(pixels(spark, sf)), order=["l_orderkey"])
    return rounded(out.withColumn("yield_balance_error_bu_ac", F.abs(F.round("yield_balance_error_bu_ac", 6))))


QUERIES["pixel_summary"] = pixel_summary
ORACLES["pixel_summary"] = rounded_sql(f"""WITH {SCALED} SELECT row_id, count(*) AS pixel_count, min(y) AS field_yield_bu_ac, avg(y * factor) AS estimated_mean_pixel_yield_bu_ac,
 min(y * factor) AS estimated_min_pixel_yield_bu_ac, max(y * factor) AS estimated_max_pixel_yield_bu_ac, avg(factor) AS mean_pixel_yield_factor,
 min(factor) AS min_pixel_yield_factor, max(factor) AS max_pixel_yield_factor, avg(score) AS mean_ndvi_score, min(score) AS min_ndvi_score, max(score) AS max_ndvi_score,
 abs(round(avg(y * factor) - min(y), 6)) AS yield_balance_error_bu_ac FROM e GROUP BY row_id""",
    ["field_yield_bu_ac", "estimated_mean_pixel_yield_bu_ac", "estimated_min_pixel_yield_bu_ac", "estimated_max_pixel_yield_bu_ac", "mean_pixel_yield_factor",
     "min_pixel_yield_factor", "max_pixel_yield_factor", "mean_ndvi_score", "min_ndvi_score", "max_ndvi_score", "yield_balance_error_bu_ac"])


def parcel_years(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("quarter_id"), F.year("l_shipdate").alias("year")).agg(
        F.max("l_extendedprice").alias("peak_ndvi"), F.avg("l_quantity").alias("peak_evi"), F.avg("l_discount").alias("peak_ndre1"),
        F.avg("l_tax").alias("seasonal_ndmi"), F.min("l_extendedprice").alias("seasonal_msi"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("mean_smap_moisture")).withColumn(
        "crop_guess", F.concat(F.lit("crop"), F.col("quarter_id") % 3))


_W = {"peak_ndvi": 0.25, "peak_evi": 0.20, "peak_ndre1": 0.20, "seasonal_ndmi": 0.15, "mean_smap_moisture": 0.10, "seasonal_msi": -0.10}


def _index(part):
    return " + ".join(f"{w} * coalesce(({c} - avg({c}) OVER {part}) / nullif(stddev_pop({c}) OVER {part}, 0), 0)" for c, w in _W.items())


POTENTIAL = f"""p AS (SELECT l_suppkey AS quarter_id, CAST(year(l_shipdate) AS INT) AS year, max(l_extendedprice) AS peak_ndvi, avg(l_quantity) AS peak_evi, avg(l_discount) AS peak_ndre1,
   avg(l_tax) AS seasonal_ndmi, min(l_extendedprice) AS seasonal_msi, avg(l_tax) FILTER (l_returnflag = 'R') AS mean_smap_moisture, 'crop' || l_suppkey % 3 AS crop_guess FROM lineitem GROUP BY ALL),
 i AS (SELECT *, {_index('wy')} AS iw, {_index('wc')} AS ia FROM p WINDOW wy AS (PARTITION BY crop_guess, year), wc AS (PARTITION BY crop_guess)),
 k AS (SELECT *, row_number() OVER (PARTITION BY crop_guess, year ORDER BY round(iw, 9), quarter_id, year) / count(*) OVER (PARTITION BY crop_guess, year) AS pw,
   row_number() OVER (PARTITION BY crop_guess ORDER BY round(ia, 9), quarter_id, year) / count(*) OVER (PARTITION BY crop_guess) AS pa FROM i)"""


def yield_potential(spark, sf):
    out = groups.yield_potential(parcel_years(spark, sf))
    return rounded(out.drop(*_W), 5)


def _class(p):
    return f"CASE WHEN {p} <= 0.33 THEN 'low' WHEN {p} <= 0.67 THEN 'medium' ELSE 'high' END"


QUERIES["zscore_index_percentile_class"] = yield_potential
ORACLES["zscore_index_percentile_class"] = rounded_sql(f"""WITH {POTENTIAL} SELECT quarter_id, year, crop_guess, iw AS yield_potential_index_within_year,
 pw AS yield_potential_percentile_within_year, {_class('pw')} AS yield_potential_class_within_year, ia AS yield_potential_index_across_years,
 pa AS yield_potential_percentile_across_years, {_class('pa')} AS yield_potential_class_across_years FROM k""",
    ["yield_potential_index_within_year", "yield_potential_percentile_within_year", "yield_potential_index_across_years", "yield_potential_percentile_across_years"], 5)


def index_summary(spark, sf):
    return rounded(groups.index_summary(groups.yield_potential(parcel_years(spark, sf))), 5)


QUERIES["index_summary"] = index_summary
ORACLES["index_summary"] = rounded_sql(f"""WITH {POTENTIAL}, b AS (SELECT *, row_number() OVER (PARTITION BY quarter_id, crop_guess ORDER BY pw DESC, year) AS rb,
   row_number() OVER (PARTITION BY quarter_id, crop_guess ORDER BY pw, year) AS rw FROM k)
 SELECT quarter_id, crop_guess, count(*) AS num_years, avg(pw) AS mean_within_year_percentile, avg(ia) AS mean_across_year_index, max(year) FILTER (rb = 1) AS best_year,
   max(pw) AS best_within_year_percentile, max(year) FILTER (rw = 1) AS worst_year, min(pw) AS worst_within_year_percentile FROM b GROUP BY ALL""",
    ["mean_within_year_percentile", "mean_across_year_index", "best_within_year_percentile", "worst_within_year_percentile"], 5)


def _scenes(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("batch_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("cloud"),
        scalars.week_index(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("week"))


SCENES = """SELECT event_id, ts, user_id AS batch_id, CASE WHEN event_type <> 'error' THEN value END AS cloud,
 CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS INT) AS week FROM events"""


def rank_scenes(spark, sf):
    return groups.rank_scenes(_scenes(spark, sf), ["batch_id", "week"], "cloud", ["ts", "event_id"]).select("event_id", "batch_id", "week", "rank")


QUERIES["rank_scenes"] = rank_scenes
ORACLES["rank_scenes"] = f"""SELECT event_id, batch_id, week, row_number() OVER (PARTITION BY batch_id, week ORDER BY coalesce(cloud, 999.0), ts, event_id) AS rank FROM ({SCENES})"""


def limit_per_week(spark, sf):
    out = groups.rank_scenes(_scenes(spark, sf), ["week"], "cloud", ["ts", "event_id"], limit=8)
    return out.select("event_id", "week", F.col("rank").cast("bigint").alias("rank"))


QUERIES["limit_per_week"] = limit_per_week
ORACLES["limit_per_week"] = f"""SELECT * FROM (SELECT event_id, week, row_number() OVER (PARTITION BY week ORDER BY coalesce(cloud, 999.0), ts, event_id) AS rank FROM ({SCENES})) WHERE rank <= 8"""


def centre_by_season(spark, sf):
    return rounded(groups.centre(seasons(spark, sf), ["yield"]).select("o_orderkey", "centred_yield"), 3)


QUERIES["centre_by_season"] = centre_by_season
ORACLES["centre_by_season"] = rounded_sql(f"SELECT o_orderkey, yield - avg(yield) OVER (PARTITION BY crop, year) AS centred_yield FROM ({SEASONS})", ["centred_yield"], 3)


def seasons_with_contrast(spark, sf):
    rows = seasons(spark, sf).withColumn("crop", F.concat("crop", F.lit("/"), "field_key"))
    return rounded(groups.seasons_with_contrast(rows).select("o_orderkey", "departure"), 3)


QUERIES["seasons_with_contrast"] = seasons_with_contrast
ORACLES["seasons_with_contrast"] = rounded_sql(f"""SELECT o_orderkey, yield - avg(yield) OVER (PARTITION BY crop, field_key, year) AS departure FROM ({SEASONS})
 QUALIFY count(*) OVER (PARTITION BY crop, field_key, year) >= 2""", ["departure"], 3)


def others_mean(spark, sf):
    rows = seasons(spark, sf).withColumn("crop", F.concat("crop", F.lit("/"), "field_key"))
    return rounded(groups.others_mean(rows, fallback=F.lit(-1.0)).select("o_orderkey", "others_mean"), 3)


QUERIES["others_mean"] = others_mean
ORACLES["others_mean"] = rounded_sql(f"""SELECT o_orderkey, coalesce((sum(yield) OVER w - yield) / nullif(count(*) OVER w - 1, 0), -1.0) AS others_mean FROM ({SEASONS})
 WINDOW w AS (PARTITION BY crop, field_key, year)""", ["others_mean"], 3)


def field_history(spark, sf):
    rows = seasons(spark, sf)
    out = groups.field_history(rows, rows, own_year_out=True)
    return rounded(out.select("o_orderkey", "field_history"))


HISTORY = f"""d AS (SELECT field_key, year, yield / avg(yield) OVER (PARTITION BY crop, year) - 1 AS d FROM ({SEASONS}) QUALIFY count(*) OVER (PARTITION BY crop, year) >= 2),
 y AS (SELECT field_key, year, avg(d) AS own FROM d GROUP BY ALL), t AS (SELECT field_key, sum(own) AS s, count(*) AS n FROM y GROUP BY ALL)"""
QUERIES["field_history"] = field_history
ORACLES["field_history"] = rounded_sql(f"""WITH {HISTORY} SELECT o_orderkey, coalesce((s - coalesce(own, 0)) / nullif(n - (own IS NOT NULL)::INT, 0), 0) AS field_history
 FROM ({SEASONS}) r LEFT JOIN t ON r.field_key = t.field_key LEFT JOIN y ON r.field_key = y.field_key AND r.year = y.year""", ["field_history"])


def field_history_means(spark, sf):
    return rounded(groups.field_history_means(seasons(spark, sf)))


QUERIES["field_history_means"] = field_history_means
ORACLES["field_history_means"] = rounded_sql(f"WITH {HISTORY} SELECT field_key, avg(own) AS field_history FROM y GROUP BY field_key", ["field_history"])


# --- regions ---------------------------------------------------------------------

def regions(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("region"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("crop")).agg(
        F.avg("o_totalprice").alias("regional_yield"), F.count("*").alias("pixels"), F.avg(F.col("o_custkey") / 100).alias("field_NDVI_jul"),
        F.avg(F.col("o_orderkey") / 1000).alias("field_EVI_jul"))


REGIONS = """SELECT c_nationkey AS region, CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS crop, avg(o_totalprice) AS regional_yield, count(*) AS pixels,
 avg(o_custkey / 100) AS field_NDVI_jul, avg(o_orderkey / 1000) AS field_EVI_jul FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def region_anomaly(spark, sf):
    rows = regions(spark, sf)
    out = groups.region_anomaly(rows, rows.where("year < 1998"), ["field_NDVI_jul"])
    return rounded(out.select("region", "year", "crop", "relative_mean", "field_NDVI_jul"))


QUERIES["region_anomaly"] = region_anomaly
ORACLES["region_anomaly"] = rounded_sql(f"""WITH r AS ({REGIONS}), m AS (SELECT region, crop, avg(regional_yield) AS y, avg(field_NDVI_jul) AS f FROM r WHERE year < 1998 GROUP BY ALL)
 SELECT region, year, crop, regional_yield / y AS relative_mean, field_NDVI_jul - f AS "field_NDVI_jul" FROM r JOIN m USING (region, crop)""", ["relative_mean", "field_NDVI_jul"])


def ratio_of_sums(spark, sf):
    rows = regions(spark, sf).withColumn("published", F.when(F.col("pixels") > 3, F.col("field_EVI_jul")))
    return rounded(groups.ratio_of_sums(rows, ["crop"], "regional_yield", "published"))


QUERIES["ratio_of_sums"] = ratio_of_sums
ORACLES["ratio_of_sums"] = rounded_sql(f"""SELECT crop, sum(regional_yield) FILTER (pixels > 3) / sum(field_EVI_jul) FILTER (pixels > 3) AS ratio FROM ({REGIONS}) GROUP BY crop""", ["ratio"])


def drop_low_coverage(spark, sf):
    return selection.drop_low_coverage(regions(spark, sf), 0.8).select("region", "year", "crop", "pixels")


QUERIES["drop_low_coverage"] = drop_low_coverage
ORACLES["drop_low_coverage"] = f"""SELECT region, year, crop, pixels FROM ({REGIONS}) JOIN (SELECT region, crop, median(pixels) AS m FROM ({REGIONS}) GROUP BY ALL) USING (region, crop) WHERE pixels >= 0.8 * m"""


def cross_sensor_slope(spark, sf):
    rows = regions(spark, sf).select("region", "crop", F.col("regional_yield").alias("NDVI_landsat"), F.col("field_EVI_jul").alias("NDVI_s2"),
                                     F.col("field_NDVI_jul").alias("EVI_landsat"), F.col("pixels").cast("double").alias("EVI_s2"))
    return rounded(groups.cross_sensor_slope(rows, ["NDVI", "EVI"]))


QUERIES["cross_sensor_slope"] = cross_sensor_slope
ORACLES["cross_sensor_slope"] = rounded_sql(f"""WITH c AS (SELECT field_EVI_jul - avg(field_EVI_jul) OVER w AS x, regional_yield - avg(regional_yield) OVER w AS y,
   pixels - avg(pixels) OVER w AS x2, field_NDVI_jul - avg(field_NDVI_jul) OVER w AS y2 FROM ({REGIONS}) WINDOW w AS (PARTITION BY region, crop))
 SELECT sum(x * y) / sum(x * x) AS "NDVI", sum(x2 * y2) / sum(x2 * x2) AS "EVI" FROM c""", ["NDVI", "EVI"])


def join_region_months(spark, sf):
    from furrow.plans.season import region_table
    rows = regions(spark, sf)
    july = rows.select("region", "year", "crop", "pixels", "field_NDVI_jul").where("pixels > 1")
    august = rows.select("region", "year", "crop", (F.col("pixels") + 1).alias("pixels"), F.col("field_EVI_jul").alias("field_NDVI_aug")).where("crop <> '5-LOW'")
    return rounded(region_table(rows, [july, august]))


QUERIES["join_region_months"] = join_region_months
ORACLES["join_region_months"] = rounded_sql(f"""SELECT region, year, crop, regional_yield, pixels, field_NDVI_jul AS "field_NDVI_jul", field_EVI_jul AS "field_NDVI_aug"
 FROM ({REGIONS}) WHERE pixels > 1 AND crop <> '5-LOW'""", ["regional_yield", "field_NDVI_jul", "field_NDVI_aug"])


def published_yields(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("REF_DATE"), F.concat(F.lit("Region "), F.col("o_custkey") % 9).alias("GEO"),
        F.when(F.col("o_orderstatus") == "F", "Average yield (bushels per acre)").otherwise("Seeded area").alias("Harvest disposition"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Barley").when(F.col("o_orderpriority") == "5-LOW", "Peas, dry").otherwise("Flax").alias("Type of crop"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise(" ").alias("VALUE"), F.lit(" A ").alias("STATUS"))
    out = selection.published_yields(rows, ["Region 1", "Region 4"], 1997)
    return rounded(out.groupBy("region", "year", "crop", "unit", "status").agg(F.sum("regional_yield").alias("total"), F.count("*").alias("n")), 2)


QUERIES["published_yields"] = published_yields
ORACLES["published_yields"] = rounded_sql("""SELECT 'Region ' || o_custkey % 9 AS region, CAST(year(o_orderdate) AS INT) AS year,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'barley' ELSE 'field_peas' END AS crop, 'bu/ac' AS unit, 'A' AS status, sum(o_totalprice) AS total, count(*) AS n
 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderkey % 5 <> 0 AND o_custkey % 9 IN (1, 4) AND year(o_orderdate) >= 1997 GROUP BY ALL""", ["total"], 2)


# --- tables ------------------------------------------------------------------------

def dedupe_first(spark, sf):
    docs = table(spark, sf, "documents")
    return tables.dedupe_first(docs.select("text", "doc_id", "source"), ["text"], [F.col("doc_id")]).select("doc_id", "source")


QUERIES["dedupe_first"] = dedupe_first
ORACLES["dedupe_first"] = "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text"


def concat_dedupe(spark, sf):
    users = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    parts = [users.where("event_type = 'purchase'"), users.where("event_type = 'click'"), users.where("event_type NOT IN ('purchase', 'click')")]
    return tables.concat_dedupe(parts, ["user_id"], [F.col("event_id")])


QUERIES["concat_dedupe"] = concat_dedupe
ORACLES["concat_dedupe"] = """SELECT user_id, event_id, event_type FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) = 1"""


def sample_n(spark, sf):
    return tables.sample_n(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 42)


QUERIES["sample_n"] = sample_n
ORACLES["sample_n"] = "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || ':42') LIMIT 100"


def batch_ranges(spark, sf):
    out = tables.batch_ranges(table(spark, sf, "customer").select("c_custkey"), [F.col("c_custkey")], 40, ["ann", "bo", "cy"])
    return out.groupBy("batch_id", "assignee").agg(F.min("feature_index").alias("feature_start"), (F.max("feature_index") + 1).alias("feature_end"),
                                                   F.count("*").alias("feature_count"))


QUERIES["batch_ranges"] = batch_ranges
ORACLES["batch_ranges"] = """WITH t AS (SELECT count(*) AS n FROM customer), b AS (SELECT CAST(unnest(range(40)) AS INT) AS i)
 SELECT printf('batch_%02d', i + 1) AS batch_id, ['ann', 'bo', 'cy'][CAST(i % 3 + 1 AS INT)] AS assignee, n * i // 40 AS feature_start, n * (i + 1) // 40 AS feature_end,
   n * (i + 1) // 40 - n * i // 40 AS feature_count FROM b, t"""


def upsert_status(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_mktsegment").alias("state"), F.lit("").alias("notes"))
    changes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(
        F.when(F.count("*") > 10, "busy").alias("state"), F.max("o_orderpriority").alias("notes"), F.count("*").alias("orders"))
    first = tables.upsert_status(base, changes.drop("orders"))
    return tables.upsert_status(first, changes.select("batch_id", "notes", "orders"))


QUERIES["upsert_status"] = upsert_status
ORACLES["upsert_status"] = """WITH c AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p FROM orders GROUP BY 1)
 SELECT c_custkey AS batch_id, CASE WHEN n > 10 THEN 'busy' ELSE c_mktsegment END AS state, coalesce(p || ' | ' || p, '') AS notes, n AS orders
 FROM customer LEFT JOIN c ON c_custkey = o_custkey"""


def dataset_summary(spark, sf):
    return tables.dataset_summary(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("Area"), F.col("l_suppkey").alias("Item"), F.year("l_shipdate").alias("Year")))


QUERIES["dataset_summary"] = dataset_summary
ORACLES["dataset_summary"] = """SELECT count(*) AS rows, 3 AS columns, count(DISTINCT l_partkey) AS areas, count(DISTINCT l_suppkey) AS items,
 CAST(min(year(l_shipdate)) AS INT) AS year_min, CAST(max(year(l_shipdate)) AS INT) AS year_max FROM lineitem"""


def clean_history(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Unnamed: 0"), F.col("l_returnflag").alias("Area"), F.col("l_linestatus").alias("Item"), F.date_format("l_shipdate", "yyyy").alias("Year"),
        F.col("l_quantity").cast("string").alias("hg/ha_yield"), F.col("l_extendedprice").cast("string").alias("average_rain_fall_mm_per_year"),
        F.col("l_discount").cast("string").alias("pesticides_tonnes"), F.col("l_tax").cast("string").alias("avg_temp"))
    rows = tables.clean_history(raw)
    return rounded(rows.groupBy("Area", "Item", "Year").agg(F.sum("hg/ha_yield").alias("yield"), F.avg("avg_temp").alias("temp"), F.count("*").alias("n")), 4)


QUERIES["clean_history"] = clean_history
ORACLES["clean_history"] = rounded_sql("""SELECT l_returnflag AS "Area", l_linestatus AS "Item", CAST(year(l_shipdate) AS INT) AS "Year", sum(l_quantity) AS yield, avg(l_tax) AS temp, count(*) AS n
 FROM lineitem GROUP BY ALL""", ["yield", "temp"], 4)


def best_candidate(spark, sf):
    """Per crop the field with the lowest error, ties to the smaller key."""
    rows = seasons(spark, sf).groupBy("crop", "field_key").agg(F.round(F.avg("yield"), -4).alias("mae"))
    return rows.groupBy("crop").agg(F.min_by("field_key", F.struct("mae", "field_key")).alias("best"), F.min("mae").alias("mae"))


QUERIES["best_candidate"] = best_candidate
ORACLES["best_candidate"] = f"""SELECT crop, arg_min(field_key, (mae, field_key)) AS best, min(mae) AS mae FROM (SELECT crop, field_key, round(avg(yield), -4) AS mae FROM ({SEASONS}) GROUP BY ALL) GROUP BY crop"""


def status_counts(spark, sf):
    return tables.status_counts(table(spark, sf, "orders"), {
        "by_status": F.col("o_orderstatus"), "by_priority": F.col("o_orderpriority"), "by_year": F.year("o_orderdate")})


QUERIES["status_counts"] = status_counts
ORACLES["status_counts"] = """SELECT 'by_status' AS counter, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY ALL
 UNION ALL SELECT 'by_year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY ALL"""


def min_group_size(spark, sf):
    out = selection.min_group_size(table(spark, sf, "orders"), ["o_custkey"], 6, distinct="o_orderkey")
    return out.groupBy("o_custkey").agg(F.count("*").alias("n"))


QUERIES["min_group_size"] = min_group_size
ORACLES["min_group_size"] = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 6"


def null_sentinel(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_tax") == 0, -9999.0).otherwise(F.col("l_tax")).alias("a"),
                                               F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("b"),
                                               F.when(F.col("l_linenumber") == 1, -9999).otherwise(F.col("l_linenumber")).alias("c"))
    clean = selection.null_sentinel(rows, keep=("l_suppkey",))
    return rounded(clean.groupBy("l_suppkey").agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.sum("c").alias("c")))


QUERIES["null_sentinel"] = null_sentinel
ORACLES["null_sentinel"] = rounded_sql("""SELECT l_suppkey, avg(nullif(l_tax, 0)) AS a, avg(nullif(l_discount, 0)) AS b, CAST(sum(nullif(l_linenumber, 1)) AS BIGINT) AS c
 FROM lineitem GROUP BY l_suppkey""", ["a", "b"])


def missing_by_family(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("NDVI_jul"), F.when(F.col("l_discount") > 0.03, 1.0).alias("B4_aug"),
                                               F.when(F.col("l_quantity") > 5, 1.0).alias("VV_jun"), F.col("l_quantity").alias("PRECIP_may"))
    return selection.missing_by_family(rows, rows.columns)


QUERIES["missing_by_family"] = missing_by_family
ORACLES["missing_by_family"] = """SELECT 's2' AS family, count(*) AS rows_missing FROM lineitem WHERE NOT (l_tax > 0.02 AND l_discount > 0.03)
 UNION ALL SELECT 's1', count(*) FROM lineitem WHERE NOT l_quantity > 5"""
