"""Masks, composites, zonal statistics and labels over lineitem and events.

Stand-ins: a lineitem row is a pixel observation (parcel l_suppkey, pixel
l_partkey, date l_shipdate, numeric columns as bands, l_tax as cloud); an event
is a reading of a station (user_id) with an inventory code in props.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.bindings.common import rounded, rounded_sql, table
from furrow.columns import MONTHS, SEASONAL_WINDOWS
from furrow.functions import indices, scalars, temporal
from furrow.operators import composites, labels, selection, zonal

QUERIES, ORACLES = {}, {}


def observations(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pid"), F.col("l_partkey").alias("pixel_id"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("scene_id"), (F.col("l_tax") * 1000).alias("scene_cloud"),
        F.col("l_linenumber").alias("scl"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("region"),
        F.col("l_quantity").alias("B4"), (F.col("l_extendedprice") / 1000).alias("B8"),
        (F.col("l_discount") * 10).alias("B2"), (F.col("l_tax") * 10 + 1).alias("B3"),
        (F.col("l_quantity") + 3).alias("B5"))
    return composites.add_calendar(rows)


OBS = """SELECT l_suppkey AS pid, l_partkey AS pixel_id, l_shipdate AS ts, l_orderkey AS scene_id,
 l_tax * 1000 AS scene_cloud, l_linenumber AS scl, l_returnflag AS flag, l_linestatus AS region,
 l_quantity AS B4, l_extendedprice / 1000 AS B8, l_discount * 10 AS B2, l_tax * 10 + 1 AS B3, l_quantity + 3 AS B5,
 CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month FROM lineitem"""


def codes(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("user_id", F.when(k == 0, 0).otherwise(100 + k).alias("code"))


CODES = """SELECT user_id, CASE WHEN k = 0 THEN 0 ELSE 100 + k END AS code FROM
 (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


# --- composites -------------------------------------------------------------

def monthly_median_composite(spark, sf):
    clear = selection.mask_scl(selection.filter_scenes(observations(spark, sf)))
    medians = composites.monthly_median(clear, ["pid"], ["B2", "B4", "B8"])
    return rounded(medians.withColumns({
        "NDVI": indices.normalised_difference(F.col("B8"), F.col("B4")),
        "EVI": indices.evi(F.col("B8"), F.col("B4"), F.col("B2"))}))


QUERIES["monthly_median_composite"] = monthly_median_composite
ORACLES["monthly_median_composite"] = rounded_sql(f"""
 SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI,
   2.5 * (B8 - B4) / nullif(B8 + 6 * B4 - 7.5 * B2 + 1, 0) AS EVI
 FROM (SELECT pid, year, month, median(B2) AS B2, median(B4) AS B4, median(B8) AS B8
       FROM ({OBS}) WHERE scene_cloud < 60 AND scl NOT IN (3, 8, 9, 10) GROUP BY pid, year, month)""",
    ["B2", "B4", "B8", "NDVI", "EVI"])


def seasonal_scene_indices(spark, sf):
    rows = selection.filter_scenes(observations(spark, sf), 50, inclusive=True)
    bands = {b: F.col(b) for b in ("B2", "B3", "B4", "B5", "B8")}
    bands.update({"B6": F.col("B5") + 1, "B11": F.col("B3") + 2, "B12": F.col("B2") + 4})
    chosen = indices.scene_indices(bands)
    rows = rows.withColumns(chosen).withColumn("window", composites.seasonal_window(F.col("ts")))
    rows = rows.where(F.col("window").isNotNull())
    return rounded(zonal.zonal_stats(rows, ["pid", "year", "window"], ["NDVI", "MSI", "OSAVI", "RECI", "NBR2"],
                                     statistics=("mean", "p50"), scene="scene_id"), 5)


QUERIES["seasonal_scene_indices"] = seasonal_scene_indices
ORACLES["seasonal_scene_indices"] = rounded_sql(f"""
 SELECT pid, year, "window", avg(NDVI) AS "NDVI_mean", median(NDVI) AS "NDVI_p50", avg(MSI) AS "MSI_mean",
   median(MSI) AS "MSI_p50", avg(OSAVI) AS "OSAVI_mean", median(OSAVI) AS "OSAVI_p50", avg(RECI) AS "RECI_mean",
   median(RECI) AS "RECI_p50", avg(NBR2) AS "NBR2_mean", median(NBR2) AS "NBR2_p50",
   count(DISTINCT scene_id) AS obs_count
 FROM (SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI, (B3 + 2) / nullif(B8, 0) AS MSI,
    1.16 * (B8 - B4) / nullif(B8 + B4 + 0.16, 0) AS OSAVI, B8 / nullif(B5, 0) - 1 AS RECI,
    (B3 + 2 - (B2 + 4)) / nullif(B3 + 2 + B2 + 4, 0) AS NBR2,
    CASE WHEN md BETWEEN 501 AND 615 THEN 'may_jun' WHEN md BETWEEN 616 AND 731 THEN 'late_jun_jul'
         WHEN md BETWEEN 801 AND 831 THEN 'aug' WHEN md BETWEEN 901 AND 930 THEN 'sep' END AS "window"
   FROM (SELECT *, month * 100 + day(ts) AS md FROM ({OBS}) WHERE scene_cloud <= 50))
 WHERE "window" IS NOT NULL GROUP BY pid, year, "window" """,
    ["NDVI_mean", "NDVI_p50", "MSI_mean", "MSI_p50", "OSAVI_mean", "OSAVI_p50", "RECI_mean", "RECI_p50", "NBR2_mean",
     "NBR2_p50"], 5)


def monthly_sum(spark, sf):
    rows = composites.add_calendar(table(spark, sf, "events"))
    return rounded(composites.monthly_sum(rows, ["user_id"], "value", "rain"), 4)


QUERIES["monthly_sum"] = monthly_sum
ORACLES["monthly_sum"] = rounded_sql("""SELECT user_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
 sum(value) AS rain FROM events GROUP BY ALL""", ["rain"], 4)


def weather_month(spark, sf):
    daily = composites.add_calendar(table(spark, sf, "events")).select(
        "user_id", "year", "month", (F.col("value") / 1000).alias("precip_m"), (F.col("value") / 10 + 270).alias("t_k"),
        (F.col("value") / 10 + 276).alias("tmax_k"), (F.col("value") / 10 + 266).alias("tmin_k"),
        (F.col("value") / 500).alias("soil_water"))
    return rounded(composites.weather_months(daily, ["user_id"]), 4)


QUERIES["weather_month"] = weather_month
ORACLES["weather_month"] = rounded_sql("""SELECT user_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
 sum(value / 1000 * 1000.0) AS precip, avg(value / 10 + 270 - 273.15) AS tmean, avg(value / 10 + 276 - 273.15) AS tmax,
 sum(greatest((value / 10 + 276 + value / 10 + 266) / 2 - 278.15, 0.0)) AS gdd5, avg(value / 500) AS soilwater
 FROM events GROUP BY ALL""", ["precip", "tmean", "tmax", "gdd5", "soilwater"], 4)


def stack_composites(spark, sf):
    rows = observations(spark, sf)
    optical = composites.monthly_median(selection.filter_scenes(rows, 40), ["pid"], ["B4", "B8"])
    radar = composites.monthly_median(rows.select("pid", "year", "month", F.col("B2").alias("VV"), F.col("B3").alias("VH")),
                                      ["pid"], ["VV", "VH"])
    rain = composites.monthly_sum(rows.where("flag = 'R'"), ["pid"], "B5", "PRECIP")
    return rounded(composites.stack_composites([optical, radar, rain], ["pid"]))


QUERIES["stack_composites"] = stack_composites
ORACLES["stack_composites"] = rounded_sql(f"""WITH o AS ({OBS})
 SELECT pid, year, month, B4, B8, VV, VH, PRECIP
 FROM (SELECT pid, year, month, median(B2) AS VV, median(B3) AS VH FROM o GROUP BY ALL)
 FULL JOIN (SELECT pid, year, month, median(B4) AS B4, median(B8) AS B8 FROM o WHERE scene_cloud < 40 GROUP BY ALL)
   USING (pid, year, month)
 FULL JOIN (SELECT pid, year, month, sum(B5) AS PRECIP FROM o WHERE flag = 'R' GROUP BY ALL) USING (pid, year, month)""",
    ["B4", "B8", "VV", "VH", "PRECIP"])


def zonal_mean_wide(spark, sf):
    return rounded(zonal.zonal_mean(observations(spark, sf), ["pid"], ["B2", "B4"]))


QUERIES["zonal_mean_wide"] = zonal_mean_wide
ORACLES["zonal_mean_wide"] = rounded_sql(
    "SELECT pid, " + ", ".join(f'avg({b}) FILTER (month = {n}) AS "{b}_{m}"' for n, m in MONTHS.items() for b in ("B2", "B4"))
    + f" FROM ({OBS}) GROUP BY pid", [f"{b}_{m}" for m in MONTHS.values() for b in ("B2", "B4")])


def zonal_stats(spark, sf):
    rows = table(spark, sf, "events").withColumn("week", scalars.week_index(F.col("ts"), F.lit("2024-01-01").cast("date")))
    return rounded(zonal.zonal_stats(rows, ["event_type", "week"], ["value"], scene="user_id"))


QUERIES["zonal_stats"] = zonal_stats
ORACLES["zonal_stats"] = rounded_sql("""SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS INT) AS week,
 avg(value) AS value_mean, stddev_pop(value) AS "value_stdDev", quantile_cont(value, 0.1) AS value_p10,
 quantile_cont(value, 0.5) AS value_p50, quantile_cont(value, 0.9) AS value_p90, count(DISTINCT user_id) AS obs_count
 FROM events GROUP BY ALL""", ["value_mean", "value_stdDev", "value_p10", "value_p50", "value_p90"])


def zonal_stats_all_windows(spark, sf):
    rows = table(spark, sf, "events").withColumn("week", scalars.week_index(F.col("ts"), F.lit("2024-01-01").cast("date")))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    wanted = zonal.expected_windows(users, ["user_id"], {"week": [1, 2, 3, 4, 5, 6]})
    return rounded(zonal.zonal_stats(rows, ["user_id", "week"], ["value"], scene="event_type", statistics=("mean", "sum", "p90"),
                                     missing=-9999.0, expected=wanted), 4)


QUERIES["zonal_stats_all_windows"] = zonal_stats_all_windows
ORACLES["zonal_stats_all_windows"] = rounded_sql("""SELECT user_id, CAST(week AS INT) AS week, coalesce(value_mean, -9999.0) AS value_mean, coalesce(value_sum, -9999.0) AS value_sum,
 coalesce(value_p90, -9999.0) AS value_p90, coalesce(obs_count, 0) AS obs_count
 FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS week) LEFT JOIN (
   SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS INT) AS week, avg(value) AS value_mean, sum(value) AS value_sum,
     quantile_cont(value, 0.9) AS value_p90, count(DISTINCT event_type) AS obs_count FROM events GROUP BY ALL) USING (user_id, week)""",
    ["value_mean", "value_sum", "value_p90"], 4)


def class_zonal_mean(spark, sf):
    rows = observations(spark, sf).withColumn("NDVI", indices.normalised_difference(F.col("B8"), F.col("B4")))
    crop = zonal.region_class(F.when(F.col("flag") == "A", 140).when(F.col("flag") == "R", 153))
    return rounded(zonal.class_zonal_mean(rows, ["region", "year"], crop, {"field_NDVI_jul": "NDVI", "field_EVI_jul": "B2"}))


QUERIES["class_zonal_mean"] = class_zonal_mean
ORACLES["class_zonal_mean"] = rounded_sql(f"""SELECT region, year, CASE flag WHEN 'A' THEN 'wheat' WHEN 'R' THEN 'canola' END AS crop,
 count(NDVI) AS pixels, avg(NDVI) AS "field_NDVI_jul", avg(B2) AS "field_EVI_jul"
 FROM (SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI FROM ({OBS}) WHERE flag IN ('A', 'R')) GROUP BY ALL""",
    ["field_NDVI_jul", "field_EVI_jul"])


def local_class_means(spark, sf):
    rows = observations(spark, sf).withColumn("NDVI", indices.normalised_difference(F.col("B8"), F.col("B4")))
    return rounded(zonal.local_class_means(rows, F.col("flag"), ["NDVI"], {7: "jul", 8: "aug"}))


QUERIES["local_class_means"] = local_class_means
ORACLES["local_class_means"] = rounded_sql(f"""SELECT year, flag AS crop, count(NDVI) FILTER (month = 7) AS pixels_jul,
 avg(NDVI) FILTER (month = 7) AS "field_NDVI_jul", count(NDVI) FILTER (month = 8) AS pixels_aug,
 avg(NDVI) FILTER (month = 8) AS "field_NDVI_aug"
 FROM (SELECT *, (B8 - B4) / nullif(B8 + B4, 0) AS NDVI FROM ({OBS})) GROUP BY ALL""", ["field_NDVI_jul", "field_NDVI_aug"])


def crop_masked_mean(spark, sf):
    match = (F.col("flag") == "R") & (F.col("region") == "F")
    return rounded(zonal.crop_masked_mean(observations(spark, sf), ["pid", "year"],
                                          {"B4": F.col("B4"), "B8": F.when(F.col("scene_cloud") < 60, F.col("B8"))}, match))


QUERIES["crop_masked_mean"] = crop_masked_mean
ORACLES["crop_masked_mean"] = rounded_sql(f"""SELECT pid, year, avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) AS aci_crop_fraction,
 avg(B4) AS "quarter_B4", avg(B8) FILTER (scene_cloud < 60) AS "quarter_B8", avg(B4) FILTER (m) AS "crop_B4",
 avg(B8) FILTER (m AND scene_cloud < 60) AS "crop_B8"
 FROM (SELECT *, flag = 'R' AND region = 'F' AS m FROM ({OBS})) GROUP BY pid, year""",
    ["aci_crop_fraction", "quarter_B4", "quarter_B8", "crop_B4", "crop_B8"])


def valid_share(spark, sf):
    rows = observations(spark, sf).withColumn("B4", F.when(F.col("scene_cloud") < 60, F.col("B4")))
    return rounded(zonal.valid_share(rows, ["pid", "month"]))


QUERIES["valid_share"] = valid_share
ORACLES["valid_share"] = rounded_sql(f"""SELECT pid, month, avg(CASE WHEN scene_cloud < 60 THEN 1.0 ELSE 0.0 END) AS s2_valid
 FROM ({OBS}) GROUP BY pid, month""", ["s2_valid"])


def class_fractions(spark, sf):
    return rounded(zonal.class_fractions(codes(spark, sf), ["user_id"], "code"))


FRACTIONS = {"canola": 153, "wheat": 140, "spring_wheat": 146, "barley": 133, "oats": 136, "peas": 162, "lentils": 174}
QUERIES["class_fractions"] = class_fractions
ORACLES["class_fractions"] = rounded_sql(f"""WITH c AS ({CODES}), n AS (SELECT user_id, code, count(*) AS n FROM c GROUP BY ALL),
 d AS (SELECT user_id, code AS aafc_dominant_class FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, code) AS r FROM n) WHERE r = 1)
 SELECT user_id, aafc_dominant_class, """ + ", ".join(
    f"avg(CASE WHEN code = {v} THEN 1.0 ELSE 0.0 END) AS aafc_{n}_fraction" for n, v in FRACTIONS.items()) + """,
 avg(CASE WHEN code >= 120 AND code < 200 THEN 1.0 ELSE 0.0 END) AS aafc_ag_fraction
 FROM c JOIN d USING (user_id) GROUP BY user_id, aafc_dominant_class""",
    [f"aafc_{n}_fraction" for n in [*FRACTIONS, "ag"]])


def majority_label_purity(spark, sf):
    labelled = labels.majority_label(codes(spark, sf), "user_id", "code")
    return rounded(selection.filter_purity(labelled, 0.02, keep_other=True))


QUERIES["majority_label_purity"] = majority_label_purity
ORACLES["majority_label_purity"] = rounded_sql(f"""WITH n AS (SELECT user_id, code, count(*) AS n FROM ({CODES}) WHERE code <> 0 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, code) AS r, sum(n) OVER (PARTITION BY user_id) AS total FROM n)
 SELECT user_id, code AS aafc_code, CASE code WHEN 122 THEN 'alfalfa' WHEN 147 THEN 'corn' WHEN 153 THEN 'canola' WHEN 140 THEN 'wheat'
   WHEN 145 THEN 'wheat' WHEN 146 THEN 'wheat' WHEN 133 THEN 'barley' WHEN 136 THEN 'oats' WHEN 162 THEN 'peas' ELSE 'other' END AS crop_label,
   n / total AS label_purity, CAST(total AS BIGINT) AS aafc_pixel_count FROM r WHERE r = 1 AND n / total >= 0.02""", ["label_purity"])


COVERAGE_YEARS = [1997, 1998, 1999]
WINDOW_NAMES = [w[0] for w in SEASONAL_WINDOWS]
WINDOW_CASE = ("CASE " + " ".join(f"WHEN month(ts) * 100 + day(ts) BETWEEN {a * 100 + b} AND {c * 100 + d} THEN '{n}'"
                                  for n, a, b, c, d in SEASONAL_WINDOWS) + " END")


def coverage_years(spark, sf):
    rows = observations(spark, sf).where(F.col("year").isin(COVERAGE_YEARS)).withColumn(
        "window", composites.seasonal_window(F.col("ts"))).where(F.col("window").isNotNull())
    counts = zonal.valid_pixels(rows, ["pid", "year", "window"], "pixel_id", "B8")
    wide = zonal.coverage_diagnostics(counts, "pid", COVERAGE_YEARS, min_pixels=10)
    return selection.filter_coverage_years(wide)


def _coverage_sql():
    px = {(y, w): f"count(DISTINCT pixel_id) FILTER (year = {y} AND w = '{w}')" for y in COVERAGE_YEARS for w in WINDOW_NAMES}
    wide = ", ".join(f"{e} AS coverage_{y}_{w}_valid_px" for (y, w), e in px.items())
    counts = ", ".join("CAST(" + " + ".join(f"(coverage_{y}_{w}_valid_px >= 10)::INT" for w in WINDOW_NAMES)
                       + f" AS INT) AS coverage_{y}_valid_window_count" for y in COVERAGE_YEARS)
    years = "CAST(" + " + ".join(f"(coverage_{y}_valid_window_count >= 2)::INT" for y in COVERAGE_YEARS) + " AS INT)"
    return f"""SELECT * FROM (SELECT *, {years} AS coverage_eligible_year_count FROM (SELECT *, {counts} FROM
      (SELECT pid, {wide} FROM (SELECT *, {WINDOW_CASE} AS w FROM ({OBS}) WHERE year IN (1997, 1998, 1999)) WHERE w IS NOT NULL GROUP BY pid)))
      WHERE coverage_eligible_year_count >= 2"""


QUERIES["coverage_years"] = coverage_years
ORACLES["coverage_years"] = _coverage_sql()


# --- time series --------------------------------------------------------------

def temporal_deltas(spark, sf):
    wide = zonal.zonal_mean(observations(spark, sf), ["pid"], ["B4"])
    return rounded(temporal.add_season_shape(wide))


_m = list(MONTHS.values())
_shape = ([f'"B4_{b}" - "B4_{a}" AS "B4_delta_{a}_{b}"' for a, b in zip(_m, _m[1:])]
          + ["greatest(" + ", ".join(f'"B4_{m}"' for m in _m) + ') AS "B4_season_max"',
             "least(" + ", ".join(f'"B4_{m}"' for m in _m) + ') AS "B4_season_min"',
             "greatest(" + ", ".join(f'"B4_{m}"' for m in _m) + ") - least(" + ", ".join(f'"B4_{m}"' for m in _m)
             + ') AS "B4_season_range"'])
QUERIES["temporal_deltas"] = temporal_deltas
ORACLES["temporal_deltas"] = rounded_sql(
    f"SELECT *, {', '.join(_shape)} FROM (SELECT pid, " + ", ".join(f'avg(B4) FILTER (month = {n}) AS "B4_{m}"' for n, m in MONTHS.items())
    + f" FROM ({OBS}) GROUP BY pid)",
    [f"B4_{m}" for m in _m] + [f"B4_delta_{a}_{b}" for a, b in zip(_m, _m[1:])] + ["B4_season_max", "B4_season_min", "B4_season_range"])


def weekly_summary(spark, sf):
    rows = table(spark, sf, "events").withColumn("week", scalars.week_index(F.col("ts"), F.lit("2024-01-01").cast("date")))
    wide = rows.groupBy("user_id").agg(*[F.avg(F.when(F.col("week") == w, F.col("value"))).alias(f"w{w}") for w in range(1, 6)])
    summary = temporal.weekly_summary("ndvi", [F.col(f"w{w}") for w in range(1, 6)])
    return rounded(wide.select("user_id", *[e.alias(n) for n, e in summary.items()]))


QUERIES["weekly_summary"] = weekly_summary
ORACLES["weekly_summary"] = rounded_sql("""WITH w AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 + 1 AS week, avg(value) AS v
   FROM events GROUP BY ALL), s AS (SELECT user_id, avg(v) FILTER (week <= 5) AS ndvi_mean, max(v) FILTER (week <= 5) AS ndvi_max,
   min(v) FILTER (week <= 5) AS ndvi_min, arg_max(week, v) FILTER (week <= 5) AS ndvi_peak_week, avg(v) FILTER (week = 1) AS ndvi_early_mean,
   avg(v) FILTER (week IN (2, 3)) AS ndvi_mid_mean, avg(v) FILTER (week IN (4, 5)) AS ndvi_late_mean FROM w GROUP BY user_id)
 SELECT *, ndvi_max - ndvi_min AS ndvi_amplitude, ndvi_mid_mean - ndvi_early_mean AS ndvi_greenup_delta,
   ndvi_late_mean - ndvi_mid_mean AS ndvi_senescence_delta FROM s""",
    ["ndvi_mean", "ndvi_max", "ndvi_min", "ndvi_early_mean", "ndvi_mid_mean", "ndvi_late_mean", "ndvi_amplitude",
     "ndvi_greenup_delta", "ndvi_senescence_delta"])


def weekly_index_means(spark, sf):
    rows = observations(spark, sf).withColumns({"B6": F.col("B5") + 1, "B11": F.col("B3") + 2})
    start = F.make_date(F.col("year"), F.lit(5), F.lit(1))
    rows = rows.withColumn("week", scalars.week_index(F.col("ts"), start)).where(F.col("week").between(1, 18))
    bands = ["B2", "B3", "B4", "B5", "B6", "B8", "B11"]
    weekly = composites.weekly_means(rows, ["pid", "year"], bands, F.col("week"))
    return rounded(weekly.withColumns(indices.weekly_indices({b: F.col(b) for b in bands})).drop(*bands), 5)


QUERIES["weekly_index_means"] = weekly_index_means
ORACLES["weekly_index_means"] = rounded_sql(f"""WITH w AS (SELECT pid, year,
   CAST(floor(date_diff('day', make_date(year, 5, 1), CAST(ts AS DATE)) / 7) + 1 AS INT) AS week, avg(B2) AS b2, avg(B3) AS b3, avg(B4) AS b4,
   avg(B5) AS b5, avg(B5 + 1) AS b6, avg(B8) AS b8, avg(B3 + 2) AS b11 FROM ({OBS}) GROUP BY ALL)
 SELECT pid, year, week, (b8 - b4) / (b8 + b4 + 1e-6) AS ndvi, (b8 - b5) / (b8 + b5 + 1e-6) AS ndre1, (b8 - b6) / (b8 + b6 + 1e-6) AS ndre2,
   (b8 - b3) / (b8 + b3 + 1e-6) AS gndvi, (b8 - b11) / (b8 + b11 + 1e-6) AS ndmi,
   2.5 * ((b8 - b4) / (b8 + 6 * b4 - 7.5 * b2 + 1 + 1e-6)) AS evi, (b3 + b4) / (2 * b2 + 1e-6) AS yellow_blue_ratio,
   (b3 - b4) / (b3 + b4 - b2 + 1e-6) AS vari, (b3 - b4) / (b3 + b4 + 1e-6) AS ngrdi, (b3 + b4) / (b8 + b2 + 1e-6) AS flowering_contrast,
   b4 / (b3 + 1e-6) AS red_green_ratio FROM w WHERE w.week BETWEEN 1 AND 18""",
    ["ndvi", "ndre1", "ndre2", "gndvi", "ndmi", "evi", "yellow_blue_ratio", "vari", "ngrdi", "flowering_contrast", "red_green_ratio"], 5)


def seasonal_signals(spark, sf):
    rows = observations(spark, sf).withColumn("window", composites.seasonal_window(F.col("ts"))).where("window IS NOT NULL")
    value = {"NDVI_mean": F.avg, "EVI_mean": F.avg, "NDRE1_mean": F.avg, "NDMI_mean": F.avg, "MSI_mean": F.avg,
             "smap_soil_moisture_am_mean": F.avg, "obs_count": F.count}
    band = dict(zip(value, ("B4", "B8", "B2", "B3", "B5", "B2", "B4")))
    wide = rows.groupBy(F.col("pid").alias("quarter_id"), "year").agg(
        *[how(F.when(F.col("window") == w, F.col(band[n]))).alias(f"{w}_{n}") for w in WINDOW_NAMES for n, how in value.items()],
        F.max(F.lit(153)).alias("aafc_dominant_class"),
        *[F.avg((F.col("flag") == flag).cast("double")).alias(f"aafc_{crop}_fraction") for crop, flag in (
            ("canola", "A"), ("spring_wheat", "R"), ("wheat", "N"), ("barley", "X"), ("oats", "X"), ("peas", "X"), ("lentils", "X"))])
    return rounded(temporal.seasonal_signals(wide, threshold=0.4))


QUERIES["seasonal_signals"] = seasonal_signals
ORACLES["seasonal_signals"] = rounded_sql(f"""WITH o AS (SELECT *, {WINDOW_CASE} AS w FROM ({OBS})), s AS (SELECT pid, year, w, avg(B4) AS b4, avg(B8) AS b8,
   avg(B2) AS b2, avg(B3) AS b3, avg(B5) AS b5, count(*) AS n FROM o WHERE w IS NOT NULL GROUP BY ALL),
 f AS (SELECT pid, year, avg((flag = 'A')::INT) AS fa, avg((flag = 'R')::INT) AS fr, avg((flag = 'N')::INT) AS fn FROM o WHERE w IS NOT NULL GROUP BY ALL),
 g AS (SELECT pid, year, max(b4) AS peak_ndvi, max(b8) AS peak_evi, max(b2) AS peak_ndre1, avg(b3) AS seasonal_ndmi, avg(b5) AS seasonal_msi,
   max(b4) - max(b4) FILTER (w = 'sep') AS late_decline, avg(b2) AS mean_smap_moisture, sum(n) / 4.0 AS coverage_score FROM s GROUP BY ALL)
 SELECT pid AS quarter_id, year, CASE WHEN fa >= fr AND fa >= fn THEN 'canola' WHEN fr >= fn THEN 'spring_wheat' ELSE 'wheat' END AS crop_guess,
   153 AS aafc_dominant_class, 'Canola and Rapeseed' AS aafc_dominant_crop_name, peak_ndvi, peak_evi, peak_ndre1, seasonal_ndmi, seasonal_msi, late_decline,
   mean_smap_moisture, coverage_score FROM g JOIN f USING (pid, year) WHERE greatest(fa, fr, fn) >= 0.4""",
    ["peak_ndvi", "peak_evi", "peak_ndre1", "seasonal_ndmi", "seasonal_msi", "late_decline", "mean_smap_moisture", "coverage_score"])


def monthly_row_stats(spark, sf):
    wide = observations(spark, sf).groupBy("pid", "year").agg(
        *[F.avg(F.when(F.col("month") == m, F.col("B4"))).alias(f"ndvi_m{m:02d}") for m in MONTHS], F.sum("B4").alias("ndvi_integral"))
    return rounded(temporal.monthly_row_stats(wide).select("pid", "year", "NDVI_max", "NDVI_min", "NDVI_median", "NDVI_integral_proxy"))


QUERIES["monthly_row_stats"] = monthly_row_stats
ORACLES["monthly_row_stats"] = rounded_sql(f"""WITH m AS (SELECT pid, year, month, avg(B4) AS v FROM ({OBS}) WHERE month BETWEEN 4 AND 10 GROUP BY ALL),
 i AS (SELECT pid, year, sum(B4) AS s FROM ({OBS}) GROUP BY ALL)
 SELECT i.pid, i.year, max(v) AS "NDVI_max", min(v) AS "NDVI_min", median(v) AS "NDVI_median", any_value(s) AS "NDVI_integral_proxy"
 FROM i LEFT JOIN m ON i.pid = m.pid AND i.year = m.year GROUP BY i.pid, i.year""",
    ["NDVI_max", "NDVI_min", "NDVI_median", "NDVI_integral_proxy"])


# --- masks and space ----------------------------------------------------------

def qa_masks(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") * 7).alias("qa"), (F.col("l_linenumber") % 2).alias("radsat"))
    s2 = selection.mask_qa60(rows).withColumn("mask", F.lit("qa60"))
    landsat = selection.mask_landsat(rows).withColumn("mask", F.lit("landsat"))
    return s2.unionByName(landsat).groupBy("mask", "l_suppkey").agg(F.count("*").alias("n"))


QUERIES["qa_masks"] = qa_masks
ORACLES["qa_masks"] = """SELECT 'qa60' AS mask, l_suppkey, count(*) AS n FROM lineitem WHERE (l_partkey * 7) & 3072 = 0 GROUP BY ALL
 UNION ALL SELECT 'landsat', l_suppkey, count(*) FROM lineitem WHERE (l_partkey * 7) & 62 = 0 AND l_linenumber % 2 = 0 GROUP BY ALL"""


def rectangles(spark, sf):
    """A rectangle per supplier: its corner and size follow from the key."""
    x, y = F.pmod("s_suppkey", F.lit(40)) * 1.25, F.floor(F.col("s_suppkey") / 40) * 0.01
    corner = [(x, y), (x + 2.5, y), (x + 2.5, y + 0.03), (x, y + 0.03), (x, y)]
    ring = F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in corner])
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("pid"), F.array(F.array(ring)).alias("polys"))


def zonal_join(spark, sf):
    pixels = table(spark, sf, "lineitem").select((F.col("l_quantity") + 0.1).alias("lon"), (F.col("l_discount") + 0.001).alias("lat"), "l_tax")
    joined = zonal.zonal_join(pixels, rectangles(spark, sf), cell=(2.5, 0.03))
    return rounded(joined.groupBy("pid").agg(F.count("*").alias("pixels"), F.avg("l_tax").alias("mean_tax")))


QUERIES["zonal_join"] = zonal_join
ORACLES["zonal_join"] = rounded_sql("""WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS pid, (s_suppkey % 40) * 1.25::DOUBLE AS x, (s_suppkey // 40) * 0.01::DOUBLE AS y FROM supplier)
 SELECT pid, count(*) AS pixels, avg(l_tax) AS mean_tax FROM r JOIN lineitem ON l_quantity + 0.1 >= x AND l_quantity + 0.1 < x + 2.5
   AND l_discount + 0.001 >= y AND l_discount + 0.001 < y + 0.03::DOUBLE GROUP BY pid""", ["mean_tax"])


def scene_weeks(spark, sf):
    first, last = table(spark, sf, "events").agg(F.to_date(F.min("ts")), F.date_add(F.to_date(F.max("ts")), 1)).first()
    start, end = F.lit(first), F.lit(last)
    weeks = F.explode(scalars.week_ranges(start, end)).alias("w")
    ranges = table(spark, sf, "region").agg(F.max("r_regionkey")).select(weeks).select("w.*")
    counts = table(spark, sf, "events").where((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(
        scalars.week_index(F.col("ts"), start).alias("week")).agg(F.count("*").alias("scenes"))
    return ranges.join(counts, "week", "left")


QUERIES["scene_weeks"] = scene_weeks
ORACLES["scene_weeks"] = """WITH b AS (SELECT CAST(min(ts) AS DATE) AS s, CAST(CAST(max(ts) AS DATE) + 1 AS DATE) AS e FROM events)
 SELECT CAST(date_diff('day', s, CAST(ts AS DATE)) // 7 + 1 AS INT) AS week,
 CAST(s + CAST((week - 1) * 7 AS INT) AS DATE) AS week_start, least(CAST(s + CAST(week * 7 AS INT) AS DATE), e) AS week_end,
 count(*) AS scenes FROM events, b GROUP BY ALL"""
