"""Report staging, land descriptions, parcel matching, files and streams over the tables.

Stand-ins: every order is printed as one report operation of the year of its
date, under a field heading per customer; wrapped cells, page footers and
unexpected rows follow from its key. Conversations stand in for headings and
continuation text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import scale
from furrow.bindings.common import rounded, rounded_sql, table
from furrow.functions import geometry, scalars
from furrow.operators import harvest, matching, selection, tables, zonal
from furrow.sources.readers import parse_feature_lines
from furrow.streaming import streams

QUERIES, ORACLES = {}, {}


# --- scalars ----------------------------------------------------------------------

def parse_measurement(spark, sf):
    price = F.format_number("l_extendedprice", 2)
    unit = F.element_at(F.array(F.lit(" bu"), F.lit("LB / AC"), F.lit(""), F.lit(" 5,00 x1")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    parsed = scalars.parse_measurement(F.concat(price, unit))
    rows = table(spark, sf, "lineitem").select("l_suppkey", parsed.alias("m"))
    return rounded(rows.groupBy("l_suppkey", F.col("m.unit").alias("unit")).agg(
        F.sum("m.value").alias("total"), F.count("m.value").alias("numbers"), F.count("*").alias("n")), 2)


QUERIES["parse_measurement"] = parse_measurement
ORACLES["parse_measurement"] = rounded_sql("""SELECT l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'bu' WHEN 1 THEN 'lb/ac' END AS unit,
 sum(l_extendedprice) FILTER (l_linenumber % 4 <> 3) AS total, count(*) FILTER (l_linenumber % 4 <> 3) AS numbers, count(*) AS n FROM lineitem GROUP BY ALL""", ["total"], 2)


def parse_date(spark, sf):
    style = F.col("o_orderkey") % 3
    raw = F.when(style == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(style == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("soon"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.parse_date(raw).alias("harvest_date"))


QUERIES["parse_date"] = parse_date
ORACLES["parse_date"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS harvest_date FROM orders"


def normalise_crop(spark, sf):
    words = {"red": "Tall  Fescue", "blue": "Dekalb 74 canola", "hot": "faba bean", "small": "Perennial Ryegrass mix", "large": "rye and oats", "cold": "FIELD PEAS green"}
    first = F.split("p_name", " ")[0]
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in words.items() for v in p]), first), F.concat(F.lit("wheat "), "p_name"))
    crop = scalars.normalise_crop(label)
    return table(spark, sf, "part").select("p_partkey", crop["crop"].alias("crop"), crop["variety"].alias("variety"), crop["status"].alias("status"))


QUERIES["normalise_crop"] = normalise_crop
ORACLES["normalise_crop"] = """SELECT p_partkey,
 CASE f WHEN 'red' THEN 'tall_fescue' WHEN 'blue' THEN 'canola' WHEN 'hot' THEN 'faba_beans' WHEN 'small' THEN 'ryegrass' WHEN 'large' THEN NULL WHEN 'cold' THEN 'field_peas' ELSE 'wheat' END AS crop,
 CASE f WHEN 'red' THEN '' WHEN 'blue' THEN 'Dekalb 74 canola' WHEN 'hot' THEN '' WHEN 'small' THEN 'mix' WHEN 'large' THEN 'rye and oats' WHEN 'cold' THEN 'green' ELSE p_name END AS variety,
 CASE f WHEN 'large' THEN 'needs_review' ELSE 'recognized_name' END AS status FROM (SELECT *, split_part(p_name, ' ', 1) AS f FROM part)"""


def description(key):
    """A land description that follows from an integer key; some are out of range."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NE", "nw", "SE", "SW", "N1/2", "S1/2")]), (key % 6 + 1).cast("int"))
    return F.concat(kind, F.lit(" "), key % 40 + 1, F.lit("-"), F.floor(key / 40) % 50 + 60, F.lit("-"), key % 3 + 8, F.lit(" W6M"))


LEGAL = """(SELECT *, ['NE', 'NW', 'SE', 'SW', 'N1/2', 'S1/2'][CAST(key % 6 + 1 AS INT)] AS kind, key % 40 + 1 AS sec, (key // 40) % 50 + 60 AS twp, key % 3 + 8 AS rng FROM {keys})"""
PIDS = """list_transform(CASE kind WHEN 'N1/2' THEN ['8', '7'] WHEN 'S1/2' THEN ['5', '6'] WHEN 'NE' THEN ['8'] WHEN 'NW' THEN ['7'] WHEN 'SE' THEN ['5'] ELSE ['6'] END,
 lambda q : '6' || lpad(CAST(rng AS VARCHAR), 2, '0') || lpad(CAST(twp AS VARCHAR), 3, '0') || lpad(CAST(sec AS VARCHAR), 2, '0') || q || '00')"""


def parse_legal(spark, sf):
    legal = scalars.parse_legal(description(F.col("c_custkey")))
    return table(spark, sf, "customer").select("c_custkey", legal["label"].alias("label"), F.array_join(legal["pids"], "|").alias("pids"))


QUERIES["parse_legal"] = parse_legal
ORACLES["parse_legal"] = f"""SELECT c_custkey, CASE WHEN sec <= 36 THEN kind || ' ' || sec || '-' || twp || '-' || rng || ' W6M' END AS label,
 CASE WHEN sec <= 36 THEN array_to_string({PIDS}, '|') END AS pids FROM {LEGAL.format(keys='(SELECT c_custkey, c_custkey AS key FROM customer)')}"""


def operation_id(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", F.lit(".xls")).alias("f"), F.lit("Sheet1").alias("s"), F.col("l_orderkey").alias("r")).distinct()
    return rows.select("f", "r", scalars.operation_id(F.col("f"), F.col("s"), F.col("r")).alias("operation_id"))


QUERIES["operation_id"] = operation_id
ORACLES["operation_id"] = """SELECT DISTINCT l_returnflag || '.xls' AS f, l_orderkey AS r,
 substr(sha256(l_returnflag || '.xls' || chr(0) || 'Sheet1' || chr(0) || l_orderkey), 1, 20) AS operation_id FROM lineitem"""


def identifiers(spark, sf):
    key = F.col("c_custkey")
    raw = F.element_at(F.array(F.lit(" nw-"), F.lit("W-"), F.lit("ALL-"), F.lit("x-"), F.lit("se-")), (key % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "customer").select(
        "c_custkey", scalars.normalise_quarter_id(F.concat(raw, key)).alias("quarter"), scalars.division_name(key % 20).alias("division"),
        scalars.feature_id(F.when(key % 2 == 0, key), none, F.when(key % 3 == 0, "id"), none, key).alias("feature_id"),
        scalars.row_id(F.lit("NW-1"), F.lit("hard red wheat"), key).alias("row_id"), scalars.group_key(key % 7, key % 3).alias("group_key"),
        scalars.parse_int(F.concat(key, F.lit(".7"))).alias("as_int"), F.size(scalars.split_list(F.when(key % 2 == 0, "a|b").otherwise(""))).alias("parts"),
        scalars.normalise_label(F.concat(F.lit("  A  "), "c_mktsegment", F.lit(" b "))).alias("label"))


QUERIES["identifiers"] = identifiers
ORACLES["identifiers"] = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'NW-' || c_custkey WHEN 1 THEN 'SW-' || c_custkey WHEN 4 THEN 'SE-' || c_custkey END AS quarter,
 printf('Division No. %2d', c_custkey % 20) AS division, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 0 THEN 'id' ELSE printf('feature_%07d', c_custkey) END AS feature_id,
 'NW-1_hardredwheat_' || c_custkey AS row_id, c_custkey % 7 || '|' || c_custkey % 3 AS group_key, CAST(c_custkey AS INT) AS as_int, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS parts,
 'a ' || lower(c_mktsegment) || ' b' AS label FROM customer"""


# --- reports ------------------------------------------------------------------------

def report_rows(spark, sf):
    """Printed rows of every order: page footers, wrapped crops, stray and unexpected rows included."""
    key = F.col("o_orderkey")
    year = F.year("o_orderdate")
    heading = F.concat(F.lit("Field "), F.col("o_custkey"), F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit(" "), description(F.col("o_custkey")))).otherwise(""))
    blank = F.lit("")
    area = F.format_string("%d.50 ac", key % 300 + 1)
    rate = F.floor(F.col("o_totalprice") / 10) / 100
    wrong = F.when(key % 10 == 3, F.lit(1.5)).otherwise(F.lit(1.0))
    total = (key % 300 + 1.5) * rate * wrong
    unit = F.when(key % 7 == 0, "lb").otherwise("bu")
    crop = F.element_at(F.array(*[F.lit(c) for c in ("Barley", "canola L233", "Faba", "mystery", "Wheat Stettler")]), (key % 5 + 1).cast("int"))
    rate_text, total_text = F.concat(F.format_number(rate, 2), F.lit(" "), unit, F.lit(" / ac")), F.concat(F.format_number(total, 4), F.lit(" "), unit)

    def cells(**given):
        return F.struct(*[given.get(f"c{i}", blank).cast("string").alias(f"c{i}") for i in range(13)])

    operation = cells(c0=F.lit("Harvesting"), c1=year, c2=F.date_format("o_orderdate", "M/d/yyyy"), c4=crop, c6=F.lit("Crop"), c9=area, c11=rate_text, c12=total_text)
    printed = F.array_compact(F.array(
        F.struct(F.lit(0).alias("part"), cells(c0=heading).alias("x")),
        F.struct(F.lit(1).alias("part"), operation.alias("x")),
        F.when(key % 6 == 1, F.struct(F.lit(2).alias("part"), cells(c0=F.lit("Page 1 of 9"), c2=F.lit("5/5/2001")).alias("x"))),
        F.when(key % 5 == 2, F.struct(F.lit(3).alias("part"), cells(c4=F.lit("Beans")).alias("x"))),
        F.when(key % 11 == 4, F.struct(F.lit(4).alias("part"), cells(c0=F.lit("odd"), c3=F.lit("row")).alias("x")))))
    lines = table(spark, sf, "orders").select(F.format_string("%d harvest.xls", year).alias("source_file"), F.lit("Sheet1").alias("source_sheet"),
                                              "o_custkey", "o_orderkey", F.explode(printed).alias("p")).select(
        "source_file", "source_sheet", "o_custkey", "o_orderkey", "p.part", "p.x.*")
    numbered = scale.ranked(scale.cut_lineage(lines, wide=True), ["source_file"], [F.col("o_custkey"), F.col("o_orderkey"), F.col("part")], "row_number")
    return numbered.select("source_file", "source_sheet", F.col("row_number").cast("int").alias("row_number"), *[f"c{i}" for i in range(13)])


REPORT = """SELECT *, 'Field ' || o_custkey || CASE WHEN o_custkey % 4 <> 0 THEN ' ' || desc_text ELSE '' END AS heading, CASE WHEN o_custkey % 4 <> 0 THEN desc_text ELSE '' END AS legal,
   sum(1 + 1 + (o_orderkey % 6 = 1)::INT + (o_orderkey % 5 = 2)::INT + (o_orderkey % 11 = 4)::INT) OVER (PARTITION BY y ORDER BY o_custkey, o_orderkey ROWS UNBOUNDED PRECEDING)
     - (o_orderkey % 6 = 1)::INT - (o_orderkey % 5 = 2)::INT - (o_orderkey % 11 = 4)::INT AS source_row
 FROM (SELECT *, year(o_orderdate) AS y, o_orderkey % 300 + 1.5 AS area, floor(o_totalprice / 10) / 100 AS rate,
   CASE WHEN o_orderkey % 7 = 0 THEN 'lb' ELSE 'bu' END AS u,
   CASE o_orderkey % 5 WHEN 0 THEN 'barley' WHEN 1 THEN 'canola' WHEN 2 THEN 'faba_beans' WHEN 3 THEN NULL ELSE 'wheat' END AS crop,
   CASE o_orderkey % 5 WHEN 0 THEN 'Barley' WHEN 1 THEN 'canola L233' WHEN 2 THEN 'Faba Beans' WHEN 3 THEN 'mystery' ELSE 'Wheat Stettler' END AS crop_raw,
   ['NE', 'nw', 'SE', 'SW', 'N1/2', 'S1/2'][CAST(o_custkey % 6 + 1 AS INT)] || ' ' || o_custkey % 40 + 1 || '-' || (o_custkey // 40) % 50 + 60 || '-' || o_custkey % 3 + 8 || ' W6M' AS desc_text FROM orders)"""


def _staged(spark, sf):
    return harvest.stage_reports(report_rows(spark, sf))


def report_operations(spark, sf):
    operations, _ = _staged(spark, sf)
    return operations.select("source_file", "source_row", "field_heading_raw", "legal_description_raw", "year", "harvest_date", "crop", "crop_raw",
                             F.round("area_ac", 2).alias("area_ac"), F.round("yield_value", 2).alias("yield_value"), "yield_unit", "total_unit",
                             (F.col("source_row_end") - F.col("source_row")).alias("wrapped_rows"))


QUERIES["report_operations"] = report_operations
ORACLES["report_operations"] = f"""SELECT y || ' harvest.xls' AS source_file, CAST(source_row AS INT) AS source_row, heading AS field_heading_raw, legal AS legal_description_raw, CAST(y AS INT) AS year,
 CAST(o_orderdate AS DATE) AS harvest_date, crop, crop_raw, round(area, 2) AS area_ac, rate AS yield_value, u || '/ac' AS yield_unit, u AS total_unit,
 CAST(CASE WHEN o_orderkey % 5 = 2 THEN 1 + (o_orderkey % 6 = 1)::INT ELSE 0 END AS INT) AS wrapped_rows FROM ({REPORT})"""


def report_issues(spark, sf):
    _, issues = _staged(spark, sf)
    return issues.groupBy("source_file", "code", "severity").agg(F.count("*").alias("n"))


QUERIES["report_issues"] = report_issues
ORACLES["report_issues"] = f"""WITH r AS ({REPORT}), g AS (SELECT o_orderkey, count(*) OVER (PARTITION BY heading, y) AS k,
   min(coalesce(crop, crop_raw)) OVER (PARTITION BY heading, y) <> max(coalesce(crop, crop_raw)) OVER (PARTITION BY heading, y) AS mixed FROM r)
 SELECT y || ' harvest.xls' AS source_file, code, severity, count(*) AS n FROM (
   SELECT y, 'missing_legal_description' AS code, 'warning' AS severity FROM r WHERE legal = ''
   UNION ALL SELECT y, 'unmapped_crop', 'warning' FROM r WHERE crop IS NULL
   UNION ALL SELECT y, 'area_rate_total_mismatch', 'error' FROM r WHERE o_orderkey % 10 = 3 AND abs(area * rate - area * rate * 1.5) > greatest(1.0, 0.001 * area * rate * 1.5)
   UNION ALL SELECT y, 'unexpected_row', 'error' FROM r WHERE o_orderkey % 11 = 4
   UNION ALL SELECT y, CASE WHEN mixed THEN 'multiple_crops_same_field_year' ELSE 'multiple_operations_same_field_year' END, 'warning' FROM r JOIN g USING (o_orderkey) WHERE k >= 2)
 GROUP BY ALL"""


def issue_codes(spark, sf):
    """Every rule over every order: the key picks what is wrong with the printed operation; missing parts are empty cells."""
    key = F.col("o_orderkey")

    def cell(clean, faults):
        chosen = clean.cast("string")
        for fault, text in faults.items():
            chosen = F.when(key % 20 == fault, text).otherwise(chosen)
        return chosen

    year, number = F.year("o_orderdate"), F.format_string("%d", key % 300 + 10)
    merged = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_row"), F.format_string("%d harvest.xls", year + F.when(key % 20 == 1, 1).otherwise(0)).alias("source_file"),
        F.lit("Sheet1").alias("source_sheet"), F.lit("Crop").alias("item_raw"),
        cell(F.lit("Home SE 30-71-9 W6M"), {2: F.lit(""), 3: F.lit("Home")}).alias("field_heading_raw"),
        cell(year, {4: F.lit("20x1"), 5: F.lit("1850")}).alias("year_raw"),
        cell(F.date_format("o_orderdate", "M/d/yyyy"), {6: F.lit("soon"), 7: F.lit("1/2/1970")}).alias("harvest_date_raw"),
        cell(F.lit("Barley"), {8: F.lit(""), 9: F.lit("rye and oats")}).alias("crop_raw"),
        cell(F.concat(number, F.lit(" ac")), {10: F.concat(number, F.lit(" ha")), 11: F.lit("0 ac")}).alias("area_raw"),
        cell(F.lit("5 bu/ac"), {12: F.lit(""), 13: F.lit("-5 bu/ac"), 14: F.lit("5 t/ac"), 15: F.lit("5 lb/ac")}).alias("yield_raw"),
        cell(F.concat(F.col("o_orderkey") % 300 * 5 + 50, F.lit(" bu")), {
            16: F.lit("x bu"), 17: F.lit("-1 bu"), 18: F.lit("7 t"), 19: F.lit("9,999 bu")}).alias("total_raw"))
    issues = harvest.parse_operations(merged).select("source_row", F.explode(harvest.operation_issues()).alias("i"))
    return issues.select("source_row", "i.severity", "i.code", "i.column", F.col("i.raw_value").alias("raw_value"))


QUERIES["issue_codes"] = issue_codes
ORACLES["issue_codes"] = """WITH o AS (SELECT o_orderkey AS source_row, o_orderkey % 20 AS k, CAST(year(o_orderdate) AS VARCHAR) AS y,
   CAST(o_orderkey % 300 + 10 AS VARCHAR) AS n, CAST(o_orderkey % 300 * 5 + 50 AS VARCHAR) || ' bu' AS total FROM orders),
 fault(k, severity, code, "column", raw) AS (VALUES
   (1, 'error', 'file_year_mismatch', 'B', NULL), (2, 'error', 'missing_field_heading', 'A', ''), (3, 'warning', 'missing_legal_description', 'A', 'Home'),
   (4, 'error', 'invalid_year', 'B', '20x1'), (5, 'error', 'invalid_year', 'B', '1850'), (6, 'error', 'invalid_harvest_date', 'C', 'soon'),
   (7, 'error', 'date_year_mismatch', 'C', '1970-01-02'), (8, 'error', 'missing_crop', 'E', ''), (9, 'warning', 'unmapped_crop', 'E', 'rye and oats'),
   (10, 'error', 'invalid_area_measurement', 'J', NULL), (11, 'error', 'invalid_area_value', 'J', '0 ac'), (11, 'error', 'area_rate_total_mismatch', 'J/L/M', NULL),
   (12, 'error', 'invalid_yield_measurement', 'L', ''), (12, 'error', 'unsupported_yield_unit', 'L', ''), (13, 'error', 'invalid_yield_value', 'L', '-5 bu/ac'),
   (14, 'error', 'unsupported_yield_unit', 'L', '5 t/ac'), (15, 'error', 'rate_total_unit_mismatch', 'L/M', 'lb/ac, bu'),
   (16, 'error', 'invalid_total_measurement', 'M', 'x bu'), (16, 'error', 'unsupported_total_unit', 'M', 'x bu'), (17, 'error', 'invalid_total_value', 'M', '-1 bu'),
   (18, 'error', 'unsupported_total_unit', 'M', '7 t'), (19, 'error', 'area_rate_total_mismatch', 'J/L/M', '9,999 bu'))
 SELECT source_row, severity, code, "column", coalesce(raw, CASE k WHEN 1 THEN y WHEN 10 THEN n || ' ha' ELSE total END) AS raw_value FROM o JOIN fault USING (k)"""


def processing_status(spark, sf):
    aliases = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(" MYSTERY").alias("label"), F.lit("oats").alias("crop"))
    operations, issues = harvest.stage_reports(report_rows(spark, sf), aliases)
    counts = harvest.import_summary(operations, issues)
    return counts.where("counter IN ('operations_by_processing_status', 'operations_by_crop', 'operations_by_crop_mapping')")


QUERIES["processing_status"] = processing_status
ORACLES["processing_status"] = f"""WITH r AS (SELECT * REPLACE (coalesce(crop, 'oats') AS crop) FROM ({REPORT})), g AS (SELECT *, min(crop) OVER (PARTITION BY heading, y) <> max(crop) OVER (PARTITION BY heading, y) AS mixed FROM r),
 s AS (SELECT *, CASE WHEN legal = '' OR mixed OR (o_orderkey % 10 = 3 AND abs(area * rate * 0.5) > greatest(1.0, 0.001 * area * rate * 1.5)) THEN 'needs_review' ELSE 'pending_boundary_review' END AS st FROM g)
 SELECT 'operations_by_processing_status' AS counter, st AS value, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'operations_by_crop', crop, count(*) FROM s GROUP BY ALL
 UNION ALL SELECT 'operations_by_crop_mapping', CASE WHEN o_orderkey % 5 = 3 THEN 'confirmed_by_review' ELSE 'recognized_name' END, count(*) FROM s GROUP BY ALL"""


def flag_shared_fields(spark, sf):
    ops = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Cust  "), F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("")).alias("field_heading_raw"),
                                            F.year("o_orderdate").alias("year"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("crop"),
                                            F.lit("LOW").alias("crop_raw"))
    return harvest.shared_field_flags(ops).select("o_orderkey", "shared_flag")


QUERIES["flag_shared_fields"] = flag_shared_fields
ORACLES["flag_shared_fields"] = """SELECT o_orderkey, CASE WHEN count(*) OVER w < 2 THEN NULL WHEN min(c) OVER w <> max(c) OVER w THEN 'multiple_crops_same_field_year' ELSE 'multiple_operations_same_field_year' END AS shared_flag
 FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE o_orderpriority END AS c, year(o_orderdate) AS y FROM orders) WINDOW w AS (PARTITION BY o_custkey, y)"""


def fill_forward_heading(spark, sf):
    turns = table(spark, sf, "conversations")
    filled = scale.fill_forward(turns, ["conv_id"], "turn", {"heading": F.when(F.col("role") == "user", F.col("text"))})
    return filled.select("conv_id", "turn", F.md5("heading").alias("heading"))


QUERIES["fill_forward_heading"] = fill_forward_heading
ORACLES["fill_forward_heading"] = """SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS heading FROM conversations"""


def merge_continuations(spark, sf):
    turns = table(spark, sf, "conversations")
    opened = scale.fill_forward(turns, ["conv_id"], "turn", {"opened": F.when(F.col("role") == "user", F.col("turn"))})
    pieces = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return opened.where("opened IS NOT NULL").groupBy("conv_id", "opened").agg(
        F.md5(F.array_join(F.transform(pieces, lambda p: p["text"]), " ")).alias("joined"), F.count("*").alias("rows"))


QUERIES["merge_continuations"] = merge_continuations
ORACLES["merge_continuations"] = """SELECT conv_id, opened, md5(string_agg(text, ' ' ORDER BY turn)) AS joined, count(*) AS rows FROM
 (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS opened FROM conversations)
 WHERE opened IS NOT NULL GROUP BY ALL"""


# --- parcels --------------------------------------------------------------------------

def feature_lines(spark, sf):
    """A feature line per customer: a square whose place and size follow from the key."""
    key = F.col("c_custkey")
    legal = scalars.parse_legal(description(key))
    pid = F.coalesce(F.get(legal["pids"], F.lit(0)), F.concat(F.lit("x"), key))
    x, y = F.format_string("%.4f", -119 + (key % 100) * 0.01), F.format_string("%.4f", 55 + (key % 50) * 0.01)
    x2, y2 = F.format_string("%.4f", -119 + (key % 100) * 0.01 + 0.0126), F.format_string("%.4f", 55 + (key % 50) * 0.01 + 0.0072)
    ring = F.concat(F.lit("[["), x, F.lit(","), y, F.lit("],["), x2, F.lit(","), y, F.lit("],["), x2, F.lit(","), y2, F.lit("],["), x, F.lit(","), y2,
                    F.lit("],["), x, F.lit(","), y, F.lit("]]"))
    ra = F.when(key % 9 == 0, '"RS"').when(key % 2 == 0, "null").otherwise('""')
    line = F.concat(F.lit('{ "type": "Feature", "properties": { "pid": "'), pid, F.lit('", "ra": '), ra, F.lit(' }, "geometry": { "type": '),
                    F.when(key % 2 == 0, F.concat(F.lit('"Polygon", "coordinates": ['), ring, F.lit("]"))).otherwise(
                        F.concat(F.lit('"MultiPolygon", "coordinates": [['), ring, F.lit("]]"))),
                    F.when(key % 13 == 5, " oops").otherwise(" } }"), F.lit(","))
    lines = scale.spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(key.alias("position"), F.when(key % 17 == 3, '{"type": "Header"').otherwise(line).alias("value"))
    return scale.cut_lineage(lines)  # as a file would be: text, not the expression that made it


def geojson_scan(spark, sf):
    parcels = parse_feature_lines(feature_lines(spark, sf))
    usable = selection.filter_farmland(selection.filter_bbox(parcels, -119.0, 55.0, -118.3, 55.4))
    middle, box = geometry.centroid(F.col("polys")), geometry.bounding_box(F.col("polys"))
    metres = geometry.web_mercator(middle["lon"], middle["lat"])
    return rounded(usable.select("position", "pid", "geom_type", geometry.multipolygon_acres(F.col("polys")).alias("acres"), middle["lon"].alias("lon"),
                                 middle["lat"].alias("lat"), box["lon_max"].alias("lon_max"), metres["x"].alias("x"), metres["y"].alias("y")), 3)


QUERIES["geojson_scan"] = geojson_scan
ORACLES["geojson_scan"] = rounded_sql(f"""WITH k AS (SELECT *, round(-119 + (key % 100) * 0.01, 4)::DOUBLE AS x1, round(55 + (key % 50) * 0.01, 4)::DOUBLE AS y1,
   round(-119 + (key % 100) * 0.01 + 0.0126, 4)::DOUBLE AS x2, round(55 + (key % 50) * 0.01 + 0.0072, 4)::DOUBLE AS y2
   FROM {LEGAL.format(keys='(SELECT c_custkey AS key FROM customer)')} WHERE key % 17 <> 3 AND key % 13 <> 5 AND key % 9 <> 0),
 c AS (SELECT *, (x1 + x2) / 2 AS lon, (y1 + y2) / 2 AS lat, radians((3 * y1 + 2 * y2) / 5) AS lat0 FROM k WHERE x1 BETWEEN -119.0 AND -118.3 AND y1 BETWEEN 55.0 AND 55.4)
 SELECT key AS position, CASE WHEN sec <= 36 THEN ({PIDS})[1] ELSE 'x' || key END AS pid, CASE WHEN key % 2 = 0 THEN 'Polygon' ELSE 'MultiPolygon' END AS geom_type,
   (x2 - x1) * (y2 - y1) * cos(lat0) * pow(6371008.8 * pi() / 180, 2) / 4046.8564224 AS acres, lon, lat, x2 AS lon_max,
   radians(lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y FROM c""", ["acres", "lon", "lat", "lon_max", "x", "y"], 3)


def bbox_union(spark, sf):
    parcels = parse_feature_lines(feature_lines(spark, sf)).withColumn("meridian", F.substring("pid", 1, 1))
    return rounded(zonal.bbox_union(parcels, ["meridian"]), 4)


QUERIES["bbox_union"] = bbox_union
ORACLES["bbox_union"] = rounded_sql(f"""SELECT CASE WHEN sec <= 36 THEN '6' ELSE 'x' END AS meridian, min(round(-119 + (key % 100) * 0.01, 4)::DOUBLE) AS lon_min,
 min(round(55 + (key % 50) * 0.01, 4)::DOUBLE) AS lat_min, max(round(-119 + (key % 100) * 0.01 + 0.0126, 4)::DOUBLE) AS lon_max, max(round(55 + (key % 50) * 0.01 + 0.0072, 4)::DOUBLE) AS lat_max
 FROM {LEGAL.format(keys='(SELECT c_custkey AS key FROM customer)')} WHERE key % 17 <> 3 AND key % 13 <> 5 GROUP BY 1""", ["lon_min", "lat_min", "lon_max", "lat_max"], 4)


def match_operations(spark, sf):
    parcels = parse_feature_lines(feature_lines(spark, sf))
    key = F.col("o_orderkey")
    ops = table(spark, sf, "orders").select(
        key.cast("string").alias("operation_id"), F.lit("f").alias("source_file"), key.cast("int").alias("source_row"), F.year("o_orderdate").alias("year"),
        F.when(key % 10 != 0, F.when(key % 3 == 0, "oats").otherwise("barley")).alias("crop"), F.lit("Unknown").alias("crop_raw"), F.lit("n").alias("field_name_raw"),
        description(F.col("o_custkey")).alias("legal_description_raw"), (key % 180 + 1).cast("double").alias("area_ac"), F.lit(1.0).alias("yield_value"),
        F.lit("bu/ac").alias("yield_unit"), F.when(key % 8 == 0, "excluded").otherwise("pending_boundary_review").alias("processing_status"))
    out = matching.match_operations(ops, parcels)
    return rounded(out.select("operation_id", "match_status", "parcel_acres", "area_fraction", "quarter_year_status", "quarter_year_operation_count",
                              F.array_join("quarter_year_crops", "|").alias("quarter_year_crops"), "quarter_year_area_ac", "boundary_pilot_eligible",
                              F.array_join("flags", "|").alias("flags")), 3)


QUERIES["match_operations"] = match_operations
ORACLES["match_operations"] = rounded_sql(f"""WITH d AS (SELECT o_orderkey AS op, CAST(year(o_orderdate) AS INT) AS year, (o_orderkey % 180 + 1)::DOUBLE AS area, o_orderkey % 8 <> 0 AS pending,
   CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'oats' ELSE 'barley' END AS crop, CASE WHEN sec <= 36 THEN {PIDS} ELSE [] END AS pids
   FROM {LEGAL.format(keys='(SELECT *, o_custkey AS key FROM orders)')}),
 u AS (SELECT op, year, area, crop, pending, unnest(pids) AS pid FROM d),
 p AS (SELECT CASE WHEN sec <= 36 THEN ({PIDS})[1] ELSE 'x' || key END AS pid, arg_min((x2 - x1) * (y2 - y1) * cos(radians((3 * y1 + 2 * y2) / 5)) * pow(6371008.8 * pi() / 180, 2) / 4046.8564224, key) AS acres
   FROM (SELECT *, round(-119 + (key % 100) * 0.01, 4)::DOUBLE AS x1, round(55 + (key % 50) * 0.01, 4)::DOUBLE AS y1, round(-119 + (key % 100) * 0.01 + 0.0126, 4)::DOUBLE AS x2,
     round(55 + (key % 50) * 0.01 + 0.0072, 4)::DOUBLE AS y2 FROM {LEGAL.format(keys='(SELECT c_custkey AS key FROM customer)')} WHERE key % 17 <> 3 AND key % 13 <> 5 AND key % 9 <> 0) GROUP BY 1),
 n AS (SELECT DISTINCT a.op, b.op AS other, b.area, b.crop FROM u a JOIN u b ON a.pid = b.pid AND a.year = b.year),
 s AS (SELECT op, count(*) AS k, string_agg(DISTINCT crop, '|' ORDER BY crop) AS crops, count(DISTINCT crop) AS nc, sum(area) AS shared FROM n GROUP BY op),
 m AS (SELECT op, count(acres) AS found, sum(acres) AS acres FROM u LEFT JOIN p USING (pid) GROUP BY op),
 j AS (SELECT d.*, coalesce(k, 0) AS k, coalesce(crops, '') AS crops, coalesce(nc, 0) AS nc, coalesce(shared, 0.0) AS shared,
   CASE WHEN len(pids) = 0 THEN 'unparsed' WHEN found = len(pids) THEN 'matched' WHEN found > 0 THEN 'partial' ELSE 'unmatched' END AS ms, acres FROM d LEFT JOIN s USING (op) LEFT JOIN m USING (op) WHERE pending),
 t AS (SELECT *, CASE WHEN ms = 'matched' THEN acres END AS pa, CASE WHEN ms = 'matched' THEN area / acres END AS af,
   CASE WHEN k <= 1 THEN 'single_operation' WHEN nc = 1 THEN 'shared_same_crop' ELSE 'shared_multiple_crops' END AS st FROM j)
 SELECT CAST(op AS VARCHAR) AS operation_id, ms AS match_status, pa AS parcel_acres, af AS area_fraction, st AS quarter_year_status, k AS quarter_year_operation_count, crops AS quarter_year_crops,
   shared AS quarter_year_area_ac, ms = 'matched' AND st <> 'shared_multiple_crops' AND NOT coalesce(af > 1.05, false) AS boundary_pilot_eligible,
   concat_ws('|', CASE ms WHEN 'unparsed' THEN 'unparsed_legal_description' WHEN 'matched' THEN NULL ELSE 'parcel_not_found' END, CASE WHEN st <> 'single_operation' THEN st END,
     CASE WHEN af > 1.05 THEN 'area_exceeds_parcel' WHEN af < 0.5 THEN 'low_parcel_coverage' END, CASE WHEN k > 1 AND shared > pa * 1.05 THEN 'quarter_year_area_exceeds_parcel' END) AS flags FROM t""",
    ["parcel_acres", "area_fraction", "quarter_year_area_ac"], 3)


def validate_rows(spark, sf):
    """Rule flags of lineitem rows, exploded and counted."""
    rules = {"zero_discount": F.col("l_discount") == 0, "high_tax": F.col("l_tax") >= 0.08, "big_order": F.col("l_quantity") >= 50}
    flags = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return tables.flag_counts(table(spark, sf, "lineitem").select(flags.alias("qa_flags")))


QUERIES["flag_counts"] = validate_rows
ORACLES["flag_counts"] = """SELECT 'zero_discount' AS flag, count(*) AS n FROM lineitem WHERE l_discount = 0 UNION ALL SELECT 'high_tax', count(*) FROM lineitem WHERE l_tax >= 0.08
 UNION ALL SELECT 'big_order', count(*) FROM lineitem WHERE l_quantity >= 50"""


# --- streams ----------------------------------------------------------------------------

def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _stream_paths(spark):
    import uuid
    scale.ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return f"{base}/sink", f"{base}/state"


def stream_weekly(spark, sf):
    events = _stream(spark, sf)
    sink, state = _stream_paths(spark)
    return rounded(streams.run_to_table(streams.weekly_composite(events, "event_type", "value"), sink, state))


QUERIES["stream_weekly"] = stream_weekly
ORACLES["stream_weekly"] = rounded_sql("""SELECT * FROM (SELECT CAST(DATE '2024-01-01' + CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) * 7 AS INT) AS TIMESTAMP) AS week_start,
 event_type, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2) WHERE week_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", ["mean_value"])


def weekly_batch(spark, sf):
    return rounded(streams.weekly_composite(table(spark, sf, "events"), "event_type", "value"))


QUERIES["weekly_composite"] = weekly_batch
ORACLES["weekly_composite"] = rounded_sql("""SELECT CAST(DATE '2024-01-01' + CAST((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7) * 7 AS INT) AS TIMESTAMP) AS week_start, event_type,
 avg(value) AS mean_value, count(*) AS n FROM events GROUP BY ALL""", ["mean_value"])


def stream_dedupe(spark, sf):
    events = _stream(spark, sf)
    sink, state = _stream_paths(spark)
    # One column, so whichever row of a key arrives first gives the same output.
    kept = streams.stream_dedupe(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], delay="60 days")
    return streams.run_to_table(kept.select("user_id", "event_type"), sink, state)


QUERIES["stream_dedupe"] = stream_dedupe
ORACLES["stream_dedupe"] = "SELECT DISTINCT user_id, event_type FROM events"
