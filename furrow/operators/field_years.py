"""Field-years: operations joined through shared parcels, with yields and weighted features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import (
    FEATURE_BANDS, FIELD_YEAR_FEATURES, FIELD_YEAR_IDS, MONTHS, SEASON_WEATHER_COLUMNS, weather_columns,
)
from furrow.operators.composites import season_weather_totals
from furrow.operators.harvest import TOTAL_UNITS

# Fixed value: below this share of crop-labelled land the crop mask is not trusted.
CROP_MASK_MIN_SHARE = 0.1


def _with_minimum(pairs: DataFrame, links: int) -> DataFrame:
    """Pairs with ``__m``, the least of src and its neighbours. Hubs are salted; with few links no node can be one."""
    low = pairs.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("__m"), F.count("*").alias("__n"))
    if links <= scale.HOT_KEY_ROWS:
        return pairs.join(low.drop("__n"), "src")
    return scale.attach(pairs, low, ["src"], rows="__n")


def _roots(links: DataFrame, max_rounds: int) -> DataFrame:
    """(id, root) of every number in a link (src, dst): root is the least number that it reaches."""
    def signature(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    pairs = scale.cut_lineage(links.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    last = signature(pairs)
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _with_minimum(both, last[0]).where("dst > src").select(F.col("dst").alias("src"), F.col("__m").alias("dst")).where("src <> dst")
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        pairs = scale.cut_lineage(_with_minimum(down, last[0]).select(
            F.explode(F.array("src", "dst")).alias("src"), F.col("__m").alias("dst")).where("src <> dst").distinct())
        now = signature(pairs)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("Components did not settle; raise max_rounds.")
    roots = pairs.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("root"))
    return roots.union(pairs.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node in an undirected edge list (src, dst).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) shrink each
    component to a star in a logarithmic number of rounds. Neighbour minima combine
    map-side and join back salted, so a hub node is never one task's work; each
    round is checkpointed.
    """
    # Nodes get numbers, fixed once they are written: minima of numbers need no sort.
    nodes = scale.cut_lineage(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn(
        "id", F.monotonically_increasing_id()))
    # Minima have at most one row per node, so one check of the node count serves every join.
    _, small = scale.broadcast_if_small(nodes)
    numbered = edges.where("src <> dst")
    for side in ("src", "dst"):
        numbered = scale.skew_join(numbered, nodes.select(F.col("node").alias(side), F.col("id").alias(f"__{side}")),
                                   [side], "inner", small=small)
    roots = _roots(numbered.select(F.col("__src").alias("src"), F.col("__dst").alias("dst")), max_rounds)
    placed = scale.cut_lineage(scale.attach(nodes, roots, ["id"], small=small).select(
        "node", F.coalesce("root", "id").alias("root")))
    # A component is named by its smallest node, which does not depend on the numbering.
    names = placed.groupBy("root").agg(F.min("node").alias("component"))
    return scale.attach(placed, names, ["root"], small=small).select("node", "component")


def group_operations(matches: DataFrame, *, pids: str = "pids", key: str = "operation_id",
                     keys: tuple[str, ...] = ("crop", "year")) -> DataFrame:
    """Operations with ``group_id``: same crop and year, connected through shared parcels.

    Rows are numbered as they are written. Each is linked to the least number on each of its parcels, so parcels are no
    nodes, and rows that share nothing stay out of the rounds. Rows of one operation are linked too.
    """
    scope = F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = scale.cut_lineage(matches.withColumns({
        "__node": F.concat_ws("\x01", F.lit("o"), scope, F.col(key)), "__row": F.monotonically_increasing_id()}), wide=True)
    cells = rows.select(F.col("__row").alias("src"), scope.alias("__scope"), F.explode_outer(pids).alias("__pid")).select(
        "src", F.concat_ws("\x01", "__scope", "__pid").alias("cell"))
    doubled = scale.cut_lineage(rows.groupBy(F.xxhash64("__node").alias("__hash")).count().where("count > 1").select("__hash"))
    links = [_to_least(cells, "cell")]
    if not doubled.isEmpty():
        again = rows.select(F.col("__row").alias("src"), "__node", F.xxhash64("__node").alias("__hash")).join(doubled, "__hash", "left_semi")
        links.append(_to_least(again.select("src", "__node"), "__node"))
    roots = scale.cut_lineage(_roots(reduce(DataFrame.union, links), 60))
    # A group is named by its smallest operation, which does not depend on the numbering.
    linked = scale.cut_lineage(rows.select("__row", "__node").join(roots.withColumnRenamed("id", "__row"), "__row"), wide=True)
    names = linked.groupBy("root").agg(F.min("__node").alias("group_id"), F.count("*").alias("__n"))
    named = scale.attach(linked.select("__row", "root"), names, ["root"], rows="__n").drop("root")
    return rows.join(named, "__row", "left").withColumn("group_id", F.coalesce("group_id", "__node")).drop("__row", "__node")


def _to_least(rows: DataFrame, by: str) -> DataFrame:
    """Links (src, dst) from each row's number to the least one with the same value of ``by``."""
    least = rows.groupBy(by).agg(F.min("src").alias("dst"), F.count("*").alias("__n")).where("__n > 1")
    return scale.attach(rows, least, [by], "inner", rows="__n").where("src <> dst").select("src", "dst")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Σ value·weight / Σ weight over rows with a value and a positive weight."""
    usable = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight)))


def sorted_join(values: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(values)), "|")


def field_year_table(matches: DataFrame, operations: DataFrame, features: DataFrame, parcels: DataFrame,
                     weather: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Field-year rows, and counts of the groups dropped with their reason.

    ``parcels`` gives parcel_acres per pid; ``features`` has one row per pid and year.
    """
    eligible = matches.where("boundary_pilot_eligible").withColumn("year", F.col("year").cast("int"))
    grouped = scale.cut_lineage(group_operations(eligible), wide=True)
    totals = operations.select("operation_id", "total_value", "total_unit")
    unit_map = F.create_map(*[F.lit(v) for pair in TOTAL_UNITS.items() for v in pair])
    rows = scale.attach(grouped, totals, ["operation_id"])
    area = F.coalesce(F.col("area_ac"), F.lit(0.0))
    produced = F.when(F.col("total_unit") == F.try_element_at(unit_map, F.col("yield_unit")), F.col("total_value"))
    groups = rows.groupBy("group_id", "year", "crop").agg(
        F.min("yield_unit").alias("yield_unit"), F.count_distinct("yield_unit").alias("__units"),
        F.sum(area).alias("__area"),
        F.sum(F.coalesce(produced, area * F.coalesce("yield_value", F.lit(0.0)))).alias("__produced"),
        F.count("*").alias("operation_count"), sorted_join(F.col("operation_id")).alias("operation_ids"),
        sorted_join(F.col("legal_description")).alias("legal_descriptions"))

    parcel_rows = grouped.select("group_id", "year", F.explode("pids").alias("pid")).distinct()
    parcel_rows = scale.attach(parcel_rows, parcels.select("pid", F.col("parcel_acres").cast("double").alias("acres")), ["pid"])
    values = [c for c in features.columns if c not in ("pid", "year", "crop", "aci_codes", "operation_ids")]
    found = features.select("pid", F.col("year").cast("int").alias("year"), *values, F.lit(True).alias("__found"))
    parcel_rows = scale.attach(parcel_rows, found, ["pid", "year"])
    if weather is not None:
        parcel_rows = scale.attach(parcel_rows, weather.select(
            "pid", F.col("year").cast("int").alias("year"), *weather_columns()), ["pid", "year"])
    acres = F.col("acres")
    labelled = F.coalesce("aci_crop_fraction", F.lit(0.0)) * acres
    stats = [F.sum(acres).alias("__acres"), F.bool_and(F.coalesce("__found", F.lit(False))).alias("__complete"),
             F.sum(labelled).alias("__labelled"), sorted_join(F.col("pid")).alias("pids"),
             sorted_join(F.substring("pid", 1, 8)).alias("section_key"),
             sorted_join(F.substring("pid", 1, 6)).alias("township_key")]
    for month in MONTHS.values():
        stats.append(weighted_mean(F.col(f"s2_valid_{month}"), acres).alias(f"s2_valid_{month}"))
        for band in FEATURE_BANDS:
            stats.append(weighted_mean(F.col(f"quarter_{band}_{month}"), acres).alias(f"quarter_{band}_{month}"))
            stats.append(weighted_mean(F.col(f"crop_{band}_{month}"), labelled).alias(f"crop_{band}_{month}"))
    if weather is not None:
        stats += [weighted_mean(F.col(c), acres).alias(c) for c in weather_columns()]
    land = parcel_rows.groupBy("group_id").agg(*stats)

    joined = scale.cut_lineage(scale.attach(groups, land, ["group_id"]))
    reason = (F.when((F.col("__units") != 1) | ~F.coalesce(F.col("yield_unit").isin(list(TOTAL_UNITS)), F.lit(False)),
                     "mixed_or_unsupported_units")
              .when(~F.col("__complete"), "missing_satellite_features")
              .when(F.col("__area") <= 0, "no_harvested_area"))
    joined = joined.withColumn("__reason", reason)
    dropped = joined.where("__reason IS NOT NULL").groupBy(F.col("__reason").alias("reason")).agg(
        F.count("*").alias("groups"))
    kept = joined.where("__reason IS NULL")
    share = F.try_divide("__labelled", "__acres")
    masked = share >= CROP_MASK_MIN_SHARE
    out = kept.withColumns({
        "field_key": F.col("pids"), "yield": F.round(F.col("__produced") / F.col("__area"), 4),
        "area_ac": F.round("__area", 2), "parcel_acres": F.round("__acres", 1),
        "harvested_share": F.round(F.col("__area") / F.col("__acres"), 3),
        "aci_crop_fraction": F.round(share, 4),
        "feature_source": F.when(masked, "crop_mask").otherwise("quarter"),
        **{f"field_{b}_{m}": F.coalesce(F.when(masked, F.col(f"crop_{b}_{m}")), F.col(f"quarter_{b}_{m}"))
           for m in MONTHS.values() for b in FEATURE_BANDS}})
    if weather is not None:
        out = season_weather_totals(out)
    return out.select(*FIELD_YEAR_IDS, *FIELD_YEAR_FEATURES, *(weather_columns() + SEASON_WEATHER_COLUMNS if weather is not None else [])), dropped
