"""Statistics of pixels inside parcels, regions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import scale
from furrow.columns import (
    FRACTION_CODES, HARVEST_CROP_CODES, MONTHS, REGION_CODE_TO_CROP, SEASONAL_WINDOWS,
)
from furrow.functions.geometry import bounding_box, edge_boxes, edges, inside
from furrow.operators.composites import months_wide


def zonal_mean(composites: DataFrame, keys: list[str], bands: list[str],
               months: dict[int, str] = MONTHS) -> DataFrame:
    """Mean of each band per parcel and month, as <band>_<month> columns."""
    return months_wide(composites, keys, {b: F.col(b) for b in bands}, months)


def zonal_stats(obs: DataFrame, keys: list[str], bands: list[str], *, scene: str | None = None,
                statistics: tuple[str, ...] = ("mean", "stdDev", "p10", "p50", "p90"),
                missing: float | None = None, expected: DataFrame | None = None,
                max_group: int = scale.MAX_GROUP_ROWS) -> DataFrame:
    """Mean, deviation, sum and percentiles per group as <band>_<statistic>, with a scene count.

    With ``expected``, a table with a row for each wanted group (see ``expected_windows``), just these groups come
    out: one without observations has no statistics and 0 scenes. ``missing`` replaces statistics that are NULL.
    """
    plain = {"mean": F.avg, "stdDev": F.stddev_pop, "sum": F.sum}
    points = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    aggs = {f"{b}_{s}": plain[s](b) for b in bands for s in statistics if s in plain}
    if scene:
        aggs["obs_count"] = F.count_distinct(scene)
    specs = {f"{b}_{s}": (F.col(b), points[s]) for b in bands for s in statistics if s in points}
    out = (scale.group_quantiles(obs, keys, specs, aggs=aggs, max_group=max_group) if specs
           else obs.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()]))
    names = [f"{b}_{s}" for b in bands for s in statistics]
    if expected is not None:
        out = scale.attach(expected.select(*keys).distinct(), out, keys)
        if scene:
            out = out.withColumn("obs_count", F.coalesce("obs_count", F.lit(0).cast("bigint")))
    if missing is not None:
        out = out.withColumns({n: F.coalesce(n, F.lit(missing)) for n in names})
    return out.select(*keys, *names, *(["obs_count"] if scene else []))


def expected_windows(parcels: DataFrame, parcel_keys: list[str], windows: dict[str, list]) -> DataFrame:
    """Every parcel with every combination of the listed values, such as years and window names."""
    out = parcels.select(*parcel_keys).distinct()
    for name, values in windows.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def region_class(code: Column) -> Column:
    """Crop of an inventory code for regional means; undifferentiated wheat joins spring wheat."""
    names = F.create_map(*[F.lit(v) for pair in REGION_CODE_TO_CROP.items() for v in pair])
    return F.try_element_at(names, code)


def class_zonal_mean(pixels: DataFrame, keys: list[str], crop: Column, indices: dict[str, str],
                     count_of: str = "NDVI") -> DataFrame:
    """Index means and pixel counts of each crop class inside a region."""
    return pixels.where(crop.isNotNull()).groupBy(*keys, crop.alias("crop")).agg(
        F.count(count_of).alias("pixels"), *[F.avg(source).alias(name) for name, source in indices.items()])


def local_class_means(pixels: DataFrame, crop: Column, indices: list[str], months: dict[int, str]) -> DataFrame:
    """Crop means of a fixed area with months side by side."""
    return pixels.where(crop.isNotNull()).groupBy("year", crop.alias("crop")).agg(*[
        expr for number, label in months.items() for expr in (
            F.count(F.when(F.col("month") == number, F.col("NDVI"))).alias(f"pixels_{label}"),
            *[F.avg(F.when(F.col("month") == number, F.col(i))).alias(f"field_{i}_{label}") for i in indices])])


def crop_codes(crop: Column) -> Column:
    codes = F.create_map(*[part for name, values in HARVEST_CROP_CODES.items() for part in (
        F.lit(name), F.array(*[F.lit(v) for v in values]))])
    return F.coalesce(F.try_element_at(codes, crop), F.array().cast("array<int>"))


def crop_masked_mean(pixels: DataFrame, keys: list[str], values: dict[str, Column], match: Column) -> DataFrame:
    """Whole-parcel means, means over pixels of the parcel's own crop, and that crop's share."""
    return pixels.groupBy(*keys).agg(
        F.avg(F.coalesce(match, F.lit(False)).cast("double")).alias("aci_crop_fraction"),
        *[F.avg(v).alias(f"quarter_{n}") for n, v in values.items()],
        *[F.avg(F.when(match, v)).alias(f"crop_{n}") for n, v in values.items()])


def valid_share(pixels: DataFrame, keys: list[str], band: str = "B4") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(F.col(band).isNotNull().cast("double")).alias("s2_valid"))


def code_counts(pixels: DataFrame, keys: list[str], code: str) -> DataFrame:
    return pixels.groupBy(*keys, code).agg(F.count("*").alias("n"))


def class_fractions(pixels: DataFrame, keys: list[str], code: str, classes: dict[str, int] = FRACTION_CODES,
                    agriculture: tuple[int, int] = (120, 200)) -> DataFrame:
    """Dominant class and share of each class; the lowest code wins a tie."""
    counts = code_counts(pixels.where(F.col(code).isNotNull()), keys, code)
    total = F.sum("n").cast("double")
    low, high = agriculture
    return counts.groupBy(*keys).agg(
        F.max_by(code, F.struct(F.col("n"), -F.col(code))).alias("aafc_dominant_class"),
        *[(F.coalesce(F.sum(F.when(F.col(code) == value, F.col("n"))), F.lit(0)) / total)
          .alias(f"aafc_{name}_fraction") for name, value in classes.items()],
        (F.coalesce(F.sum(F.when((F.col(code) >= low) & (F.col(code) < high), F.col("n"))), F.lit(0)) / total)
        .alias("aafc_ag_fraction"))


def valid_pixels(obs: DataFrame, keys: list[str], pixel: str, band: str) -> DataFrame:
    """Pixels with any usable observation per parcel, year and window."""
    return obs.where(F.col(band).isNotNull()).groupBy(*keys).agg(
        F.count_distinct(pixel).alias("valid_px"))


def coverage_diagnostics(counts: DataFrame, parcel: str, years: list[int], *, min_pixels: int = 50,
                         required_windows: int = 2,
                         windows: list[str] = [w[0] for w in SEASONAL_WINDOWS]) -> DataFrame:
    """Valid pixels by year and window, usable windows per year, and usable years per parcel.

    ``counts`` has one row per parcel, year and window with ``valid_px``.
    """
    def pixels(y: int, w: str) -> Column:
        return F.coalesce(F.max(F.when((F.col("year") == y) & (F.col("window") == w), F.col("valid_px"))), F.lit(0))

    wide = counts.groupBy(parcel).agg(*[pixels(y, w).alias(f"coverage_{y}_{w}_valid_px")
                                        for y in years for w in windows])
    usable = {y: sum((F.when(F.col(f"coverage_{y}_{w}_valid_px") >= min_pixels, 1).otherwise(0)
                      for w in windows), F.lit(0)) for y in years}
    wide = wide.withColumns({f"coverage_{y}_valid_window_count": n for y, n in usable.items()})
    eligible = sum((F.when(F.col(f"coverage_{y}_valid_window_count") >= required_windows, 1).otherwise(0)
                    for y in years), F.lit(0))
    return wide.withColumn("coverage_eligible_year_count", eligible)


def bbox_union(parcels: DataFrame, keys: list[str] = []) -> DataFrame:
    """The box around all parcels, overall or per key, from each parcel's own box."""
    boxes = parcels.select(*keys, bounding_box(F.col("polys")).alias("b"))
    return boxes.groupBy(*keys).agg(F.min("b.lon_min").alias("lon_min"), F.min("b.lat_min").alias("lat_min"),
                                    F.max("b.lon_max").alias("lon_max"), F.max("b.lat_max").alias("lat_max"))


#: Cells that a parcel's box spans at most along each side, but for one at the border.
COVER_CELLS = 4


def zonal_join(pixels: DataFrame, parcels: DataFrame, *, lon: str = "lon", lat: str = "lat",
               cell: tuple[float, float] = (0.01, 0.01)) -> DataFrame:
    """Attach each pixel to every parcel whose polygon holds it.

    Cells come in levels, each twice as wide as the one below. A parcel is listed at the level at which its box spans at most COVER_CELLS cells a side, so the rows
    for a parcel are bounded, however large it is; a pixel is looked up at the levels that occur. Cells that no edge comes near are all inside, and need
    no ray test, or all outside, and are left out. The join is an equi-join on the cell. Small parcel sets are broadcast;
    otherwise a crowded cell is spread by salting its pixels.
    """
    box = bounding_box(F.col("polys"))

    spans = F.greatest((F.col("__box.lon_max") - F.col("__box.lon_min")) / cell[0], (F.col("__box.lat_max") - F.col("__box.lat_min")) / cell[1])
    level = F.greatest(F.lit(0), F.ceil(F.log2(spans / (COVER_CELLS - 1)))).cast("int")

    def size(axis: int) -> Column:
        return F.lit(cell[axis]) * F.pow(F.lit(2.0), F.col("__level"))

    def covered(low: str, high: str, axis: int) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"__box.{low}") / size(axis)), F.floor(F.col(f"__box.{high}") / size(axis))))

    listed = parcels.select("pid", edges(F.col("polys")).alias("__edges"), edge_boxes(F.col("polys")).alias("__near"), box.alias("__box")).where("__box.lon_min IS NOT NULL AND __box.lat_min IS NOT NULL").withColumn("__level", F.coalesce(level, F.lit(0)))
    cells = listed.withColumn("__cx", covered("lon_min", "lon_max", 0)).withColumn("__cy", covered("lat_min", "lat_max", 1))
    left, low = F.col("__cx") * size(0), F.col("__cy") * size(1)
    right, high = left + size(0), low + size(1)
    # An edge's own box is wider than the edge, so a cell without one near it has no boundary in it. The margin is for rounding.
    wide, tall = size(0) * 1e-9, size(1) * 1e-9
    crossed = F.exists("__near", lambda e: (e["x_min"] <= right + wide) & (e["x_max"] >= left - wide) & (e["y_min"] <= high + tall) & (e["y_max"] >= low - tall))
    cells = cells.withColumn("__crossed", crossed).where(F.col("__crossed") | inside(F.col("__edges"), (left + right) / 2, (low + high) / 2)) \
        .withColumn("__edges", F.when(F.col("__crossed"), F.col("__edges"))).drop("__crossed", "__near")
    cells = scale.cut_lineage(cells)
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())  # as many as doublings between the smallest and largest parcel
    keyed = pixels.withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    keyed = keyed.withColumns({"__cx": F.floor(F.col(lon) / size(0)), "__cy": F.floor(F.col(lat) / size(1))})
    held = F.col("__edges").isNull() | (F.col(lon).between(F.col("__box.lon_min"), F.col("__box.lon_max")) & F.col(lat).between(
        F.col("__box.lat_min"), F.col("__box.lat_max")) & inside(F.col("__edges"), F.col(lon), F.col(lat)))
    return scale.skew_join(keyed, cells, ["__level", "__cx", "__cy"], "inner", condition=held).select(*pixels.columns, "pid")
