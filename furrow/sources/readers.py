"""Readers: feature lines and collections, CSV parts, archives, report rows and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow import scale

FEATURE_LINE = r'^\s*\{\s*"type":\s*"Feature"\s*,'
RINGS = "array<array<array<double>>>"
PROPERTIES = "pid string, m string, rge string, twp string, sec string, qs string, ra string, descriptor string"


def feature_columns(line: Column) -> list[Column]:
    """Parcel columns of one feature given as JSON text; a Polygon becomes a one-part MultiPolygon."""
    kind = F.get_json_object(line, "$.geometry.type")
    coordinates = F.get_json_object(line, "$.geometry.coordinates")
    polys = F.when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{RINGS}>")).when(
        kind == "Polygon", F.array(F.from_json(coordinates, RINGS)))
    properties = F.from_json(F.get_json_object(line, "$.properties"), PROPERTIES)
    return [properties.alias("__p"), kind.alias("geom_type"), polys.alias("polys")]


def parse_feature_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parcels from text lines; header, footer and malformed lines are skipped, trailing commas dropped.

    The cheap pattern test runs before any JSON is parsed. A line is cut and parsed once: what explode() and inline() give are columns, into which no later
    filter or expression puts the parsing again.
    """
    body = F.regexp_replace(F.trim(column), r",\s*$", "")
    features = lines.where(F.col(column).rlike(FEATURE_LINE))
    keep = [c for c in lines.columns if c != column]
    bodies = features.select(*keep, F.explode(F.array(body)).alias("__line"))
    parsed = bodies.select(*keep, F.inline(F.array(F.struct(*feature_columns(F.col("__line"))))))
    return parsed.where("__p IS NOT NULL AND polys IS NOT NULL").select(*keep, "__p.*", "geom_type", "polys")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Parcels of a one-feature-per-line file of any size; refuses files in another layout."""
    lines = spark.read.text(path)
    if lines.where(F.col("value").rlike(FEATURE_LINE)).isEmpty():
        raise ValueError(f"{path}: expected one GeoJSON feature per line.")
    return parse_feature_lines(lines)


def first_per_pid(parcels: DataFrame, order: Column) -> DataFrame:
    return parcels.groupBy("pid").agg(F.min_by(F.struct(*[c for c in parcels.columns if c != "pid"]), order).alias("f")).select(
        "pid", "f.*")


def read_crs_name(spark: SparkSession, path: str) -> str | None:
    """CRS name from the header line, or None."""
    row = spark.read.text(path).where(F.col("value").contains('"crs"') & ~F.col("value").rlike(FEATURE_LINE)).select(
        F.regexp_extract("value", r'"crs".*?"name":\s*"([^"]+)"', 1)).first()
    return row[0] or None if row else None


def ordered_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Files cut after each separator, with what restores their order: file, block (split of the file) and place.

    Splits read in parallel; Spark's reader repairs the pieces at their borders. ``value`` lacks the separator.
    """
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")


def nested_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces that end in '}' with ``closes``: the brace is no text and closes an object of the root or of a root array.

    Whether a block starts inside a string, and how deep, is known from all blocks before it only. So each block
    sums its quotes and its change of depth for both cases; prefix sums over these few rows (one for each block)
    then tell the true case. A backslash escapes the next character; no piece can end in one outside a string.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))

    def change(inside: int) -> Column:
        """Change of depth over a piece that starts outside (0) or inside (1) a string."""
        code = F.regexp_replace(F.concat(F.lit('"' * inside), bare), '"[^"]*("|$)', "")
        opened, closed = [F.length(F.regexp_replace(code, f"[^{c}]", "")) for c in (r"\[{", r"\]")]
        return opened - closed - F.when((quotes + inside) % 2 == 0, 1).otherwise(0)

    in_block = Window.partitionBy("file", "block").orderBy("place")
    counted = pieces.withColumns({"quotes": quotes, "d0": change(0), "d1": change(1)}).withColumn(
        "parity", F.sum("quotes").over(in_block) % 2)
    starts = (F.col("parity") + F.col("quotes")) % 2
    counted = counted.withColumns({
        "deep0": F.sum(F.when(starts == 0, F.col("d0")).otherwise(F.col("d1"))).over(in_block),
        "deep1": F.sum(F.when(starts == 0, F.col("d1")).otherwise(F.col("d0"))).over(in_block)})
    stored = scale.cut_lineage(counted.select("file", "block", "place", "value", "parity", "deep0", "deep1"), wide=True)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored.groupBy("file", "block").agg(F.max_by(F.struct("parity", "deep0", "deep1"), "place").alias("t"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("t.parity").over(earlier), F.lit(0)) % 2)
    blocks = blocks.select("file", "block", "inside", F.coalesce(F.sum(
        F.when(F.col("inside") == 0, F.col("t.deep0")).otherwise(F.col("t.deep1"))).over(earlier), F.lit(0)).alias("depth"))
    placed = scale.attach(stored, blocks, ["file", "block"])
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("deep0")).otherwise(F.col("deep1"))
    return placed.select("file", "block", "place", "value",
                         (((F.col("inside") + F.col("parity")) % 2 == 0) & (depth <= 2)).alias("closes"))


def split_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, text) of every object in a root array of JSON documents, read by many tasks however large a document is.

    Text before an object's opening brace is cut off. The root's own objects (such as a CRS) come too, with their
    text cut anywhere: callers keep what parses as their kind. ``at`` sorts the objects of a file. Only objects across a block's border are joined
    between tasks; one object must fit in memory, a document need not.
    """
    pieces = nested_pieces(ordered_pieces(spark, path, "}"))
    before = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("n", F.coalesce(F.count_if("closes").over(before), F.lit(0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"])
    # Grouped as the window was: no further shuffle.
    parts = scale.cut_lineage(numbered.groupBy("file", "block", "n").agg(
        F.concat(F.array_join(texts, "}"), F.lit("}")).alias("text"), F.max("closes").alias("closes")), wide=True)
    # A block's first part may go on from an earlier block, its last one into a later block.
    edge = (F.col("n") == 0) | ~F.col("closes")
    order = Window.partitionBy("file").orderBy("block", "n")
    edges = parts.where(edge).withColumn("starts", F.coalesce(F.lag("closes").over(order), F.lit(True)))
    edges = edges.withColumn("g", F.count_if("starts").over(order))
    joined = edges.groupBy("file", "g").agg(
        F.min(F.struct("block", "n")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "text"))), lambda p: p["text"]), "").alias("text"))
    whole = parts.where(~edge).select("file", F.struct("block", "n").alias("at"), "text").unionByName(joined.drop("g"))
    lead = r"^(?s)(?:\s*,\s*(?=\{)|.*?\"features\"\s*:\s*\[\s*(?=\{))"
    return whole.select("file", "at", F.regexp_replace("text", lead, "").alias("text"))


def read_feature_collection(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Parcels of whole documents in any layout, also on one line; one document is read by many tasks.

    Features without a Polygon or MultiPolygon keep NULL ``polys``; an empty collection gives no rows.
    Rows come in the documents' order; where that is of no use, ``ordered=False`` spares a sort.
    """
    features = split_objects(spark, path).where(F.get_json_object("text", "$.type") == "Feature")
    parcels = features.select("file", "at", *feature_columns(F.col("text")))
    if ordered:
        parcels = parcels.sort("file", "at")
    return parcels.select("__p.*", "geom_type", "polys")


def read_table_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Header CSV with declared types; identifiers keep their leading digits."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def check_headers(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The one header all files share; refuses files whose ordered header differs.

    Only the first line of each file is compared, by a map-side combined aggregate.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file_path").agg(
        F.min_by("value", "n").alias("header"))
    headers = first.groupBy("header").agg(F.min("file_path").alias("f")).limit(2).collect()
    if not headers:
        raise ValueError(f"No input files under {path}")
    if len(headers) > 1:
        raise ValueError(f"Header mismatch in {max(r.f for r in headers)}")
    return headers[0].header.lstrip("﻿").split(",")


def merge_parts(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """Union of CSV parts that all have the same ordered header."""
    columns = [c.strip('"') for c in check_headers(spark, path)]
    if schema is None:
        schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the data member of each zip (not the metadata), as text columns; archives of any size.

    Splits of an archive are read in parallel and streamed, in order, through one inflating task: a deflate
    stream has no place to start but its first byte. The task holds a batch and a chunk of lines, never the
    archive. Extracted files should use ``read_table_csv``, which splits them.
    """
    pieces = ordered_pieces(spark, path, "\n").withColumn("value", F.col("value").cast("binary"))
    streamed = pieces.repartition("file").sortWithinPartitions("file", "block", "place").select("file", "value")

    def unzip(batches):
        import io
        from itertools import groupby

        import pandas as pd

        from furrow.sources import zip_stream

        rows = (row for batch in batches for row in zip(batch["file"], batch["value"]))
        for name, lines in groupby(rows, key=lambda row: row[0]):
            archive = zip_stream.members(bytes(value) + b"\n" for _, value in lines)
            for member, parts in archive:
                if member.endswith(".csv") and "MetaData" not in member:
                    break
            else:
                raise ValueError(f"{name}: no CSV member beside the metadata.")
            text = io.TextIOWrapper(io.BufferedReader(zip_stream.Reader(parts)), encoding="utf-8-sig", newline="")
            for chunk in pd.read_csv(text, dtype=str, keep_default_na=False, chunksize=50_000):
                yield pd.DataFrame({"path": name, "cells": chunk.to_dict("records")})

    return streamed.mapInPandas(unzip, "path string, cells map<string,string>")


def cells_to_columns(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in names])


def read_report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Exported report rows: source_file, source_sheet, row_number and thirteen text cells."""
    cells = ", ".join(f"c{i} string" for i in range(13))
    return spark.read.schema(f"source_file string, source_sheet string, row_number int, {cells}").csv(path, header=True)


def report_rows(df: DataFrame, width: int = 13) -> DataFrame:
    """Pad any report table to its thirteen cells."""
    missing = {f"c{i}": F.lit(None).cast("string") for i in range(width) if f"c{i}" not in df.columns}
    return df.withColumns(missing) if missing else df


def read_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Aliases (label, crop), exclusions (operation_id, reason) and who reviewed them."""
    schema = ("schema_version int, reviewed_by string, reviewed_on string, "
              "crop_aliases map<string,string>, excluded_operations map<string,string>")
    review = spark.read.schema(schema).json(path, multiLine=True)
    head = review.select("schema_version", "reviewed_by", "reviewed_on").first()
    if head is None or head.schema_version != 1:
        raise ValueError("A harvest review must have schema_version 1.")
    aliases = review.select(F.explode("crop_aliases").alias("label", "crop"))
    exclusions = review.select(F.explode("excluded_operations").alias("operation_id", "reason"))
    return aliases, exclusions, {"reviewed_by": head.reviewed_by or "reviewer", "reviewed_on": head.reviewed_on or "undated"}


def read_feature_batches(spark: SparkSession, path: str, schema: StructType | str,
                         batch_ids: list[str] | None = None) -> DataFrame:
    """Rows of batch files, optionally of named batches only; unwanted files are pruned by name."""
    rows = spark.read.schema(schema).csv(path, header=True)
    if not batch_ids:
        return rows
    stem = F.regexp_extract("_metadata.file_name", r"(batch_\d+)", 1)
    return rows.where(stem.isin(batch_ids))
