"""Writers: tables, feature lines, yearly partitions, resumable appends, manifests and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.tables import upsert_status


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a readable table at the path."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).count()
        return True
    except AnalysisException:
        return False


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "csv",
                mode: str = "errorifexists") -> None:
    """Columns in a fixed order; missing values are blank, lists are joined by '|'."""
    out = df.select(*(columns or df.columns))
    if fmt == "csv":
        lists = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
        out = out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists}) if lists else out
        out.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def feature_json(df: DataFrame, properties: list[str]) -> Column:
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get("polys", F.lit(0)).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("polys").alias("coordinates")))
    geometry = F.when(F.size("polys") == 1, polygon).otherwise(multi) if "geom_type" not in df.columns else F.when(
        F.col("geom_type") == "Polygon", polygon).otherwise(multi)
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{ "type": "Feature", "properties": '), props, F.lit(', "geometry": '), geometry, F.lit(" }"))


def write_geojson_lines(df: DataFrame, path: str, properties: list[str], crs: str | None = None,
                        mode: str = "errorifexists") -> None:
    """One feature per line, with the CRS name as an extra member of each feature when given."""
    line = feature_json(df, properties)
    if crs:
        line = F.concat(F.regexp_replace(line, r" \}$", ""), F.lit(f', "crs": "{crs}" }}'))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_feature_collection(df: DataFrame, path: str, properties: list[str], crs: str | None = None,
                             mode: str = "errorifexists") -> None:
    """Each part file one valid collection: CRS member once, before the features, one feature a line.

    Both ``read_feature_collection`` and ``read_geojson_lines`` read the folder back. A partition without rows
    gives an empty collection, a table known to be empty one file without text.
    """
    head = '{ "type": "FeatureCollection", '
    if crs:
        name = crs.replace("\\", "\\\\").replace('"', '\\"')
        head += f'"crs": {{ "type": "name", "properties": {{ "name": "{name}" }} }}, '

    def documents(batches):
        import pandas as pd
        yield pd.DataFrame({"value": [head + '"features": [']})
        waiting = None
        for batch in batches:
            lines = batch["value"].tolist()
            if not lines:
                continue
            out = lines if waiting is None else [waiting, *lines]
            waiting = out[-1]
            yield pd.DataFrame({"value": [text + "," for text in out[:-1]]})
        yield pd.DataFrame({"value": ([] if waiting is None else [waiting]) + ["]}"]})

    df.select(feature_json(df, properties).alias("value")).mapInPandas(documents, "value string").write.mode(mode).text(path)


def export_by_year(df: DataFrame, path: str, years: list[int], overwrite: bool = False) -> DataFrame:
    """One partition per year; finished years are kept unless overwritten. Returns all listed years."""
    spark = df.sparkSession
    rows = df.where(F.col("year").isin(years))
    if not overwrite and exists(spark, path):
        done = spark.read.parquet(path).select("year").distinct()
        rows = rows.join(F.broadcast(done), "year", "left_anti")
    if not rows.isEmpty():
        rows.write.mode("overwrite").partitionBy("year").option("partitionOverwriteMode", "dynamic").parquet(path)
    return spark.read.parquet(path).where(F.col("year").isin(years))


def append_missing_keys(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key is not there yet; refuses a table with other columns."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return
    present = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in present.schema.fields] != [(f.name, f.dataType) for f in df.schema.fields]:
        raise ValueError(f"{path} has other columns; write to a new table.")
    fresh = df.join(present.select(*keys).distinct(), keys, "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)


def export_batches(planned: DataFrame, status: DataFrame, run, path: str, config: dict,
                   batch: str = "batch_id") -> DataFrame:
    """Run planned batches not completed under this configuration; stop at the first failure.

    ``run(batch_id)`` gives the batch's rows. The returned status table has one
    row per attempted batch with the configuration's hash, so a changed setting reruns.
    """
    import hashlib
    import json
    spark = planned.sparkSession
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    done = status.where((F.col("state") == "completed") & (F.col("config_hash") == digest)).select(batch)
    todo = [r[0] for r in planned.select(batch).distinct().join(done, batch, "left_anti").orderBy(batch).collect()]
    outcomes = []
    for name in todo:
        try:
            run(name).write.mode("overwrite").parquet(f"{path}/{batch}={name}")
            outcomes.append((name, "completed", digest, ""))
        except Exception as failure:  # recorded, then the run stops
            outcomes.append((name, "failed", digest, str(failure)))
            break
    changes = spark.createDataFrame(outcomes, f"{batch} string, state string, config_hash string, notes string")
    known = status.unionByName(changes.join(status, batch, "left_anti").select(
        batch, *[F.lit(None).cast("string").alias(c) for c in ("state", "config_hash", "notes")]))
    return upsert_status(known, changes, batch)


def guarded_write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_manifest(df: DataFrame, counts: dict[str, Column], settings: dict[str, str], path: str,
                   mode: str = "errorifexists") -> DataFrame:
    """One JSON row of a run's counts and settings."""
    row = df.agg(*[e.alias(n) for n, e in counts.items()]).select(
        F.struct(*counts).alias("counts"), F.create_map(*[F.lit(v) for pair in settings.items() for v in pair]).alias("settings"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
    row.write.mode(mode).json(path)
    return row


def register_run(spark: SparkSession, path: str, kind: str, outputs: list[str], rows: int, duplicates: int = 0,
                 settings: dict[str, str] | None = None, sources: list[str] | None = None) -> None:
    """Append one provenance row to a registry table."""
    spark.createDataFrame([(kind, outputs, sources or [], rows, duplicates, settings or {})],
                          "kind string, outputs array<string>, sources array<string>, rows bigint, "
                          "duplicates bigint, settings map<string,string>").withColumn(
        "recorded_at", F.current_timestamp()).write.mode("append").parquet(path)
