"""Readers, writers and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from furrow import scale
from furrow.functions import geometry
from furrow.operators import selection
from furrow.sources import readers, writers
from furrow.streaming import streams


def line(pid, ra="null", comma=","):
    return ('{ "type": "Feature", "properties": { "pid": "%s", "twp": 71, "ra": %s }, "geometry": { "type": "Polygon", "coordinates": '
            '[ [ [ -119.0, 55.0 ], [ -118.9, 55.0 ], [ -118.9, 55.1 ], [ -119.0, 55.0 ] ] ] } }%s' % (pid, ra, comma))


HEADER = '{\n"type": "FeatureCollection",\n"crs": { "type": "name", "properties": { "name": "urn:ogc:def:crs:OGC:1.3:CRS84" } },\n"features": [\n'


def test_feature_lines(spark, tmp_path):
    path = tmp_path / "parcels.geojson"
    path.write_text(HEADER + line("0601") + "\n" + '{ "type": "Feature", broken' + "\n" + line("0602", '"RS"') + "\n" + line("0603", '"null"', "") + "\n]\n}\n")
    df = readers.read_geojson_lines(spark, str(path))
    assert sorted(r.pid for r in df.collect()) == ["0601", "0602", "0603"]
    assert sorted(r.pid for r in selection.filter_farmland(df).collect()) == ["0601", "0603"]
    assert [r.pid for r in selection.filter_farmland(df, null_text=False).collect()] == ["0601"]
    assert readers.read_crs_name(spark, str(path)) == "urn:ogc:def:crs:OGC:1.3:CRS84"
    other = tmp_path / "other.txt"
    other.write_text("[1, 2]\n")
    with pytest.raises(ValueError, match="one GeoJSON feature per line"):
        readers.read_geojson_lines(spark, str(other))
    out = str(tmp_path / "out")
    writers.write_geojson_lines(df, out, ["pid", "twp"], crs="EPSG:4326")
    again = readers.read_geojson_lines(spark, out)
    assert sorted((r.pid, r.twp, r.polys) for r in again.collect()) == sorted((r.pid, r.twp, r.polys) for r in df.collect())
    with pytest.raises(Exception, match="exist"):
        writers.write_geojson_lines(df, out, ["pid"])


def test_whole_collection(spark, tmp_path):
    features = [json.loads(line(p, comma="")) for p in ("1", "2")]
    features[1]["geometry"] = {"type": "MultiPolygon", "coordinates": [features[0]["geometry"]["coordinates"]]}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rows = readers.read_feature_collection(spark, str(tmp_path / "c.geojson")).collect()
    assert [r.pid for r in rows] == ["1", "2"] and rows[0].polys == rows[1].polys


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    odd = ["plain", "a } b", 'quote " and {', "back \\\\ slash", '}{"features": [{', "[]]", "é \n", ""]
    features = [{"type": "Feature", "properties": {"pid": str(i), "descriptor": odd[i % 8] * (1 + i % 50)}, "id": {"of": [i, {"x": 1}]},
                 "geometry": {"type": "Polygon", "coordinates": [[[i, 0.5], [1.0, 2.0], [i, 0.5]]]} if i % 7 else None}
                for i in range(3000)]
    head = {"type": "FeatureCollection", "name": "a } [ {", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}}
    (tmp_path / "one.geojson").write_text(json.dumps({**head, "features": features}))
    (tmp_path / "two.geojson").write_text(json.dumps({**head, "features": features[:40]}, indent=2) + "\n")
    (tmp_path / "none.geojson").write_text(json.dumps({**head, "features": []}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        path = str(tmp_path / "one.geojson")
        blocks = readers.ordered_pieces(spark, path, "}").select("block").distinct().count()
        rows = readers.read_feature_collection(spark, path).collect()
        small = readers.read_feature_collection(spark, str(tmp_path / "*o*.geojson")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 5
    got = sorted((int(r.pid), r.descriptor, r.geom_type, r.polys) for r in rows)
    want = sorted((i, f["properties"]["descriptor"], "Polygon" if f["geometry"] else None,
                   [f["geometry"]["coordinates"]] if f["geometry"] else None) for i, f in enumerate(features))
    assert got == want and small == 3040


def test_written_collections_are_valid(spark, tmp_path):
    rows = [(f"{i}", f"say \"{i}\"", [[[[0.0, 0.5], [1.0, float(i)], [0.0, 0.5]]]]) for i in range(50)]
    df = spark.createDataFrame(rows, "pid string, descriptor string, polys array<array<array<array<double>>>>").repartition(3)
    out = str(tmp_path / "c")
    writers.write_feature_collection(df, out, ["pid", "descriptor"], crs="EPSG:4326")
    documents = [json.loads(p.read_text()) for p in sorted((tmp_path / "c").glob("part-*"))]
    assert len(documents) == 3 and all(d["type"] == "FeatureCollection" for d in documents)
    assert all(d["crs"]["properties"]["name"] == "EPSG:4326" and "crs" not in f for d in documents for f in d["features"])
    for again in (readers.read_feature_collection(spark, out), readers.read_geojson_lines(spark, out)):
        assert sorted((r.pid, r.descriptor, r.polys) for r in again.collect()) == sorted(rows)
    assert readers.read_crs_name(spark, out) == "EPSG:4326"
    writers.write_feature_collection(df.repartition(3, F.lit(1)), str(tmp_path / "e"), ["pid"])
    sizes = sorted(len(json.loads(p.read_text())["features"]) for p in (tmp_path / "e").glob("part-*"))
    assert sizes == [0, 0, 50]
    writers.write_feature_collection(df.limit(0), str(tmp_path / "n"), ["pid"])
    assert readers.read_feature_collection(spark, str(tmp_path / "n")).count() == 0


def test_parts_need_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pid,x\n001,1\n002,2\n")
    (tmp_path / "b.csv").write_text("pid,x\n003,3\n")
    df = readers.merge_parts(spark, str(tmp_path / "*.csv"))
    assert sorted(r.pid for r in df.collect()) == ["001", "002", "003"] and df.columns == ["pid", "x"]
    (tmp_path / "c.csv").write_text("x,pid\n4,004\n")
    with pytest.raises(ValueError, match="Header mismatch"):
        readers.merge_parts(spark, str(tmp_path / "*.csv"))


def test_zipped_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("x_MetaData.csv", "no\n")
        z.writestr("x.csv", "﻿REF_DATE,GEO\n2020,Here\n2021,\"There, too\"\n")
    rows = readers.cells_to_columns(readers.read_zipped_csv(spark, str(tmp_path / "t.zip")), ["REF_DATE", "GEO"]).collect()
    assert [tuple(r) for r in rows] == [("2020", "Here"), ("2021", "There, too")]


def test_large_archives_are_streamed(spark, tmp_path):
    import io
    lines = "".join(f"{i},{(i * 2654435761) % 2 ** 32},\"x, {i}\"\n" for i in range(120_000))
    for name, kind in (("deflated", zipfile.ZIP_DEFLATED), ("stored", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", kind) as z:
            z.writestr("x_MetaData.csv", "no\n" * 1000)
            z.writestr("x.csv", "\ufeffid,hash,text\n" + lines)
            z.writestr("later.csv", "other\n1\n")

    class Pipe(io.BytesIO):
        def seekable(self):
            return False

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:  # sizes follow the data, in descriptors
        z.writestr("x_MetaData.csv", "no\n")
        z.writestr("x.csv", "id,hash,text\n" + lines)
    (tmp_path / "piped.zip").write_bytes(pipe.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        cells = readers.read_zipped_csv(spark, str(tmp_path / "*.zip"))
        rows = readers.cells_to_columns(cells, ["id", "hash", "text"])
        got = rows.selectExpr("count(*)", "count(distinct id)", "sum(cast(hash AS bigint))", "count_if(text = 'x, ' || id)").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    n = 120_000
    assert tuple(got) == (3 * n, n, 3 * sum((i * 2654435761) % 2 ** 32 for i in range(n)), 3 * n)
    (tmp_path / "bad.zip").write_bytes((tmp_path / "stored.zip").read_bytes().replace(b"x, 77\"", b"x, 78\""))
    with pytest.raises(Exception, match="wrong checksum"):
        readers.read_zipped_csv(spark, str(tmp_path / "bad.zip")).count()
    (tmp_path / "no.zip").write_bytes(b"PK nothing")
    with pytest.raises(Exception, match="Not a zip"):
        readers.read_zipped_csv(spark, str(tmp_path / "no.zip")).count()


def test_review_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "reviewed_by": "ann", "crop_aliases": {"Mix": "oats"},
                                                 "excluded_operations": {"abc": "strip"}}, indent=2))
    aliases, exclusions, who = readers.read_review(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in aliases.collect()] == [("Mix", "oats")] and [tuple(r) for r in exclusions.collect()] == [("abc", "strip")]
    assert who == {"reviewed_by": "ann", "reviewed_on": "undated"}
    (tmp_path / "bad.json").write_text('{"schema_version": 2}')
    with pytest.raises(ValueError):
        readers.read_review(spark, str(tmp_path / "bad.json"))


def test_years_are_kept_unless_overwritten(spark, tmp_path):
    path = str(tmp_path / "years")
    make = lambda v: spark.createDataFrame([(y, v) for y in (2020, 2021, 2022)], "year int, v int")
    assert writers.export_by_year(make(1), path, [2020, 2021]).count() == 2
    got = writers.export_by_year(make(2), path, [2021, 2022])
    assert sorted((r.year, r.v) for r in got.collect()) == [(2021, 1), (2022, 2)]
    got = writers.export_by_year(make(3), path, [2021], overwrite=True)
    assert [(r.year, r.v) for r in got.collect()] == [(2021, 3)]
    assert sorted((r.year, r.v) for r in spark.read.parquet(path).collect()) == [(2020, 1), (2021, 3), (2022, 2)]


def test_appending_skips_present_keys(spark, tmp_path):
    path = str(tmp_path / "regions")
    df = spark.createDataFrame([("a", 2020, 1.0), ("b", 2020, 2.0)], "region string, year int, v double")
    writers.append_missing_keys(df.where("region = 'a'"), path, ["region", "year"])
    writers.append_missing_keys(df.withColumn("v", F.col("v") * 10), path, ["region", "year"])
    assert sorted((r.region, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1.0), ("b", 20.0)]
    with pytest.raises(ValueError, match="other columns"):
        writers.append_missing_keys(df.drop("v"), path, ["region", "year"])


def test_batches_resume_and_stop_at_a_failure(spark, tmp_path):
    plan = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "batch_id string")
    status = spark.createDataFrame([], "batch_id string, state string, config_hash string, notes string")
    ran = []

    def run(name, fail=()):
        ran.append(name)
        if name in fail:
            raise RuntimeError("quota")
        return spark.range(3)

    status = writers.export_batches(plan, status, lambda n: run(n, ("b2",)), str(tmp_path / "b"), {"scale": 10})
    assert ran == ["b1", "b2"]
    assert {r.batch_id: r.state for r in status.collect()} == {"b1": "completed", "b2": "failed"}
    status = writers.export_batches(plan, status, run, str(tmp_path / "b"), {"scale": 10})
    assert ran[2:] == ["b2", "b3"] and "quota" in status.where("batch_id = 'b2'").first().notes
    writers.export_batches(plan, status, run, str(tmp_path / "b"), {"scale": 20})
    assert ran[4:] == ["b1", "b2", "b3"]


def test_tables_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"], None)], "id string, flags array<string>, v double")
    writers.write_table(df, str(tmp_path / "t"), ["flags", "id", "v"])
    assert {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"flags,id,v", "a|b,1,"}
    row = writers.write_manifest(df, {"rows": F.count("*")}, {"kind": "test"}, str(tmp_path / "m")).first()
    assert row.counts.rows == 1
    writers.register_run(spark, str(tmp_path / "reg"), "merge", ["t"], 1)
    writers.register_run(spark, str(tmp_path / "reg"), "merge", ["t"], 2)
    assert spark.read.parquet(str(tmp_path / "reg")).count() == 2
    with pytest.raises(Exception, match="exist"):
        writers.guarded_write(df, str(tmp_path / "reg"))


def test_resumable_extract(spark, tmp_path):
    source, sink, state = [str(tmp_path / n) for n in ("in", "sink", "state")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.geojson").write_text(HEADER + line("1") + "\n" + line("2", '"RS"') + "\n")
    keep = selection.filter_farmland
    assert streams.stream_extract(spark, source, sink, state, keep) == 1
    (tmp_path / "in" / "2.geojson").write_text(line("3") + "\n")
    assert streams.stream_extract(spark, source, sink, state, keep) == 2
    assert streams.stream_extract(spark, source, sink, state, keep) == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = streams.run_to_memory(streams.weekly_composite(stream, "event_type", "value"), "weekly_test", str(tmp_path / "c"))
    batch = {(r.week_start, r.event_type): (r.n, round(r.mean_value, 9)) for r in streams.weekly_composite(table, "event_type", "value").collect()}
    closed = {(r.week_start, r.event_type): (r.n, round(r.mean_value, 9)) for r in got.collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())
    assert set(batch) - set(closed) == {k for k in batch if k[0] == max(w for w, _ in batch)}


def test_stream_status(spark, tmp_path):
    path, inbox = str(tmp_path / "status"), tmp_path / "in"
    inbox.mkdir()
    spark.createDataFrame([("b1", "planned", "")], "batch_id string, state string, notes string").write.parquet(f"{path}/version=0")
    (inbox / "1.json").write_text('{"batch_id": "b1", "state": "running", "notes": "go"}\n{"batch_id": "b2", "state": "planned", "notes": null}\n')
    updates = spark.readStream.schema("batch_id string, state string, notes string").json(str(inbox))
    streams.stream_status_upsert(updates, path, str(tmp_path / "c")).awaitTermination()
    got = {r.batch_id: (r.state, r.notes) for r in spark.read.parquet(f"{path}/version=1").collect()}
    assert got == {"b1": ("running", "go"), "b2": ("planned", "")}


def test_status_log_equals_full_versions(spark, tmp_path):
    schema = "batch_id string, state string, notes string"
    base = [("b1", "planned", ""), ("b2", None, "old"), ("b9", "done", None)]
    batches = [[("b1", "running", "go"), ("b3", "planned", None)], [("b1", None, "slow"), ("b2", "failed", "")],
               [("b1", "done", "x"), ("b4", None, "late"), ("b3", "running", "y")], [("b2", "planned", "again")], [("b3", "done", None)]]
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("full", "log"):
        spark.createDataFrame(base, schema).write.parquet(str(tmp_path / name / "version=0"))
    updates = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(inbox))
    for n, rows in enumerate(batches):
        (inbox / f"{n}.json").write_text("".join(json.dumps(dict(zip(("batch_id", "state", "notes"), r))) + "\n" for r in rows))
        streams.stream_status_upsert(updates, str(tmp_path / "full"), str(tmp_path / "cf")).awaitTermination()
        streams.stream_status_upsert(updates, str(tmp_path / "log"), str(tmp_path / "cl"), every=3).awaitTermination()
        full = {r.batch_id: (r.state, r.notes or "") for r in streams.read_status(spark, str(tmp_path / "full"), n).collect()}
        log = {r.batch_id: (r.state, r.notes or "") for r in streams.read_status(spark, str(tmp_path / "log"), n, every=3).collect()}
        assert full == log
        assert spark.read.parquet(str(tmp_path / "log" / "changes" / f"batch={n}")).count() == len(rows)
    assert log["b1"] == ("done", "go | slow | x") and log["b9"] == ("done", "")
    assert sorted(p.name for p in (tmp_path / "log").glob("version=*")) == ["version=0", "version=3"]


def test_a_line_is_parsed_once(spark):
    """Later filters and expressions name the parsed columns; they don't parse the text again."""
    line = '{ "type": "Feature", "properties": { "pid": "a", "ra": null }, "geometry": { "type": "Polygon", "coordinates": [[[1,2],[3,2],[3,4],[1,2]]] } },'
    lines = spark.createDataFrame([(0, line), (1, line.replace("} },", "oops,")), (2, '{"type": "Header"'), (3, None)], "at int, value string")
    used = selection.filter_farmland(selection.filter_bbox(readers.parse_feature_lines(lines), 0, 0, 5, 5))
    used = used.select("at", "pid", geometry.centroid(F.col("polys"))["lon"].alias("lon"), geometry.multipolygon_acres(F.col("polys")).alias("acres"))
    assert [(r.at, r.pid, round(r.lon, 3)) for r in used.collect()] == [(0, "a", 2.333)]
    assert used._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 3


def test_spread_uses_all_cores(spark):
    few = spark.range(50).coalesce(1)
    wide = scale.spread(few, "id")
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in wide.collect()) == list(range(50))
    assert scale.spread(wide, "id") is wide
