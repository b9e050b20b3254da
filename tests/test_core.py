"""Literals and edge cases of functions, readers, streams and geometry."""

import math

import pytest
from pyspark.sql import functions as F

from gridlark.functions import crs, grid, vec
from gridlark.operators import audit, cube, features, geometry, lookup, points
from gridlark.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_cells(spark):
    c = lambda lon, lat: (grid.cell_centre(F.lit(lon)), grid.cell_centre(F.lit(lat)))
    assert tuple(one(spark, *c(0.17, 52.23))) == (0.15, 52.25)
    assert tuple(one(spark, *c(-0.12, -0.03))) == (-0.15, -0.05)
    assert one(spark, grid.cell_name(F.lit(-79.93), F.lit(-1.04)))[0] == "grid_-79.95_-1.05"
    assert one(spark, grid.cell_centre(F.lit(float("nan"))), grid.pixel(F.lit(float("nan")), F.lit(0.0), 10.0)) == (None, None)


def test_cell_shape_in_utm(spark):
    corners = spark.createDataFrame([(x, y) for x in (-80.0, -79.9) for y in (-1.1, -1.0)], "lon double, lat double")
    x, y = crs.utm(F.col("lon"), F.col("lat"), F.lit(17), F.lit(True))
    w, s, e, n = corners.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).collect()[0]
    size = lambda a, b: (math.ceil(b / 10) - math.floor(a / 10))
    assert (size(w, e), size(s, n)) == (1114, 1107)


def test_boxes(spark):
    df = spark.createDataFrame([(-80.0, -79.8, -1.1, -0.9)], "x0 double, x1 double, y0 double, y1 double")
    assert lookup.cells_of_boxes(df).count() == 4


def test_footprints_and_splits():
    a = (10.0, 0.0, 500000.0, 0.0, -10.0, 10000000.0)
    assert grid.footprints_match(a, (10.0, 0.0, 500010.0, 0.0, 10.0, 9999900.0))
    assert not grid.footprints_match(a, (10.0, 0.0, 500003.0, 0.0, -10.0, 10000000.0))
    assert [p[:4] for p in grid.quad_split(0, 0, 8, 8, 4)] == [(0, 0, 4, 4), (0, 4, 4, 4), (4, 0, 4, 4), (4, 4, 4, 4)]
    assert list(grid.quad_split(0, 0, 4, 4, 4)) == []
    assert grid.retry_delay(1) == 1 and grid.retry_delay(9, 1) == 60
    with pytest.raises(ValueError):
        grid.years_argument([2016, 2025])


def test_windows_and_patches(spark):
    assert cube.bbox_window(0.0, 100.0, (5.0, 75.0, 26.0, 95.0)) == (0, 3, 0, 3)
    px = spark.createDataFrame([(r, c, r * 4 + c) for r in range(4) for c in range(4)], "row long, col long, v int")
    pt = spark.createDataFrame([(1, 0, 0)], "id int, row long, col long")
    assert cube.patches(pt, px, "id", 3, "v").collect()[0].patch == [None, None, None, None, 0, 1, None, 4, 5]
    with pytest.raises(ValueError):
        cube.patches(pt, px, "id", 2, "v")
    assert cube.window(px, -3, 2, 3, 9).count() == 2


def test_vectors(spark):
    assert one(spark, vec.norm(F.array(F.lit(3.0), F.lit(4.0))))[0] == 5
    rows = [(1, [1.0] * 64), (2, [0.0] * 64), (3, [float("nan")] + [1.0] * 63), (4, None), (5, [float("inf")] * 64), (6, [1.0] * 3)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = {r.id: (r.c, r.p, bool(r.v)) for r in df.select("id", vec.complete(F.col("embedding")).alias("c"), vec.present(F.col("embedding")).alias("p"), vec.valid(F.col("embedding")).alias("v")).collect()}
    assert got == {1: (True, True, True), 2: (True, True, False), 3: (False, False, False), 4: (False, False, False), 5: (False, True, False), 6: (False, False, False)}
    wide = df.where("id = 1").select("id", *[F.col("embedding")[b].alias(c) for b, c in enumerate(vec.band_columns(2020))])
    assert features.discover_years(wide.columns) == [2020]
    back = features.long_to_wide(features.wide_to_long(wide, ["id"]), ["id"], [2020, 2021]).collect()[0]
    assert back.aef2020_complete and not back.aef2021_complete and not back.aef_complete_all_years


def test_compare_and_coverage(spark):
    a = spark.createDataFrame([(1, [0.0] * 64), (2, [float("nan")] * 64), (3, [1.0] * 64)], "k int, embedding array<float>")
    b = spark.createDataFrame([(1, [0.0] * 64), (2, [0.0] * 64), (3, [2.0] + [1.0] * 63)], "k int, embedding array<float>")
    r = audit.compare(a, b, ["k"]).collect()[0]
    assert (r.n_vectors, r.n_complete, r.n_exact, r.mask_disagreements, r.max_difference) == (3, 2, 1, 64, 1)
    assert one(spark, audit.redact(F.lit("authorization: Bearer a.b-c; access_token: x")))[0] == "authorization: Bearer <redacted>; access_token: <redacted>"


def test_merge_guards(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        points.merge_one_to_one(a, a, "k")
    chunks = points.assign_chunks(spark.range(1300).select(F.col("id").alias("sample_id"), F.col("id").alias("ord")), "ord", 333)
    assert sorted(r["count"] for r in chunks.groupBy("chunk").count().collect()) == [301, 333, 333, 333]
    tied = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "y"), ("a", 0, "z")], "sample_id string, ord int, v string")
    got = points.assign_chunks(tied, "ord", 2, carry=("v",))
    assert sorted((r.v, r.chunk) for r in got.collect()) == [("x", 1), ("x", 2), ("y", 2), ("z", 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("site,lon,lat\na,1.5,2\nb,x,3\n")
    rows = readers.read_points(spark, f"{tmp_path}/p.csv", id_field="site").collect()
    assert {r.sample_id: (r.lon, r.lat) for r in rows} == {"a": (1.5, 2.0), "b": (None, 3.0)}
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"site":"a"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert readers.read_points(spark, f"{tmp_path}/p.geojson", id_field="site").collect()[0].lat == 2
    with pytest.raises(ValueError):
        readers.read_points(spark, f"{tmp_path}/p.csv", id_field="site", most=1)
    with pytest.raises(ValueError):
        readers.read_points(spark, f"{tmp_path}/p.kml")


def test_cube_on_disk(spark, tmp_path):
    px = spark.createDataFrame([("g", 2020, r, c) for r in range(70) for c in range(3)], "grid_id string, year int, row int, col int")
    cube.write_cube(px, f"{tmp_path}/cube")
    back = spark.read.parquet(f"{tmp_path}/cube").where("grid_id = 'g' AND year = 2020 AND chunk_row = 1")
    assert back.count() == 18


def test_signature_ignores_order(spark):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("v"))
    a, b = (audit.content_signature(x, ["id", "v"]).collect()[0] for x in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert a == b and a != audit.content_signature(df.where("id > 0"), ["id", "v"]).collect()[0]


def test_geometry(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))"
    df = spark.sql(f"SELECT {ring} AS ring")
    inside = lambda x, y: df.select(geometry.contains(F.col("ring"), F.lit(x), F.lit(y))).collect()[0][0]
    assert inside(1.0, 1.0) and inside(3.9, 3.9) and not inside(4.0, 2.0) and not inside(0.0, 0.0) and not inside(5.0, 1.0) and not inside(2.0, 4.0)
    assert geometry.interior_pixels(df, 0.0, 4.0, 2.0).count() == 4
    spots = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (10, 0), (10, 9), (0, 0))])
    assert one(spark, geometry.spread_out(spots, F.lit(10)))[0] == [0, 3, 2, 1]
    assert one(spark, geometry.spread_out(F.slice(spots, 1, 0), F.lit(3)))[0] == []


def test_stream_equals_batch(spark, tmp_path):
    from gridlark.streaming import events

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{tmp_path}/in")
    stream = events.windowed(events.read_stream(spark, f"{tmp_path}/in", src.schema), "ts", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("win").collect()), key=repr) == sorted(map(tuple, events.windowed(src, "ts", "event_type").collect()), key=repr)
