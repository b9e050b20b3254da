"""Stores, sources, streams, areas and plans that SQL does not cover."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import crs
from gridlark.operators import geometry, lookup, mosaic, store
from gridlark.plans import budget
from gridlark.plans.relations import relation
from gridlark.sources import readers
from gridlark.streaming import events

DIR = "/root/testdata/sf0.001"


def test_store_round_trip_and_guards(spark, tmp_path):
    s = store.shards(relation(spark, DIR, "vecs"), "vec_id", 70)
    folder = str(tmp_path / "store")
    store.write_points(s, folder)
    got = store.open_points(spark, folder)
    assert got.count() == 500 and got.where("chunk = 1").agg(F.max("vec_id")).first()[0] == 69
    s.where("chunk = 2").limit(3).drop("chunk").write.mode("append").parquet(f"{folder}/shards/chunk=2")
    with pytest.raises(ValueError, match="catalogue"):
        store.open_points(spark, folder)
    again = str(tmp_path / "again")
    store.write_points(store.shards(relation(spark, DIR, "vecs").withColumn("sample_id", F.lit("same")), "vec_id", 70), again)
    with pytest.raises(ValueError, match="share an id"):
        store.open_points(spark, again)


def test_project_and_ids(spark):
    wide = spark.range(1).select("id", *[F.lit(0.0).alias(c) for c in store.vec.band_columns(2017)])
    assert len(store.project(wide, ["id"], [2017]).columns) == 65
    assert store.project(wide).columns == ["id"]
    with pytest.raises(ValueError, match="unknown"):
        store.project(wide, ["id"], [2018])
    with pytest.raises(Exception, match="empty id"):
        store.identify(spark.createDataFrame([(1, " ")], "n int, sample_id string"), "n").collect()
    assert [r.sample_id for r in store.pixel_ids(spark.createDataFrame([("p", 7), ("p", 123)], "polygon_id string, point_rank int")).collect()] == ["p_px07", "p_px123"]


def test_compare_coordinates_nulls(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, None)], "k int, x double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, None), (3, 2.0)], "k int, x double")
    assert tuple(store.compare_coordinates(a, b, "k", ["x"]).first()) == (3, 0, 0, 1)


@pytest.mark.parametrize(("lon", "lat", "tile"), [(-79.93, -1.04, "17MPU"), (113.999, 30.0, "49RGP"), (5.0, 60.0, "32VKM"), (15.0, 78.0, "33XWG"), (0.0, -85.0, None), (float("nan"), 0.0, None)])
def test_mgrs(spark, lon, lat, tile):
    df = crs.mgrs_tiles(spark.createDataFrame([(lon, lat)], "lon double, lat double"))
    assert df.columns == ["lon", "lat", "mgrs_tile"] and df.first().mgrs_tile == tile


def test_inner_pole_and_lattice(spark):
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert np.allclose(geometry.inner_pole(square), (5, 5), atol=0.02)
    ell = np.array([[0, 0], [20, 0], [20, 4], [4, 4], [4, 12], [0, 12]], float)
    pole = np.array([geometry.inner_pole(ell)])
    fine = np.stack(np.meshgrid(np.linspace(0, 20, 401), np.linspace(0, 12, 241)), -1).reshape(-1, 2)
    assert geometry._reach(ell, pole)[0] >= geometry._reach(ell, fine).max() - 0.02
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ell])
    got = geometry.lattices(spark.range(1).select("id", ring.alias("ring")), "id", F.lit(30)).first().points
    got = np.array([(p.x, p.y) for p in got])
    assert len(got) >= 30 and (geometry._reach(ell, got) > 0).all()
    assert (np.lexsort((got[:, 1], got[:, 0])) == np.arange(len(got))).all()
    thin = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 10), (10, 10.01))])
    assert geometry.lattices(spark.range(1).select("id", thin.alias("ring")), "id", F.lit(30)).count() == 1


def test_sample_polygons(spark):
    corner = "struct<x: double, y: double>"
    df = spark.createDataFrame([(1, [(0.0, 0.0), (400.0, 0.0), (400.0, 100.0), (0.0, 100.0)]), (2, None), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (4, [])], f"polygon_id int, ring array<{corner}>")
    rows = geometry.sample_polygons(df, "polygon_id", 0.5, 6).orderBy("polygon_id", "point_rank").collect()
    assert [(r.polygon_id, r.point_rank) for r in rows] == [(1, k) for k in range(1, 7)] + [(3, 1)]
    assert abs(sum(r.weight for r in rows if r.polygon_id == 1) - 1) < 1e-12
    assert len({(r.x, r.y) for r in rows if r.polygon_id == 1}) == 6


def test_clip_and_distance(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    row = spark.range(1).select(geometry.signed_area(geometry.clip(ring, 5, 20, -5, 4)).alias("a"), F.size(geometry.clip(ring, 50, 60, 0, 1)).alias("n"), geometry.segment_distance(ring, F.lit(13.0), F.lit(14.0)).alias("d"), geometry.segment_distance(ring, F.lit(4.0), F.lit(5.0)).alias("e")).first()
    assert (row.a, row.n, row.d, row.e) == (20.0, 0, 5.0, 4.0)


def test_background_is_repeatable_and_even(spark):
    a = geometry.background(spark, 20_000, 3, -180, 180, -60, 60)
    assert a.exceptAll(a.repartition(5)).isEmpty()
    low = a.where("y < 0").count()
    assert 9_600 < low < 10_400
    assert 9_600 < a.where("abs(y) < 25.6589").count() < 10_400  # half of the area


def test_select_region_and_requests(spark):
    n = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "country string, area string")
    assert lookup.select_region(n, {"country": "x", "area": "b"}).first().admin_level == 1
    for names, text in (({"country": "x"}, "several"), ({"country": "z"}, "no such")):
        with pytest.raises(ValueError, match=text):
            lookup.select_region(n, names)
    with pytest.raises(ValueError, match="distinct"):
        lookup.select_ids(n, "area", ["a", "A"])


def test_write_ids(spark, tmp_path):
    i = spark.createDataFrame([("mgrs", "17MPU"), ("mgrs", "17MPU"), ("mgrs", "17NQA"), ("t", "g")], "scheme string, grid_id string")
    lookup.write_ids(i, str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids/scheme=mgrs")).collect()] == ["17MPU", "17NQA"]


def test_catalogs_and_discovery(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "grid_id string, n int").write.parquet(str(tmp_path / "root"))
    spark.createDataFrame([("b", "c")], "grid_id string, crs string").write.parquet(str(tmp_path / "more"))
    got = readers.load_catalogs(spark, str(tmp_path / "root"), [str(tmp_path / "more")])
    assert got.count() == 2 and got.columns == ["grid_id", "n", "crs"]
    for name in ("x/one.tif", "x/deep/two.tif", ".git/three.tif", "x/four.txt"):
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(b"12345")
    found = readers.discover(spark, str(tmp_path / "files"), ".tif").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["one.tif", "two.tif"] and {r.length for r in found} == {5}


def test_wkb_points(spark):
    rows = [(1, bytearray(struct.pack("<BIdd", 1, 1, 3.5, -2.0))), (2, bytearray(struct.pack(">BIdd", 0, 1, 1.0, 2.0))), (3, None), (4, bytearray(struct.pack("<BIdd", 1, 1, float("nan"), float("nan"))))]
    got = readers.wkb_points(spark.createDataFrame(rows, "k int, geometry binary")).orderBy("k").collect()
    assert [(r.lon, r.lat) for r in got] == [(3.5, -2.0), (1.0, 2.0), (None, None), (None, None)]
    with pytest.raises(Exception, match="only points"):
        readers.wkb_points(spark.createDataFrame([(bytearray(struct.pack("<BII", 1, 3, 0)),)], "geometry binary")).collect()


def test_read_areas(spark, tmp_path):
    read = lambda doc: readers.parse_areas(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    hole = [[0.5, 0.1], [0.9, 0.1], [0.9, 0.2], [0.5, 0.1]]
    ok = {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Polygon", "coordinates": [ring, hole]}}
    (props, shapes), = read(ok)
    assert props == {"n": "1"} and [len(r) for r in shapes[0]] == [3, 3]
    assert len(read({"type": "FeatureCollection", "features": [ok, ok]})) == 2
    assert len(read({"type": "MultiPolygon", "coordinates": [[ring], [hole]]})[0].polygons) == 2
    (tmp_path / "a.geojson").write_text(json.dumps(ok))
    assert readers.read_areas(spark, f"{tmp_path}/a.geojson").count() == 1
    for bad in ({"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [ring[:-1]]}, {"type": "Polygon", "coordinates": [[[0, 0], [200, 0], [1, 1], [0, 0]]]}, {"type": "FeatureCollection", "features": []}, {"type": "Polygon", "coordinates": []}, {"type": "Polygon", "coordinates": [[[0, 0], [1, "x"], [1, 1], [0, 0]]]}, {"type": "Polygon", "coordinates": [ring], "crs": {"properties": {"name": "EPSG:3857"}}}):
        with pytest.raises(Exception, match="areas|polygons|ring|degrees"):
            read(bad)


def test_append_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    df.repartition(3).write.parquet(src)
    for _ in range(2):
        events.append_once(events.read_stream(spark, src, df.schema, 1), out, check, "r").awaitTermination()
    assert spark.read.parquet(out).count() == 50


def test_split_until_small(spark):
    b = spark.createDataFrame([("k", 0, 0, 8, 9)], "key string, row long, col long, height long, width long")
    once = mosaic.split_blocks(b, 4)
    twice = mosaic.split_blocks(once, 4)
    assert once.count() == 4 and twice.agg(F.sum(F.col("height") * F.col("width"))).first()[0] == 72
    assert twice.where("height > 4 OR width > 4").isEmpty()
    assert {r.key for r in once.collect()} == {f"k/split{i}" for i in range(4)}


def test_empty_tables(spark):
    none = relation(spark, DIR, "pix").where("false")
    assert mosaic.scan(none, ["tile"]).count() == 0
    assert tuple(mosaic.cube_difference(none, none, ["row", "col"]).first()) == (0, 0, 0)
    assert mosaic.priority_mosaic(none, ["row", "col"], "vec_id").count() == 0
    assert store.shard_catalog(store.shards(relation(spark, DIR, "vecs").where("false"), "vec_id", 70)).count() == 0


def test_plans():
    assert budget.grid_peak(256, 1, 1) == 256 * budget.MIB + 40 * budget.MIB + 16 * budget.MIB
    assert budget.plan_grid(256, 4 * budget.GIB, most=4).workers == 4
    assert budget.plan_grid(433, 512 * budget.MIB, most=4).workers == 1
    assert budget.plan_points(1000, 2, budget.GIB, most=8, workers=2).workers == 2
    with pytest.raises(ValueError, match="GiB"):
        budget.plan_grid(4096, budget.GIB)
    assert list(budget.chunk_slice(5, 2, 2)) == [2, 3] and list(budget.chunk_slice(5, 4)) == [4, 5]
    c = budget.capacity(10 * budget.GIB, 5 * budget.GIB, 20 * budget.GIB, budget.GIB, 1.3, budget.GIB)
    assert not c["can_start"] and len(c["blocked"]) == 1 and c["phrase"] == "DOWNLOAD 10.00 GiB"
    one, two = {"id": "a", "year": 2017}, {"id": "b", "year": 2017}
    assert budget.signature(years=[2017], sources=[one, two]) == budget.signature(sources=[two, one], years=[2017])
    assert budget.signature(years=[2017]) != budget.signature(years=[2018])
    assert budget.resumable("x", "x") and not budget.resumable(None, "x")
    with pytest.raises(ValueError, match="another run"):
        budget.resumable("y", "x")
