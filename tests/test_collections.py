"""Catalogue reads, grid contracts, areas, deliveries and sources: errors, corners and files that SQL does not cover."""

import json
import random
import struct
import threading

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.catalogue import ORACLES, QUERIES
from gridlark.catalogue_collections import _catalog, _pixels
from gridlark.functions import crs, grid
from gridlark.operators import buckets, collection, cube, deliveries, features, geometry, gridspec, points, ranks, regions, store
from gridlark.plans.relations import relation
from gridlark.sources import readers, vectors

DIR = "/root/testdata/sf0.001"
SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def ring_of(corners):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])


def test_catalogue_errors(spark):
    c, px = _catalog(spark, DIR), _pixels(spark, DIR)
    p = spark.createDataFrame([(1, 500001.0, 9999999.0, "g0"), (2, 500001.0, 9999999.0, None), (3, float("nan"), 0.0, "g1")], "k int, x double, y double, g string")
    with pytest.raises(Exception, match="unknown grid"):
        collection.sample(p.withColumn("g", F.lit("nowhere")), c, px, "k", ids="g", x="x", y="y", epsg=32717, value="vec_id").collect()
    with pytest.raises(Exception, match="no such year"):
        collection.sample(p, c, px, "k", [2021], ids="g", x="x", y="y", epsg=32717, value="vec_id").collect()
    with pytest.raises(KeyError, match="unknown"):
        collection.open_grid(c, px, "nowhere")
    with pytest.raises(ValueError, match="odd"):
        collection.patches(p, c, px, "k", 4, x="x", y="y", epsg=32717)
    for bad in ((3, 1, 2, 4), (0, 0, float("nan"), 1), (0, 1, 1, 1)):
        with pytest.raises(ValueError, match="box"):
            collection.bbox_windows(c, bad, 32717)
    with pytest.raises(ValueError, match="stops"):
        collection.read_window(c, px, "g0", 5, 4, 0, 1)
    with pytest.raises(ValueError, match="system"):
        collection.place(p, c, "k", "x", "y", 3857)
    got = {r.k: (r.grid_id, r.vec_id) for r in collection.sample(p, c, px, "k", [2017], ids="g", x="x", y="y", epsg=32717, value="vec_id").collect()}
    assert got == {1: ("g0", 0), 2: (None, None), 3: ("g1", None)}
    assert collection.requested_years(c, None) == [2017, 2018]
    assert collection.read_window(c, px, "g0", -3, 2, -1, 2, [2017]).count() == 4


def test_points_of_degrees_meet_grids_of_their_zone_and_its_neighbours(spark):
    lonlat = [(1, -81.0, -0.0001), (2, -80.9999, -0.0005), (3, 20.0, 10.0)]
    p = spark.createDataFrame(lonlat, "k int, lon double, lat double")
    placed = {r.k: (r.grid_id, r.row, r.col) for r in collection.route(p, _catalog(spark, DIR), "k").collect()}
    for k, lon, lat in lonlat:
        x, y = spark.range(1).select(*crs.utm(F.lit(lon), F.lit(lat), F.lit(17), F.lit(True))).first()
        row, col = int((1e7 - y) // 10), int((x - 500000) // 10)
        want = ("a_over", row - 2, col - 5) if 2 <= row < 10 and 5 <= col < 15 else (f"g{row // 8}", row % 8, col) if 0 <= row < 20 and 0 <= col < 25 else (None, None, None)
        assert placed[k] == want
    east = spark.createDataFrame([("e", 32618, 165000.0, 10000.0, 500, 2000, [2017])], "grid_id string, epsg int, x0 double, y0 double, width long, height long, years array<int>")
    near = spark.createDataFrame([(1, -78.005, 0.05)], "k int, lon double, lat double")  # west of zone 18
    assert collection.route(near, east, "k").first().grid_id == "e"


def test_patches_at_edges(spark):
    c, px = _catalog(spark, DIR), _pixels(spark, DIR)
    p = spark.createDataFrame([(1, 500005.0, 9999995.0, "g0"), (2, 499995.0, 10000005.0, "g0")], "k int, x double, y double, g string")
    got = {r.k: list(r.patch) for r in collection.patches(p, c, px, "k", 3, [2017], ids="g", x="x", y="y", epsg=32717, value="vec_id").collect()}
    assert got[1] == [None, None, None, None, 0, 1, None, 25, 26]
    assert got[2] == [None] * 8 + [0]  # a centre outside still has the part that overlaps
    local = cube.locate(p, "x", "y", 500000, 10000000)
    same = {r.k: (r.n_filled, list(r.patch)) for r in cube.patches(local, relation(spark, DIR, "pix"), "k", 3, "vec_id").collect()}
    assert same == {1: (4, got[1]), 2: (1, got[2])}


# ---- contracts


def test_cell_contracts(spark):
    one = gridspec.cell_grids(spark.createDataFrame([(-79.93, -1.04)], "lon double, lat double")).first()
    assert (one.grid_id, one.epsg, one.width, one.height) == ("grid_-79.95_-1.05", 32717, 1114, 1107)
    assert gridspec.grids_of_box(spark, (-80, -1.1, -79.8, -0.9)).count() == 4
    with pytest.raises(Exception, match="cell"):
        gridspec.cell_grids(spark.createDataFrame([(-79.93, -1.04)], "lon double, lat double"), centres=True).collect()
    with pytest.raises(ValueError, match="west"):
        gridspec.grids_of_box(spark, (1, 0, 1, 1))


def test_tile_contracts(spark):
    wkt = "POLYGON ((600000 9790240, 709800 9790240, 709800 9900040, 600000 9900040, 600000 9790240))"
    index = spark.createDataFrame([("17MPU", 32717, wkt)], "mgrs_tile_id string, utm_epsg int, utm_wkt string")
    g = gridspec.tile_grids(index, ["17mpu"]).first()
    assert (g.x0, g.y0, g.width, g.height) == (600000, 9900040, 10980, 10980)
    for ids in ([], ["17MPU", "17mpu"], ["17MPV"]):
        with pytest.raises(ValueError, match="ids|tiles"):
            gridspec.tile_grids(index, ids)
    with pytest.raises(ValueError, match="lacks"):
        gridspec.tile_grids(index.drop("utm_wkt"), ["17MPU"])
    with pytest.raises(ValueError, match="either"):
        gridspec.selection(index)
    with pytest.raises(ValueError, match="either"):
        gridspec.selection(index, ["17MPU"], (0, 0, 1, 1))
    assert gridspec.selection(index, ["17MPU"]).count() == 1 and gridspec.selection(index, bbox=(0, 0, 0.1, 0.1)).count() == 1
    ring = gridspec.tile_areas(index).first().ring
    assert len(ring) == 4 and all(-81 < p.x < -78 and -2 < p.y < 0 for p in ring)


def test_reference_contracts(spark, tmp_path):
    good = {"grid_id": "r", "epsg": 32717, "transform": [10, 0, 500000, 0, -10, 10000000], "width": 16, "height": 16}
    (tmp_path / "g.json").write_text(json.dumps(good))
    assert tuple(gridspec.read_contracts(spark, f"{tmp_path}/g.json").first()) == ("reference", "r", 32717, 500000.0, 1e7, 16, 16)
    (tmp_path / "b.json").write_text(json.dumps(good | {"transform": [30, 0, 500000, 0, -30, 10000000]}))
    with pytest.raises(Exception, match="10 m"):
        gridspec.read_contracts(spark, f"{tmp_path}/b.json").collect()
    (tmp_path / "z/s.zarr/embeddings").mkdir(parents=True)
    (tmp_path / "z/s.zarr/embeddings/zarr.json").write_text(json.dumps({"node_type": "array", "shape": [1, 64, 8, 8], "data_type": "float32", "attributes": {"grid_id": "g"}}))
    h = gridspec.zarr_headers(spark, f"{tmp_path}/z").first()
    assert h.shape == [1, 64, 8, 8] and h.attributes == {"grid_id": "g"} and h.path.endswith("s.zarr/embeddings")


# ---- areas


def test_areas_and_cells(spark):
    hole = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]
    df = spark.range(1).select(F.lit("a").alias("region_id"), F.array(ring_of(SQUARE), ring_of(hole)).alias("rings"))
    box = lambda *b: regions.box_ring(*map(F.lit, map(float, b)))
    ask = lambda touching, *b: df.select(regions.meets(F.col("rings"), box(*b), touching)).first()[0]
    assert ask(False, 3, 5, 3, 5) and not ask(False, 1.5, 2.5, 1.5, 2.5) and not ask(True, 1.5, 2.5, 1.5, 2.5)
    assert not ask(False, 4, 5, 0, 1) and ask(True, 4, 5, 0, 1) and not ask(True, 4.1, 5, 0, 1)
    assert not ask(False, 4, 5, 4, 5) and ask(True, 4, 5, 4, 5) and ask(False, -1, 9, -1, 9)
    assert abs(df.select(regions.common_area(F.col("rings"), box(-1, 9, -1, 9))).first()[0] - 12) < 1e-9
    cell = spark.range(1).select(F.lit("a").alias("region_id"), F.array(ring_of([(-79.16, -0.14), (-79.04, -0.14), (-79.04, -0.06), (-79.16, -0.06)])).alias("rings"))
    assert {r.grid_id for r in regions.region_cells(cell).collect()} == {"grid_-79.15_-0.15", "grid_-79.05_-0.15", "grid_-79.15_-0.05", "grid_-79.05_-0.05"}
    point = spark.createDataFrame([("p", -79.1, -0.1)], "region_id string, lon double, lat double")
    assert [r.grid_id for r in regions.region_points(point).collect()] == ["grid_-79.05_-0.05"]
    both = regions.dissolved(df.withColumn("name", F.lit(" b ")).unionByName(df.withColumn("name", F.lit("a"))).unionByName(df.withColumn("name", F.lit(" "))), "region_id", ["name"]).first()
    assert both.feature_count == 3 and both.name == "a|b" and len(both.rings) == 6
    with pytest.raises(ValueError, match="180"):
        readers.request_area((-170, 0, 175, 1))
    for bad in ((1, 0, 0, 1), (0, 0, float("inf"), 1), (0, -91, 1, 1)):
        with pytest.raises(ValueError, match="box"):
            readers.request_area(bad)
    assert readers.request_area((0, 0, 1, 1))[2] == (1, 1)


def test_buckets_hold_boxes_of_all_sizes(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.5, 0.0, 0.5), (2, -5000.0, 5000.0, -5000.0, 5000.0), (3, 3.0, 3.0, 3.0, 3.0), (4, float("nan"), 1.0, 0.0, 1.0)], "b int, x0 double, x1 double, y0 double, y1 double")
    dealt = buckets.boxes(boxes, *[F.col(c) for c in ("x0", "x1", "y0", "y1")], span=1.0)
    assert dealt.groupBy("b").count().agg(F.max("count")).first()[0] <= 100 and dealt.select("b").distinct().count() == 3
    p = spark.createDataFrame([(1, 0.2, 0.2), (2, 4000.0, -4999.0), (3, 3.0, 3.0), (4, float("nan"), 0.0)], "k int, x double, y double")
    met = buckets.points(p, F.col("x"), F.col("y"), 1.0, buckets.levels(dealt)).join(dealt, buckets.KEYS).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    assert {(r.k, r.b) for r in met.collect()} == {(1, 1), (1, 2), (2, 2), (3, 2), (3, 3)}


def test_percentiles(spark):
    rows = [("a", float(v)) for v in range(101)] + [("b", 1.0)] * 50 + [("b", 2.0)] + [(None, 3.0), ("c", None)]
    got = {r.g: (r.p50, r.p95) for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (50.0, 95.0), "b": (1.0, 1.0), None: (3.0, 3.0)}
    assert ranks.percentiles(spark.createDataFrame([(2.0,), (1.0,)], "v double"), [], "v", {"p": 0.5}).first().p == 1.5


# ---- deliveries


def test_exports_are_checked(spark):
    m = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    row = lambda *r: spark.createDataFrame(list(r), "sample_id string, year int, embedding array<float>")
    with pytest.raises(ValueError, match="repeat"):
        deliveries.checked_exports(m, row(("a", 2017, None), ("a", 2017, None)))
    with pytest.raises(ValueError, match="lacks"):
        deliveries.checked_exports(m, row(("x", 2017, None)))
    q = deliveries.merge_qc(m, deliveries.checked_exports(m, row(("a", 2017, None), ("a", 2018, [1.0] * 64)))).orderBy("year").collect()
    assert [tuple(r) for r in q] == [(2017, 1, 0, 1, 64), (2018, 1, 1, 1, 0)]


def test_preflight_verdict(spark):
    rows = [("a", -79.0, -1.0, "train"), ("a", -79.0, -1.0, "train"), ("b", 999.0, 0.0, "validation")]
    df = spark.createDataFrame(rows, "sample_id string, lon double, lat double, split string")
    r = points.preflight_report(df, [2016, 2025], 2).first()
    assert not r.valid and r.duplicate_rows == 2 and r.n_chunks == 2 and r.n_features == 128 and r.group_counts == {"split": {"train": 2, "validation": 1}}
    assert [e.split(":")[0] for e in r.errors] == ["years outside 2017-2025", "rows with duplicated sample_id", "rows outside lon [-180,180] or lat [-90,90]"] and len(r.warnings) == 1
    assert points.preflight_report(df.drop("lat"), [2017]).first().errors == ["missing required columns: ['lat']"]
    assert "point table is empty" in points.preflight_report(df.where("false"), [2017]).first().errors
    assert points.preflight_report(df.limit(1), [2017]).first().valid


def test_files_of_points_and_patches(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "sample_id string, lon double, lat double")
    deliveries.write_canonical(df, f"{tmp_path}/p.parquet", [2017])
    assert spark.read.parquet(f"{tmp_path}/p.parquet").count() == 2 and spark.read.json(f"{tmp_path}/p.parquet.report").first().valid
    with pytest.raises(ValueError, match="duplicated"):
        deliveries.write_canonical(df.unionByName(df), f"{tmp_path}/q.csv", [2017])
    s = store.shards(relation(spark, DIR, "vecs"), "vec_id", 70)
    store.write_points(s, f"{tmp_path}/store")
    r = deliveries.merge_shards(spark, f"{tmp_path}/store", f"{tmp_path}/all.parquet").first()
    assert (r.n_shards, r.n_rows, r.n_complete) == (8, 500, 500)
    c, px = _catalog(spark, DIR), _pixels(spark, DIR)
    p = relation(spark, DIR, "loc").limit(40).withColumn("sample_id", F.col("ord").cast("string")).withColumn("lon", F.col("x")).withColumn("lat", F.col("y"))
    sig = deliveries.patch_signature(p, c, 3, [2017])
    assert sig == deliveries.patch_signature(p.orderBy(F.desc("ord")), c, 3, [2017]) != deliveries.patch_signature(p, c, 5, [2017])
    got = collection.patches(p, c, px, "ord", 3, [2017], x="x", y="y", epsg=32717, value="vec_id")
    first = got.where("ord % 2 = 0")
    n = deliveries.write_patches(first, f"{tmp_path}/patches", sig, F.col("ord") % 4)
    assert n == deliveries.write_patches(got, f"{tmp_path}/patches", sig, F.col("ord") % 4) == 2  # the other half only
    assert deliveries.write_patches(got, f"{tmp_path}/patches", sig, F.col("ord") % 4) == 0 and spark.read.parquet(f"{tmp_path}/patches/shards").count() == 40
    with pytest.raises(ValueError, match="another run"):
        deliveries.write_patches(got, f"{tmp_path}/patches", "x", F.col("ord") % 4)


def test_coverage_guards(spark):
    row = lambda *v: spark.createDataFrame([("k", *map(float, v))], "g string, total_m2 double, valid_m2 double, missing_m2 double")
    assert tuple(deliveries.coverage_summary(row(4e6, 3e6, 1e6), ["g"]).first()) == ("k", 4.0, 3.0, 1.0, 75.0, 25.0)
    assert deliveries.coverage_summary(row(1, 1, 0), ["g"]).first().valid_percent == 100 and deliveries.coverage_summary(row(1, 0, 1), ["g"]).first().valid_percent == 0
    for bad in ((0, 0, 0), (4, 1, 1), (-1, 0, 0), (float("nan"), 0, 0), (float("inf"), 1, 1)):
        with pytest.raises(Exception, match="sound"):
            deliveries.coverage_summary(row(*bad), ["g"]).collect()


def test_strict_prototypes_and_guards(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (1, [0.0] * 64)], "g int, embedding array<float>")
    assert features.spherical_prototype(df, ["g"]).first().n == 1
    with pytest.raises(Exception, match="finite"):
        features.spherical_prototype(df, ["g"], strict=True).collect()
    twice = spark.createDataFrame([("a", "1"), ("a", "1.0"), ("b", "x")], "sample_id string, label string")
    with pytest.raises(ValueError, match="repeats"):
        features.prototype_rows(twice)
    assert features.prototype_rows(twice.dropDuplicates(["sample_id"])).count() == 1
    ranked = spark.createDataFrame([("p", "b", 2), ("p", "a", 1), ("q", "c", 5)], "polygon_id string, sample_id string, point_rank int")
    assert sorted(r.sample_id for r in features.anchors(ranked).collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="placed"):
        cube.cap_per_block(relation(spark, DIR, "loc"), "x", "y", [F.col("ord")], 1, 6000.0, target=10_000)


# ---- sources


def geojson(*geometries, crs_name=None):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"site": f"s{k}"}, "geometry": g} for k, g in enumerate(geometries)]}
    return json.dumps(doc | ({"crs": {"properties": {"name": crs_name}}} if crs_name else {}))


def test_geojson_of_all_kinds(spark, tmp_path):
    square = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]
    (tmp_path / "a.geojson").write_text(geojson({"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[3, 4], [5, 6, 7]]}, {"type": "Polygon", "coordinates": [square]}, None, {"type": "MultiPolygon", "coordinates": [[square]]}))
    rows = {r.sample_id: r for r in readers.read_points(spark, f"{tmp_path}/a.geojson", id_field="site", mode="centroid").collect()}
    assert {k: (r.lon, r.lat) for k, r in rows.items()} == {"s0": (1, 2), "s1__px000001": (3, 4), "s1__px000002": (5, 6), "s2": (2, 2), "s4": (2, 2)}
    assert rows["s2"].point_method == "centroid" and rows["s2"].source_geometry_type == "Polygon" and rows["s0"].source_feature_id == "0" and rows["s0"].source_path.endswith("a.geojson")
    (tmp_path / "b.geojson").write_text(geojson({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}))
    with pytest.raises(Exception, match="unsupported geometry"):
        readers.read_points(spark, f"{tmp_path}/b.geojson").collect()
    (tmp_path / "c.geojson").write_text(geojson(None))
    with pytest.raises(ValueError, match="no usable"):
        readers.read_points(spark, f"{tmp_path}/c.geojson")
    (tmp_path / "d.geojson").write_text(geojson({"type": "Point", "coordinates": [500000, 10000000]}, crs_name="urn:ogc:def:crs:EPSG::32717"))
    one = readers.read_points(spark, f"{tmp_path}/d.geojson").first()
    assert one.sample_id == "feature_00000001" and abs(one.lon + 81) < 1e-9 and abs(one.lat) < 1e-9


def test_interior_pixels_of_a_reference_grid(spark, tmp_path):
    box = [[500010, 9999970], [500030, 9999970], [500030, 9999990], [500010, 9999990], [500010, 9999970]]
    (tmp_path / "p.geojson").write_text(geojson({"type": "Polygon", "coordinates": [box]}, crs_name="EPSG:32717"))
    ref = {"epsg": 32717, "x0": 500000, "y0": 10000000, "width": 4, "height": 4}
    got = readers.read_points(spark, f"{tmp_path}/p.geojson", id_field="site", mode="interior_pixels", reference=ref).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == [f"s0__px{k:06d}" for k in range(1, 5)] and {r.point_method for r in got} == {"interior_pixel"}
    x, y = spark.range(1).select(*crs.utm(F.lit(got[0].lon), F.lit(got[0].lat), F.lit(17), F.lit(True))).first()
    assert abs(x - 500015) < 1e-4 and abs(y - 9999985) < 1e-4
    with pytest.raises(ValueError, match="reference"):
        readers.read_points(spark, f"{tmp_path}/p.geojson", mode="interior_pixels")
    degrees = vectors.read_geojson(spark, f"{tmp_path}/p.geojson").withColumn("epsg", F.lit(32718))
    assert vectors.interior_points(degrees, ref).count() == 0


def test_geoparquet(spark, tmp_path):
    wkb = [struct.pack("<BIdd", 1, 1, 3.5, -2.0), None]
    t = pa.table({"site": ["a", "b"], "geometry": pa.array(wkb, pa.binary())}).replace_schema_metadata({"geo": json.dumps({"primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB"}}})})
    pq.write_table(t, f"{tmp_path}/g.parquet")
    assert readers.is_geoparquet(spark, f"{tmp_path}/g.parquet")
    row, = readers.read_points(spark, f"{tmp_path}/g.parquet", id_field="site").collect()
    assert (row.sample_id, row.lon, row.lat) == ("a", 3.5, -2.0)
    spark.range(1).write.parquet(f"{tmp_path}/plain.parquet")
    assert not readers.is_geoparquet(spark, f"{tmp_path}/plain.parquet")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_points(spark, f"{tmp_path}/plain.parquet")
    with pytest.raises(Exception, match="empty id"):
        (tmp_path / "p.csv").write_text("site,lon,lat\n ,1,2\n")
        readers.read_points(spark, f"{tmp_path}/p.csv", id_field="site").collect()


def test_shards_beside_their_catalogue(spark, tmp_path):
    for k in (1, 2):
        spark.range(3).select((F.col("id") + 10 * k).alias("id")).write.parquet(f"{tmp_path}/s/shard{k}")
    spark.createDataFrame([(2, "shard2"), (1, "shard1")], "chunk int, path string").write.parquet(f"{tmp_path}/s/catalog.parquet")
    got = readers.read_shards(spark, f"{tmp_path}/s/catalog.parquet")
    assert sorted((r.shard_order, r.id) for r in got.collect()) == [(k, 10 * k + i) for k in (1, 2) for i in range(3)]
    assert [len(b) for b in readers.batches(got.orderBy("shard_order", "id"), 4)] == [4, 2]
    assert readers.load_catalogs(spark, f"{tmp_path}/s/catalog.parquet", None).count() == 2
    spark.createDataFrame([(1, "gone")], "chunk int, path string").write.parquet(f"{tmp_path}/t/catalog.parquet")
    with pytest.raises(FileNotFoundError, match="gone"):
        readers.read_shards(spark, f"{tmp_path}/t/catalog.parquet")


def test_sources_that_change(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    before = spark.createDataFrame(readers.fingerprint(spark.read.parquet(f"{tmp_path}/x")).collect())
    readers.assert_unchanged(before, spark.read.parquet(f"{tmp_path}/x"))
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/x")
    with pytest.raises(ValueError, match="changed"):
        readers.assert_unchanged(before, spark.read.parquet(f"{tmp_path}/x"))


def test_relations_of_footprints(spark):
    base = {"a": 10.0, "b": 0.0, "c": 663840.0, "d": 0.0, "e": 10.0, "f": 2457600.0}
    def ask(**other):
        cols = {f"u{k}": F.lit(v) for k, v in base.items()} | {f"v{k}": F.lit(float(other.get(k, v))) for k, v in base.items()} | {"uepsg": F.lit(32649), "vepsg": F.lit(other.get("epsg", 32649))}
        return spark.range(1).withColumns(cols).select(grid.footprint_relation("u", "v").alias("g")).first().g
    assert ask(e=-10.0, f=2621440.0).matches and not ask(e=-10.0, f=2621440.0).aligned and not ask(epsg=32650).matches and not ask(c=663843.0).matches
    assert ask(c=663850.0).aligned and abs(ask(c=663843.0).rx - 0.3) < 1e-9


def against_sql(spark, folder, name):
    """A query's rows over the tables in a folder, and those of its SQL."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in df.columns)).fetchall())


def test_points_on_slanted_edges(spark, tmp_path):
    """Points whose distance to a triangle's side is a rounding error: quotients put them on the other side than products do."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT o.* REPLACE (k::bigint AS o_orderkey, c::bigint AS o_custkey) FROM (SELECT * FROM '/root/testdata/sf0.001/orders.parquet' LIMIT 1) o, (VALUES (529581, 51964), (386280, 38320), (749188, 66528)) v(k, c)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (FROM '/root/testdata/sf0.001/nation.parquet') TO '{tmp_path}/nation.parquet'")
    got, want = against_sql(spark, tmp_path, "point_in_polygon")
    assert got == want


def test_an_edge_answers_alike_in_both_directions(spark):
    """Two triangles that share a side: no point is in both, and one on the side is so for both."""
    rows = [(-147.5 + k / 1000, -10 + 4 * k / 1000) for k in range(-2500, 2500)]
    df = spark.createDataFrame(rows, "x double, y double")
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    low, high, west, east = p(-150, -20), p(-145, 0), p(-160, 0), p(-140, -20)
    left, right = (geometry.contains(F.array(*c), F.col("x"), F.col("y")) for c in ((low, high, west), (low, east, high)))
    turned = geometry.contains(F.array(high, east, low), F.col("x"), F.col("y"))
    assert df.where((left & right) | (right != turned)).count() == 0


def test_spot_check_of_windows_of_few_pixels(spark, tmp_path):
    """The last window of each outcome holds one to five pixels, or those from the middle on; each still shows its outcome."""
    kept = "vec_id < 81 OR vec_id BETWEEN 105 AND 120 OR vec_id BETWEEN 143 AND 144 OR vec_id BETWEEN 168 AND 180 OR vec_id = 199"
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE {kept}) TO '{tmp_path}/embeddings.parquet'")
    got, want = against_sql(spark, tmp_path, "spot_check")
    assert got == want and len(got) == 10


def within_seconds(spark, seconds, df):
    """df's rows; its jobs are cancelled after so many seconds."""
    spark.sparkContext.addJobTag("timed")
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag("timed"))
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag("timed")


def plainly_spread(points, most):
    """Of (key, x, y) in order: the first, then always the farthest, while there is one apart."""
    far = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    points = sorted(points)
    taken = points[:1]
    while len(taken) < most:
        best = max(points, key=lambda p: min(far(p, q) for q in taken))
        if min(far(best, q) for q in taken) <= 1e-12:
            break
        taken.append(best)
    return [p[0] for p in taken]


def test_farthest_points_of_large_groups(spark):
    rng = random.Random(5)
    rows = [(g, k, float(rng.randrange(side)), float(rng.randrange(side))) for k in range(6000) for g, side in ((None, 90), (1, 1000), (2, 3))]
    df = spark.createDataFrame(rows, "g int, k long, x double, y double")
    got = {}
    for g, k, i in sorted(within_seconds(spark, 60, geometry.farthest_points(df, "g", "k", "x", "y", 11)), key=lambda r: r["point_rank"]):
        got.setdefault(g, []).append(k)
        assert len(got[g]) == i
    assert got == {g: plainly_spread([r[1:] for r in rows if r[0] == g], 11) for g in (None, 1, 2)} and len(got[2]) == 9
    one = df.where("g = 1").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    assert [r[0] for r in within_seconds(spark, 60, one.select(F.explode(geometry.spread_out(F.col("p"), F.lit(5)))))] == got[1][:5]


def test_farthest_points_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, 0.0, 0.0), (1, 2, nan, 5.0), (1, 3, 3.0, 4.0), (1, 4, None, 1.0), (1, 5, inf, 1.0), (2, 1, nan, 0.0), (2, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double")
    assert sorted(map(tuple, geometry.farthest_points(df, "g", "k", "x", "y", 4).collect())) == [(1, 1, 1), (1, 3, 2), (2, 1, 1)]
