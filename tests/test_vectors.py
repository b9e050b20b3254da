"""Vector files, written here byte by byte, and read back."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from gridlark.operators import geometry
from gridlark.sources import readers, vectors

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]


def wkb_polygon(*rings, order="<"):
    head = struct.pack(order + "BII", order == "<", 3, len(rings))
    return head + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "2d", *p) for p in r) for r in rings)


def shp(bodies):
    records = b"".join(struct.pack(">2i", k, len(b) // 2) + b for k, b in enumerate(bodies, 1))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, 0, *[0.0] * 8) + records


def shp_polygon(*rings):
    starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
    xy = [p for r in rings for p in r]
    return struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xy)


def dbf(names, deleted=()):
    field = b"name".ljust(11, b"\0") + b"C" + bytes(4) + bytes([10]) + bytes(15)
    head = struct.pack("<4BIHH", 3, 0, 0, 0, len(names), 65, 11) + bytes(20) + field + b"\r"
    return head + b"".join((b"*" if k in deleted else b" ") + n.encode().ljust(10) for k, n in enumerate(names))


def test_wkb():
    assert vectors.parse_wkb(struct.pack(">BI3d", 0, 1001, 1, 2, 9)) == ("Point", [(1.0, 2.0)], [])
    kind, _, rings = vectors.parse_wkb(wkb_polygon(SQUARE[::-1], HOLE[::-1], order=">"))
    assert kind == "Polygon" and [vectors._area(r) for r in rings] == [16.0, -1.0]
    multi = struct.pack("<BII", 1, 6, 2) + wkb_polygon(SQUARE) + wkb_polygon(HOLE)
    assert [vectors._area(r) for r in vectors.parse_wkb(multi)[2]] == [16.0, 1.0]
    with pytest.raises(ValueError, match="neither"):
        vectors.parse_wkb(struct.pack("<BII", 1, 2, 0))


def test_shapefile(spark, tmp_path):
    point = struct.pack("<i2d", 1, 7.5, -3.0)
    (tmp_path / "a.shp").write_bytes(shp([shp_polygon(SQUARE[::-1], HOLE[::-1]), point, struct.pack("<i", 0), point]))
    (tmp_path / "a.dbf").write_bytes(dbf(["one", "two", "three", "gone"], deleted={3}))
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984"]')
    (tmp_path / "ab.shp").write_bytes(b"another file")
    got = vectors.read_features(spark, str(tmp_path / "a.shp"))
    rows = got.orderBy("feature").collect()
    assert [(r.properties["name"], r.kind, r.epsg) for r in rows] == [("one", "MultiPolygon", 4326), ("two", "Point", 4326), ("three", None, 4326)]
    assert [vectors._area([tuple(p) for p in r]) for r in rows[0].rings] == [16.0, -1.0]
    pts = {r.sample_id: r for r in vectors.to_points(got, "centroid", "name").collect()}
    assert set(pts) == {"one", "two"} and pts["two"].point_method == "source_point"
    assert abs(pts["one"].lon - (16 * 2 - 1.5) / 15) < 1e-12


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "b.gpkg")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, geometry_type_name, srs_id, z, m)")
    con.execute("CREATE TABLE sites (fid INTEGER PRIMARY KEY, geom BLOB, species TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom', 'GEOMETRY', 32717, 0, 0)")
    head = b"GP\0\1" + struct.pack("<i", 32717)
    boxed = b"GP\0\3" + struct.pack("<i4d", 32717, 0, 0, 0, 0)
    shift = lambda r: [(500000 + x, 9990000 + y) for x, y in r]
    many = struct.pack("<BII", 1, 4, 2) + b"".join(struct.pack("<BI2d", 1, 1, 500000 + k, 9990000) for k in range(2))
    con.executemany("INSERT INTO sites (geom, species) VALUES (?, ?)", [(boxed + wkb_polygon(shift(SQUARE), shift(HOLE)), "teca"), (head + many, None), (None, "x")] + [(head + struct.pack("<BI2d", 1, 1, 500000, 10000000), "p")] * 600)
    con.commit()
    con.close()
    got = vectors.read_features(spark, path)
    assert got.count() == 603 and got.where("kind IS NULL").count() == 1
    pts = vectors.to_points(got)
    assert pts.count() == 603 and pts.select("sample_id").distinct().count() == 603
    ids = [r.sample_id for r in pts.where("source_geometry_type = 'MultiPoint'").orderBy("sample_id").collect()]
    assert ids == ["feature_00000002__px000001", "feature_00000002__px000002"]
    last = pts.where("sample_id = 'feature_00000603'").first()
    assert abs(last.lon + 81) < 1e-9 and abs(last.lat) < 1e-9
    inside = got.where("kind = 'Polygon'").withColumn("p", geometry.rings_representative(F.col("rings")))
    assert inside.where(geometry.rings_contain(F.col("rings"), F.col("p.x"), F.col("p.y"))).count() == 1
    assert readers.read_points(spark, path, most=603).count() == 603
    with pytest.raises(ValueError, match="more than"):
        readers.read_points(spark, path, most=602)
    with pytest.raises(Exception, match="no layer"):
        vectors.read_features(spark, path, "other").collect()
    with pytest.raises(Exception, match="empty id"):
        vectors.to_points(got, id_field="species").collect()
    with pytest.raises(Exception, match="unsupported"):
        vectors.to_points(got.withColumn("epsg", F.lit(3857))).collect()


def test_rings_contain(spark):
    ring = lambda r: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r[:-1]])
    rings = F.array(ring(SQUARE), ring(HOLE))
    df = spark.createDataFrame([(3.0, 3.0, True), (1.5, 1.5, False), (1.0, 1.5, False), (4.0, 2.0, False), (5.0, 5.0, False), (0.5, 2.0, True)], "x double, y double, want boolean")
    assert df.where(geometry.rings_contain(rings, F.col("x"), F.col("y")) != F.col("want")).count() == 0
