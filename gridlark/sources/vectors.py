"""Vector features from Shapefile, GeoPackage and WKB columns, parsed on executors from bytes that Spark reads.

A file is one task's work, as its format wants (a Shapefile ends at 2 GB, and so does a row of file bytes); many
files are many tasks. Outer rings come counter-clockwise and holes clockwise, without the closing corner.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import crs
from gridlark.operators import geometry
from gridlark.runtime import ship

XY = "struct<x: double, y: double>"
SCHEMA = f"feature bigint, properties map<string, string>, kind string, points array<{XY}>, rings array<array<{XY}>>, epsg int"
Shape = tuple[str | None, list, list]


def _area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def _turned(ring: list, outer: bool) -> list:
    """The ring without its closing corner, counter-clockwise where outer."""
    open_ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    return open_ring if (_area(open_ring) > 0) == outer else open_ring[::-1]


def parse_wkb(blob: bytes) -> Shape:
    """(kind, points, rings) of a point, polygon or a collection of either; empty ones have neither."""
    points, rings = [], []

    def number(at: int, order: str) -> int:
        return struct.unpack_from(order + "I", blob, at)[0]

    def read(at: int) -> tuple[int, int]:
        order = "<" if blob[at] == 1 else ">"
        code = number(at + 1, order)
        at += 5
        if code & 0x20000000:
            at += 4
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000]
        kind = (code & 0xFFFF) % 1000

        def corners(at: int, n: int) -> list:
            flat = struct.unpack_from(f"{order}{n * dims}d", blob, at)
            return [(flat[k], flat[k + 1]) for k in range(0, len(flat), dims)]

        if kind == 1:
            points.extend(p for p in corners(at, 1) if p[0] == p[0])
            return kind, at + 8 * dims
        if kind not in (3, 4, 6):
            raise ValueError(f"geometry type {kind} is neither point nor polygon")
        n = number(at, order)
        at += 4
        for k in range(n):
            if kind == 3:
                size = number(at, order)
                rings.append(_turned(corners(at + 4, size), k == 0))
                at += 4 + 8 * dims * size
            else:
                at = read(at)[1]
        return kind, at

    kind = {1: "Point", 3: "Polygon", 4: "MultiPoint", 6: "MultiPolygon"}[read(0)[0]]
    return kind, points, rings


def parse_shp(data: bytes) -> Iterator[Shape]:
    """The shapes of a .shp file; null shapes are (None, [], [])."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        code = struct.unpack_from("<i", body)[0]
        if code == 0:
            yield None, [], []
        elif code in (1, 11, 21):
            yield "Point", [struct.unpack_from("<2d", body, 4)], []
        elif code in (8, 18, 28):
            n = struct.unpack_from("<i", body, 36)[0]
            yield "MultiPoint", [struct.unpack_from("<2d", body, 40 + 16 * k) for k in range(n)], []
        elif code in (5, 15, 25):
            parts, n = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
            xy = [struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * k) for k in range(n)]
            # The format's outer rings are clockwise, so every ring is turned round.
            whole = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            rings = [_turned(r, _area(r[:-1]) <= 0) for r in whole]
            yield "Polygon" if parts == 1 else "MultiPolygon", [], rings
        else:
            raise ValueError(f"shape type {code} is neither point nor polygon")


def parse_dbf(data: bytes) -> Iterator[dict[str, str | None] | None]:
    """The rows of a .dbf file as text, blank fields null; deleted rows are None, so that numbers still fit the shapes."""
    n, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32

    def text(b: bytes) -> str | None:
        try:
            s = b.decode()
        except UnicodeDecodeError:
            s = b.decode("latin-1")
        return s.strip("\0 ") or None

    for k in range(n):
        row, at, out = data[head + k * width : head + (k + 1) * width], 1, {}
        for name, size in fields:
            out[name], at = text(row[at : at + size]), at + size
        yield None if row[:1] == b"*" else out


def prj_epsg(text: str | None) -> int | None:
    """Code of a .prj text: UTM on WGS84, or WGS84 degrees; null for others."""
    if not text or "WGS" not in text.upper():
        return None
    if m := re.search(r"UTM[ _]zone[ _](\d{1,2})([NS])", text, re.I):
        return (32600 if m[2].upper() == "N" else 32700) + int(m[1])
    return None if "PROJCS" in text.upper() else 4326


def parse_gpkg(data: bytes, layer: str | None = None) -> Iterator[tuple[dict, Shape, int]]:
    """(properties, shape, epsg) of a layer; without a name the file must have just one."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    layers = {t: (c, s) for t, c, s in con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns")}
    if layer is None and len(layers) != 1:
        raise ValueError(f"name one of the layers {sorted(layers)}")
    name = layer or next(iter(layers))
    if name not in layers:
        raise ValueError(f"no layer {name}; there are {sorted(layers)}")
    column, epsg = layers[name]
    quoted = name.replace('"', '""')
    rows = con.execute(f'SELECT * FROM "{quoted}"')
    names = [c[0] for c in rows.description]
    for row in rows:
        props = {k: None if v is None else str(v) for k, v in zip(names, row, strict=True) if k != column}
        blob = row[names.index(column)]
        skip = None if blob is None else 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
        yield props, (None, [], []) if blob is None else parse_wkb(blob[skip:]), epsg


def _frame(rows: list[tuple]) -> pd.DataFrame:
    xy = lambda ps: [{"x": p[0], "y": p[1]} for p in ps]
    out = [(k, props, shape[0], xy(shape[1]), [xy(r) for r in shape[2]], epsg) for k, props, shape, epsg in rows]
    frame = pd.DataFrame(out, columns=["feature", "properties", "kind", "points", "rings", "epsg"])
    return frame.astype({"epsg": "Int32"})


def _batches(rows: Iterator[tuple], size: int = 512) -> Iterator[pd.DataFrame]:
    held = []
    for k, (props, shape, epsg) in enumerate(rows, 1):
        held.append((k, props, shape, epsg))
        if len(held) == size:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def read_features(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """feature (from 1), properties, kind, points, rings and epsg of a .shp (with .dbf and .prj beside it) or .gpkg file.

    Null shapes keep their row, with null kind. Deleted rows of a .dbf are left out.
    """
    ship(spark)
    low = path.lower()
    if low.endswith(".gpkg"):
        files = spark.read.format("binaryFile").load(path).select("content")

        def run(batches):
            for pdf in batches:
                for content in pdf["content"]:
                    yield from _batches(parse_gpkg(bytes(content), layer))

        return files.mapInPandas(run, SCHEMA)
    if not low.endswith(".shp"):
        raise ValueError("not a .shp or .gpkg file")
    folder, _, name = path.rpartition("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", re.sub(r"([\[\]{}*?\\])", r"\\\1", name[:-4]) + ".*").load(folder or ".")
    part = lambda s: F.max(F.when(F.lower("path").endswith(s), F.col("content"))).alias(s[1:])
    one = files.where(F.lower("path").rlike(r"\.(shp|dbf|prj)$")).agg(part(".shp"), part(".dbf"), part(".prj"))

    def run_shp(batches):
        for pdf in batches:
            for shp, dbf, prj in zip(pdf["shp"], pdf["dbf"], pdf["prj"], strict=True):
                shapes = list(parse_shp(bytes(shp)))
                rows = list(parse_dbf(bytes(dbf))) if dbf is not None else [{}] * len(shapes)
                epsg = prj_epsg(None if prj is None else bytes(prj).decode("utf-8", "replace"))
                yield from _batches((p, s, epsg) for p, s in zip(rows, shapes, strict=True) if p is not None)

    return one.mapInPandas(run_shp, SCHEMA)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The same rows of GeoJSON files: points, several points, polygons and several polygons; other types are an error.

    A text's `crs` member names the system, degrees without one. A file is one row of text.
    """
    schema = "crs struct<properties: struct<name: string>>, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    name = F.coalesce("d.crs.properties.name", F.lit("CRS84"))
    code = F.when(F.upper(name).endswith("CRS84"), F.lit(4326)).otherwise(F.regexp_extract(name, r"(?i)epsg:+(?:[0-9.]*:)?([0-9]+)$", 1).try_cast("int"))
    f = d.select(code.alias("epsg"), F.posexplode("d.features").alias("k", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    nested = lambda levels, wrap: F.from_json(F.concat(F.lit("[" * wrap), text, F.lit("]" * wrap)), "array<" * levels + "double" + ">" * levels)
    point = lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))
    odd = kind.isNotNull() & ~kind.isin("Point", "MultiPoint", "Polygon", "MultiPolygon")
    spots = F.when(kind == "Point", nested(2, 1)).when(kind == "MultiPoint", nested(2, 0))
    shapes = F.when(kind == "Polygon", nested(4, 1)).when(kind == "MultiPolygon", nested(4, 0))

    def turned(ring, i):
        bare = F.transform(ring, point)
        bare = F.when(F.element_at(bare, 1) == F.element_at(bare, -1), F.slice(bare, F.lit(1), F.size(bare) - 1)).otherwise(bare)
        return F.when((geometry.signed_area(bare) > 0) == (i == 0), bare).otherwise(F.reverse(bare))

    empty = F.array().cast("array<array<double>>")
    solid = F.filter(F.coalesce(spots, empty), lambda c: F.size(c) > 1)
    rings = F.flatten(F.transform(F.coalesce(shapes, F.array().cast("array<array<array<array<double>>>>")), lambda s: F.transform(s, turned)))
    return f.select((F.col("k") + 1).cast("long").alias("feature"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"), kind.alias("kind"), F.when(odd, F.raise_error(F.concat(F.lit("unsupported geometry: "), kind))).otherwise(F.transform(solid, point)).alias("points"), rings.alias("rings"), "epsg")


def from_wkb(df: DataFrame, column: str = "geometry", epsg: int | None = 4326) -> DataFrame:
    """The same rows of a table with WKB geometries; its other columns are the properties. Features are numbered in no order of theirs."""
    ship(df.sparkSession)

    @F.pandas_udf(f"kind string, points array<{XY}>, rings array<array<{XY}>>")
    def parse(blobs: pd.Series) -> pd.DataFrame:
        shapes = [(None, [], []) if b is None else parse_wkb(bytes(b)) for b in blobs]
        xy = lambda line: [{"x": p[0], "y": p[1]} for p in line]
        return pd.DataFrame({"kind": [s[0] for s in shapes], "points": [xy(s[1]) for s in shapes], "rings": [[xy(r) for r in s[2]] for s in shapes]})

    others = [c for c in df.columns if c != column]
    props = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*[F.col(c).cast("string") for c in others])) if others else F.create_map().cast("map<string,string>")
    out = df.select((F.monotonically_increasing_id() + 1).alias("feature"), props.alias("properties"), parse(column).alias("g"))
    return out.select("feature", "properties", "g.kind", "g.points", "g.rings", F.lit(epsg).cast("int").alias("epsg"))


def _moved(ring, code, target: int):
    """A ring in the target system, from degrees or UTM: by way of degrees, point by point."""
    known = code.between(32601, 32660) | code.between(32701, 32760)

    def degrees(p):
        lon, lat = crs.utm_inverse(p["x"], p["y"], code % 100, code >= 32700)
        return F.named_struct(F.lit("x"), F.when(code == 4326, p["x"]).when(known, lon), F.lit("y"), F.when(code == 4326, p["y"]).when(known, lat))

    def metres(p):
        x, y = crs.utm(p["x"], p["y"], F.lit(target % 100), F.lit(target >= 32700))
        return F.named_struct(F.lit("x"), x, F.lit("y"), y)

    return F.when(code == target, ring).otherwise(F.transform(F.transform(ring, degrees), metres))


def interior_points(features: DataFrame, reference: dict) -> DataFrame:
    """features' rows with x and y (in the reference's system) of each pixel centre strictly inside, and k, its place (row-major, from 1).

    reference: epsg (UTM), x0, y0 (top left corner), width, height of a north-up 10 m grid.
    """
    target, x0, y0 = int(reference["epsg"]), float(reference["x0"]), float(reference["y0"])
    moved = features.where(F.size("rings") > 0).withColumn("__r", F.transform("rings", lambda r: _moved(r, F.col("epsg"), target)))
    flat = lambda axis: F.flatten(F.transform("__r", lambda r: F.transform(r, lambda p: p[axis])))
    ends = moved.select("feature", F.array_min(flat("x")).alias("w"), F.array_max(flat("x")).alias("e"), F.array_min(flat("y")).alias("s"), F.array_max(flat("y")).alias("n"))
    span = lambda low, high, most: F.sequence(F.greatest(F.lit(0), F.floor(low / 10)).cast("long"), F.least(F.lit(int(most) - 1), F.floor(high / 10)).cast("long"))
    inside = ends.where((F.col("e") > x0) & (F.col("w") < x0 + 10 * int(reference["width"])) & (F.col("n") > y0 - 10 * int(reference["height"])) & (F.col("s") < y0))
    cells = inside.withColumn("row", F.explode(span(y0 - F.col("n"), y0 - F.col("s"), reference["height"]))).withColumn("col", F.explode(span(F.col("w") - x0, F.col("e") - x0, reference["width"]))).select("feature", "row", "col")
    x, y = F.lit(x0) + (F.col("col") + 0.5) * 10, F.lit(y0) - (F.col("row") + 0.5) * 10
    met = cells.withColumn("x", x).withColumn("y", y).join(moved.select("feature", "__r"), "feature").where(geometry.rings_contain(F.col("__r"), F.col("x"), F.col("y")))
    from pyspark.sql import Window

    numbered = met.select("feature", "x", "y", F.row_number().over(Window.partitionBy("feature").orderBy("row", "col")).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("feature")).alias("n"))
    return features.join(numbered, "feature")


def to_points(features: DataFrame, mode: str = "auto", id_field: str | None = None, reference: dict | None = None) -> DataFrame:
    """sample_id, lon, lat, source_feature_id, source_geometry_type, point_method and properties.

    Points are themselves and several points several rows, numbered; polygons give their centroid, a point inside (auto and
    representative) or all pixel centres of the reference grid inside (interior_pixels). Null and empty shapes give no row.
    Systems other than WGS84 degrees and UTM are an error.
    """
    if mode not in ("auto", "representative", "centroid", "interior_pixels"):
        raise ValueError("mode has to be auto, representative, centroid or interior_pixels")
    if mode == "interior_pixels" and reference is None:
        raise ValueError("interior_pixels needs a reference grid")
    from gridlark.operators.store import padded

    field = id_field or "sample_id"
    ids = F.trim(F.try_element_at("properties", F.lit(field)))
    absent = ids.isNull() if id_field else F.lit(False)
    base = F.when(absent | (ids == ""), F.raise_error(F.lit("empty id"))).otherwise(F.coalesce(ids, F.concat(F.lit("feature_"), padded(F.col("feature"), 8))))
    area = geometry.rings_centroid(F.col("rings")) if mode == "centroid" else geometry.rings_representative(F.col("rings"))
    has_rings = F.size("rings") > 0
    kept = ["feature", "kind", "properties", "epsg"]
    rows = features.where(~has_rings) if mode == "interior_pixels" else features
    spots = F.when(has_rings, F.array(area)).otherwise(F.col("points"))
    method = F.when(has_rings, "centroid" if mode == "centroid" else "representative_point").otherwise("source_point")
    out = rows.select(*kept, method.alias("point_method"), F.size(spots).alias("__n"), F.posexplode(spots).alias("__k", "__p")).where(F.col("__p").isNotNull())
    out = out.select(*kept, "point_method", "__n", (F.col("__k") + 1).alias("__k"), F.col("__p.x").alias("__x"), F.col("__p.y").alias("__y"))
    if mode == "interior_pixels":
        pixels = interior_points(features, reference).select("feature", "kind", "properties", F.lit(int(reference["epsg"])).alias("epsg"), F.lit("interior_pixel").alias("point_method"), F.col("n").cast("int").alias("__n"), F.col("k").alias("__k"), F.col("x").alias("__x"), F.col("y").alias("__y"))
        out = out.unionByName(pixels)
    known = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)
    lon, lat = crs.utm_inverse(F.col("__x"), F.col("__y"), F.col("epsg") % 100, F.col("epsg") >= 32700)
    plain = F.coalesce(F.col("epsg") == 4326, F.lit(False))
    bad = F.raise_error(F.lit("unsupported coordinate system"))
    name = F.when(F.col("__n") > 1, F.concat(base, F.lit("__px"), padded(F.col("__k"), 6))).otherwise(base)
    return out.select(
        name.alias("sample_id"), F.when(plain, F.col("__x")).when(known, lon).otherwise(bad).alias("lon"), F.when(plain, F.col("__y")).when(known, lat).otherwise(bad).alias("lat"),
        (F.col("feature") - 1).cast("string").alias("source_feature_id"), F.col("kind").alias("source_geometry_type"), "point_method", "properties",
    )
