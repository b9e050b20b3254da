"""Sources: tables and vector files by suffix, catalogues, fingerprints, areas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources import vectors

#: Suffixes of point sources.
SUFFIXES = (".csv", ".parquet", ".geojson", ".json", ".shp", ".gpkg")


def read_points(spark: SparkSession, path: str, id_field: str | None = None, most: int | None = None, layer: str | None = None, mode: str = "auto", reference: dict | None = None) -> DataFrame:
    """A point table with sample_id, lon, lat and what else the file has.

    `most` is a guard: a longer table is an error, not cut. layer, mode and reference are for vector files (Shapefile,
    GeoPackage, GeoJSON, and Parquet with a WKB `geometry` column but no lon and lat): their areas become points inside (auto,
    representative), centroids, or the centres of a reference grid's pixels inside (interior_pixels).
    """
    low = path.lower()
    vector = None
    if low.endswith((".shp", ".gpkg")):
        vector = vectors.read_features(spark, path, layer)
    elif low.endswith((".geojson", ".json")):
        vector = vectors.read_geojson(spark, path)
    elif low.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
        if not {"lon", "lat"} <= set(df.columns) and "geometry" in df.columns:
            vector = vectors.from_wkb(df, epsg=geoparquet_epsg(spark, path))
    else:
        raise ValueError(f"unsupported point source; use one of {', '.join(SUFFIXES)}")
    if vector is not None:
        df = vectors.to_points(vector, mode, id_field, reference).withColumn("source_path", F.lit(path))
        if df.isEmpty():
            raise ValueError(f"no usable point or polygon in {path}")
    elif id_field:
        df = df.withColumn("sample_id", F.col(id_field).cast("string"))
    if missing := {"sample_id", "lon", "lat"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} points")
    name = F.trim(F.col("sample_id").cast("string"))
    if id_field:
        name = F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("empty id"))).otherwise(name)
    return df.withColumn("sample_id", name).withColumn("lon", F.col("lon").try_cast("double")).withColumn("lat", F.col("lat").try_cast("double"))


def read_catalog(df: DataFrame, key: str = "grid_id") -> DataFrame:
    """Complete grids of a catalogue; none, or a repeated id, is an error."""
    out = df.where(F.col("status") == "complete")
    n, d = out.agg(F.count(F.lit(1)), F.countDistinct(key)).collect()[0]
    if n == 0:
        raise ValueError("catalogue has no complete grid")
    if n != d:
        raise ValueError("catalogue repeats a grid id")
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """Name, size and modification time of each file that a file-based table reads."""
    return df.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def assert_unchanged(before: DataFrame, df: DataFrame) -> None:
    """Error where the files of df are no longer those of an earlier fingerprint."""
    now = fingerprint(df)
    moved = before.exceptAll(now).unionByName(now.exceptAll(before)).limit(5).collect()
    if moved:
        raise ValueError(f"the source changed: {sorted({r[0] for r in moved})}")


def load_catalogs(spark: SparkSession, root: str, supplements: list[str] | None = None) -> DataFrame:
    """The root catalogue and its supplements as one; columns that one lacks are null.

    Without a list, supplements are the catalog.parquet of every folder beside the root catalogue.
    """
    out = spark.read.parquet(root)
    if supplements is None:
        supplements = list_paths(spark, f"{root.rstrip('/').rpartition('/')[0]}/*/catalog.parquet")
    for path in supplements:
        out = out.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return out


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths that a pattern names, on whatever file system Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(str(s.getPath()) for s in at.getFileSystem(conf).globStatus(at) or [])


def resolve_shards(catalog: DataFrame, catalog_path: str) -> DataFrame:
    """A shard catalogue in shard order, with relative paths made relative to its own folder. order is the rows' place, from 1."""
    folder = catalog_path.rstrip("/").rpartition("/")[0]
    full = F.when(F.col("path").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?/"), F.col("path")).otherwise(F.concat(F.lit(folder + "/"), "path"))
    from pyspark.sql import Window

    by = "chunk" if "chunk" in catalog.columns else "path"
    return catalog.withColumn("path", full).withColumn("order", F.row_number().over(Window.orderBy(by, "path")))  # one row a shard


def read_shards(spark: SparkSession, catalog_path: str, columns: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """All shards of a catalogue as one table with their order; a shard that is not there is an error. Rows sort by order."""
    from gridlark.operators import store

    listed = resolve_shards(spark.read.parquet(catalog_path), catalog_path).select("order", "path").orderBy("order").collect()
    if gone := [r.path for r in listed if not list_paths(spark, r.path)]:
        raise FileNotFoundError(f"missing shards: {gone[:5]}")
    out = None
    for r in listed:
        part = spark.read.parquet(r.path).withColumn("shard_order", F.lit(r.order))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if columns is None and years is None else store.project(out, ["shard_order", *(columns or [])], years)


def batches(df: DataFrame, size: int = 10_000):
    """Rows as pandas frames of at most `size` rows, one task's at a time."""
    rows = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def source_listing(sources: DataFrame, year: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Sources (id, start, end, west, south, east, north) of a calendar year that meet a box, by id."""
    west, south, east, north = bounds
    inside = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    begin, end = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")
    return sources.where((F.col("start") >= begin) & (F.col("start") < end) & inside)


def discover(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, length and modification time of files below a folder, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", "length", "modificationTime").where(~F.col("path").rlike(r"/\.[^/]*(/|$)"))


def parquet_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value metadata of a Parquet file's footer (a folder's first file), read as Spark reads files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [p for p in (list_paths(spark, f"{path}/*.parquet") or [path])]
    entry = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(entry)
    try:
        return dict(reader.getFileMetaData().getKeyValueMetaData())
    finally:
        reader.close()


def is_geoparquet(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet footer has the key of GeoParquet."""
    return "geo" in parquet_metadata(spark, path)


def geoparquet_epsg(spark: SparkSession, path: str) -> int | None:
    """The coordinate system of a GeoParquet file's main geometry: degrees where the footer names none, null without a footer key."""
    import json

    text = parquet_metadata(spark, path).get("geo")
    if text is None:
        return None
    geo = json.loads(text)
    system = geo.get("columns", {}).get(geo.get("primary_column", "geometry"), {}).get("crs", {})
    code = (system or {}).get("id", {}).get("code")
    return int(code) if str(code).isdigit() else 4326


def wkb_points(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """df with lon and lat of WKB points, null for null and empty geometries; other types are an error."""
    import struct

    @F.pandas_udf("lon double, lat double")
    def parse(blobs: pd.Series) -> pd.DataFrame:
        out = []
        for b in blobs:
            if b is None:
                out.append((None, None))
                continue
            order = "<" if b[0] == 1 else ">"
            if struct.unpack_from(order + "I", b, 1)[0] % 1000 != 1:
                raise ValueError("only points")
            x, y = struct.unpack_from(order + "dd", b, 5)
            out.append((None, None) if x != x else (x, y))
        return pd.DataFrame(out, columns=["lon", "lat"], dtype="float64")

    return df.withColumn("__p", parse(geometry)).withColumns({"lon": F.nanvl("__p.lon", F.lit(None)), "lat": F.nanvl("__p.lat", F.lit(None))}).drop("__p")


#: Names that mean WGS84 degrees.
CRS_NAMES = ("epsg:4326", "urn:ogc:def:crs:epsg::4326", "crs84", "ogc:crs84", "urn:ogc:def:crs:ogc:1.3:crs84")
_SYSTEM = "crs struct<properties: struct<name: string>>"
_SHAPE = f"struct<type: string, coordinates: string, {_SYSTEM}>"
_FEATURE = f"struct<type: string, properties: map<string, string>, geometry: {_SHAPE}, {_SYSTEM}>"


def parse_areas(texts: DataFrame, column: str = "value") -> DataFrame:
    """properties and polygons (lists of rings, holes included, without closing corners) of every area of GeoJSON texts.

    A text is a collection, a feature or a bare geometry. Anything but closed, finite rings of WGS84 polygons in
    range is an error, and so is a text without areas.
    """
    stop = lambda test, reason, value: F.when(test, F.raise_error(F.lit(reason))).otherwise(value)
    doc = F.from_json(column, f"type string, features array<{_FEATURE}>, properties map<string, string>, geometry {_SHAPE}, coordinates string, {_SYSTEM}")
    d = texts.select(doc.alias("d"))
    bare = F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates"), F.col("d.crs").alias("crs"))
    one = F.struct(F.lit("Feature").alias("type"), F.col("d.properties").alias("properties"), F.when(F.col("d.type") == "Feature", F.col("d.geometry")).otherwise(bare).alias("geometry"), F.col("d.crs").alias("crs"))
    listed = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array(one))
    listed = stop(F.coalesce(F.size(listed), F.lit(0)) == 0, "no areas", listed)
    f = d.select(F.col("d.crs.properties.name").alias("c0"), F.explode(listed).alias("f"))
    names = F.array("c0", "f.crs.properties.name", "f.geometry.crs.properties.name")
    foreign = F.exists(names, lambda n: n.isNotNull() & ~F.lower(n).isin(*CRS_NAMES))
    kind = F.coalesce(F.col("f.geometry.type"), F.lit(""))
    four = F.when(kind == "Polygon", F.concat(F.lit("["), "f.geometry.coordinates", F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    f = f.select(stop(foreign, "coordinates have to be WGS84 degrees", F.col("f")).alias("f"), stop(~kind.isin("Polygon", "MultiPolygon"), "only polygons", F.from_json(four, "array<array<array<array<double>>>>")).alias("p"))
    number = lambda v, most: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most)
    corner = lambda c: F.coalesce((F.size(c) > 1) & number(F.get(c, 0), 180.0) & number(F.get(c, 1), 90.0), F.lit(False))
    closed = lambda r: (F.size(r) >= 4) & (F.slice(F.element_at(r, 1), 1, 2) == F.slice(F.element_at(r, -1), 1, 2))
    rings = F.flatten("p")
    hollow = F.col("p").isNull() | (F.size("p") == 0) | F.exists("p", lambda s: F.coalesce(F.size(s), F.lit(0)) == 0)
    loose = F.exists(rings, lambda r: ~F.coalesce(F.when(F.size(r) >= 4, closed(r)), F.lit(False)))
    wild = F.exists(rings, lambda r: F.exists(r, lambda c: ~corner(c)))
    point = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    polygons = F.transform("p", lambda s: F.transform(s, lambda r: F.transform(F.slice(r, 1, F.size(r) - 1), point)))
    checked = F.when(hollow, F.raise_error(F.lit("an area needs an outer ring"))).when(loose, F.raise_error(F.lit("a ring needs four corners at least and has to be closed"))).when(wild, F.raise_error(F.lit("coordinates have to be finite degrees in range"))).otherwise(polygons)
    return f.select(F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"), checked.alias("polygons"))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """parse_areas of GeoJSON files, one row of text a file."""
    return parse_areas(spark.read.text(path, wholetext=True))


def request_area(bounds: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The ring (counter-clockwise) of a box of degrees (west, south, east, north) that a request may ask for.

    Values that are not finite or out of range, a box without area and one of more than 180 degrees (as across the antimeridian) are errors.
    """
    import math

    west, south, east, north = map(float, bounds)
    if not all(map(math.isfinite, (west, south, east, north))):
        raise ValueError("a box needs finite values")
    if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
        raise ValueError("a box needs degrees in range, west below east and south below north")
    if east - west > 180:
        raise ValueError("a box spans 180 degrees at most; cut it at the antimeridian")
    return [(west, south), (east, south), (east, north), (west, north)]
