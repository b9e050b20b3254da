"""Grid contracts: rows of (scheme, grid_id, epsg, x0, y0, width, height), north-up at 10 m, from cells, boxes, tile indexes and references."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import crs, grid, vec

XY = "array<struct<x: double, y: double>>"
#: Names of the schemes.
CELLS, TILES, REFERENCE = "tessera_0p1", "mgrs", "reference"


def _contract(df: DataFrame, scheme: str, xs: list[Column], ys: list[Column]) -> DataFrame:
    """Contract of the box around projected corners, widened to whole pixels. df has grid_id and epsg."""
    a, b = grid.snapped(F.least(*xs) if len(xs) > 1 else xs[0], F.greatest(*xs) if len(xs) > 1 else xs[0])
    c, d = grid.snapped(F.least(*ys) if len(ys) > 1 else ys[0], F.greatest(*ys) if len(ys) > 1 else ys[0])
    out = df.withColumns({"__a": a.cast("double"), "__b": b.cast("double"), "__c": c.cast("double"), "__d": d.cast("double")})
    size = lambda low, high: F.round((F.col(high) - F.col(low)) / grid.RESOLUTION).cast("long")
    return out.withColumns({"scheme": F.lit(scheme), "x0": F.col("__a"), "y0": F.col("__d"), "width": size("__a", "__b"), "height": size("__c", "__d")}).drop("__a", "__b", "__c", "__d")


def cell_grids(cells: DataFrame, lon: str = "lon", lat: str = "lat", centres: bool = False) -> DataFrame:
    """Contract of the 0.1 degree cell of each row's point: grid_id, scheme, epsg, centre_lon, centre_lat, x0, y0, width, height.

    centres: the coordinates are cells' centres; any that is none is an error.
    """
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    if centres:
        x, y = F.round(x, 2), F.round(y, 2)
    cx, cy = grid.cell_centre(x), grid.cell_centre(y)
    bad = ~grid.in_range(x, y)
    if centres:
        bad = bad | (F.abs(cx - x) > 1e-9) | (F.abs(cy - y) > 1e-9)
    out = cells.withColumn("centre_lon", F.when(bad, F.raise_error(F.lit("not a cell's coordinates"))).otherwise(cx)).withColumn("centre_lat", cy)
    lon_, lat_ = F.col("centre_lon"), F.col("centre_lat")
    out = out.withColumn("grid_id", F.format_string("grid_%.2f_%.2f", lon_, lat_)).withColumn("epsg", grid.utm_epsg(lon_, lat_))
    zone, south = F.col("epsg") % 100, F.col("epsg") >= 32700
    corners = [crs.utm(lon_ + dx, lat_ + dy, zone, south) for dx in (-0.05, 0.05) for dy in (-0.05, 0.05)]
    return _contract(out, CELLS, [c[0] for c in corners], [c[1] for c in corners])


def grids_of_box(spark: SparkSession, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Contracts of all 0.1 degree cells that a box (west, south, east, north) reaches into."""
    west, south, east, north = map(float, bounds)
    if not (west < east and south < north):
        raise ValueError("a box needs west below east and south below north")
    ix, iy = math.floor(west * 10), math.floor(south * 10)
    across, down = math.ceil(east * 10) - ix, math.ceil(north * 10) - iy
    n = spark.range(across * down)
    centre = lambda i: F.round((i + F.lit(0.5)) / 10, 2)
    cells = n.select(centre(F.lit(ix) + F.floor(F.col("id") / down)).alias("lon"), centre(F.lit(iy) + F.col("id") % down).alias("lat"))
    return cell_grids(cells, centres=True).drop("lon", "lat")


def wkt_ring(wkt: Column) -> Column:
    """Corners of a WKT polygon's rings, one after the other."""
    number = lambda k: F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(k))
    return F.zip_with(number(1), number(2), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def tile_grids(index: DataFrame, ids: list[str]) -> DataFrame:
    """Contracts of the tiles asked for, with request_order. index: mgrs_tile_id, utm_epsg, utm_wkt. Unknown or repeated ids are an error.

    The ids are literals of the plan, so that the scan can use them.
    """
    wanted = [i.strip().upper() for i in ids]
    if not wanted or len(set(wanted)) != len(wanted):
        raise ValueError("ids have to be distinct, and one at least")
    if missing := {"mgrs_tile_id", "utm_epsg", "utm_wkt"} - set(index.columns):
        raise ValueError(f"the tile index lacks {sorted(missing)}")
    rows = index.where(F.col("mgrs_tile_id").isin(wanted))
    found = {r[0] for r in rows.select("mgrs_tile_id").collect()}  # the caller's list at most
    if unknown := sorted(set(wanted) - found):
        raise ValueError(f"unknown tiles: {unknown}")
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col("mgrs_tile_id")).cast("int") - 1
    ring = wkt_ring(F.col("utm_wkt"))
    out = rows.select(F.col("mgrs_tile_id").alias("grid_id"), F.col("utm_epsg").cast("int").alias("epsg"), order.alias("request_order"), ring.alias("__ring"))
    reach = lambda axis, f: f(F.transform("__ring", lambda p: p[axis]))
    return _contract(out, TILES, [reach("x", F.array_min), reach("x", F.array_max)], [reach("y", F.array_min), reach("y", F.array_max)]).drop("__ring")


def tile_areas(index: DataFrame) -> DataFrame:
    """The tile index with ring: each tile's corners in WGS84 degrees, counter-clockwise, without the closing one."""
    ring = wkt_ring(F.col("utm_wkt"))
    open_ring = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    zone, south = F.col("utm_epsg") % 100, F.col("utm_epsg") >= 32700

    def degrees(p):
        lon, lat = crs.utm_inverse(p["x"], p["y"], zone, south)
        return F.struct(lon.alias("x"), lat.alias("y"))

    from gridlark.operators import geometry

    out = index.withColumn("ring", F.transform(open_ring, degrees))
    return out.withColumn("ring", F.when(geometry.signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")))


def contract_errors(specs: DataFrame) -> DataFrame:
    """grid_id and reason (null: sound) of contracts (grid_id, epsg, a, b, c, d, e, f, width, height, west, south, east, north)."""
    v = lambda c: F.col(c).cast("double")
    near = lambda x, y: F.abs(x - y) <= 1e-6
    metres = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)
    bounds = near(v("west"), v("c")) & near(v("south"), v("f") + v("height") * v("e")) & near(v("east"), v("c") + v("width") * v("a")) & near(v("north"), v("f"))
    rules = [
        ("no projected metre system", ~F.coalesce(metres, F.lit(False))),
        ("width and height must be positive", (F.col("width") <= 0) | (F.col("height") <= 0)),
        ("rotated or sheared", (v("b") != 0) | (v("d") != 0)),
        ("resolution must be 10 m", ~(near(F.abs(v("a")), F.lit(grid.RESOLUTION)) & near(F.abs(v("e")), F.lit(grid.RESOLUTION)))),
        ("not north-up", (v("a") <= 0) | (v("e") >= 0)),
        ("bounds differ from transform and size", ~bounds),
    ]
    return specs.select("grid_id", F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(reason)) for reason, test in rules]).alias("reason"))


def selection(index: DataFrame, tiles: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Contracts of a list of tiles or of a box's cells: exactly one of the two has to be given."""
    if (tiles is None) == (bbox is None):
        raise ValueError("give either tiles or a box")
    return tile_grids(index, tiles) if tiles is not None else grids_of_box(index.sparkSession, bbox)


def output_name(grid_id: Column, years: Column) -> Column:
    """Path of a grid's store below the output folder, by its id and its first and last year."""
    return F.concat(grid_id, F.lit(f"/{vec.PREFIX}_"), grid_id, F.lit("_"), F.array_min(years).cast("string"), F.lit("_"), F.array_max(years).cast("string"))


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of reference grids from JSON files {grid_id, epsg, transform, width, height}; unsound ones are an error."""
    raw = spark.read.schema("grid_id string, epsg int, transform array<double>, width long, height long").option("multiLine", True).json(path)
    t = {n: F.col("transform")[k].alias(n) for k, n in enumerate("abcdef")}
    out = raw.select(F.lit(REFERENCE).alias("scheme"), "grid_id", "epsg", *t.values(), "width", "height")
    out = out.withColumns({"west": F.col("c"), "north": F.col("f"), "east": F.col("c") + F.col("width") * F.col("a"), "south": F.col("f") + F.col("height") * F.col("e")})
    bad = contract_errors(out).where("reason is not null").withColumnRenamed("grid_id", "__id")
    checked = out.join(bad, F.col("grid_id").eqNullSafe(F.col("__id")), "left")
    fine = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat_ws(": ", "grid_id", "reason"))).otherwise(F.col("grid_id"))
    return checked.select("scheme", fine.alias("grid_id"), "epsg", F.col("c").alias("x0"), F.col("f").alias("y0"), "width", "height")


def zarr_headers(spark: SparkSession, root: str) -> DataFrame:
    """path, shape, data type and attributes of every array and group below a folder that has a zarr.json; chunks are not read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "zarr.json").text(root, wholetext=True)
    meta = F.from_json("value", "node_type string, shape array<long>, data_type string, attributes map<string,string>")
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "/zarr.json$", "").alias("path"), meta.alias("m")).select("path", "m.*")
