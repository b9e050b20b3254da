"""Reads across a catalogue of grids.

catalog: rows of (grid_id, epsg, x0, y0, width, height, years): north-up 10 m grids with their top left corner, UTM
codes, and the years they hold. pixels: rows of (grid_id, year, row, col, value). Points meet grids under the UTM codes
of their own zone and its neighbours and under equal buckets, so no join is a nested loop; grids reach into
neighbouring zones at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import crs, grid, vec
from gridlark.operators import cube
from gridlark.runtime import materialize

DEGREES = 4326


def lonlat(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    """Degrees of coordinates in WGS84 degrees or a UTM system."""
    if epsg == DEGREES:
        return x, y
    if not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError("unsupported coordinate system")
    return crs.utm_inverse(x, y, F.lit(epsg % 100), F.lit(epsg >= 32700))


def into(df: DataFrame, x: str, y: str, epsg: int, code: str = "epsg") -> DataFrame:
    """df with __px and __py: coordinates of one system in the UTM system that the code column names; those of the same system stay.

    Degrees are columns of their own, so that the long series are not written into each other.
    """
    same = F.col(code) == epsg
    # Rows that stay are null on the way: a branch around the series would keep generated code from computing shared parts once.
    out = df.withColumn("__sx", F.when(~same, F.col(x))).withColumn("__sy", F.when(~same, F.col(y)))
    lon, lat = lonlat(F.col("__sx"), F.col("__sy"), epsg)
    out = out.withColumn("__lon", lon).withColumn("__lat", lat)
    a, b = crs.utm(F.col("__lon"), F.col("__lat"), F.col(code) % 100, F.col(code) >= 32700)
    out = out.withColumn("__px", F.greatest(F.when(same, F.col(x)), a)).withColumn("__py", F.greatest(F.when(same, F.col(y)), b))
    return out.drop("__sx", "__sy", "__lon", "__lat")


def place(points: DataFrame, catalog: DataFrame, key: str, x: str = "lon", y: str = "lat", epsg: int = DEGREES, span: float = 110_000.0) -> DataFrame:
    """key, grid_id, row and col for every grid that holds a point."""
    zone = grid.utm_zone(lonlat(F.col(x), F.col(y), epsg)[0])
    ok = vec.is_finite(F.col(x)) & vec.is_finite(F.col(y))
    rows = points.where(ok).select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), zone.alias("__z"))
    codes = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.array(F.lit(32600), F.lit(32700)), lambda base: (base + F.pmod(F.col("__z") - 1 + d, F.lit(60)) + 1).cast("int"))))
    rows = rows.select(key, "__x", "__y", F.explode(codes).alias("epsg"))
    rows = rows.join(F.broadcast(catalog.select("epsg").distinct()), "epsg", "left_semi")  # 120 codes at most
    cell = lambda c: F.floor(c / span)
    rows = into(rows, "__x", "__y", epsg).select(key, "epsg", "__px", "__py").withColumn("__bx", cell(F.col("__px"))).withColumn("__by", cell(F.col("__py")))
    g = catalog.select("grid_id", "epsg", "x0", "y0", "width", "height")
    g = g.withColumn("__bx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x0") + 10 * F.col("width")))))
    g = g.withColumn("__by", F.explode(F.sequence(cell(F.col("y0") - 10 * F.col("height")), cell(F.col("y0")))))
    met = rows.join(g, ["epsg", "__bx", "__by"])
    met = met.withColumn("row", grid.pixel(F.col("__py"), F.col("y0"), -grid.RESOLUTION)).withColumn("col", grid.pixel(F.col("__px"), F.col("x0"), grid.RESOLUTION))
    return met.where((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))).select(key, "grid_id", "row", "col")


def route(points: DataFrame, catalog: DataFrame, key: str, x: str = "lon", y: str = "lat", epsg: int = DEGREES, ids: str | None = None) -> DataFrame:
    """key, grid_id, row and col: the first grid by id that holds each point, or the grid that the `ids` column names.

    A point that no grid holds, or whose id is null, has null grid_id. An id that the catalogue lacks is an error. A given grid
    need not hold its point: row and col may lie outside.
    """
    if ids is None:
        first = place(points, catalog, key, x, y, epsg).groupBy(key).agg(F.min(F.struct("grid_id", "row", "col")).alias("__b"))
        return points.select(key).join(first, key, "left").select(key, "__b.grid_id", "__b.row", "__b.col")
    g = catalog.select("grid_id", "epsg", "x0", "y0")
    asked = points.select(key, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(ids).cast("string").alias("grid_id"))
    met = asked.join(g, "grid_id", "left")
    known = F.when(F.col("grid_id").isNotNull() & F.col("epsg").isNull(), F.raise_error(F.concat(F.lit("unknown grid: "), "grid_id"))).otherwise(F.col("grid_id"))
    met = into(met, "__x", "__y", epsg)
    return met.select(key, known.alias("grid_id"), grid.pixel(F.col("__py"), F.col("y0"), -grid.RESOLUTION).alias("row"), grid.pixel(F.col("__px"), F.col("x0"), grid.RESOLUTION).alias("col"))


def requested_years(catalog: DataFrame, years: list[int] | None) -> list[int]:
    """The years asked for, in their order, else those of the first grid by id."""
    return list(years) if years is not None else list(catalog.orderBy("grid_id").select("years").first()["years"])


def _by_year(placed: DataFrame, catalog: DataFrame, years: list[int] | None) -> DataFrame:
    """placed for every year asked for; a year that a point's grid lacks is an error."""
    wanted = F.explode(F.array(*[F.lit(int(n)) for n in requested_years(catalog, years)])).alias("year")
    held = catalog.select("grid_id", F.col("years").alias("__years"))
    rows = placed.join(held, "grid_id", "left").select(*placed.columns, "__years", wanted)
    lacks = F.col("__years").isNotNull() & ~F.array_contains("__years", F.col("year"))
    return rows.withColumn("year", F.when(lacks, F.raise_error(F.concat(F.lit("no such year in "), "grid_id"))).otherwise(F.col("year"))).drop("__years")


def sample(points: DataFrame, catalog: DataFrame, pixels: DataFrame, key: str, years: list[int] | None = None, ids: str | None = None, x: str = "lon", y: str = "lat", epsg: int = DEGREES, value: str = "embedding") -> DataFrame:
    """key, year, grid_id and value of each point's pixel; null where no grid or pixel is."""
    placed = _by_year(route(points, catalog, key, x, y, epsg, ids), catalog, years)
    return placed.join(pixels.select("grid_id", "year", "row", "col", value), ["grid_id", "year", "row", "col"], "left").select(key, "year", "grid_id", value)


def patches(points: DataFrame, catalog: DataFrame, pixels: DataFrame, key: str, size: int, years: list[int] | None = None, ids: str | None = None, x: str = "lon", y: str = "lat", epsg: int = DEGREES, value: str = "embedding") -> DataFrame:
    """key, year, grid_id and patch: size x size values of the point's own grid, row-major, null where it has no pixel.

    Nothing is stitched: a neighbouring grid's pixels do not fill a seam. Points and pixels meet under squares of the
    patch's size, of which a patch touches four at most, so a point gives four rows and not one a pixel.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("patch size must be a positive odd number")
    placed = _by_year(materialize(route(points, catalog, key, x, y, epsg, ids)), catalog, years)  # slim, and used twice
    inside = placed.where(F.col("grid_id").isNotNull())
    held = cube.patch_values(inside, pixels.select("grid_id", "year", "row", "col", value), [key, "year"], ["grid_id", "year"], size, value)
    return placed.select(key, "year", "grid_id").join(held, [key, "year"], "left").select(key, "year", "grid_id", cube.unfolded(size, dict(pixels.dtypes)[value]).alias("patch"))


def patch_quality(patches: DataFrame, key: str, size: int) -> DataFrame:
    """key, patch_valid_fraction and patch_complete over all years, bands and pixels of vector patches."""
    finite = F.aggregate("patch", F.lit(0), lambda n, v: n + F.coalesce(F.size(F.filter(v, vec.is_finite)), F.lit(0)))
    share = F.sum(finite) / (F.count(F.lit(1)) * float(vec.BANDS * size * size))
    return patches.groupBy(key).agg(share.alias("patch_valid_fraction")).withColumn("patch_complete", F.col("patch_valid_fraction") == 1.0)


def _chosen(catalog: DataFrame, grid_ids: list[str] | None) -> DataFrame:
    if grid_ids is None:
        return catalog
    found = {r[0] for r in catalog.where(F.col("grid_id").isin(grid_ids)).select("grid_id").collect()}  # the caller's list at most
    if unknown := [g for g in grid_ids if g not in found]:
        raise KeyError(f"unknown grids: {unknown[:5]}")
    return catalog.where(F.col("grid_id").isin(grid_ids))


def open_grid(catalog: DataFrame, pixels: DataFrame, grid_id: str) -> DataFrame:
    """The pixels of one grid; an unknown id is an error."""
    _chosen(catalog, [grid_id])
    return pixels.where(F.col("grid_id") == grid_id)


def read_window(catalog: DataFrame, pixels: DataFrame, grid_id: str, r0: int, r1: int, c0: int, c1: int, years: list[int] | None = None) -> DataFrame:
    """Pixels of rows [r0, r1) and columns [c0, c1) of one grid and some years; numbers are relative to the window."""
    if r1 < max(0, r0) or c1 < max(0, c0):
        raise ValueError("window stops before it starts")
    r0, c0 = max(0, r0), max(0, c0)
    out = open_grid(catalog, pixels, grid_id).where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    out = out if years is None else out.where(F.col("year").isin([int(n) for n in years]))
    return out.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)


def bbox_windows(catalog: DataFrame, bounds: tuple[float, float, float, float], epsg: int = DEGREES, grid_ids: list[str] | None = None) -> DataFrame:
    """grid_id, r0, r1, c0, c1 and the window's corner (x0, y0) of each grid that a box (west, south, east, north) meets.

    The box's four corners are projected into each grid's system; a box without area, or values that are not finite, is an error.
    """
    west, south, east, north = map(float, bounds)
    if not all(map(math.isfinite, (west, south, east, north))) or not (west < east and south < north):
        raise ValueError("a box needs finite values, west below east and south below north")
    spots = [(a, b) for a in (west, east) for b in (south, north)]
    out = _chosen(catalog, grid_ids).select("grid_id", "epsg", "x0", "y0", "width", "height")
    out = out.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in spots])).alias("__c")).select("*", F.col("__c.x").alias("__x"), F.col("__c.y").alias("__y"))
    of = ["grid_id", "x0", "y0", "width", "height"]
    out = into(out, "__x", "__y", epsg).groupBy(*of).agg(F.min("__px").alias("__w"), F.max("__px").alias("__e"), F.min("__py").alias("__s"), F.max("__py").alias("__n"))
    edge = lambda c, low, most: F.greatest(F.lit(0), F.least(F.col(most).cast("long"), (F.floor(c) if low else F.ceil(c)).cast("long")))
    out = out.select(
        "grid_id", "x0", "y0",
        edge((F.col("y0") - F.col("__n")) / 10, True, "height").alias("r0"), edge((F.col("y0") - F.col("__s")) / 10, False, "height").alias("r1"),
        edge((F.col("__w") - F.col("x0")) / 10, True, "width").alias("c0"), edge((F.col("__e") - F.col("x0")) / 10, False, "width").alias("c1"),
    )
    return out.where("r0 < r1 AND c0 < c1").select("grid_id", "r0", "r1", "c0", "c1", (F.col("x0") + 10 * F.col("c0")).alias("x0"), (F.col("y0") - 10 * F.col("r0")).alias("y0"))


def read_bbox(catalog: DataFrame, pixels: DataFrame, bounds: tuple[float, float, float, float], epsg: int = DEGREES, years: list[int] | None = None, grid_ids: list[str] | None = None) -> DataFrame:
    """Pixels of every grid's window on a box, with window numbers of rows and columns; grids are not reprojected or merged."""
    w = bbox_windows(catalog, bounds, epsg, grid_ids).select("grid_id", "r0", "r1", "c0", "c1")
    rows = pixels if years is None else pixels.where(F.col("year").isin([int(n) for n in years]))
    met = rows.join(w, "grid_id").where("row >= r0 AND row < r1 AND col >= c0 AND col < c1")
    return met.withColumn("row", F.col("row") - F.col("r0")).withColumn("col", F.col("col") - F.col("c0")).select(*pixels.columns)
