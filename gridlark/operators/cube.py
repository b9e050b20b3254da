"""Reads of pixel tables: rows of (tile, row, col, year?, embedding) with a north-up transform.

Lookups are equi-joins on derived pixel numbers, range joins are bucketed first, so none is a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import grid
from gridlark.operators import buckets

CHUNK = 64


def locate(points: DataFrame, x: str, y: str, x0: float, y0: float, step: float = grid.RESOLUTION) -> DataFrame:
    """points with row and col of a north-up grid; null where not finite."""
    return points.withColumn("row", grid.pixel(F.col(y), F.lit(float(y0)), -step)).withColumn("col", grid.pixel(F.col(x), F.lit(float(x0)), step))


def contains(points: DataFrame, height: int, width: int) -> Column:
    del points
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    return F.coalesce(inside, F.lit(False))


def sample_points(points: DataFrame, pixels: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Every point with its pixel's vector, null outside."""
    return points.join(pixels, list(keys), "left")


def window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Pixels of [r0, r1) x [c0, c1), starts clamped to 0; numbers are relative to the window."""
    r0, c0 = max(0, r0), max(0, c0)
    if r1 < r0 or c1 < c0:
        raise ValueError("window stops before it starts")
    inside = pixels.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return inside.withColumn("row", F.col("row") - r0).withColumn("col", F.col("col") - c0)


def bbox_window(x0: float, y0: float, bounds: tuple[float, float, float, float], step: float = grid.RESOLUTION) -> tuple[int, int, int, int]:
    """Rows and columns that a box (west, south, east, north) in the grid's system touches."""
    import math

    west, south, east, north = bounds
    if not (west < east and south < north):
        raise ValueError("box has no area")
    return math.floor((y0 - north) / step), math.ceil((y0 - south) / step), math.floor((west - x0) / step), math.ceil((east - x0) / step)


def patches(points: DataFrame, pixels: DataFrame, key: str, size: int, value: str, within: tuple[str, ...] = ()) -> DataFrame:
    """key, n_filled and patch: size x size values around each located point, row-major, null where no pixel is.

    within: columns of both sides, such as a tile's id, beyond which a patch does not reach.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("patch size must be a positive odd number")
    placed = points.select(key, *within, "row", "col")
    held = patch_values(placed, pixels.select(*within, "row", "col", value), [key], list(within), size, value)
    kind = dict(pixels.dtypes)[value]
    return placed.select(key).distinct().join(held, key, "left").select(key, F.coalesce(F.size(F.filter(F.map_values("__m"), lambda v: v.isNotNull())), F.lit(0)).cast("long").alias("n_filled"), unfolded(size, kind).alias("patch"))


def patch_values(placed: DataFrame, pixels: DataFrame, by: list[str], within: list[str], size: int, value: str) -> DataFrame:
    """by and __m: each patch's values by their place in it (row-major, from 0).

    Patches and pixels meet under squares of the patch's size, of which a patch touches four at most: a point gives four
    rows, not one a pixel, and every pixel one.
    """
    half = size // 2
    square = lambda c: F.floor(c / size).cast("long")
    spread = lambda c: F.explode(F.sequence(square(F.col(c) - half), square(F.col(c) + half)))
    near = placed.where(F.col("row").isNotNull() & F.col("col").isNotNull()).withColumn("__sr", spread("row")).withColumn("__sc", spread("col"))
    cells = pixels.select(*within, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v")).withColumn("__sr", square(F.col("__r"))).withColumn("__sc", square(F.col("__c")))
    dr, dc = F.col("__r") - F.col("row") + half, F.col("__c") - F.col("col") + half
    met = near.join(cells, [*within, "__sr", "__sc"]).where(dr.between(0, size - 1) & dc.between(0, size - 1))
    return met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((dr * size + dc).cast("int").alias("k"), F.col("__v").alias("v")))).alias("__m"))


def unfolded(size: int, kind: str) -> Column:
    """The whole patch of patch_values, null where there is no value."""
    held = F.coalesce("__m", F.create_map().cast(f"map<int,{kind}>"))
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at(held, k))


def patch_quality(patches: DataFrame, size: int) -> DataFrame:
    """patches with patch_valid_fraction and patch_complete."""
    return patches.withColumn("patch_valid_fraction", F.col("n_filled") / float(size * size)).withColumn("patch_complete", F.col("n_filled") == size * size)


def _bucketed(points: DataFrame, boxes: DataFrame, x: str, y: str, span: float, closed: bool = False) -> DataFrame:
    """Pairs of points and the boxes (x0, x1, y0, y1, grid_id) that hold them, by equal buckets; half-open or closed."""
    dealt = buckets.boxes(boxes, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), span)
    met = buckets.points(points, F.col(x), F.col(y), span, buckets.levels(dealt)).join(dealt, buckets.KEYS)
    below = lambda a, b: F.col(a) <= F.col(b) if closed else F.col(a) < F.col(b)
    return met.where((F.col(x) >= F.col("x0")) & below(x, "x1") & (F.col(y) >= F.col("y0")) & below(y, "y1")).drop(*buckets.KEYS)


def route_first(points: DataFrame, boxes: DataFrame, key: str, x: str = "lon", y: str = "lat", span: float = 10.0) -> DataFrame:
    """key and the first grid (ascending id) that holds each point, null where none does."""
    hit = _bucketed(points, boxes, x, y, span).groupBy(key).agg(F.min("grid_id").alias("grid_id"))
    return points.select(key).join(hit, key, "left")


def choose_grid(points: DataFrame, boxes: DataFrame, key: str, x: str = "lon", y: str = "lat", span: float = 10.0) -> DataFrame:
    """key, grid_id and margin of the covering grid whose boundary is farthest; points on a boundary count; ties: smallest id."""
    met = _bucketed(points, boxes, x, y, span, closed=True)
    margin = F.least(F.col(x) - F.col("x0"), F.col("x1") - F.col(x), F.col(y) - F.col("y0"), F.col("y1") - F.col(y))
    best = met.withColumn("__m", margin).groupBy(key).agg(F.min(F.struct((-F.col("__m")).alias("m"), "grid_id")).alias("b"))
    return best.select(key, F.col("b.grid_id").alias("grid_id"), (-F.col("b.m")).alias("margin"))


def near_any(left: DataFrame, right: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """key of left rows with a right row closer than radius, and the least distance, by 3 x 3 buckets."""
    cell = lambda c: F.floor(c / radius)
    around = F.sequence(F.lit(-1), F.lit(1))
    r = right.select(F.col(x).alias("__x"), F.col(y).alias("__y")).distinct()
    r = r.withColumn("__bx", F.explode(F.transform(around, lambda d: cell(F.col("__x")) + d))).withColumn("__by", F.explode(F.transform(around, lambda d: cell(F.col("__y")) + d)))
    met = left.withColumn("__bx", cell(F.col(x))).withColumn("__by", cell(F.col(y))).join(r, ["__bx", "__by"])
    d = F.hypot(F.col(x) - F.col("__x"), F.col(y) - F.col("__y"))
    return met.withColumn("__d", d).where(F.col("__d") < radius).groupBy(key).agg(F.min("__d").alias("distance"))


def exclude_near(left: DataFrame, right: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    return left.join(near_any(left, right, key, x, y, radius), key, "left_anti")


def cap_per_block(df: DataFrame, x: str, y: str, order: list[Column], most: int, size: float = 6000.0, target: int | None = None) -> DataFrame:
    """At most `most` rows of each spatial block, in the given order; block shows where they lie.

    target: of these, so many at most over all blocks, in the same order. Fewer than the target is an error.
    """
    from pyspark.sql import Window

    block = grid.spatial_block(F.col(x), F.col(y), size)
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    out = df.withColumn("block", block).withColumn("block_rank", rank).where(F.col("block_rank") <= most)
    if target is None:
        return out
    first = out.orderBy(*order).limit(target)  # each task keeps its first ones, so no task holds all
    n = first.count()
    if n < target:
        raise ValueError(f"{n} of {target} points could be placed")
    return first


def pending(blocks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that a ledger of finished ones lacks."""
    return blocks.join(done.select(*keys), keys, "left_anti")


def block_plan(grids: DataFrame, size: int = 256) -> DataFrame:
    """grid_id, block_row, block_col, height, width: request blocks, ragged at the far edges. grids: grid_id, height, width."""
    rows = grids.withColumn("block_row", F.explode(grid.block_starts(F.col("height"), size)))
    cells = rows.withColumn("block_col", F.explode(grid.block_starts(F.col("width"), size)))
    return cells.select("grid_id", "block_row", "block_col", F.least(F.lit(size).cast("long"), F.col("height") - F.col("block_row")).alias("height"), F.least(F.lit(size).cast("long"), F.col("width") - F.col("block_col")).alias("width"))


def pick_source(candidates: DataFrame, key: str, order: list[Column], ok: Column) -> DataFrame:
    """The first complete candidate of each key."""
    from pyspark.sql import Window

    return candidates.where(ok).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def write_cube(pixels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pixels as Parquet by (grid_id, year), clustered by chunk, so that a read touches few row groups."""
    out = pixels.withColumn("chunk_row", F.floor(F.col("row") / CHUNK).cast("int")).withColumn("chunk_col", F.floor(F.col("col") / CHUNK).cast("int"))
    order = ["chunk_row", "chunk_col", "row", "col"]
    out.repartitionByRange("grid_id", "year", "chunk_row", "chunk_col").sortWithinPartitions("grid_id", "year", *order).write.mode(mode).partitionBy("grid_id", "year").option("compression", "zstd").parquet(path)
