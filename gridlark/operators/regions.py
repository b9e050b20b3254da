"""Areas against grid cells and tiles: which share area, or touch.

Areas are rows of (region_id, rings): outer rings counter-clockwise and holes clockwise, array<array<struct<x, y>>>. Bounds meet
first, by equal keys and without the rings; rings are joined to the pairs that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import grid
from gridlark.operators import geometry, lookup

#: Square degrees below which a common area counts as rounding: about a hundredth of a square metre.
LEAST = 1e-12


def half_plane(ring: Column, a: Column, b: Column) -> Column:
    """The ring's part to the left of the line from a to b, the line included."""
    side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def edge(e):
        p, q = e["a"], e["b"]
        sp, sq = side(p), side(q)
        t = sp / F.nullif(sp - sq, F.lit(0.0))
        crossing = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
        end = point(q["x"], q["y"])
        return F.when((sp >= 0) & (sq >= 0), F.array(end)).when(sp >= 0, F.array(crossing)).when(sq >= 0, F.array(crossing, end)).otherwise(F.slice(F.array(end), 1, 0))

    return F.flatten(F.transform(geometry._edges(ring), edge))


def common_area(rings: Column, convex: Column) -> Column:
    """Area that rings share with a convex ring (counter-clockwise); holes count against it."""

    def part(ring):
        cut = F.aggregate(geometry._edges(convex), F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))), lambda left, e: half_plane(left, e["a"], e["b"]))
        return geometry.signed_area(cut)

    return F.aggregate(F.transform(rings, part), F.lit(0.0), lambda s, x: s + x)


def box_ring(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def edges_meet(rings: Column, convex: Column) -> Column:
    """Whether an edge of the rings meets a convex ring, its border included: no line of either parts them."""
    cross = lambda o, p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])

    def one(e):
        sides = F.transform(convex, lambda c: cross(e["a"], e["b"], c))
        beside = (F.array_min(sides) > 0) | (F.array_max(sides) < 0)
        outside = F.exists(geometry._edges(convex), lambda w: (cross(w["a"], w["b"], e["a"]) < 0) & (cross(w["a"], w["b"], e["b"]) < 0))
        return ~beside & ~outside

    return F.exists(geometry.rings_edges(rings), one)


def meets(rings: Column, convex: Column, touching: bool = False) -> Column:
    """Whether rings share area with a convex ring, or only touch it where `touching`."""
    shared = common_area(rings, convex) > LEAST
    return shared | edges_meet(rings, convex) if touching else shared


def bounds_of(rings: Column) -> tuple[Column, Column, Column, Column]:
    """West, east, south and north of all rings."""
    flat = lambda axis: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p[axis].cast("double"))))
    return F.array_min(flat("x")), F.array_max(flat("x")), F.array_min(flat("y")), F.array_max(flat("y"))


def region_cells(regions: DataFrame, key: str = "region_id", touching: bool = False) -> DataFrame:
    """key, grid_id, centre_lon, centre_lat and epsg of the 0.1 degree cells that each area meets."""
    w, e, s, n = bounds_of(F.col("rings"))
    ends = regions.select(key, w.alias("w"), e.alias("e"), s.alias("s"), n.alias("n")).where("w is not null")
    whole = lambda c, up: (F.ceil(F.col(c) * 10) if up else F.floor(F.col(c) * 10)).cast("long")
    span = lambda a, b: F.explode(F.filter(F.sequence(whole(a, False), F.greatest(whole(a, False), whole(b, True) - 1)), lambda i: i < whole(b, True)))
    cells = ends.withColumn("ix", span("w", "e")).withColumn("iy", span("s", "n")).select(key, "ix", "iy")
    edge = lambda i, d: (F.col(i) + d) / F.lit(10.0)
    met = cells.join(regions.select(key, "rings"), key).where(meets(F.col("rings"), box_ring(edge("ix", 0), edge("ix", 1), edge("iy", 0), edge("iy", 1)), touching))
    centre = lambda i: F.round((F.col(i) + F.lit(0.5)) / 10, 2)
    out = met.select(key, centre("ix").alias("centre_lon"), centre("iy").alias("centre_lat"))
    return out.select(key, F.format_string("grid_%.2f_%.2f", "centre_lon", "centre_lat").alias("grid_id"), "centre_lon", "centre_lat", grid.utm_epsg(F.col("centre_lon"), F.col("centre_lat")).alias("epsg"))


def region_points(points: DataFrame, key: str = "region_id") -> DataFrame:
    """The same of areas that are points only: the one half-open cell of each, so a point on a border has no more than one."""
    lon, lat = F.col("lon"), F.col("lat")
    out = points.where(grid.in_range(lon, lat)).select(key, grid.cell_centre(lon).alias("centre_lon"), grid.cell_centre(lat).alias("centre_lat")).distinct()
    return out.select(key, F.format_string("grid_%.2f_%.2f", "centre_lon", "centre_lat").alias("grid_id"), "centre_lon", "centre_lat", grid.utm_epsg(F.col("centre_lon"), F.col("centre_lat")).alias("epsg"))


def region_tiles(regions: DataFrame, tiles: DataFrame, key: str = "region_id", tile: str = "mgrs_tile_id", span: float = 6.0, touching: bool = False) -> DataFrame:
    """key and tile of areas and convex tiles (rows with ring, counter-clockwise) that share area, or touch."""
    w, e, s, n = bounds_of(F.col("rings"))
    a = regions.select(key, w.alias("x0"), e.alias("x1"), s.alias("y0"), n.alias("y1")).where("x0 is not null")
    tw, te, ts, tn = geometry.bounds(F.col("ring"))
    b = tiles.select(tile, tw.alias("x0"), te.alias("x1"), ts.alias("y0"), tn.alias("y1"))
    pairs = lookup.boxes_meet(a, b, key, tile, span, touching=True)
    met = pairs.join(regions.select(key, "rings"), key).join(tiles.select(tile, "ring"), tile)
    return met.where(meets(F.col("rings"), F.col("ring"), touching)).select(key, tile)


def dissolved(features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """key, feature_count, joined distinct names and the rings of all features of a region (its parts, side by side)."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    joined = [F.array_join(F.array_sort(F.collect_set(clean(c))), "|").alias(c) for c in names]
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("feature_count"), *joined, F.flatten(F.collect_list("rings")).alias("rings"))
