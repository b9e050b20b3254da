"""Grid algebra as column expressions. A transform is (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import is_finite

RESOLUTION = 10.0
FIRST_YEAR, LAST_YEAR = 2017, 2025


def in_range(lon: Column, lat: Column) -> Column:
    return is_finite(lon) & is_finite(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def cell_centre(v: Column) -> Column:
    """Centre of the 0.1 degree cell that holds v; null where v is not finite."""
    return F.when(is_finite(v), F.round(F.floor(v * 10) / 10 + F.lit(0.05), 2))


def cell_name(lon: Column, lat: Column) -> Column:
    return F.format_string("grid_%.2f_%.2f", cell_centre(lon), cell_centre(lat))


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone, without the exceptions of Norway and Svalbard."""
    return (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("int")


def pixel(x: Column, origin: Column, step: float) -> Column:
    """Row or column number of a coordinate; null where it is not finite (floor of NaN would be 0)."""
    return F.when(is_finite(x), F.floor((x - origin) / F.lit(step)).cast("long"))


def pixel_centre(n: Column, origin: Column, step: float) -> Column:
    return origin + (n + F.lit(0.5)) * F.lit(step)


def snapped(low: Column, high: Column, step: float = RESOLUTION) -> tuple[Column, Column]:
    """Bounds widened to whole steps."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def spatial_block(x: Column, y: Column, size: float = 6000.0) -> Column:
    if size <= 0:
        raise ValueError("block size must be positive")
    return F.concat(F.lit("g"), F.floor(x / size).cast("string"), F.lit("_"), F.floor(y / size).cast("string"))


def block_starts(length: Column, size: int) -> Column:
    """Starts of a side's blocks."""
    return F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, F.lit(size).cast("long"))


def footprints_match(a: tuple, b: tuple, tol: float = 1e-6) -> bool:
    """Whether two transforms tile the plane alike: equal up to flips or swaps of axes and whole-pixel shifts."""
    det = a[0] * a[4] - a[1] * a[3]
    if det == 0:
        return False
    solve = lambda x, y: ((a[4] * x - a[1] * y) / det, (a[0] * y - a[3] * x) / det)
    (p, r), (q, s) = solve(b[0], b[3]), solve(b[1], b[4])
    unit = lambda v: abs(abs(v) - 1) < 1e-10
    zero = lambda v: abs(v) < 1e-10
    axes = unit(p) and unit(s) and zero(q) and zero(r) or unit(q) and unit(r) and zero(p) and zero(s)
    return axes and all(abs(v - round(v)) < tol for v in solve(b[2] - a[2], b[5] - a[5]))


def footprint_relation(one: str, other: str, tol: float = 1e-6) -> Column:
    """struct of how the transform in columns {other}a to {other}f lies to the one in {one}a to {one}f, both with {..}epsg.

    p, q, r, s: its linear part in the first grid's pixels; dx, dy: its origin there; rx, ry: how far these are from whole pixels;
    aligned: the same axes and whole shifts; matches: pixels cover the same ground, flips and swaps of axes aside. Both need one system.
    """
    u = {k: F.col(one + k).cast("double") for k in "abcdef"}
    v = {k: F.col(other + k).cast("double") for k in "abcdef"}
    det = F.nullif(u["a"] * u["e"] - u["b"] * u["d"], F.lit(0.0))
    solve = lambda x, y: ((u["e"] * x - u["b"] * y) / det, (u["a"] * y - u["d"] * x) / det)
    (p, r), (q, s), (dx, dy) = solve(v["a"], v["d"]), solve(v["b"], v["e"]), solve(v["c"] - u["c"], v["f"] - u["f"])
    off = lambda x: F.abs(x - F.rint(x))
    unit = lambda x: F.abs(F.abs(x) - 1) < 1e-10
    zero = lambda x: F.abs(x) < 1e-10
    same = F.col(one + "epsg") == F.col(other + "epsg")
    whole = (off(dx) < tol) & (off(dy) < tol)
    straight = (F.abs(p - 1) < 1e-10) & (F.abs(s - 1) < 1e-10) & zero(q) & zero(r)
    turned = (unit(p) & unit(s) & zero(q) & zero(r)) | (unit(q) & unit(r) & zero(p) & zero(s))
    told = lambda test: F.coalesce(same & whole & test, F.lit(False))
    return F.struct(p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s"), dx.alias("dx"), dy.alias("dy"), off(dx).alias("rx"), off(dy).alias("ry"), told(straight).alias("aligned"), told(turned).alias("matches"))


def window_origin(x0: Column, y0: Column, row: Column, col: Column, step: float = RESOLUTION) -> Column:
    """Top left corner of a window of a north-up grid."""
    return F.struct((x0 + col * step).cast("double").alias("x"), (y0 - row * step).cast("double").alias("y"))


def quad_split(row: int, col: int, height: int, width: int, least: int) -> Iterator[tuple[int, int, int, int, str]]:
    """The parts into which a request is halved, row-major, while an edge is above `least`."""
    rows = [(row, height)] if height <= least else [(row, height // 2), (row + height // 2, height - height // 2)]
    cols = [(col, width)] if width <= least else [(col, width // 2), (col + width // 2, width - width // 2)]
    if len(rows) * len(cols) > 1:
        for k, (r, c) in enumerate((r, c) for r in rows for c in cols):
            yield r[0], c[0], r[1], c[1], f"/split{k}"


def retry_delay(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before a retry: doubling, at most a minute, moved by up to a fifth."""
    return max(0.0, min(60.0, min(60.0, 2.0 ** (attempt - 1)) * (1 + 0.2 * jitter)))


def years_argument(years) -> list[int]:
    """Sorted distinct years within the catalogue's range; none is an error."""
    out = sorted(set(int(y) for y in years))
    if not out or out[0] < FIRST_YEAR or out[-1] > LAST_YEAR:
        raise ValueError(f"years must lie in {FIRST_YEAR} to {LAST_YEAR}")
    return out
