"""Source rasters: decoding, validation of their metadata, relation of grids, priority mosaics, scans of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import vec

#: Fixed value: what marks a missing band in encoded responses.
NODATA = -9999.0


def decode(v: Column) -> Column:
    """A vector as sent: the no-data mark becomes NaN, and null where there are not 64 bands."""
    clean = F.transform(v, lambda x: F.when(x == NODATA, F.lit(float("nan"))).otherwise(x.cast("double")))
    return F.when(F.size(v) == vec.BANDS, clean)


def masked(v: Column) -> Column:
    """The vector where all its bands are present, else null: one gap hides the pixel."""
    return F.when(vec.complete(v), v)


def priority_mosaic(pixels: DataFrame, keys: list[str], source: str, ok: Column | None = None, vector: str = "embedding") -> DataFrame:
    """keys, source, vector: of each pixel the complete vector of the smallest source id; ok: compatible sources only.

    Sources are compared first and vectors fetched by key after, so that the aggregate's rows stay slim.
    """
    rows = pixels.where(vec.complete(F.col(vector)) & (F.lit(True) if ok is None else ok))
    best = rows.groupBy(*keys).agg(F.min(source).alias(source))
    return rows.select(*keys, source, vector).join(best, [*keys, source])


def source_errors(bands: DataFrame) -> DataFrame:
    """id and reason (null: fit) of each source, from rows (id, version, band, epsg, a, b, d, e, c, f, width, height)."""
    grid = F.struct("epsg", "a", "b", "c", "d", "e", "f", "width", "height")
    names = F.array_sort(F.collect_list(F.struct("ord", "band")))
    wanted = F.array(*[F.lit(f"A{b:02d}") for b in range(vec.BANDS)])
    one = bands.groupBy("id").agg(F.max("version").alias("version"), names.alias("names"), F.min(grid).alias("g"), F.max(grid).alias("h"))
    g = lambda c: F.col(f"g.{c}")
    unit = lambda c: F.abs(F.abs(g(c)) - 10) < 1e-9
    zero = lambda c: F.abs(g(c)) < 1e-9
    axes = (unit("a") & unit("e") & zero("b") & zero("d")) | (unit("b") & unit("d") & zero("a") & zero("e"))
    reason = (
        F.when(F.col("version").isNull(), "no_version")
        .when(F.transform("names", lambda s: s["band"]) != wanted, "bands")
        .when(~(g("epsg").between(32601, 32660) | g("epsg").between(32701, 32760)), "not_utm")
        .when(~axes | (F.least(g("width"), g("height")) <= 0), "not_native_grid")
        .when(~F.col("g").eqNullSafe(F.col("h")), "bands_differ")
    )
    return one.select("id", reason.alias("reason"))


def relation(c1: Column, f1: Column, c2: Column, f2: Column, step: float = 10.0) -> Column:
    """struct: offset of the second north-up origin in pixels of the first grid, residuals from whole pixels, aligned."""
    dx, dy = (c2 - c1) / step, (f1 - f2) / step
    rx, ry = F.abs(dx - F.rint(dx)), F.abs(dy - F.rint(dy))
    return F.struct(dx.alias("dx"), dy.alias("dy"), rx.alias("rx"), ry.alias("ry"), ((rx < 1e-6) & (ry < 1e-6)).alias("aligned"))


def scan(pixels: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """by, pixels, complete pixels, their fraction, infinite and zero vectors, least and largest norm."""
    v = F.col(vector)
    slim = pixels.select(*by, vec.complete(v).alias("__ok"), F.exists(v, lambda x: F.abs(x) == float("inf")).alias("__inf"), F.when(vec.complete(v), vec.norm(v)).alias("__n"))
    out = slim.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pixels"), F.count_if("__ok").alias("n_complete"), F.count_if("__inf").alias("n_infinite"), F.count_if(F.col("__n") <= vec.ZERO).alias("n_zero"), F.min("__n").alias("norm_min"), F.max("__n").alias("norm_max"))
    return out.withColumn("fraction", F.col("n_complete") / F.col("n_pixels"))


def cube_difference(left: DataFrame, right: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row: pixels of either side only and shared pixels whose vectors differ in a bit; NaN equals NaN."""
    a = left.select(*keys, F.col(vector).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(vector).alias("__b"), F.lit(True).alias("__r"))
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return a.join(b, keys, "full").agg(
        F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"), F.count_if(both & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_different")
    )


def split_blocks(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks halved along each edge above `least` (the first half is the smaller), row-major, with key/splitN."""

    def parts(start: str, length: str) -> Column:
        n, half = F.col(length), F.floor(F.col(length) / 2)
        part = lambda s, k: F.struct(s.cast("long").alias("s"), k.cast("long").alias("n"))
        return F.when(n <= least, F.array(part(F.col(start), n))).otherwise(F.array(part(F.col(start), half), part(F.col(start) + half, n - half)))

    cells = F.flatten(F.transform(parts("row", "height"), lambda r: F.transform(parts("col", "width"), lambda c: F.struct(r.alias("r"), c.alias("c")))))
    out = blocks.select("key", F.size(cells).alias("__k"), F.posexplode(cells).alias("__i", "__p"))
    key = F.when(F.col("__k") > 1, F.concat("key", F.lit("/split"), F.col("__i").cast("string"))).otherwise(F.col("key"))
    return out.select(key.alias("key"), F.col("__p.r.s").alias("row"), F.col("__p.c.s").alias("col"), F.col("__p.r.n").alias("height"), F.col("__p.c.n").alias("width"))


def centre_probe(height: Column, width: Column, size: int) -> Column:
    """struct row, col, height, width of the middle window; grids below the size are taken whole."""
    h, w = F.least(height, F.lit(size)), F.least(width, F.lit(size))
    half = lambda n, k: F.floor((n - k) / 2).cast("long")
    return F.struct(half(height, h).alias("row"), half(width, w).alias("col"), h.cast("long").alias("height"), w.cast("long").alias("width"))


def mosaic_contract(tiles: DataFrame, by: str, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """by, tiles, and whether their union's bounds equal the reference's."""
    b = tiles.groupBy(by).agg(F.count(F.lit(1)).alias("n_tiles"), F.min("x0").alias("a"), F.max("x1").alias("b"), F.min("y0").alias("c"), F.max("y1").alias("d"))
    near = lambda c, v: F.abs(F.col(c) - v) < 1e-6
    return b.select(by, "n_tiles", (near("a", x0) & near("b", x1) & near("c", y0) & near("d", y1)).alias("matches"))


#: How a tile id and a year look in a path.
TILE_ID = r"(?i)(?<![A-Z0-9])T?((?:0[1-9]|[1-5][0-9]|60)[C-HJ-NP-X][A-HJ-NP-Z]{2})(?![A-Z0-9])"
YEAR = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"


def inventory(headers: DataFrame, index: DataFrame) -> DataFrame:
    """One row per raster and year, with what its header and names say of its grid.

    headers: path, format (zarr or geotiff), band_count, grid_tag, tile_tag, year_tag, years (of a zarr's time axis),
    epsg, a, b, c, d, e, f (its transform), width, height. index: tile, epsg, x0, y0, width, height of whole tiles (10 m).
    Rasters of another number of bands are left out. A tile id is looked for in the grid id, the tile id, the file's
    and the folder's name, in this order. A raster is a whole tile only where system, transform and size are the index's.
    """
    parts = F.split("path", "/")
    folder = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    is_zarr = F.col("format") == "zarr"
    fallback = F.when(is_zarr, stem).otherwise(folder)
    rows = headers.where(F.col("band_count") == vec.BANDS).withColumns({
        "grid_id": F.coalesce("grid_tag", "tile_tag", fallback),
        "tile_id": F.coalesce("tile_tag", F.when(is_zarr, fallback).otherwise(F.coalesce("grid_tag", fallback))),
        "__origin": F.when(F.col("grid_tag").isNotNull(), "grid_id").when(F.col("tile_tag").isNotNull(), "tile_id").when(is_zarr, "filename").otherwise("parent_directory"),
    })
    told = F.array(*[F.struct(o.alias("from"), v.alias("text")) for o, v in ((F.col("__origin"), F.col("grid_id")), (F.lit("tile_id"), F.col("tile_id")), (F.lit("filename"), stem), (F.lit("parent_directory"), folder))])
    first = F.try_element_at(F.filter(told, lambda t: t["text"].rlike(TILE_ID)), F.lit(1))
    named = F.array_distinct(F.regexp_extract_all(stem, F.lit(YEAR), 1))
    n_named = F.size(F.regexp_extract_all(stem, F.lit(YEAR), 1))
    tag = F.col("year_tag").cast("string")
    one = lambda y, how: F.array(F.struct(y.cast("int").alias("year"), F.lit(how).alias("year_evidence")))
    by_header = F.when(tag.rlike("^(19|20)[0-9]{2}$"), one(tag.try_cast("int"), "tiff_year_tag")).when(tag.isNull() & (n_named == 1), one(named[0], "annual_filename")).otherwise(one(F.lit(None), "unknown"))
    by_axis = F.when(F.size(F.coalesce("years", F.array())) > 0, F.transform("years", lambda y: F.struct(y.cast("int").alias("year"), F.lit("zarr_time").alias("year_evidence")))).otherwise(one(F.lit(None), "unknown"))
    rows = rows.withColumn("__t", first).withColumn("__y", F.when(is_zarr, by_axis).otherwise(by_header))
    exact = F.col("__t.text").rlike(f"^(?:{TILE_ID})$")
    rows = rows.withColumns({"mgrs_candidate": F.upper(F.regexp_extract("__t.text", TILE_ID, 1)), "mgrs_candidate_evidence": F.concat("__t.from", F.when(exact, ":exact").otherwise(":derived_name"))})
    side = {"__ix": "x0", "__iy": "y0", "__iw": "width", "__ih": "height", "__ie": "epsg"}
    known = index.select(F.upper("tile").alias("mgrs_candidate"), *[F.col(c).alias(n) for n, c in side.items()])
    met = rows.join(known, "mgrs_candidate", "left")
    near = lambda u, v: F.abs(u - v) <= 1e-6
    c = F.col
    same = (c("epsg") == c("__ie")) & (c("width") == c("__iw")) & (c("height") == c("__ih")) & near(c("a"), F.lit(10.0)) & near(c("b"), F.lit(0.0)) & near(c("c"), c("__ix")) & near(c("d"), F.lit(0.0)) & near(c("e"), F.lit(-10.0)) & near(c("f"), c("__iy"))
    whole = F.coalesce(same, F.lit(False))
    metres = F.coalesce(c("epsg").between(32601, 32660) | c("epsg").between(32701, 32760), F.lit(False))
    size = lambda m: near(F.hypot("a", "d"), F.lit(float(m))) & near(F.hypot("b", "e"), F.lit(float(m)))
    resolution = F.when(metres & size(10), "10m_grid_not_native_verified").when(metres & size(30), "30m_derivative_not_native_10m").otherwise("other_or_unknown")
    footprint = F.when(whole, "full_mgrs").when(c("mgrs_candidate").isNotNull(), "mgrs_subset/reference").otherwise("other")
    out = met.withColumns({"mgrs_geometry_match": whole, "footprint_class": footprint, "resolution_class": resolution, "resolution_x": F.hypot("a", "d"), "resolution_y": F.hypot("b", "e")})
    kept = [x for x in headers.columns if x not in ("grid_tag", "tile_tag", "year_tag", "years")]
    out = out.select(*kept, "grid_id", "tile_id", F.explode("__y").alias("__one"), "mgrs_candidate", "mgrs_candidate_evidence", "mgrs_geometry_match", "footprint_class", "resolution_class", "resolution_x", "resolution_y")
    return out.select("*", "__one.year", "__one.year_evidence").drop("__one")
