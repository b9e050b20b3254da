"""More queries with their SQL: reads across a catalogue of grids, grid contracts, areas, delivery rules, request logs, signatures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlark.catalogue import NORM, V, _triangles, q, query, r
from gridlark.functions import crs, grid, vec
from gridlark.operators import audit, collection, cube, deliveries, features, geometry, gridspec, lookup, mosaic, points, regions, store
from gridlark.plans import budget
from gridlark.plans.relations import relation, with_sql
from gridlark.runtime import table
from gridlark.sources import readers

# ---- a catalogue: the raster's tiles as grids, and one grid across two of them that comes first by id


def _catalog(spark, d):
    t = relation(spark, d, "pix").select("tile").distinct()
    both = F.array(F.lit(2017), F.lit(2018))
    own = t.select(F.concat(F.lit("g"), F.col("tile").cast("string")).alias("grid_id"), F.lit(500000.0).alias("x0"), (F.lit(10000000.0) - 80 * F.col("tile")).alias("y0"), F.lit(25).cast("long").alias("width"), F.lit(8).cast("long").alias("height"))
    over = spark.range(1).select(F.lit("a_over").alias("grid_id"), F.lit(500050.0).alias("x0"), F.lit(9999980.0).alias("y0"), F.lit(10).cast("long").alias("width"), F.lit(8).cast("long").alias("height"))
    return own.unionByName(over).select("grid_id", F.lit(32717).alias("epsg"), "x0", "y0", "width", "height", both.alias("years"))


def _pixels(spark, d):
    """Both grids' pixels of two years; of the second year every fourth is missing."""
    p = relation(spark, d, "pix")
    own = p.select(F.concat(F.lit("g"), F.col("tile").cast("string")).alias("grid_id"), (F.col("row") - 8 * F.col("tile")).alias("row"), "col", "vec_id", "embedding")
    over = p.where("row BETWEEN 2 AND 9 AND col BETWEEN 5 AND 14").select(F.lit("a_over").alias("grid_id"), (F.col("row") - 2).alias("row"), (F.col("col") - 5).alias("col"), (F.col("vec_id") + 100000).alias("vec_id"), "embedding")
    return own.unionByName(over).withColumn("year", F.explode(F.array(F.lit(2017), F.lit(2018)))).where("year = 2017 OR vec_id % 4 <> 0")


GRIDS = with_sql("loc", "pix") + """, grids AS (SELECT DISTINCT 'g' || tile AS grid_id, 500000 AS x0, 10000000 - 80 * tile AS y0, 25 AS w, 8 AS h FROM pix UNION ALL SELECT 'a_over', 500050, 9999980, 10, 8),
px AS (SELECT 'g' || tile AS grid_id, row, col, vec_id FROM pix UNION ALL SELECT 'a_over', row, col, vec_id + 100000 FROM pix WHERE row BETWEEN 2 AND 9 AND col BETWEEN 5 AND 14),
pxy AS (SELECT * FROM px, (SELECT unnest([2017, 2018]) AS year) WHERE year = 2017 OR vec_id % 4 <> 0),
first AS (SELECT ord, x, y, floor((10000000 - y) / 10) AS r, floor((x - 500000) / 10) AS c, min(grid_id) AS grid_id FROM loc LEFT JOIN grids ON x >= x0 AND x < x0 + 10 * w AND y <= y0 AND y > y0 - 10 * h GROUP BY ALL)"""


@query(GRIDS + " SELECT ord, n.year, f.grid_id, p.vec_id FROM first f CROSS JOIN (SELECT unnest([2018, 2017]) AS year) n LEFT JOIN pxy p ON p.grid_id = f.grid_id AND p.row = f.r AND p.col = f.c AND p.year = n.year")
def catalog_sample(spark, d):
    return collection.sample(relation(spark, d, "loc"), _catalog(spark, d), _pixels(spark, d), "ord", [2018, 2017], x="x", y="y", epsg=32717, value="vec_id").select("ord", "year", "grid_id", "vec_id")


@query(GRIDS + ", given AS (SELECT ord, r, c, CASE ord % 3 WHEN 1 THEN 'g0' WHEN 2 THEN 'a_over' END AS grid_id FROM first) SELECT ord, n.year, f.grid_id, p.vec_id FROM given f CROSS JOIN (SELECT unnest([2017, 2018]) AS year) n LEFT JOIN pxy p ON p.grid_id = f.grid_id AND p.row = f.r AND p.col = f.c AND p.year = n.year")
def catalog_sample_by_id(spark, d):
    """Grids given by id, null for none; years are those of the first grid."""
    p = relation(spark, d, "loc").withColumn("g", F.when(F.col("ord") % 3 == 1, "g0").when(F.col("ord") % 3 == 2, "a_over"))
    return collection.sample(p, _catalog(spark, d), _pixels(spark, d), "ord", ids="g", x="x", y="y", epsg=32717, value="vec_id").select("ord", "year", "grid_id", "vec_id")


@query(GRIDS + ", o AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) SELECT ord, f.grid_id, string_agg(coalesce(p.vec_id::varchar, '-'), ',' ORDER BY dr, dc) AS patch FROM first f CROSS JOIN o LEFT JOIN pxy p ON p.grid_id = f.grid_id AND p.row = f.r + dr AND p.col = f.c + dc AND p.year = 2018 GROUP BY ord, f.grid_id")
def catalog_patches(spark, d):
    """Patches of the grid that holds their centre; seams stay empty."""
    p = collection.patches(relation(spark, d, "loc"), _catalog(spark, d), _pixels(spark, d), "ord", 3, [2018], x="x", y="y", epsg=32717, value="vec_id")
    return p.select("ord", "grid_id", F.array_join(F.transform("patch", lambda v: v.cast("string")), ",", "-").alias("patch"))


@query(GRIDS + ", o AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)), n AS (SELECT ord, count(p.vec_id) AS n FROM first f CROSS JOIN o JOIN pxy p ON p.grid_id = f.grid_id AND p.row = f.r + dr AND p.col = f.c + dc GROUP BY ord) SELECT ord, " + q("coalesce(n, 0) / 18::double") + " AS patch_valid_fraction, coalesce(n, 0) = 18 AS patch_complete FROM first LEFT JOIN n USING (ord) WHERE ord % 10 = 0")
def catalog_patch_quality(spark, d):
    """Quality over two years, all bands and nine pixels."""
    few = relation(spark, d, "loc").where("ord % 10 = 0")
    p = collection.patches(few, _catalog(spark, d), _pixels(spark, d), "ord", 3, [2017, 2018], x="x", y="y", epsg=32717)
    return collection.patch_quality(p, "ord", 3).withColumn("patch_valid_fraction", r("patch_valid_fraction"))


@query(GRIDS + " SELECT p.grid_id, year, (row - greatest(2, r0))::bigint AS row, (col - greatest(4, c0))::bigint AS col, vec_id FROM pxy p JOIN (SELECT grid_id, (10000000 - y0) / 10 AS r0, (x0 - 500000) / 10 AS c0 FROM grids) g USING (grid_id) WHERE row >= 2 AND row < 12 AND col >= 4 AND col < 9 AND grid_id IN ('g0', 'g1', 'a_over') AND year = 2018")
def catalog_bbox(spark, d):
    """Windows of three grids on one box of their own system."""
    got = collection.read_bbox(_catalog(spark, d), _pixels(spark, d), (500041.0, 9999885.0, 500085.0, 9999975.0), 32717, [2018], ["g0", "g1", "a_over"])
    return got.select("grid_id", "year", "row", "col", "vec_id")


def _corners(zone: int, south: int) -> str:
    """SQL for px, py of a relation c (lon, lat): their projected coordinates in one zone."""
    e = "eta" + "".join(f" + ({a!r}::double) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    n = "xi" + "".join(f" + ({a!r}::double) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    ecc, k = f"({crs.E1!r}::double)", f"({crs.K0 * crs.R!r}::double)"
    return f"""c1 AS (SELECT *, radians(lon - ({zone} * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM c), c2 AS (SELECT *, sinh(atanh(s) - {ecc} * atanh({ecc} * s)) AS t FROM c1),
c3 AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM c2), c4 AS (SELECT *, 500000 + {k} * ({e}) AS px, {south} + {k} * ({n}) AS py FROM c3)"""


@query(GRIDS + ", c AS (SELECT * FROM (VALUES (-80.9997, -0.0012), (-80.9992, -0.0012), (-80.9997, -0.0003), (-80.9992, -0.0003)) v(lon, lat)), " + _corners(17, 10000000) + ", b AS (SELECT min(px) AS w, max(px) AS e, min(py) AS s, max(py) AS n FROM c4) SELECT grid_id, greatest(0, least(h, floor((y0 - n) / 10)))::bigint AS r0, greatest(0, least(h, ceil((y0 - s) / 10)))::bigint AS r1, greatest(0, least(grids.w, floor((x0 - b.w) / -10)))::bigint AS c0, greatest(0, least(grids.w, ceil((e - x0) / 10)))::bigint AS c1 FROM grids, b WHERE r0 < r1 AND c0 < c1")
def catalog_windows_degrees(spark, d):
    """Windows of a box of degrees, projected into each grid's system."""
    return collection.bbox_windows(_catalog(spark, d), (-80.9997, -0.0012, -80.9992, -0.0003)).select("grid_id", "r0", "r1", "c0", "c1")


@query(GRIDS + " SELECT year, (row - 3)::bigint AS row, (col - 1)::bigint AS col, vec_id FROM pxy WHERE grid_id = 'g0' AND row >= 3 AND row < 6 AND col >= 1 AND col < 4 AND year IN (2017, 2018)")
def catalog_window(spark, d):
    return collection.read_window(_catalog(spark, d), _pixels(spark, d), "g0", 3, 6, 1, 4, [2017, 2018]).select("year", "row", "col", "vec_id")


# ---- grid contracts


@query(with_sql("pts") + """, c0 AS (SELECT DISTINCT round(floor(lon * 10) / 10 + 0.05::double, 2) AS cx, round(floor(lat * 10) / 10 + 0.05::double, 2) AS cy FROM pts WHERE ord % 20 = 0),
c AS (SELECT cx, cy, least(60, greatest(1, floor((cx + 180) / 6)::int + 1)) AS zone, cx + dx AS lon, cy + dy AS lat FROM c0, (SELECT unnest([-0.05::double, 0.05::double]) AS dx), (SELECT unnest([-0.05::double, 0.05::double]) AS dy)), """ + _corners(0, 0).replace("(0 * 6 - 183)", "(zone * 6 - 183)").replace("0 + (", "CASE WHEN cy < 0 THEN 10000000 ELSE 0 END + (", 2).replace("50000CASE WHEN cy < 0 THEN 10000000 ELSE 0 END + (", "500000 + (") + """
SELECT printf('grid_%.2f_%.2f', cx, cy) AS grid_id, (CASE WHEN cy >= 0 THEN 32600 ELSE 32700 END + any_value(zone))::int AS epsg, floor(min(px) / 10) * 10 AS x0, ceil(max(py) / 10) * 10 AS y0, round((ceil(max(px) / 10) * 10 - floor(min(px) / 10) * 10) / 10)::bigint AS width, round((ceil(max(py) / 10) * 10 - floor(min(py) / 10) * 10) / 10)::bigint AS height FROM c4 GROUP BY cx, cy""")
def cell_grid_contracts(spark, d):
    """The projected grid of every 20th point's 0.1 degree cell."""
    cells = relation(spark, d, "pts").where("ord % 20 = 0").select(grid.cell_centre(F.col("lon")).alias("lon"), grid.cell_centre(F.col("lat")).alias("lat")).distinct()
    return gridspec.cell_grids(cells, centres=True).select("grid_id", "epsg", "x0", "y0", "width", "height")


@query("SELECT printf('grid_%.2f_%.2f', (x + 0.5::double) / 10, (y + 0.5::double) / 10) AS grid_id, (CASE WHEN y >= 0 THEN 32600 ELSE 32700 END + floor(((x + 0.5::double) / 10 + 180) / 6) + 1)::int AS epsg FROM (SELECT unnest(range(-804, -795)) AS x), (SELECT unnest(range(-11, 4)) AS y)")
def grids_of_box(spark, d):
    return gridspec.grids_of_box(spark, (-80.37, -1.1, -79.5001, 0.35)).select("grid_id", "epsg")


@query("WITH t AS (SELECT upper(n_name) AS id, 300000 + 1000 * n_nationkey AS x, 9800040 - 1000 * n_regionkey AS y FROM nation), w(o, id) AS (VALUES (0, 'NATION_7'), (1, 'NATION_3'), (2, 'NATION_19')) SELECT id AS grid_id, o AS request_order, 32717 AS epsg, floor((x + 3) / 10) * 10 AS x0, ceil((y + 109800 - 4) / 10::double) * 10 AS y0, 10980::bigint AS width, 10980::bigint AS height FROM t JOIN w USING (id)")
def tile_grid_contracts(spark, d):
    """Grids from the corners of a tile index, in the order asked for."""
    x, y = 300000 + 1000 * F.col("n_nationkey") + 3, 9800040 - 1000 * F.col("n_regionkey") + 6
    corner = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(".0 "), (y + dy).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(109790, 0), corner(109790, 109790), corner(0, 109790), corner(0, 0)), F.lit("))"))
    index = table(spark, d, "nation").select(F.upper("n_name").alias("mgrs_tile_id"), F.lit(32717).alias("utm_epsg"), wkt.alias("utm_wkt"))
    return gridspec.tile_grids(index, ["nation_7", "NATION_3", "nation_19"]).select("grid_id", "request_order", "epsg", "x0", "y0", "width", "height")


@query("SELECT n_name AS grid_id, CASE n_nationkey % 8 WHEN 1 THEN 'no projected metre system' WHEN 2 THEN 'width and height must be positive' WHEN 3 THEN 'rotated or sheared' WHEN 4 THEN 'resolution must be 10 m' WHEN 5 THEN 'not north-up' WHEN 6 THEN 'bounds differ from transform and size' WHEN 7 THEN 'no projected metre system' END AS reason FROM nation")
def grid_contract_errors(spark, d):
    k = F.col("n_nationkey") % 8
    a = F.when(k == 4, 30.0).when(k == 5, -10.0).otherwise(10.0)
    n = table(spark, d, "nation").select(F.col("n_name").alias("grid_id"), F.when(k == 1, 4326).when(k == 7, F.lit(None)).otherwise(32717).alias("epsg"), a.alias("a"), F.when(k == 3, 1.0).otherwise(0.0).alias("b"), F.lit(500000.0).alias("c"), F.lit(0.0).alias("d"), (-F.abs(a)).alias("e"), F.lit(10000000.0).alias("f"), F.when(k == 2, 0).otherwise(16).alias("width"), F.lit(16).alias("height"), k.alias("k"))
    n = n.withColumns({"west": F.col("c"), "north": F.col("f"), "east": F.col("c") + F.col("width") * F.col("a") + F.when(F.col("k") == 6, 1.0).otherwise(0.0), "south": F.col("f") + F.col("height") * F.col("e")})
    return gridspec.contract_errors(n)


@query(f"SELECT n_name, n_name || '/{vec.PREFIX}_' || n_name || '_' || (2017 + n_regionkey % 3) || '_' || (2020 + n_nationkey % 4) AS path FROM nation")
def output_names(spark, d):
    years = F.array((2020 + F.col("n_nationkey") % 4).cast("int"), F.lit(2020), (2017 + F.col("n_regionkey") % 3).cast("int"))
    return table(spark, d, "nation").select("n_name", gridspec.output_name(F.col("n_name"), years).alias("path"))


# ---- areas, cells and tiles

SMALL = "CAST(-79.93 + 0.31 * n_nationkey AS DOUBLE) AS x0, CAST(-79.93 + 0.31 * n_nationkey + 0.12 * (1 + n_regionkey) AS DOUBLE) AS x1, CAST(-1.27 + 0.17 * n_regionkey AS DOUBLE) AS y0, CAST(-1.27 + 0.17 * n_regionkey + 0.23 AS DOUBLE) AS y1"
#: A triangle (base x0 to x1 at y0, top in the middle at y1) shares area with an open box (a to b, s to t): no edge of either parts them.
MEETS = "x0 < b AND x1 > a AND y0 < t AND y1 > s AND greatest((y1 - y0) * (b - x0) - (x1 - x0) / 2 * (s - y0), (y1 - y0) * (b - x0) - (x1 - x0) / 2 * (t - y0)) > 0 AND greatest((y1 - y0) * (x1 - a) - (x1 - x0) / 2 * (s - y0), (y1 - y0) * (x1 - a) - (x1 - x0) / 2 * (t - y0)) > 0"


def _small(spark, d):
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    boxes = table(spark, d, "nation").selectExpr("n_name AS region_id", *SMALL.split(", "))
    return boxes.selectExpr("region_id", "x0", "x1", "y0", "y1", f"array(array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('(x0 + x1) / 2', 'y1')})) AS rings")


@query(f"WITH n AS (SELECT n_name AS region_id, {SMALL} FROM nation), c AS (SELECT *, unnest(range(floor(x0 * 10)::bigint, ceil(x1 * 10)::bigint)) AS ix FROM n), e AS (SELECT *, unnest(range(floor(y0 * 10)::bigint, ceil(y1 * 10)::bigint)) AS iy FROM c), f AS (SELECT *, ix / 10::double AS a, (ix + 1) / 10::double AS b, iy / 10::double AS s, (iy + 1) / 10::double AS t FROM e) SELECT region_id, printf('grid_%.2f_%.2f', (ix + 0.5::double) / 10, (iy + 0.5::double) / 10) AS grid_id FROM f WHERE {MEETS}")
def region_cells(spark, d):
    """0.1 degree cells that share area with triangles."""
    return regions.region_cells(_small(spark, d)).select("region_id", "grid_id")


@query(f"WITH n AS (SELECT n_name AS region_id, {SMALL} FROM nation) SELECT region_id, printf('grid_%.2f_%.2f', (ix + 0.5::double) / 10, (iy + 0.5::double) / 10) AS cell FROM (SELECT *, unnest(range(floor(x0 * 10)::bigint, ceil(x1 * 10)::bigint)) AS ix FROM n), LATERAL (SELECT unnest(range(floor(y0 * 10)::bigint, ceil(y1 * 10)::bigint)) AS iy)")
def cells_from_bbox(spark, d):
    return lookup.cells_of_boxes(_small(spark, d).select("region_id", "x0", "x1", "y0", "y1")).select("region_id", "cell")


@query(f"WITH n AS (SELECT n_name AS region_id, {SMALL} FROM nation), c AS (SELECT region_id, printf('grid_%.2f_%.2f', (ix + 0.5::double) / 10, (iy + 0.5::double) / 10) AS cell FROM (SELECT *, unnest(range(floor(x0 * 10)::bigint, ceil(x1 * 10)::bigint)) AS ix FROM n), LATERAL (SELECT unnest(range(floor(y0 * 10)::bigint, ceil(y1 * 10)::bigint)) AS iy)) SELECT cell, string_agg(DISTINCT region_id, '|' ORDER BY region_id) AS regions FROM c GROUP BY cell")
def cell_intersections(spark, d):
    cells = lookup.cells_of_boxes(_small(spark, d).select("region_id", "x0", "x1", "y0", "y1"))
    return cells.groupBy("cell").agg(F.array_join(F.array_sort(F.collect_set("region_id")), "|").alias("regions"))


@query(with_sql("pts") + " SELECT DISTINCT split AS region_id, printf('grid_%.2f_%.2f', round(floor(lon * 10) / 10 + 0.05::double, 2), round(floor(lat * 10) / 10 + 0.05::double, 2)) AS grid_id FROM pts")
def region_points(spark, d):
    return regions.region_points(relation(spark, d, "pts").withColumnRenamed("split", "region_id")).select("region_id", "grid_id")


@query(with_sql("tiles") + ", areas AS (SELECT r_name AS region_id, CAST(-175 + 7 * r_regionkey AS DOUBLE) AS a, CAST(-60 + 45 * r_regionkey AS DOUBLE) AS b, CAST(-50 + 10 * r_regionkey AS DOUBLE) AS s, CAST(10 + 10 * r_regionkey AS DOUBLE) AS t FROM region) SELECT areas.region_id, grid_id FROM areas JOIN tiles ON " + MEETS)
def region_tiles_polygons(spark, d):
    """Areas against triangular tiles: shared area, not shared bounds."""
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    areas = table(spark, d, "region").selectExpr("r_name AS region_id", "CAST(-175 + 7 * r_regionkey AS DOUBLE) AS x0", "CAST(-60 + 45 * r_regionkey AS DOUBLE) AS x1", "CAST(-50 + 10 * r_regionkey AS DOUBLE) AS y0", "CAST(10 + 10 * r_regionkey AS DOUBLE) AS y1")
    areas = areas.selectExpr("region_id", f"array(array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('x1', 'y1')}, {p('x0', 'y1')})) AS rings")
    return regions.region_tiles(areas, _triangles(spark, d), tile="grid_id", span=20.0)


# ---- prototypes' companions


@query("SELECT o_custkey AS polygon_id, o_orderkey AS sample_id, CASE WHEN o_custkey % 4 = 0 THEN 't' || o_custkey ELSE o_orderpriority END AS tile_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END, o_orderkey) = 1")
def anchor_rows(spark, d):
    flag = F.when(F.col("o_orderkey") % 7 == 0, F.element_at(F.array(F.lit("True"), F.lit("1"), F.lit("YES")), (F.col("o_orderkey") % 3 + 1).cast("int"))).otherwise("no")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("polygon_id"), F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("tile_id"), F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).alias("polygon_tile_id"), flag.alias("is_anchor"))
    return features.anchors(o).select("polygon_id", "sample_id", "tile_id")


@query(with_sql("vecs") + ", y AS (SELECT polygon_id, sample_id, vec_id, yr FROM vecs, (SELECT unnest([2017, 2018, 2019]) AS yr)), p AS (SELECT polygon_id, yr, count(*) AS n, count(*) FILTER (yr = 2017 OR vec_id % (polygon_id + 2) <> 0) AS ok FROM y GROUP BY ALL) SELECT polygon_id, max(n) AS n_points_polygon, bool_and(ok = n) AS complete_all_requested_years FROM p GROUP BY polygon_id")
def polygon_years(spark, d):
    """Polygons of three years, in which some vectors of the later years are zero; every row has to be valid."""
    v = relation(spark, d, "vecs").withColumn("year", F.explode(F.array(F.lit(2017), F.lit(2018), F.lit(2019))))
    gone = (F.col("year") > 2017) & (F.col("vec_id") % (F.col("polygon_id") + 2) == 0)
    v = v.withColumn("embedding", F.when(gone, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    p = features.polygon_prototypes(v, year="year")
    return features.polygon_table(p, features.anchors(relation(spark, d, "vecs").select("polygon_id", "sample_id")), [2017, 2018, 2019]).select("polygon_id", "n_points_polygon", "complete_all_requested_years")


# ---- exports and deliveries

EXPORTS = with_sql("vecs") + ", m AS (SELECT sample_id, vec_id, vec_id % 6 AS tile_id FROM vecs WHERE vec_id % 10 <> 9), e AS (SELECT sample_id, vec_id, yr AS year, CASE WHEN vec_id % 8 = 1 THEN 63 ELSE 64 END AS n FROM m, (SELECT unnest([2017, 2018]) AS yr) WHERE yr = 2017 OR vec_id % 5 <> 0)"


def _master(spark, d):
    return relation(spark, d, "vecs").where("vec_id % 10 <> 9").select("sample_id", (F.col("vec_id") % 6).alias("tile_id"))


def _exports(spark, d):
    v = relation(spark, d, "vecs").where("vec_id % 10 <> 9").withColumn("year", F.explode(F.array(F.lit(2017), F.lit(2018)))).where("year = 2017 OR vec_id % 5 <> 0")
    gap = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 8 == 1) & (i == 5), F.lit(float("nan")).cast("float")).otherwise(x))
    return v.select("sample_id", "year", gap.alias("embedding"))


@query(EXPORTS + " SELECT year, count(*) AS n_rows, count(*) FILTER (n = 64) AS n_complete, (SELECT count(*) FROM m) - count(*) AS missing_master_ids, sum(64 - n)::bigint AS nonfinite_values FROM e GROUP BY year")
def merge_qc(spark, d):
    m = _master(spark, d)
    return deliveries.merge_qc(m, deliveries.checked_exports(m, _exports(spark, d)))


@query(EXPORTS + " SELECT m.tile_id, count(*) FILTER (e.n = 64) AS n_retained, count(*) FILTER (e.n IS NULL OR e.n < 64) AS n_excluded FROM m LEFT JOIN (SELECT * FROM e WHERE year = 2018) e USING (sample_id) GROUP BY m.tile_id")
def complete_by_tile(spark, d):
    rows = deliveries.complete_rows(_master(spark, d), _exports(spark, d).where("year = 2018").drop("year"))
    return deliveries.counts_by_tile(rows)


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS id FROM nation), r(rule, subject) AS (
SELECT 'missing from the catalogue', id FROM n WHERE k % 6 = 1 UNION ALL SELECT 'not in the plan', id || '_x' FROM n WHERE k % 12 = 2 UNION ALL SELECT 'listed more than once', id FROM n WHERE k % 12 = 4
UNION ALL SELECT 'not complete', id FROM n WHERE k % 6 = 3 UNION ALL SELECT 'path escapes the output folder', id FROM n WHERE k % 6 = 5 UNION ALL SELECT 'years or bands differ from the plan', id FROM n WHERE k % 12 = 6
UNION ALL SELECT 'run summary is incomplete', NULL) SELECT * FROM r""")
def grid_delivery_rules(spark, d):
    """Every kind of broken rule of a grid delivery."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    path = F.concat(F.when(k % 6 == 5, "/out/../else/").otherwise("/out/run/"), "n_name")
    c = n.where(k % 6 != 1).select(F.col("n_name").alias("grid_id"), F.when(k % 6 == 3, "failed").otherwise("complete").alias("status"), path.alias("path"), F.array(F.lit(2017)).alias("years"), F.when(k % 12 == 6, 63).otherwise(64).alias("n_bands"), k.alias("k"))
    extra = c.where("k % 12 = 2").withColumn("grid_id", F.concat("grid_id", F.lit("_x")))
    c = c.unionByName(c.where("k % 12 = 4")).unionByName(extra).drop("k")
    report = spark.range(1).select(F.lit(24).cast("long").alias("completed"), F.lit(1).cast("long").alias("failed"))
    return deliveries.grid_delivery(n.select(F.col("n_name").alias("grid_id")), report, c, [2017], "/out/run")


@query("SELECT 'sample_count differs from the plan' AS rule, NULL AS subject UNION ALL SELECT 'complete and incomplete rows do not add up', NULL UNION ALL SELECT 'missing shard', 'shard_' || n_nationkey FROM nation WHERE n_nationkey % 9 = 2")
def point_delivery_rules(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("shard_"), F.col("n_nationkey").cast("string")).alias("path"))
    report = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("complete_rows"), F.lit(7).cast("long").alias("incomplete_rows"))
    return deliveries.point_delivery(report, n.select("path"), n.where("n_nationkey % 9 <> 2").select("path"), 1)


RULES = ("missing file", "file size differs from the manifest", "not 64 float32 bands", "grid differs from the manifest", "band names", "no-data value is not NaN", "tags")


@query("SELECT 'not in the manifest' AS rule, 'other_' || n_name || '.tif' AS subject FROM nation WHERE n_nationkey % 12 = 0 UNION ALL SELECT CASE n_nationkey % 9 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(RULES, 1)) + " END, n_name || '.tif' FROM nation WHERE n_nationkey % 9 BETWEEN 1 AND 7")
def raster_delivery_rules(spark, d):
    k = F.col("n_nationkey") % 9
    n = table(spark, d, "nation").withColumn("path", F.concat("n_name", F.lit(".tif")))
    grid_of = {"epsg": F.lit(32717), "a": F.lit(10.0), "b": F.lit(0.0), "c": F.lit(500000.0), "d": F.lit(0.0), "e": F.lit(-10.0), "f": F.lit(1e7), "width": F.lit(16), "height": F.lit(16)}
    manifest = n.select("path", F.lit(1000).alias("bytes"), F.col("n_name").alias("grid_id"), F.lit(2017).alias("year"), F.lit("s").alias("signature"), *[v.alias(c) for c, v in grid_of.items()])
    names = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.format_string("A%02d", i))
    tags = F.create_map(F.lit("year"), F.lit("2017"), F.lit("grid_id"), "n_name", F.lit("signature"), F.when(k == 7, "x").otherwise("s"))
    own = grid_of | {"width": F.when(k == 4, 17).otherwise(16)}
    headers = n.where(k != 1).select("n_nationkey", "path", F.when(k == 2, 999).otherwise(1000).alias("bytes"), F.when(k == 3, 63).otherwise(64).alias("count"), F.lit("float32").alias("dtype"), F.when(k == 5, F.reverse(names)).otherwise(names).alias("names"), F.when(k == 6, 0.0).otherwise(float("nan")).alias("nodata"), tags.alias("tags"), *[v.alias(c) for c, v in own.items()])
    other = headers.where("n_nationkey % 12 = 0").withColumn("path", F.concat(F.lit("other_"), "path"))
    return deliveries.raster_rules(headers.unionByName(other).drop("n_nationkey"), manifest)


@query("SELECT n_name AS grid_id, 2::bigint AS n_files, n_name || '/2017.tif' AS first_path, (1000 + n_nationkey + 1000 + n_nationkey)::bigint AS bytes, sha256(n_name || '|32717|500000.0|1.0E7|16|16|2017') AS first_signature FROM nation WHERE n_nationkey % 4 <> 3")
def export_manifest(spark, d):
    n = table(spark, d, "nation")
    c = n.select(F.col("n_name").alias("grid_id"), F.lit("mgrs").alias("scheme"), F.lit(32717).alias("epsg"), F.lit(500000.0).alias("x0"), F.lit(1e7).alias("y0"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.array(F.lit(2018), F.lit(2017)).alias("years"), F.when(F.col("n_nationkey") % 4 == 3, "pending").otherwise("complete").alias("status"))
    f = n.withColumn("year", F.explode(F.array(F.lit(2017), F.lit(2018)))).select(F.col("n_name").alias("grid_id"), "year", F.concat("n_name", F.lit("/"), F.col("year").cast("string"), F.lit(".tif")).alias("path"), (1000 + F.col("n_nationkey")).cast("long").alias("bytes"))
    m = deliveries.export_manifest(c, f)
    first = F.col("files")[0]
    return m.select("grid_id", F.size("files").cast("long").alias("n_files"), first["path"].alias("first_path"), F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x["bytes"]).alias("bytes"), first["signature"].alias("first_signature"))


@query("SELECT c_mktsegment, " + ", ".join(f"{q(e, 6)} AS {a}" for e, a in (("sum(abs(c_acctbal)) / 1e6", "total_km2"), ("sum(abs(c_acctbal)) FILTER (c_acctbal > 0) / 1e6", "valid_km2"), ("sum(abs(c_acctbal)) FILTER (c_acctbal > 0) * 100 / sum(abs(c_acctbal))", "valid_percent"))) + " FROM customer GROUP BY 1")
def coverage_summary(spark, d):
    area, ok = F.abs("c_acctbal"), F.col("c_acctbal") > 0
    stats = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum(area).alias("total_m2"), F.sum(F.when(ok, area)).alias("valid_m2"), F.sum(F.when(~ok, area).otherwise(0.0)).alias("missing_m2"))
    out = deliveries.coverage_summary(stats, ["c_mktsegment"])
    return out.select("c_mktsegment", *[r(c, 6).alias(c) for c in ("total_km2", "valid_km2", "valid_percent")])


@query(with_sql("badpts") + """, n AS (SELECT (SELECT count(*) FROM badpts WHERE trim(sample_id) = '') AS e, (SELECT sum(n) FROM (SELECT count(*) AS n FROM badpts WHERE sample_id <> '' GROUP BY sample_id) WHERE n > 1) AS d, (SELECT count(*) FROM badpts WHERE NOT (isfinite(lon) AND isfinite(lat))) AS f, (SELECT count(*) FROM badpts WHERE isfinite(lon) AND isfinite(lat) AND NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) AS o,
(SELECT count(*) FROM badpts) AS rows, (SELECT {c} FROM (SELECT count(*) AS n FROM badpts WHERE isfinite(lon) AND isfinite(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY lon, lat) WHERE n > 1) AS c)
SELECT false AS valid, concat_ws('; ', 'years outside 2017-2025: [2031]', CASE WHEN e > 0 THEN 'empty sample_id rows: ' || e END, CASE WHEN d > 0 THEN 'rows with duplicated sample_id: ' || d::bigint END, CASE WHEN f > 0 THEN 'rows with non-finite lon/lat: ' || f END, CASE WHEN o > 0 THEN 'rows outside lon [-180,180] or lat [-90,90]: ' || o END) AS errors, coalesce(c[1]::bigint || ' rows share coordinates in ' || c[2]::bigint || ' groups', '') AS warnings, 128 AS n_features, (SELECT max(n) FROM (SELECT count(*) AS n FROM badpts GROUP BY split)) AS most_split FROM n""".replace("{c}", "[sum(n), count(*)]"))
def preflight_verdict(spark, d):
    out = points.preflight_report(relation(spark, d, "badpts"), [2031, 2017], 1000)
    most = F.array_max(F.map_values(F.col("group_counts")["split"]))
    return out.select("valid", F.concat_ws("; ", "errors").alias("errors"), F.concat_ws("; ", "warnings").alias("warnings"), "n_features", most.alias("most_split"))


# ---- sources


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey % 300 + 10 >= 40 AND o_custkey % 300 <= 90 AND o_orderkey % 100 + 5 >= 20 AND o_orderkey % 100 <= 30")
def source_listing(spark, d):
    """Sources of one year that meet a box."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), *[(c).cast("double").alias(n) for n, c in (("west", F.col("o_custkey") % 300), ("east", F.col("o_custkey") % 300 + 10), ("south", F.col("o_orderkey") % 100), ("north", F.col("o_orderkey") % 100 + 5))])
    return readers.source_listing(o, 1996, (40.0, 20.0, 90.0, 30.0)).select("id")


@query("SELECT n_nationkey AS chunk, CASE n_nationkey % 3 WHEN 0 THEN '/abs/' || n_name WHEN 1 THEN 's3a://b/' || n_name ELSE '/data/store/' || n_name END AS path, row_number() OVER (ORDER BY n_nationkey)::int AS \"order\" FROM nation")
def shard_paths(spark, d):
    k = F.col("n_nationkey") % 3
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("chunk"), F.concat(F.when(k == 0, "/abs/").when(k == 1, "s3a://b/").otherwise(""), "n_name").alias("path"))
    return readers.resolve_shards(c, "/data/store/catalog.parquet")


@query("WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, p_size FROM part) SELECT p_partkey, CASE k WHEN 0 THEN '17MPU' WHEN 1 THEN '50RMV' WHEN 2 THEN '17MPU' END AS mgrs_candidate, CASE k WHEN 0 THEN 'grid_id:exact' WHEN 1 THEN 'filename:derived_name' WHEN 2 THEN 'parent_directory:exact' END AS mgrs_candidate_evidence, CASE WHEN k = 1 AND p_size % 2 = 0 THEN NULL ELSE (2017 + p_size % 9) END::int AS year, CASE WHEN k = 0 THEN 'tiff_year_tag' WHEN k = 1 AND p_size % 2 = 0 THEN 'unknown' ELSE CASE WHEN k = 3 THEN 'zarr_time' ELSE 'annual_filename' END END AS year_evidence, CASE WHEN k = 3 THEN 'other' WHEN k IN (0, 2) AND p_size % 3 = 0 THEN 'full_mgrs' ELSE 'mgrs_subset/reference' END AS footprint_class, CASE WHEN p_size % 3 = 1 THEN '30m_derivative_not_native_10m' WHEN p_size % 3 = 2 THEN 'other_or_unknown' ELSE '10m_grid_not_native_verified' END AS resolution_class FROM t")
def raster_inventory(spark, d):
    """Rasters whose tile is named by a tag, the file, the folder or not at all; whole tiles, other sizes, and other resolutions."""
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 4).withColumn("s", F.col("p_size") % 3).withColumn("y", (2017 + F.col("p_size") % 9).cast("int"))
    k, s, y = F.col("k"), F.col("s"), F.col("y").cast("string")
    path = F.when(k == 0, F.lit("/data/x/any.tif")).when(k == 1, F.concat(F.lit("/data/x/T50rmv_"), y, F.when(F.col("p_size") % 2 == 0, "_1999").otherwise(""), F.lit(".tif"))).when(k == 2, F.concat(F.lit("/data/17MPU/site_"), y, F.lit(".tif"))).otherwise("/data/x/site.zarr")
    step = F.when(s == 1, 30.0).otherwise(10.0)
    h = p.select(
        "p_partkey", path.alias("path"), F.when(k == 3, "zarr").otherwise("geotiff").alias("format"), F.lit(64).alias("band_count"), F.when(k == 0, "17MPU").when(k == 3, "site").alias("grid_tag"), F.lit(None).cast("string").alias("tile_tag"),
        F.when(k == 0, y).alias("year_tag"), F.when(k == 3, F.array("y")).alias("years"), F.when(s == 2, 4326).otherwise(32717).alias("epsg"), step.alias("a"), F.lit(0.0).alias("b"), F.lit(600000.0).alias("c"), F.lit(0.0).alias("d"), (-step).alias("e"), F.lit(9900040.0).alias("f"), F.lit(10980).alias("width"), F.lit(10980).alias("height"),
    )
    index = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "17MPU").otherwise(F.concat(F.lit("18MP"), F.substring("r_name", -1, 1))).alias("tile"), F.lit(32717).alias("epsg"), F.lit(600000.0).alias("x0"), F.lit(9900040.0).alias("y0"), F.lit(10980).alias("width"), F.lit(10980).alias("height"))
    return mosaic.inventory(h, index).select("p_partkey", "mgrs_candidate", "mgrs_candidate_evidence", "year", "year_evidence", "footprint_class", "resolution_class")


# ---- request logs, comparisons, signatures, plans

#: (status, exception name, message, class) of failed requests, a few for each way to tell them apart.
FAILURES = [
    (None, "TimeoutError", None, "timeout"), (503, "ReadTimeoutError", "x", "timeout"), (None, None, "The request timed out", "timeout"), (400, None, "Deadline exceeded here", "timeout"),
    (408, None, "x", "retryable"), (409, None, None, "retryable"), (425, None, "not found", "retryable"), (429, None, "", "retryable"), (500, None, "permission denied", "retryable"), (599, None, None, "retryable"),
    (400, None, "failed to generate", "permanent"), (401, None, None, "permanent"), (403, "ConnectionError", None, "permanent"), (404, None, None, "permanent"), (None, None, "Unknown band A99", "permanent"), (None, "ProtocolError", "invalid argument", "permanent"), (600, None, None, "permanent"),
    (None, "ChunkedEncodingError", None, "retryable"), (None, None, "Connection reset by peer", "retryable"), (None, None, "Rate limit reached", "retryable"), (None, "SSLEOFError", "", "retryable"), (200, None, "quota exceeded", "retryable"),
    (None, None, "failed to iterate", "permanent"), (None, None, None, "permanent"), (None, "ValueError", "separate", "permanent"),
]
_literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"


def _failures(spark, d):
    rows = F.array(*[F.struct(F.lit(s).cast("int").alias("status"), F.lit(k).cast("string").alias("kind"), F.lit(m).cast("string").alias("message")) for s, k, m, _ in FAILURES])
    return table(spark, d, "events").select("event_id", F.element_at(rows, (F.col("event_id") % len(FAILURES) + 1).cast("int")).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, c AS class FROM events JOIN (VALUES " + ", ".join(f"({i}, '{c}')" for i, (_, _, _, c) in enumerate(FAILURES)) + f") v(i, c) ON event_id % {len(FAILURES)} = i")
def error_classes(spark, d):
    return _failures(spark, d).select("event_id", audit.error_class(F.col("status"), F.col("message"), F.col("kind")).alias("class"))


#: Log lines and what is left of them.
LINES = [
    ("Authorization: Bearer ab.c-1, next", "Authorization: Bearer <redacted>, next"), ("access_token: x9 done", "access_token: <redacted> done"), ('{"refresh_token"="q"}', '{"refresh_token"="q"}'), ("client_secret='s3' kept", "client_secret=<redacted>' kept"),
    ("project gee-abc12-x used", "project <redacted-project> used"), ("id_token = t, GEE-Zzzzz9", "id_token = <redacted>, <redacted-project>"), ("token=plain stays", "token=plain stays"), ("gee-abc short", "gee-abc short"),
]


@query("SELECT event_id, t AS text FROM events JOIN (VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, (_, t) in enumerate(LINES)) + f") v(i, t) ON event_id % {len(LINES)} = i")
def redaction(spark, d):
    line = F.element_at(F.array(*[F.lit(t) for t, _ in LINES]), (F.col("event_id") % len(LINES) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", audit.redact(line).alias("text"))


@query(with_sql("pix") + """, k AS (SELECT DISTINCT floor(vec_id / 20)::bigint AS w FROM pix) SELECT w AS window, CASE w % 5 WHEN 0 THEN 'inconclusive_local_nodata' WHEN 1 THEN 'inconclusive_native_nodata' WHEN 2 THEN 'sample_native_match' WHEN 3 THEN 'cross_utm_source_match_at_differing_pixels' ELSE 'unresolved_difference_not_automatically_resampling' END AS outcome FROM k""")
def spot_check(spark, d):
    """Windows of 20 pixels of each outcome: no local data, no native data, a match, another zone's pixel, and neither."""
    p = relation(spark, d, "pix").withColumn("window", F.floor(F.col("vec_id") / 20).cast("long")).withColumn("k", F.col("window") % 5)
    # The planted pixel is each window's first, so that windows of fewer pixels have it too.
    p = p.withColumn("odd", F.col("vec_id") == F.min("vec_id").over(Window.partitionBy("window")))
    nan = F.lit(float("nan")).cast("float")
    blank = (F.col("k") == 2) & (F.col("vec_id") % 20 == 3) & ~F.col("odd")
    local = p.withColumn("embedding", F.transform("embedding", lambda x: F.when((F.col("k") == 0) | blank, nan).when((F.col("k") >= 3) & F.col("odd"), x + 1).otherwise(x)))
    native = p.withColumn("embedding", F.transform("embedding", lambda x: F.when((F.col("k") == 1) | blank, nan).otherwise(x)))
    foreign = p.where((F.col("k") >= 3) & ((F.col("vec_id") % 2 == 1) | F.col("odd"))).withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("k") == 3, x + 1).otherwise(x)))
    return audit.spot_check(local.select("window", "row", "col", "embedding"), native.select("row", "col", "embedding"), foreign.select("row", "col", "embedding"), ["row", "col"], "window")


_FOLD = ", l AS (SELECT substr(h, 1, 4) AS b, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM d GROUP BY 1), m AS (SELECT substr(b, 1, 2) AS c, sum(n) AS n, sha256(string_agg(b || h, ',' ORDER BY b || h)) AS h FROM l GROUP BY 1) SELECT sum(n)::bigint AS n_rows, sha256(string_agg(c || h, ',' ORDER BY c || h)) AS signature FROM m"


@query("WITH d AS (SELECT sha256('[\"' || o_orderkey || '\",\"' || o_custkey || '\",' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '\"' || o_orderpriority || '\"' END || ']') AS h FROM orders)" + _FOLD)
def content_signature(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return audit.content_signature(o, ["o_orderkey", "o_custkey", "p"])


@query(with_sql("pts") + ", d AS (SELECT sha256(sample_id || chr(9) || printf('%.10f', lon) || chr(9) || printf('%.10f', lat)) AS h FROM pts)" + _FOLD)
def sample_signature(spark, d):
    return audit.sample_signature(relation(spark, d, "pts"))


@query("SELECT n_nationkey, 268435456 + 4 * greatest(33554432, floor(2.5 * (64 * n_nationkey) * (64 * n_nationkey) * 256)::bigint) + 4 * (64 * n_nationkey)::bigint * (64 * n_nationkey) * 256 AS peak FROM nation")
def request_memory(spark, d):
    return table(spark, d, "nation").select("n_nationkey", budget.grid_peaks(64 * F.col("n_nationkey"), 4, 4).cast("long").alias("peak"))


@query("SELECT o_orderkey, CASE WHEN length(o_orderkey * 100003) < 8 THEN lpad((o_orderkey * 100003)::varchar, 8, '0') ELSE (o_orderkey * 100003)::varchar END AS id FROM orders".replace("length(o_orderkey * 100003)", "length((o_orderkey * 100003)::varchar)"))
def padded_numbers(spark, d):
    """Numbers of more than eight digits keep them all."""
    return table(spark, d, "orders").select("o_orderkey", store.padded(F.col("o_orderkey") * 100003, 8).alias("id"))


@query(with_sql("loc") + ", b AS (SELECT ord, 'g' || floor(x / 60)::bigint || '_' || floor(y / 60)::bigint AS block FROM loc), k AS (SELECT ord, block FROM b QUALIFY row_number() OVER (PARTITION BY block ORDER BY ord) <= 5) SELECT ord, block FROM k ORDER BY ord LIMIT 60")
def capped_selection(spark, d):
    """The first 60 points of at most five a block."""
    return cube.cap_per_block(relation(spark, d, "loc"), "x", "y", [F.col("ord")], 5, 60.0, target=60).select("ord", "block")


@query(with_sql("loc") + " SELECT ord, x - 5 * 10 + 10 * (ord % 7) AS x, y - 10 * (ord % 3) AS y FROM loc")
def window_origins(spark, d):
    o = grid.window_origin(F.col("x") - 50, F.col("y"), F.col("ord") % 3, F.col("ord") % 7)
    return relation(spark, d, "loc").select("ord", o.alias("o")).select("ord", "o.x", "o.y")


@query(f"SELECT vec_id, {q(f'list_sum({V})')} AS total FROM embeddings WHERE {NORM} > 1e-8 AND vec_id % 3 = 1")
def strict_vectors(spark, d):
    """A shard's complete rows, projected and filtered."""
    v = table(spark, d, "embeddings").withColumn("label", (F.col("vec_id") % 3).cast("string"))
    return store.label_rows(v).where(vec.valid(F.col("embedding"))).select("vec_id", r(F.aggregate(vec.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(with_sql("tiles") + " SELECT grid_id, 'representative' AS mode, " + q("(x0 + x1) / 2") + " AS x, " + q("(y0 + y1) / 2") + " AS y FROM tiles")
def representative_points(spark, d):
    """A point inside every triangle: the middle of its level line at half height."""
    p = geometry.rings_representative(F.array("ring"))
    return _triangles(spark, d).select("grid_id", F.lit("representative").alias("mode"), r(p["x"]).alias("x"), r(p["y"]).alias("y"))
