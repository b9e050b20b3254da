"""More queries with their SQL: point stores, mosaics, patches, areas, inventories, logs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.catalogue import NORM, V, _triangles, q, query, r
from gridlark.functions import crs, grid
from gridlark.operators import audit, cube, geometry, lookup, mosaic, store
from gridlark.plans.relations import relation, with_sql
from gridlark.runtime import table


def _shards(spark, d):
    """Vectors in shards of 70; every 13th lacks its vector's last band."""
    v = relation(spark, d, "vecs").withColumn("embedding", F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return store.shards(v, "vec_id", 70)


SHARDS = with_sql("vecs") + ", s AS (SELECT sample_id, vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 70 + 1)::bigint AS chunk, vec_id % 13 <> 0 AS complete FROM vecs)"


@query(SHARDS + " SELECT chunk, count(*) AS rows, count(*) FILTER (complete) AS complete_rows FROM s GROUP BY chunk")
def shard_catalog(spark, d):
    return store.shard_catalog(_shards(spark, d))


@query(SHARDS + ", c AS (SELECT chunk, count(*) + CASE WHEN chunk % 3 = 0 THEN 1 ELSE 0 END AS e FROM s WHERE chunk > 1 GROUP BY chunk UNION ALL SELECT 999::bigint, 5::bigint), h AS (SELECT chunk, count(*) AS a FROM s GROUP BY chunk) SELECT chunk, coalesce(e, 0)::bigint AS expected, coalesce(a, 0)::bigint AS actual, coalesce(e, 0) = coalesce(a, 0) AS matches FROM c FULL JOIN h USING (chunk)")
def shard_row_counts(spark, d):
    s = _shards(spark, d)
    wrong = store.shard_catalog(s).where("chunk > 1").select("chunk", (F.col("rows") + (F.col("chunk") % 3 == 0).cast("int")).alias("rows"))
    extra = wrong.sparkSession.range(1).select(F.lit(999).cast("long").alias("chunk"), F.lit(5).cast("long").alias("rows"))
    return store.verify_counts(s, wrong.unionByName(extra))


@query(with_sql("pts") + ", a AS (SELECT DISTINCT ord, lon, lat FROM pts WHERE ord % 5 <> 0), b AS (SELECT ord, CASE WHEN ord % 11 = 0 THEN lon + 0.001::double ELSE lon END AS lon, lat FROM pts WHERE ord % 7 <> 0) SELECT count(*) FILTER (a.ord IS NOT NULL AND b.ord IS NOT NULL) AS n_shared, count(*) FILTER (b.ord IS NULL) AS n_missing, count(*) FILTER (a.ord IS NULL) AS n_unexpected, count(*) FILTER (a.ord IS NOT NULL AND b.ord IS NOT NULL AND abs(a.lon - b.lon) > 1e-7) AS n_moved FROM a FULL JOIN b ON a.ord = b.ord")
def compare_coordinates(spark, d):
    p = relation(spark, d, "pts")
    moved = p.where("ord % 7 <> 0").withColumn("lon", F.when(F.col("ord") % 11 == 0, F.col("lon") + 0.001).otherwise(F.col("lon")))
    return store.compare_coordinates(p.where("ord % 5 <> 0"), moved, "ord", ["lon", "lat"])


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 4 = 1")
def label_rows(spark, d):
    label = F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("event_id") % 4).cast("string"))
    return store.label_rows(table(spark, d, "events").withColumn("label", label)).select("event_id")


@query("SELECT o_orderkey, 'feature_' || lpad((row_number() OVER (ORDER BY o_orderkey))::varchar, 8, '0') AS sample_id FROM orders")
def base_identifier(spark, d):
    return store.identify(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "sample_id")


@query("SELECT o_orderkey, o_custkey || '_px' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS sample_id FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def pixel_sample_id(spark, d):
    from gridlark.operators.features import nth_rank

    return store.pixel_ids(nth_rank(table(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")]), "o_custkey").select("o_orderkey", "sample_id")


@query("WITH n AS (SELECT count(*)::double AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS groups, " + ", ".join(f"{q(e, 6)} AS {a}" for e, a in (("avg(n)", "mean"), ("stddev_samp(n)", "std"), ("min(n)", "min"), ("quantile_cont(n, 0.25)", "p25"), ("quantile_cont(n, 0.5)", "p50"), ("quantile_cont(n, 0.75)", "p75"), ("max(n)", "max"))) + " FROM n")
def sampling_inventory(spark, d):
    return store.describe_groups(table(spark, d, "orders"), "o_custkey").select("groups", *[r(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _sources(spark, d):
    """Three overlapping sources over the raster; each lacks some pixels' last band."""
    p = relation(spark, d, "pix").withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    gap = (F.col("vec_id") + F.ascii("source")) % 3 == 0
    return p.withColumn("embedding", F.when(gap, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))).where("source <> 'a' OR vec_id % 5 <> 0")


@query(with_sql("pix") + ", s AS (SELECT row, col, source FROM pix, (SELECT unnest(['a', 'b', 'c']) AS source) WHERE (vec_id + ascii(source)) % 3 <> 0 AND (source <> 'a' OR vec_id % 5 <> 0)) SELECT row, col, min(source) AS source, 64::bigint AS width FROM s GROUP BY row, col")
def native_mosaic(spark, d):
    return mosaic.priority_mosaic(_sources(spark, d), ["row", "col"], "source").select("row", "col", "source", F.size("embedding").cast("long").alias("width"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 0 WHEN vec_id % 4 = 0 THEN 63 ELSE 64 END::bigint AS n_finite, vec_id % 9 <> 0 AND vec_id % 4 <> 0 AS usable, CASE WHEN vec_id % 9 <> 0 AND vec_id % 4 <> 0 THEN {q(f'list_sum({V})')} END AS total FROM embeddings")
def decode_and_mask(spark, d):
    sent = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 50)).when(F.col("vec_id") % 4 == 0, F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, F.lit(-9999.0).cast("float")).otherwise(x))).otherwise(F.col("embedding"))
    v = table(spark, d, "embeddings").select("vec_id", mosaic.decode(sent).alias("v"))
    n = F.coalesce(F.size(F.filter("v", lambda x: ~F.isnan(x))), F.lit(0))
    total = F.aggregate(mosaic.masked(F.col("v")), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.when(F.col("v").isNull(), 0).otherwise(n).cast("long").alias("n_finite"), mosaic.masked(F.col("v")).isNotNull().alias("usable"), r(total).alias("total"))


@query("WITH b AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 1 THEN 'v1' END AS version, n_nationkey % 5 AS k FROM nation) SELECT id, CASE k WHEN 1 THEN 'no_version' WHEN 2 THEN 'bands' WHEN 3 THEN 'not_utm' WHEN 4 THEN 'bands_differ' END AS reason FROM b")
def source_validation(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("k"))
    b = n.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(63))))
    one = lambda v: F.lit(float(v))
    return mosaic.source_errors(
        b.select(
            "id", "ord", F.when(F.col("k") != 1, "v1").alias("version"), F.format_string("A%02d", F.when((F.col("k") == 2) & (F.col("ord") > 61), 125 - F.col("ord")).otherwise(F.col("ord"))).alias("band"),
            F.when(F.col("k") == 3, 4326).otherwise(32649).alias("epsg"), one(10).alias("a"), one(0).alias("b"), F.when((F.col("k") == 4) & (F.col("ord") == 9), 1.0).otherwise(0.0).alias("c"), one(0).alias("d"), one(10).alias("e"), one(0).alias("f"), F.lit(16384).alias("width"), F.lit(16384).alias("height"),
        )
    )


@query(with_sql("loc") + f" SELECT ord, {q('(x - 500000) / 10', 6)} AS dx, {q('(10000000 - y) / 10', 6)} AS dy, (x - 500000) % 10 = 0 AND (10000000 - y) % 10 = 0 AS aligned FROM loc")
def grid_relation(spark, d):
    rel = mosaic.relation(F.lit(500000.0), F.lit(10000000.0), F.col("x"), F.col("y"))
    return relation(spark, d, "loc").select("ord", rel.alias("g")).select("ord", r("g.dx", 6).alias("dx"), r("g.dy", 6).alias("dy"), "g.aligned")


@query(with_sql("pix") + f" SELECT tile, count(*) AS n_pixels, count(*) FILTER (vec_id % 13 <> 0) AS n_complete, count(*) FILTER (vec_id % 17 = 0 AND vec_id % 13 <> 0) AS n_zero, {q('min(CASE WHEN vec_id % 13 <> 0 THEN CASE WHEN vec_id % 17 = 0 THEN 0 ELSE ' + NORM + ' END END)')} AS norm_min, {q('count(*) FILTER (vec_id % 13 <> 0) / count(*)::double')} AS fraction FROM pix GROUP BY tile")
def pixel_scan(spark, d):
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 13 == 0, F.lit(float("nan")).cast("float")).when(F.col("vec_id") % 17 == 0, F.lit(0.0).cast("float")).otherwise(x))
    out = mosaic.scan(relation(spark, d, "pix").withColumn("embedding", v), ["tile"])
    return out.select("tile", "n_pixels", "n_complete", "n_zero", r("norm_min").alias("norm_min"), r("fraction").alias("fraction"))


@query("SELECT count(*) FILTER (vec_id % 5 = 0) AS left_only, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 7 = 0 AND false) AS right_only, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 3 = 0) AS n_different FROM embeddings")
def cube_equality(spark, d):
    p = relation(spark, d, "pix")
    other = p.where("vec_id % 5 <> 0").withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 3 == 0, x + 1).otherwise(x)))
    return mosaic.cube_difference(p, other, ["row", "col"])


@query(with_sql("loc", "pix") + ", c AS (SELECT ord, floor((10000000 - y) / 10)::bigint AS r, floor((x - 500000) / 10)::bigint AS c FROM loc), o AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)), g AS (SELECT c.ord, p.vec_id FROM c, o LEFT JOIN pix p ON p.row = c.r + dr AND p.col = c.c + dc AND p.tile = c.r // 8) SELECT ord, count(vec_id) AS n_filled, " + q("count(vec_id) / 9::double") + " AS patch_valid_fraction, count(vec_id) = 9 AS patch_complete FROM g GROUP BY ord")
def tile_patches(spark, d):
    """Patches that do not reach beyond the tile of their centre, with their quality."""
    at = cube.locate(relation(spark, d, "loc"), "x", "y", 500000, 10000000).withColumn("tile", F.floor(F.col("row") / 8).cast("long"))
    p = cube.patch_quality(cube.patches(at, relation(spark, d, "pix"), "ord", 3, "vec_id", within=("tile",)), 3)
    return p.select("ord", "n_filled", r("patch_valid_fraction").alias("patch_valid_fraction"), "patch_complete")


@query(with_sql("pix") + " SELECT vec_id, 500000 + (col + 0.5::double) * 10 AS x, 10000000 - (row + 0.5::double) * 10 AS y FROM pix")
def pixel_centres(spark, d):
    return relation(spark, d, "pix").select("vec_id", grid.pixel_centre(F.col("col"), F.lit(500000.0), 10.0).alias("x"), grid.pixel_centre(F.col("row"), F.lit(10000000.0), -10.0).alias("y"))


@query("WITH b AS (SELECT n_name AS key, (3 + n_nationkey)::bigint AS h, (2 + n_regionkey * 2)::bigint AS w FROM nation), s AS (SELECT key, i, j, CASE WHEN h <= 6 THEN 0 WHEN i = 0 THEN 0 ELSE h // 2 END AS row, CASE WHEN w <= 6 THEN 0 WHEN j = 0 THEN 0 ELSE w // 2 END AS col, CASE WHEN h <= 6 THEN h WHEN i = 0 THEN h // 2 ELSE h - h // 2 END AS height, CASE WHEN w <= 6 THEN w WHEN j = 0 THEN w // 2 ELSE w - w // 2 END AS width, h > 6 OR w > 6 AS cut, CASE WHEN w > 6 THEN 2 ELSE 1 END AS across FROM b, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE (i = 0 OR h > 6) AND (j = 0 OR w > 6)) SELECT CASE WHEN cut THEN key || '/split' || (i * across + j) ELSE key END AS key, row::bigint AS row, col::bigint AS col, height, width FROM s")
def split_blocks(spark, d):
    b = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), (3 + F.col("n_nationkey")).cast("long").alias("height"), (2 + 2 * F.col("n_regionkey")).cast("long").alias("width"))
    return mosaic.split_blocks(b, 6)


@query("SELECT n_name, ((8 + n_nationkey - least(16, 8 + n_nationkey)) // 2)::bigint AS row, ((20 - 16) // 2)::bigint AS col, least(16, 8 + n_nationkey)::bigint AS height, 16::bigint AS width FROM nation")
def centre_probe(spark, d):
    return table(spark, d, "nation").select("n_name", mosaic.centre_probe(8 + F.col("n_nationkey"), F.lit(20), 16).alias("p")).select("n_name", "p.row", "p.col", "p.height", "p.width")


def _mgrs_sql() -> str:
    e = "eta" + "".join(f" + ({a!r}::double) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    n = "xi" + "".join(f" + ({a!r}::double) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    ecc, k = f"({crs.E1!r}::double)", f"({crs.K0 * crs.R!r}::double)"
    zone = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lon >= 33 AND lon < 42 THEN 37 ELSE least(60, greatest(1, floor((lon + 180) / 6)::int + 1)) END"
    return with_sql("pts") + f""", z AS (SELECT *, {zone} AS zone FROM pts), a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM z),
t AS (SELECT *, sinh(atanh(s) - {ecc} * atanh({ecc} * s)) AS t FROM a), x AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t),
m AS (SELECT *, 500000 + {k} * ({e}) AS x, CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + {k} * ({n}) AS y FROM x)
SELECT lpad(zone::varchar, 2, '0') || substr('{crs.BAND_LETTERS}', least(19, floor((lat + 80) / 8)::bigint) + 1, 1) || substr('{crs.COLUMN_LETTERS}', ((zone - 1) % 3) * 8 + floor(x / 100000)::bigint, 1) || substr('{crs.ROW_LETTERS}', (floor(y / 100000)::bigint + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1) AS tile, count(*) AS n FROM m GROUP BY 1"""


@query(_mgrs_sql())
def mgrs_tile(spark, d):
    return crs.mgrs_tiles(relation(spark, d, "pts")).groupBy(F.col("mgrs_tile").alias("tile")).agg(F.count(F.lit(1)).alias("n"))


def _areas(spark, d):
    """Regions' boxes: a strip across all tiles, half a cell higher."""
    return table(spark, d, "region").selectExpr("r_name AS region_id", "CAST(-175 + 7 * r_regionkey AS DOUBLE) AS x0", "CAST(-60 + 45 * r_regionkey AS DOUBLE) AS x1", "CAST(-50 + 10 * r_regionkey AS DOUBLE) AS y0", "CAST(10 + 10 * r_regionkey AS DOUBLE) AS y1")


AREAS = with_sql("tiles") + ", areas AS (SELECT r_name AS region_id, CAST(-175 + 7 * r_regionkey AS DOUBLE) AS x0, CAST(-60 + 45 * r_regionkey AS DOUBLE) AS x1, CAST(-50 + 10 * r_regionkey AS DOUBLE) AS y0, CAST(10 + 10 * r_regionkey AS DOUBLE) AS y1 FROM region)"


@query(AREAS + " SELECT a.region_id, t.grid_id FROM areas a JOIN tiles t ON a.x0 < t.x1 AND t.x0 < a.x1 AND a.y0 < t.y1 AND t.y0 < a.y1")
def region_tiles(spark, d):
    return lookup.boxes_meet(_areas(spark, d), relation(spark, d, "tiles").select("grid_id", "x0", "x1", "y0", "y1"), "region_id", "grid_id", 30.0)


@query(AREAS + " SELECT a.region_id, t.grid_id FROM areas a JOIN tiles t ON a.x0 <= t.x1 AND t.x0 <= a.x1 AND a.y0 <= t.y1 AND t.y0 <= a.y1")
def region_tiles_touching(spark, d):
    return lookup.boxes_meet(_areas(spark, d), relation(spark, d, "tiles").select("grid_id", "x0", "x1", "y0", "y1"), "region_id", "grid_id", 30.0, touching=True)


@query("SELECT o AS request_order, n_name, n_regionkey, true AS found FROM nation JOIN (VALUES (0, 'NATION_3'), (2, 'NATION_1')) v(o, k) ON n_name = k UNION ALL SELECT o, k, NULL, false FROM (VALUES (0, 'NATION_3'), (1, 'NOWHERE'), (2, 'NATION_1')) v(o, k) WHERE k NOT IN (SELECT n_name FROM nation)")
def select_ids(spark, d):
    return lookup.select_ids(table(spark, d, "nation").select("n_name", "n_regionkey"), "n_name", ["nation_3", "nowhere", "NATION_1"])


@query("SELECT r_name, count(*) AS feature_count, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_dissolve(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    return lookup.dissolve(n.join(g, n["n_regionkey"] == g["r_regionkey"]), ["r_name"], "n_name")


IDS = "WITH i AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'mgrs' ELSE 'tessera_0p1' END AS scheme, n_name AS grid_id, n_regionkey AS region_id FROM nation UNION ALL SELECT 'mgrs', n_name, n_regionkey + 1 FROM nation WHERE n_nationkey % 4 = 0)"


def _ids(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.when(F.col("n_nationkey") % 2 == 0, "mgrs").otherwise("tessera_0p1").alias("scheme"), F.col("n_name").alias("grid_id"), F.col("n_regionkey").alias("region_id"))
    return a.unionByName(n.where("n_nationkey % 4 = 0").select(F.lit("mgrs").alias("scheme"), F.col("n_name").alias("grid_id"), (F.col("n_regionkey") + 1).alias("region_id")))


@query(IDS + " SELECT region_id, scheme, string_agg(DISTINCT grid_id, ',' ORDER BY grid_id) AS grid_ids, count(DISTINCT grid_id) AS n_grids FROM i GROUP BY 1, 2")
def ids_by_region(spark, d):
    return lookup.ids_by(_ids(spark, d), ["region_id", "scheme"]).withColumn("grid_ids", F.array_join("grid_ids", ","))


@query(IDS + " SELECT scheme, count(*) AS n_rows, count(DISTINCT grid_id) AS n_grids, count(DISTINCT region_id) AS n_regions FROM i GROUP BY 1")
def lookup_report(spark, d):
    return lookup.lookup_report(_ids(spark, d))


@query(with_sql("pts", "tiles") + ", p AS (SELECT ord, lon, lat FROM pts) SELECT ord FROM p WHERE NOT EXISTS (SELECT 1 FROM tiles WHERE greatest(x0 - lon, 0, lon - x1) * greatest(x0 - lon, 0, lon - x1) + greatest(y0 - lat, 0, lat - y1) * greatest(y0 - lat, 0, lat - y1) <= 4)")
def exclude_around(spark, d):
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    boxes = relation(spark, d, "tiles").selectExpr(f"array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('x1', 'y1')}, {p('x0', 'y1')}) AS ring")
    return geometry.exclude_around(relation(spark, d, "pts"), boxes, 2.0, 12.0, "ord", "lon", "lat").select("ord")


@query(with_sql("tiles") + ", t AS (SELECT grid_id, (x1 - x0) / 2 AS m, y1 - y0 AS h, greatest(0.0::double, least(y1, 15.0::double) - y0) AS k FROM tiles) SELECT grid_id, " + q("CASE WHEN k >= h THEN m * h ELSE m * h - (h - k) * (m * (h - k) / h) END", 6) + " AS area FROM t")
def clip_area(spark, d):
    """Areas of the tiles' triangles below 15 degrees north."""
    return _triangles(spark, d).select("grid_id", r(F.abs(geometry.signed_area(geometry.clip(F.col("ring"), -180.0, 180.0, -60.0, 15.0))), 6).alias("area"))


@query("SELECT c_custkey, least(12, greatest(1, ceil(abs(c_acctbal) / 1000)))::int AS target FROM customer")
def target_points(spark, d):
    return table(spark, d, "customer").select("c_custkey", geometry.target_points(F.abs("c_acctbal") * 10, 1.0, 12).alias("target"))


@query()
def polygon_inventory(spark, d):
    """Spread points of every triangle; random-free, but the pole search has no SQL."""
    return geometry.sample_polygons(_triangles(spark, d), "grid_id", 0.001, 12)


@query()
def background_points(spark, d):
    b = geometry.background(spark, 5000, 7, -180.0, 180.0, -60.0, 75.0)
    return cube.cap_per_block(b, "x", "y", [F.col("draw")], 3, 20.0)


def _log(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("EVENT "), F.to_json(F.struct("event_id", F.col("user_id").alias("grid"), F.col("event_type").alias("event"))))
    return e.select(F.when(F.col("event_id") % 10 == 0, "progress 10%").otherwise(line).alias("value"))


@query("SELECT user_id AS grid, count(*) AS n_events, max_by(event_type, event_id) AS last_event FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def parse_log(spark, d):
    return audit.progress(audit.parse_log(_log(spark, d), "EVENT", "event_id long, grid long, event string"), "grid", ["event_id"])


@query("SELECT count(*) AS n_reports, count(DISTINCT event_type) AS n_workflows, " + q("quantile_cont(value, 0.5)") + " AS median_peak, max(value) AS max_peak, bool_or(event_type = 'click') AND bool_or(event_type = 'view' AND value > 1) AS calibration_ready FROM events")
def report_summary(spark, d):
    e = table(spark, d, "events")
    return audit.report_summary(e, "value", "event_type", [F.col("event_type") == "click", (F.col("event_type") == "view") & (F.col("value") > 1)]).withColumn("median_peak", r("median_peak"))


@query(with_sql("pix") + " SELECT tile, count(*) AS n_probes, bool_and(vec_id % 101 <> 0) AS passed FROM pix GROUP BY tile")
def probes_pass(spark, d):
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 101 == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    return audit.probes_pass(relation(spark, d, "pix").withColumn("embedding", v), "tile")


@query(with_sql("tiles") + " SELECT region_id, count(*) AS n_tiles, abs(min(x0) + 180) < 1e-6 AND abs(max(x1) - 30) < 1e-6 AND abs(min(y0) + 50) < 1e-6 AND abs(max(y1) + 30) < 1e-6 AS matches FROM tiles GROUP BY 1")
def mosaic_contract(spark, d):
    return mosaic.mosaic_contract(relation(spark, d, "tiles"), "region_id", -180.0, 30.0, -50.0, -30.0)


@query("WITH g AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    from gridlark.streaming.events import sessions

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return sessions(e, "ts", "user_id").select("user_id", plain("start"), plain("end"), "n")
