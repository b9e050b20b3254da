"""Registry of queries over the driver tables and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import crs, grid, vec
from gridlark.operators import audit, cube, features, geometry, lookup, points
from gridlark.plans.relations import relation, with_sql
from gridlark.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, n: int = 9):
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def q(e: str, n: int = 9) -> str:
    return f"round({e}, {n}) + 0.0::double"


V = "CAST(embedding AS DOUBLE[])"
NORM = f"sqrt(list_sum(list_transform({V}, lambda x: x * x)))"
UNIT = f"list_transform({V}, lambda x: x / {NORM})"
BANDS = "range(1, 65)"
PROTO = f"""
, u AS (SELECT polygon_id, weight, unnest({BANDS}) AS b, unnest({UNIT}) AS x FROM vecs),
m AS (SELECT polygon_id, b, sum(weight * x) / sum(weight) AS v, avg(x) AS e FROM u GROUP BY ALL),
p AS (SELECT polygon_id, sqrt(sum(v * v)) AS rl, list(v ORDER BY b) AS ws, sqrt(sum(e * e)) AS re, list(e ORDER BY b) AS es FROM m GROUP BY ALL),
c AS (SELECT v.polygon_id, v.weight AS w, greatest(-1.0::double, least(1.0::double, list_sum(list_transform(list_zip({UNIT}, p.ws), lambda z: z[1] * z[2])) / p.rl)) AS c FROM vecs v JOIN p USING (polygon_id))
"""


@query(with_sql("vecs") + PROTO + f"""
SELECT p.polygon_id, count(*) AS n_expected, count(*) AS n_valid, true AS prototype_valid, {q('any_value(rl)')} AS resultant_length,
  {q('sum(w * c) / sum(w)')} AS mean_cosine, {q('quantile_cont(c, 0.1)')} AS p10_cosine, {q('sum(w * degrees(acos(c))) / sum(w)', 6)} AS mean_angle, {q('any_value(ws)[1] / any_value(rl)')} AS first_band
FROM p JOIN c USING (polygon_id) GROUP BY p.polygon_id""")
def polygon_prototype(spark, d):
    out = features.polygon_prototypes(relation(spark, d, "vecs"))
    return out.select("polygon_id", "n_expected", "n_valid", "prototype_valid", r("resultant_length").alias("resultant_length"), r("mean_cosine").alias("mean_cosine"), r("p10_cosine").alias("p10_cosine"), r("mean_angle", 6).alias("mean_angle"), r(F.col("prototype")[0]).alias("first_band"))


@query(with_sql("vecs") + PROTO + f"SELECT polygon_id, {q('re')} AS resultant, unnest({BANDS}) - 1 AS band, {q('unnest(es) / re')} AS value FROM p")
def spherical_prototype(spark, d):
    out = features.spherical_prototype(relation(spark, d, "vecs"), ["polygon_id"])
    return out.select("polygon_id", r("resultant").alias("resultant"), F.posexplode("prototype").alias("band", "v")).select("polygon_id", "resultant", F.col("band").cast("long").alias("band"), r("v").alias("value"))


@query(f"SELECT vec_id, {q(f'list_sum({UNIT})')} AS total, {q(NORM)} AS norm FROM embeddings")
def l2_normalize(spark, d):
    u = vec.l2_normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", r(F.aggregate(u, F.lit(0.0), lambda s, x: s + x)).alias("total"), r(vec.norm(F.col("embedding"))).alias("norm"))


@query(with_sql("vecs") + PROTO.rstrip() + f""", e AS (SELECT v.vec_id, v.polygon_id, greatest(-1.0::double, least(1.0::double, list_sum(list_transform(list_zip({UNIT}, p.es), lambda z: z[1] * z[2])) / p.re)) AS c FROM vecs v JOIN p USING (polygon_id))
SELECT vec_id, polygon_id, {q('c')} AS cosine, {q('degrees(acos(c))', 5)} AS angle FROM e""")
def cosine_to_prototype(spark, d):
    v = relation(spark, d, "vecs")
    p = features.spherical_prototype(v, ["polygon_id"]).select("polygon_id", "prototype")
    met = v.join(p, "polygon_id")
    return met.select("vec_id", "polygon_id", r(vec.cosine(F.col("embedding"), F.col("prototype"))).alias("cosine"), r(vec.angle_degrees(F.col("embedding"), F.col("prototype")), 5).alias("angle"))


@query(with_sql("vecs") + PROTO + f"""SELECT a.polygon_id AS left_id, b.polygon_id AS right_id, {q('degrees(acos(least(1.0::double, list_sum(list_transform(list_zip(a.es, b.es), lambda z: z[1] * z[2])) / (a.re * b.re))))', 5)} AS angle
FROM p a JOIN p b ON a.polygon_id + 1 = b.polygon_id""")
def prototype_angle_pairs(spark, d):
    p = features.spherical_prototype(relation(spark, d, "vecs"), ["polygon_id"])
    b = p.select(F.col("polygon_id").alias("right_id"), F.col("prototype").alias("other"))
    met = p.join(b, p["polygon_id"] + 1 == b["right_id"])
    return met.select(F.col("polygon_id").alias("left_id"), "right_id", r(vec.angle_degrees(F.col("prototype"), F.col("other")), 5).alias("angle"))


@query(f"SELECT count(*) AS n_rows, 64::bigint AS n_columns, (64 * count(*) FILTER (vec_id % 11 = 0) + count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 7 = 0))::bigint AS missing, (64 * count(*) FILTER (vec_id % 11 = 0) + count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 7 = 0))::bigint AS nonfinite, count(*) FILTER (vec_id % 11 = 0 OR vec_id % 7 <> 0 AND vec_id % 5 = 0 OR {NORM} <= 1e-8) AS zero_norm, count(*) FILTER (vec_id % 11 <> 0 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0 AND {NORM} > 1e-8) AS valid FROM embeddings")
def feature_qc(spark, d):
    """Every 11th vector is all NaN, of the rest every 7th lacks its first value and every 5th is zero."""
    gone, first, zero = (F.col("vec_id") % k == 0 for k in (11, 7, 5))
    nan = F.lit(float("nan")).cast("float")
    v = F.transform("embedding", lambda x, i: F.when(gone | (first & (i == 0)), nan).when(zero & ~first, F.lit(0.0).cast("float")).otherwise(x))
    return features.feature_qc(table(spark, d, "embeddings").withColumn("embedding", v))


@query(f"SELECT label, count(*) AS n_valid FROM embeddings WHERE {NORM} > 1e-8 GROUP BY label")
def valid_rows(spark, d):
    return table(spark, d, "embeddings").where(vec.valid(F.col("embedding"))).groupBy("label").agg(F.count(F.lit(1)).alias("n_valid"))


def _annual(spark, d):
    """Three years of every vector, scaled by whole numbers."""
    y = F.explode(F.array(F.lit(2017), F.lit(2018), F.lit(2019)))
    k = F.when(F.col("year") == 2017, 1).when(F.col("year") == 2018, 1 + F.col("vec_id") % 3).otherwise(2)
    out = table(spark, d, "embeddings").withColumn("year", y).withColumn("k", k.cast("double"))
    return out.select(F.col("vec_id").alias("sample_id"), "year", F.transform("embedding", lambda x: x.cast("double") * F.col("k")).alias("embedding"))


ANN = f"WITH ann AS (SELECT vec_id AS sample_id, y AS year, list_transform({V}, lambda x: x * CASE y WHEN 2017 THEN 1 WHEN 2018 THEN 1 + vec_id % 3 ELSE 2 END) AS e FROM embeddings, (SELECT unnest([2017, 2018, 2019]) AS y))"


@query(ANN + f""", l AS (SELECT sample_id, year, unnest({BANDS}) - 1 AS band, unnest(e) AS x FROM ann)
SELECT sample_id, band, {q('avg(x)')} AS mean, {q('stddev_pop(x)')} AS std, {q('max_by(x, year) - min_by(x, year)')} AS delta, {q('regr_slope(x, year - 2017)')} AS slope FROM l GROUP BY sample_id, band""")
def fuse_temporal_stats(spark, d):
    out = features.fuse_years(_annual(spark, d)).select("sample_id", F.posexplode("fused").alias("band", "s"))
    return out.select("sample_id", F.col("band").cast("long").alias("band"), *[r(F.col(f"s.{c}")).alias(c) for c in ("mean", "std", "delta", "slope")])


@query(ANN + f" SELECT sample_id, count(*) * 64 AS width, {q('list_sum(max_by(e, year))')} AS last_sum FROM ann GROUP BY sample_id")
def fuse_concat(spark, d):
    f = features.fuse_years(_annual(spark, d), mode="concat")
    return f.select("sample_id", F.size("fused").cast("long").alias("width"), r(F.aggregate(F.slice("fused", -64, 64), F.lit(0.0), lambda s, x: s + x)).alias("last_sum"))


@query("SELECT vec_id AS sample_id, vec_id % 4 <> 0 AS usable FROM embeddings")
def window_matrix_mask(spark, d):
    return features.window_mask(_annual(spark, d).where("NOT (sample_id % 4 = 0 AND year = 2018)"), [2017, 2018, 2019])


@query(with_sql("pts") + ", y AS (SELECT DISTINCT year FROM pts) SELECT a.year AS end_year, l AS length, (a.year - l + 1)::int AS first_year FROM y a, (SELECT unnest([1, 2, 3, 5])::int AS l) WHERE (SELECT count(*) FROM y b WHERE b.year BETWEEN a.year - l + 1 AND a.year) = l")
def trailing_windows(spark, d):
    return features.trailing_windows(relation(spark, d, "pts"), [1, 2, 3, 5])


@query(f"SELECT vec_id, y AS year, {q(f'list_sum({V})')} AS total FROM embeddings, (SELECT unnest([2017, 2018]) AS y)")
def wide_to_long(spark, d):
    e = table(spark, d, "embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[b].alias(c) for y in (2017, 2018) for b, c in enumerate(vec.band_columns(y))])
    return features.wide_to_long(wide, ["vec_id"]).select("vec_id", "year", r(F.aggregate(vec.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(with_sql("badpts") + """, i AS (SELECT count(*) AS g, coalesce(sum(n), 0)::bigint AS n FROM (SELECT count(*) AS n FROM badpts WHERE sample_id <> '' GROUP BY sample_id) WHERE n > 1),
c AS (SELECT count(*) AS g, coalesce(sum(n), 0)::bigint AS n FROM (SELECT count(*) AS n FROM badpts WHERE isfinite(lon) AND isfinite(lat) AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY lon, lat) WHERE n > 1)
SELECT (SELECT count(*) FROM badpts) AS n_rows, (SELECT count(*) FROM badpts WHERE sample_id = '') AS empty_ids, (SELECT count(*) FROM badpts WHERE NOT (isfinite(lon) AND isfinite(lat))) AS nonfinite,
(SELECT count(*) FROM badpts WHERE isfinite(lon) AND isfinite(lat) AND NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)) AS outside, (SELECT ceil(count(*) / 1000)::bigint FROM badpts) AS n_chunks, 128 AS n_features,
i.g AS duplicate_groups, i.n AS duplicate_rows, c.g AS coordinate_groups, c.n AS coordinate_rows FROM i, c""")
def preflight_report(spark, d):
    return points.preflight(relation(spark, d, "badpts"), [2017, 2025], 1000)


@query(with_sql("dups") + " SELECT count(*) AS duplicate_groups, sum(n)::bigint AS duplicate_rows FROM (SELECT count(*) AS n FROM dups GROUP BY sample_id) WHERE n > 1")
def duplicate_ids(spark, d):
    return points.duplicate_ids(relation(spark, d, "dups"))


@query(with_sql("dups") + " SELECT count(*) AS coordinate_groups, sum(n)::bigint AS coordinate_rows FROM (SELECT count(*) AS n FROM dups GROUP BY lon, lat) WHERE n > 1")
def duplicate_coordinates(spark, d):
    return points.duplicate_coordinates(relation(spark, d, "dups"))


@query(with_sql("badpts") + ", p AS (SELECT 'split' AS field, split AS value FROM badpts UNION ALL SELECT 'label', label FROM badpts), n AS (SELECT field, value, count(*) AS n FROM p GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::int AS rank FROM n QUALIFY rank <= 100")
def group_counts_top100(spark, d):
    return points.group_counts(relation(spark, d, "badpts"))


@query(with_sql("loc", "pix") + " SELECT l.year, count(*) AS n_rows, count(p.vec_id) AS n_complete, " + q("count(p.vec_id) / count(*)::double") + " AS fraction FROM loc l LEFT JOIN pix p ON p.row = floor((10000000 - l.y) / 10) AND p.col = floor((l.x - 500000) / 10) GROUP BY l.year")
def annual_completeness(spark, d):
    got = cube.sample_points(cube.locate(relation(spark, d, "loc"), "x", "y", 500000, 10000000), relation(spark, d, "pix"))
    return points.completeness(got).withColumn("fraction", r("fraction"))


@query(with_sql("pts") + " SELECT sample_id, ord, (floor((row_number() OVER (ORDER BY ord) - 1) / 1000) + 1)::bigint AS chunk FROM pts")
def chunk_assignment(spark, d):
    return points.assign_chunks(relation(spark, d, "pts"), "ord", 1000)


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def one_to_one_merge(spark, d):
    return points.merge_one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("WITH a AS (SELECT vec_id, label AS y2017 FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id, label AS y2018 FROM embeddings WHERE vec_id % 3 = 0), c AS (SELECT vec_id, label AS y2019 FROM embeddings WHERE vec_id % 5 = 0) SELECT * FROM a FULL JOIN b USING (vec_id) FULL JOIN c USING (vec_id)")
def multi_year_outer_merge(spark, d):
    e = table(spark, d, "embeddings")
    return points.merge_years([e.where(f"vec_id % {k} = 0").select("vec_id", F.col("label").alias(f"y{y}")) for k, y in ((2, 2017), (3, 2018), (5, 2019))], "vec_id")


@query("SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id + 7, 'unknown' FROM labels WHERE doc_id + 7 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'absent' FROM documents WHERE false")
def missing_ids(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    a = points.missing_ids(docs, labels, "doc_id").where("side = 'missing'")
    b = points.missing_ids(docs, labels.select((F.col("doc_id") + 7).alias("doc_id")), "doc_id").where("side = 'unknown'")
    return a.unionByName(b)


@query(f"SELECT count(*) AS n_rows, count(*) AS n_retained, {q(f'min(list_min({V}))')} AS feature_min, {q(f'max(list_max({V}))')} AS feature_max, {q(f'min({NORM})')} AS norm_min, {q(f'max({NORM})')} AS norm_max, {q(f'avg({NORM})')} AS norm_mean, {q(f'stddev_pop({NORM})')} AS norm_std, count(*) = 500 AS passed FROM embeddings")
def background_qc(spark, d):
    out = points.background_qc(table(spark, d, "embeddings"), expected=500)
    return out.select("n_rows", "n_retained", *[r(c).alias(c) for c in ("feature_min", "feature_max", "norm_min", "norm_max", "norm_mean", "norm_std")], "passed")


@query(with_sql("pts") + " SELECT sample_id, round(floor(lon * 10) / 10 + 0.05::double, 2) AS cell_lon, round(floor(lat * 10) / 10 + 0.05::double, 2) AS cell_lat, printf('grid_%.2f_%.2f', round(floor(lon * 10) / 10 + 0.05::double, 2), round(floor(lat * 10) / 10 + 0.05::double, 2)) AS cell FROM pts")
def tessera_cell(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    return relation(spark, d, "pts").select("sample_id", grid.cell_centre(lon).alias("cell_lon"), grid.cell_centre(lat).alias("cell_lat"), grid.cell_name(lon, lat).alias("cell"))


@query(with_sql("pts") + " SELECT (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, floor((lon + 180) / 6)::int + 1)))::int AS epsg, count(*) AS n FROM pts GROUP BY 1")
def utm_zone(spark, d):
    return relation(spark, d, "pts").groupBy(grid.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")).agg(F.count(F.lit(1)).alias("n"))


def _utm_sql() -> str:
    e = "eta" + "".join(f" + ({a!r}::double) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    n = "xi" + "".join(f" + ({a!r}::double) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.ALPHA, 1))
    ecc = f"({crs.E1!r}::double)"
    return with_sql("pts") + f""", z AS (SELECT *, least(60, greatest(1, floor((lon + 180) / 6)::int + 1)) AS zone FROM pts),
a AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sin(radians(lat)) AS s FROM z),
t AS (SELECT *, sinh(atanh(s) - {ecc} * atanh({ecc} * s)) AS t FROM a),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t)
SELECT sample_id, {q(f'500000 + ({crs.K0 * crs.R!r}::double) * ({e})', 3)} AS x, {q(f'CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + ({crs.K0 * crs.R!r}::double) * ({n})', 3)} AS y FROM x"""


@query(_utm_sql())
def utm_project(spark, d):
    p = relation(spark, d, "pts")
    x, y = crs.utm(F.col("lon"), F.col("lat"), grid.utm_zone(F.col("lon")), F.col("lat") < 0)
    return p.select("sample_id", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("SELECT 0.0::double AS error, count(*) AS n FROM orders")
def utm_round_trip(spark, d):
    """Points projected and back: the largest error in degrees, which rounds to zero."""
    p = relation(spark, d, "pts").withColumn("z", grid.utm_zone(F.col("lon"))).withColumn("s", F.col("lat") < 0)
    x, y = crs.utm(F.col("lon"), F.col("lat"), F.col("z"), F.col("s"))
    lon, lat = crs.utm_inverse(F.col("x"), F.col("y"), F.col("z"), F.col("s"))
    err = F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat")))
    return p.withColumn("x", x).withColumn("y", y).agg(F.round(F.max(err), 7).alias("error"), F.count(F.lit(1)).alias("n"))


@query(with_sql("loc") + " SELECT ord, floor((x + 3) / 10) * 10 AS xmin, ceil((x + 17) / 10) * 10 AS xmax, floor((y - 8) / 10) * 10 AS ymin, ceil((y + 5) / 10) * 10 AS ymax, round((ceil((x + 17) / 10) * 10 - floor((x + 3) / 10) * 10) / 10)::bigint AS width FROM loc")
def snap_grid_spec(spark, d):
    x0, x1 = grid.snapped(F.col("x") + 3, F.col("x") + 17)
    y0, y1 = grid.snapped(F.col("y") - 8, F.col("y") + 5)
    f = lambda c, n: c.cast("double").alias(n)
    return relation(spark, d, "loc").select("ord", f(x0, "xmin"), f(x1, "xmax"), f(y0, "ymin"), f(y1, "ymax"), F.round((x1 - x0) / 10).cast("long").alias("width"))


@query(with_sql("loc", "pix") + " SELECT l.ord, p.vec_id FROM loc l LEFT JOIN pix p ON p.row = floor((10000000 - l.y) / 10) AND p.col = floor((l.x - 500000) / 10)")
def pixel_lookup(spark, d):
    return cube.sample_points(cube.locate(relation(spark, d, "loc"), "x", "y", 500000, 10000000), relation(spark, d, "pix").drop("embedding")).select("ord", "vec_id")


@query(with_sql("loc") + " SELECT ord, (10000000 - y) / 10 < 20 AND (x - 500000) / 10 < 25 AS inside FROM loc")
def contains_points(spark, d):
    p = cube.locate(relation(spark, d, "loc"), "x", "y", 500000, 10000000)
    return p.select("ord", cube.contains(p, 20, 25).alias("inside"))


@query(with_sql("pix") + " SELECT row - 2 AS row, col - 3 AS col, vec_id FROM pix WHERE row >= 2 AND row < 9 AND col >= 3 AND col < 40")
def window_read(spark, d):
    return cube.window(relation(spark, d, "pix"), 2, 9, 3, 40).select("row", "col", "vec_id")


@query(with_sql("pix") + " SELECT row - 1 AS row, col - 2 AS col, vec_id FROM pix WHERE row >= 1 AND row < 4 AND col >= 2 AND col < 6")
def bbox_read(spark, d):
    r0, r1, c0, c1 = cube.bbox_window(500000, 10000000, (500025, 9999965, 500051, 9999985))
    return cube.window(relation(spark, d, "pix"), r0, r1, c0, c1).select("row", "col", "vec_id")


@query(with_sql("loc", "pix") + ", c AS (SELECT ord, floor((10000000 - y) / 10) AS r, floor((x - 500000) / 10) AS c FROM loc), o AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)), g AS (SELECT c.ord, dr, dc, p.vec_id FROM c, o LEFT JOIN pix p ON p.row = c.r + dr AND p.col = c.c + dc) SELECT ord, count(vec_id) AS n_filled, string_agg(coalesce(vec_id::varchar, '-'), ',' ORDER BY dr, dc) AS patch FROM g GROUP BY ord")
def patch_extract(spark, d):
    p = cube.patches(cube.locate(relation(spark, d, "loc"), "x", "y", 500000, 10000000), relation(spark, d, "pix"), "ord", 3, "vec_id")
    return p.select("ord", "n_filled", F.array_join(F.transform("patch", lambda v: v.cast("string")), ",", "-").alias("patch"))


@query(with_sql("pts", "tiles") + " SELECT p.ord, min(t.grid_id) AS grid_id FROM pts p LEFT JOIN tiles t ON p.lon >= t.x0 AND p.lon < t.x1 AND p.lat >= t.y0 AND p.lat < t.y1 GROUP BY p.ord")
def route_first_match(spark, d):
    return cube.route_first(relation(spark, d, "pts"), relation(spark, d, "tiles"), "ord")


@query(with_sql("pts", "tiles") + ", w AS (SELECT grid_id, x0 - 4 AS x0, x1 + 4 AS x1, y0 - 4 AS y0, y1 + 4 AS y1 FROM tiles), m AS (SELECT p.ord, t.grid_id, least(p.lon - x0, x1 - p.lon, p.lat - y0, y1 - p.lat) AS m FROM pts p JOIN w t ON p.lon >= t.x0 AND p.lon <= t.x1 AND p.lat >= t.y0 AND p.lat <= t.y1) SELECT ord, grid_id, " + q("m") + " AS margin FROM m QUALIFY row_number() OVER (PARTITION BY ord ORDER BY m DESC, grid_id) = 1")
def choose_grid(spark, d):
    w = relation(spark, d, "tiles").selectExpr("grid_id", "x0 - 4 AS x0", "x1 + 4 AS x1", "y0 - 4 AS y0", "y1 + 4 AS y1")
    return cube.choose_grid(relation(spark, d, "pts"), w, "ord").withColumn("margin", r("margin"))


def _intersections(spark, d):
    n, g = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(g, n["n_regionkey"] == g["r_regionkey"]).select(F.when(F.col("n_nationkey") % 2 == 0, "mgrs").otherwise("tessera_0p1").alias("scheme"), F.substring("n_name", 1, 8).alias("grid_id"), F.col("r_regionkey").cast("string").alias("region_id"), F.col("r_name").alias("region_name"))


CAT = "WITH i AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'mgrs' ELSE 'tessera_0p1' END AS scheme, substr(n_name, 1, 8) AS grid_id, r_regionkey::varchar AS region_id, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT scheme, grid_id, string_agg(DISTINCT region_id, '|' ORDER BY region_id) AS region_ids, string_agg(DISTINCT region_name, '|' ORDER BY region_name) AS region_names FROM i GROUP BY ALL), c AS (SELECT *, lower(grid_id || ' ' || region_ids || ' ' || region_names) AS search_text FROM s)"


@query(CAT + " SELECT * FROM c")
def search_catalog(spark, d):
    return lookup.search_catalog(_intersections(spark, d))


@query(CAT + " SELECT scheme, grid_id FROM c WHERE contains(search_text, 'a') AND scheme = 'mgrs'")
def search(spark, d):
    return lookup.search(lookup.search_catalog(_intersections(spark, d)), "A", "mgrs").select("scheme", "grid_id")


BLOCKS = "WITH g AS (SELECT n_name AS grid_id, 1000 + 10 * n_nationkey AS h, 700 + n_regionkey AS w FROM nation), b AS (SELECT grid_id, br AS block_row, bc AS block_col, least(256, h - br)::bigint AS height, least(256, w - bc)::bigint AS width FROM g, LATERAL (SELECT unnest(range(0, h, 256)) AS br), LATERAL (SELECT unnest(range(0, w, 256)) AS bc))"


def _blocks(spark, d):
    g = table(spark, d, "nation").select(F.col("n_name").alias("grid_id"), (1000 + 10 * F.col("n_nationkey")).cast("long").alias("height"), (700 + F.col("n_regionkey")).cast("long").alias("width"))
    return cube.block_plan(g)


@query(BLOCKS + " SELECT * FROM b")
def block_plan(spark, d):
    return _blocks(spark, d)


@query(BLOCKS + " SELECT grid_id, block_row, block_col FROM b WHERE (block_row + block_col) % 512 <> 0")
def pending_blocks(spark, d):
    b = _blocks(spark, d).select("grid_id", "block_row", "block_col")
    return cube.pending(b, b.where("(block_row + block_col) % 512 = 0"), ["grid_id", "block_row", "block_col"])


@query("SELECT o_custkey, o_orderkey AS source FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) = 1")
def native_source_pick(spark, d):
    o = table(spark, d, "orders")
    return cube.pick_source(o, "o_custkey", [F.col("o_orderpriority") != "1-URGENT", F.col("o_orderkey")], F.col("o_orderstatus") != "P").select("o_custkey", F.col("o_orderkey").alias("source"))


@query(f"WITH p AS (SELECT {V} AS a, list_transform({V}, lambda x: CASE WHEN vec_id % 7 = 0 THEN x + 1 ELSE x END) AS b FROM embeddings), z AS (SELECT list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS dif FROM p) SELECT count(*) AS n_vectors, count(*) AS n_complete, count(*) FILTER (list_max(dif) = 0) AS n_exact, 0::bigint AS mask_disagreements, {q('max(list_max(dif))', 6)} AS max_difference, {q('sum(list_sum(dif)) / (count(*) * 64)', 6)} AS mean_difference FROM z")
def window_compare(spark, d):
    e = table(spark, d, "embeddings")
    moved = e.select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 7 == 0, x.cast("double") + 1).otherwise(x.cast("double"))).alias("embedding"))
    out = audit.compare(e, moved, ["vec_id"])
    return out.select("n_vectors", "n_complete", "n_exact", "mask_disagreements", r("max_difference", 6).alias("max_difference"), r("mean_difference", 6).alias("mean_difference"))


@query(with_sql("reqlog") + f" SELECT event, count(*) AS n, {q('quantile_cont(latency, 0.5)')} AS p50, {q('quantile_cont(latency, 0.95)')} AS p95, max(latency) AS max FROM reqlog GROUP BY event")
def latency_percentiles(spark, d):
    return audit.latency(relation(spark, d, "reqlog")).withColumn("p50", r("p50")).withColumn("p95", r("p95"))


@query(f"SELECT c_mktsegment, {q('sum(abs(c_acctbal))', 4)} AS total, {q('sum(CASE WHEN c_acctbal > 0 THEN abs(c_acctbal) ELSE 0 END)', 4)} AS valid, {q('sum(CASE WHEN c_acctbal > 0 THEN abs(c_acctbal) ELSE 0 END) * 100 / sum(abs(c_acctbal))', 6)} AS valid_percent FROM customer GROUP BY 1")
def coverage_percent(spark, d):
    c = table(spark, d, "customer").withColumn("area", F.abs("c_acctbal"))
    out = audit.coverage(c, "area", F.col("c_acctbal") > 0, ["c_mktsegment"])
    return out.select("c_mktsegment", r("total", 4).alias("total"), r("valid", 4).alias("valid"), r("valid_percent", 6).alias("valid_percent"))


@query(with_sql("loc") + ", b AS (SELECT ord, 'g' || floor(x / 60)::bigint || '_' || floor(y / 60)::bigint AS block FROM loc) SELECT ord, block, row_number() OVER (PARTITION BY block ORDER BY ord)::int AS block_rank FROM b QUALIFY block_rank <= 5")
def spatial_block_cap(spark, d):
    return cube.cap_per_block(relation(spark, d, "loc"), "x", "y", [F.col("ord")], 5, 60.0).select("ord", "block", "block_rank")


@query(with_sql("loc") + ", n AS (SELECT DISTINCT x, y FROM loc WHERE ord % 50 = 0) SELECT ord FROM loc l WHERE NOT EXISTS (SELECT 1 FROM n WHERE sqrt((l.x - n.x) * (l.x - n.x) + (l.y - n.y) * (l.y - n.y)) < 7)")
def nearest_negative_exclusion(spark, d):
    p = relation(spark, d, "loc")
    return cube.exclude_near(p, p.where("ord % 50 = 0"), "ord", "x", "y", 7.0).select("ord")


@query(with_sql("loc") + " SELECT ord, CASE WHEN ord % 5 = 4 THEN false ELSE (x - 500000) % 10 = 0 AND (10000000 - y) % 10 = 0 AND ord % 5 <> 3 END AS matches, ord % 5 = 0 AND (x - 500000) % 10 = 0 AND (10000000 - y) % 10 = 0 AS aligned FROM loc")
def footprint_match(spark, d):
    """Grids at every point: as they are, flipped, with swapped axes, sheared or in another zone."""
    k = F.col("ord") % 5
    n = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (k + 1).cast("int"))
    one = {"ua": 10.0, "ub": 0.0, "uc": 500000.0, "ud": 0.0, "ue": -10.0, "uf": 10000000.0}
    rows = relation(spark, d, "loc").withColumns({c: F.lit(v) for c, v in one.items()} | {"uepsg": F.lit(32717), "vepsg": F.when(k == 4, 32650).otherwise(32717)})
    rows = rows.withColumns({"va": n(10, 10, 0, 10, 10), "vb": n(0, 0, 10, 1, 0), "vc": F.col("x"), "vd": n(0, 0, 10, 0, 0), "ve": n(-10, 10, 0, -10, -10), "vf": F.col("y")})
    return rows.select("ord", grid.footprint_relation("u", "v").alias("g")).select("ord", "g.matches", "g.aligned")


@query("SELECT n_name AS grid_id, n_regionkey AS version FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_name, n_regionkey + 10 FROM nation WHERE n_nationkey % 3 = 0")
def catalog_upsert(spark, d):
    n = table(spark, d, "nation")
    return lookup.upsert(n.select(F.col("n_name").alias("grid_id"), F.col("n_regionkey").alias("version")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("grid_id"), (F.col("n_regionkey") + 10).alias("version")), ["grid_id"])


@query("WITH a AS (SELECT o_custkey AS k, bool_and(o_orderstatus <> 'P') AS done FROM orders GROUP BY 1) SELECT count(c_custkey) AS n_expected, count(done) AS n_delivered, count(*) FILTER (c_custkey IS NOT NULL AND done IS NULL) AS n_missing, count(*) FILTER (c_custkey IS NULL) AS n_unexpected, count(*) FILTER (NOT done) AS n_incomplete FROM customer FULL JOIN a ON c_custkey = k")
def delivery_check(spark, d):
    return audit.delivery_check(table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", F.col("o_orderstatus") != "P")


@query(f"SELECT l_returnflag, count(*) AS calls, {q('sum(l_quantity)', 4)} AS total, {q('avg(l_quantity)', 6)} AS mean, {q('quantile_cont(l_quantity, 0.5)')} AS median, {q('quantile_cont(l_quantity, 0.95)')} AS p95, min(l_quantity) AS min, max(l_quantity) AS max, {q('sum(l_extendedprice) / sum(l_quantity)', 4)} AS rate FROM lineitem GROUP BY 1")
def benchmark_summary(spark, d):
    out = audit.benchmark_summary(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "calls", r("total", 4).alias("total"), r("mean", 6).alias("mean"), r("median").alias("median"), r("p95").alias("p95"), "min", "max", r("rate", 4).alias("rate"))


@query(BLOCKS + f" SELECT grid_id, {q('sum(height * width) * 2 * 64 * 4 / 1073741824.0::double', 9)} AS raw_gib FROM b GROUP BY grid_id")
def raw_size_plan(spark, d):
    g = table(spark, d, "nation").select(F.col("n_name").alias("grid_id"), (1000 + 10 * F.col("n_nationkey")).alias("h"), (700 + F.col("n_regionkey")).alias("w"))
    return g.select("grid_id", r(audit.raw_gib(F.col("h"), F.col("w"), 2)).alias("raw_gib"))


@query(with_sql("reqlog") + " SELECT worker, count(*) AS n_events, max_by(event, (ts, event_id)) AS last_event FROM reqlog GROUP BY worker")
def event_progress(spark, d):
    return audit.progress(relation(spark, d, "reqlog"), "worker", ["ts", "event_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '<MISSING>' ELSE upper(trim(c_mktsegment)) END AS segment FROM customer")
def normalised_class(spark, d):
    return table(spark, d, "customer").select("c_custkey", points.missing_text(F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))).alias("segment"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::int AS point_rank FROM orders")
def point_rank(spark, d):
    return features.nth_rank(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "point_rank")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, " + q("sum(value)", 4) + " AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from gridlark.streaming.events import windowed

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed(e, "ts", "event_type")
    return out.select(F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"), "event_type", "n", r("total", 4).alias("total"))


def _triangles(spark, d):
    """A triangle in each box: lower corners and the middle of the top edge."""
    t = relation(spark, d, "tiles")
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    return t.selectExpr("grid_id", f"array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('(x0 + x1) / 2', 'y1')}) AS ring")


@query(with_sql("tiles") + " SELECT grid_id, " + q("(x1 - x0) * (y1 - y0) / 2") + " AS area, " + q("(x0 + x1) / 2") + " AS cx, " + q("(2 * y0 + y1) / 3") + " AS cy FROM tiles")
def polygon_area_centroid(spark, d):
    c = geometry.centroid(F.col("ring"))
    return _triangles(spark, d).select("grid_id", r(geometry.signed_area(F.col("ring"))).alias("area"), r(c["x"]).alias("cx"), r(c["y"]).alias("cy"))


@query(with_sql("pts", "tiles") + " SELECT ord, grid_id FROM pts JOIN tiles ON lat > y0 AND lat < y1 AND (y1 - y0) * (lon - x0) > (x1 - x0) / 2 * (lat - y0) AND (y1 - y0) * (x1 - lon) > (x1 - x0) / 2 * (lat - y0)")
def point_in_polygon(spark, d):
    return geometry.points_in_polygons(relation(spark, d, "pts"), _triangles(spark, d), 10.0, "lon", "lat").select("ord", "grid_id")


@query(with_sql("tiles") + ", c AS (SELECT grid_id, x0, x1, y0, y1, unnest(range(floor((100 - y1) / 1)::bigint, (floor((100 - y0) / 1) + 1)::bigint)) AS row FROM tiles), e AS (SELECT *, unnest(range(floor(x0)::bigint, (floor(x1) + 1)::bigint)) AS col FROM c) SELECT grid_id, count(*) AS n FROM (SELECT *, col + 0.5::double AS x, 100 - (row + 0.5::double) AS y FROM e) WHERE y > y0 AND y < y1 AND (y1 - y0) * (x - x0) > (x1 - x0) / 2 * (y - y0) AND (y1 - y0) * (x1 - x) > (x1 - x0) / 2 * (y - y0) GROUP BY grid_id")
def interior_pixels(spark, d):
    return geometry.interior_pixels(_triangles(spark, d), 0.0, 100.0, 1.0).groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def farthest_points(spark, d):
    p = relation(spark, d, "loc").withColumn("g", F.col("ord") % 20)
    return geometry.farthest_points(p, "g", "ord", "x", "y", 5)
