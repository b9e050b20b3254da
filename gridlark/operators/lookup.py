"""From areas to grid ids, and search over the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions import grid


def cells_of_boxes(boxes: DataFrame, per: int = 10) -> DataFrame:
    """Every box's cells of 1/per degree that it meets with positive area: boxes' columns, ix, iy, cell."""
    ix = F.sequence(F.floor(F.col("x0") * per).cast("long"), F.ceil(F.col("x1") * per).cast("long") - 1)
    iy = F.sequence(F.floor(F.col("y0") * per).cast("long"), F.ceil(F.col("y1") * per).cast("long") - 1)
    out = boxes.where("x0 < x1 AND y0 < y1").withColumn("ix", F.explode(ix)).withColumn("iy", F.explode(iy))
    name = lambda i: (F.col(i) + F.lit(0.5)) / per
    return out.withColumn("cell", F.format_string("grid_%.2f_%.2f", name("ix"), name("iy"))) if per == 10 else out.withColumn("cell", F.concat_ws("_", F.lit("cell"), "ix", "iy"))


def cells_of_points(points: DataFrame) -> DataFrame:
    """The half-open cell of each point in range."""
    return points.where(grid.in_range(F.col("lon"), F.col("lat"))).withColumn("cell", grid.cell_name(F.col("lon"), F.col("lat")))


def search_catalog(intersections: DataFrame) -> DataFrame:
    """One row per (scheme, grid_id): joined region ids and names, and the text to search."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    out = intersections.groupBy("scheme", "grid_id").agg(joined("region_id").alias("region_ids"), joined("region_name").alias("region_names"))
    return out.withColumn("search_text", F.lower(F.concat_ws(" ", "grid_id", "region_ids", "region_names")))


def search(catalog: DataFrame, text: str, scheme: str | None = None) -> DataFrame:
    """Rows whose text holds the query, letter case aside."""
    hit = F.col("search_text").contains(text.lower())
    return catalog.where(hit & (F.col("scheme") == scheme) if scheme else hit)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue rows replaced by key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def boxes_meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, span: float, touching: bool = False) -> DataFrame:
    """left_id, right_id of boxes (x0, x1, y0, y1) that share area, or only an edge where touching.

    Both sides are dealt into buckets of `span`; a pair is kept in the first bucket that both have, so none repeats.
    """
    cell = lambda c: F.floor(c / span)

    def dealt(df: DataFrame, key: str, p: str) -> DataFrame:
        out = df.select(F.col(key).alias(f"{p}id"), *[F.col(c).alias(p + c) for c in ("x0", "x1", "y0", "y1")])
        out = out.withColumn("__bx", F.explode(F.sequence(cell(F.col(p + "x0")), cell(F.col(p + "x1")))))
        return out.withColumn("__by", F.explode(F.sequence(cell(F.col(p + "y0")), cell(F.col(p + "y1")))))

    met = dealt(left, left_id, "l").join(dealt(right, right_id, "r"), ["__bx", "__by"])
    x0, x1 = F.greatest("lx0", "rx0"), F.least("lx1", "rx1")
    y0, y1 = F.greatest("ly0", "ry0"), F.least("ly1", "ry1")
    share = (x0 <= x1) & (y0 <= y1) if touching else (x0 < x1) & (y0 < y1)
    first = (cell(x0) == F.col("__bx")) & (cell(y0) == F.col("__by"))
    return met.where(share & first).select(F.col("lid").alias(left_id), F.col("rid").alias(right_id))


def select_ids(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """request_order and the rows of the wanted ids (letter case aside); ids that are not there keep a row, found false.

    The ids are literals of the plan, so that the scan can use them; their number is the caller's list.
    """
    ids = [w.strip().upper() for w in wanted]
    if len(set(ids)) != len(ids) or not ids:
        raise ValueError("ids have to be distinct, and one at least")
    order = df.sparkSession.createDataFrame(list(enumerate(ids)), "request_order int, __id string")
    rows = df.where(F.upper(F.col(key)).isin(ids)).withColumn("__id", F.upper(F.col(key)))
    out = order.join(rows.withColumn("found", F.lit(True)), "__id", "left")
    return out.withColumn(key, F.coalesce(F.col(key), F.col("__id"))).withColumn("found", F.coalesce("found", F.lit(False))).drop("__id")


def select_region(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The one row of an administrative area, given by its exact names; none or several are an error."""
    out = df
    for c, v in names.items():
        out = out.where(F.col(c) == v)
    n = out.limit(2).count()
    if n != 1:
        raise ValueError("no such area" if n == 0 else "the names fit several areas")
    return out.withColumn("admin_level", F.lit(len(names) - 1))


def dissolve(features: DataFrame, by: list[str], name: str, ring: str | None = None) -> DataFrame:
    """by, feature_count, joined distinct names and, where asked for, the parts as a list of rings (a multi-polygon)."""
    parts = [F.collect_list(ring).alias("rings")] if ring else []
    return features.groupBy(*by).agg(F.count(F.lit(1)).alias("feature_count"), F.array_join(F.array_sort(F.collect_set(name)), "|").alias("names"), *parts)


def ids_by(intersections: DataFrame, by: list[str]) -> DataFrame:
    """by and the sorted distinct grid ids."""
    return intersections.groupBy(*by).agg(F.array_sort(F.collect_set("grid_id")).alias("grid_ids")).withColumn("n_grids", F.size("grid_ids").cast("long"))


def lookup_report(intersections: DataFrame) -> DataFrame:
    """scheme, rows, distinct grids and regions."""
    return intersections.groupBy("scheme").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("grid_id").alias("n_grids"), F.countDistinct("region_id").alias("n_regions"))


def write_ids(intersections: DataFrame, folder: str) -> None:
    """Distinct ids as text, a folder by scheme."""
    intersections.select("scheme", "grid_id").distinct().repartition("scheme").sortWithinPartitions("scheme", "grid_id").write.partitionBy("scheme").text(folder)
