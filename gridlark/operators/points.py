"""Point tables: preflight audit, merging, completeness, chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import grid, vec

#: Fixed value: columns that a preflight report counts by.
GROUP_FIELDS = ("split", "label", "species", "mgrs_tile", "grid_id", "tile_id")


def duplicate_ids(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: groups and rows of ids that occur more than once, all members counted."""
    n = df.where(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    n = df.where(grid.in_range(F.col(lon), F.col(lat))).groupBy(lon, lat).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("coordinate_groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("coordinate_rows"))


def preflight(df: DataFrame, years: list[int], chunk_size: int = 10_000) -> DataFrame:
    """One row of counts: rows, empty ids, bad coordinates, duplicates, chunks, features.

    One scan: every row gives its id and its coordinates as keys of one aggregation, which is added up.
    """
    years = grid.years_argument(years)
    lon, lat = F.col("lon"), F.col("lat")
    name = F.trim(F.col("sample_id").cast("string"))
    finite = F.coalesce(vec.is_finite(lon) & vec.is_finite(lat), F.lit(False))
    inside = F.coalesce(grid.in_range(lon, lat), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    plain = lambda c: (c.cast("double") + F.lit(0.0)).cast("string")  # noqa: E731  (minus zero is zero)
    blank = F.coalesce(name, F.lit("")) == ""
    keys = F.array(
        F.struct(F.lit("i").alias("t"), F.when(~blank, F.col("sample_id").cast("string")).alias("k"), F.lit(1).alias("r"), flag(blank).alias("e"), flag(~finite).alias("f"), flag(finite & ~inside).alias("o")),
        F.struct(F.lit("c").alias("t"), F.when(inside, F.concat_ws(" ", plain(lon), plain(lat))).alias("k"), F.lit(0).alias("r"), F.lit(0).alias("e"), F.lit(0).alias("f"), F.lit(0).alias("o")),
    )
    n = df.select(F.explode(keys).alias("x")).groupBy("x.t", "x.k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x.{c}").alias(c) for c in "refo"])
    twice = lambda t: F.col("k").isNotNull() & (F.col("n") > 1) & (F.col("t") == t)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = n.agg(
        total("r").alias("n_rows"), total("e").alias("empty_ids"), total("f").alias("nonfinite"), total("o").alias("outside"),
        F.count_if(twice("i")).alias("duplicate_groups"), total(F.when(twice("i"), F.col("n"))).alias("duplicate_rows"),
        F.count_if(twice("c")).alias("coordinate_groups"), total(F.when(twice("c"), F.col("n"))).alias("coordinate_rows"),
    )
    return one.select("n_rows", "empty_ids", "nonfinite", "outside", F.ceil(F.col("n_rows") / chunk_size).cast("long").alias("n_chunks"), F.lit(len(years) * vec.BANDS).alias("n_features"), "duplicate_groups", "duplicate_rows", "coordinate_groups", "coordinate_rows")


def preflight_report(df: DataFrame, years: list[int], chunk_size: int = 10_000, most: int = 100) -> DataFrame:
    """One row: the counts of preflight, errors, warnings, group counts and the verdict.

    A table without one of the three columns, an empty one, and years out of range are errors of the report, not of the call.
    """
    missing = sorted({"sample_id", "lon", "lat"} - set(df.columns))
    wanted = sorted({int(y) for y in years})
    outside = [y for y in wanted if not grid.FIRST_YEAR <= y <= grid.LAST_YEAR]
    fixed = [f"missing required columns: {missing}"] * bool(missing) + ["chunk_size must be positive"] * (chunk_size <= 0) + ["at least one year is required"] * (not wanted) + [f"years outside {grid.FIRST_YEAR}-{grid.LAST_YEAR}: {outside}"] * bool(outside)
    counted = df
    for c, kind in (("sample_id", "string"), ("lon", "double"), ("lat", "double")):
        counted = counted.withColumn(c, F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind))
    counted = counted.withColumn("sample_id", F.trim("sample_id"))
    one = preflight(counted, [grid.LAST_YEAR], max(1, chunk_size)).withColumn("n_features", F.lit(len(wanted) * vec.BANDS))
    c = F.col
    count = lambda name, text: F.when(c(name) > 0, F.concat(F.lit(text + ": "), c(name).cast("string")))
    rows = [] if missing else [count("empty_ids", "empty sample_id rows"), count("duplicate_rows", "rows with duplicated sample_id"), count("nonfinite", "rows with non-finite lon/lat"), count("outside", "rows outside lon [-180,180] or lat [-90,90]")]
    errors = F.array(*[F.lit(t) for t in fixed], F.when(c("n_rows") == 0, F.lit("point table is empty")), *rows)
    shared = F.when(c("coordinate_rows") > 0, F.concat(c("coordinate_rows").cast("string"), F.lit(" rows share coordinates in "), c("coordinate_groups").cast("string"), F.lit(" groups")))
    warnings = F.array(F.lit(None).cast("string"), *([] if missing else [shared]))
    kept = lambda a: F.filter(a, lambda x: x.isNotNull())
    out = one.withColumn("errors", kept(errors)).withColumn("warnings", kept(warnings)).withColumn("valid", F.size("errors") == 0)
    fields = [f for f in GROUP_FIELDS if f in df.columns]
    if not fields:
        return out.withColumn("group_counts", F.create_map().cast("map<string,map<string,bigint>>"))
    groups = group_counts(df, fields, most).groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("m"))
    groups = groups.agg(F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("group_counts"))  # `most` values of a few fields
    return out.withColumn("group_counts", groups.scalar())


def group_counts(df: DataFrame, fields: list[str] | None = None, most: int = 100) -> DataFrame:
    """The `most` largest groups of each field, ties by value; null shows as <missing>."""
    fields = fields or [c for c in GROUP_FIELDS if c in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in fields])).alias("p")
    n = df.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)


def assign_chunks(df: DataFrame, order: str, size: int, key: str = "sample_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, order, the columns to carry, and chunk (from 1) by ordinal in input order, ties by key and then by content.

    Ordinals come from range partitions and their sizes, not from one sorted task. Rows keep
    their chunk with them, so repeated ones need no join back.
    """
    columns = list(dict.fromkeys([key, order, *carry]))
    ties = [order, key, F.xxhash64(*columns)]
    dealt = df.select(*columns).repartitionByRange(order, key).sortWithinPartitions(*ties).withColumn("__p", F.spark_partition_id())
    from gridlark.runtime import materialize

    dealt = materialize(dealt)
    before = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*ties))
    return dealt.withColumn("__i", within).join(F.broadcast(before), "__p").select(*columns, (F.floor((F.col("__n") + F.col("__i") - 1) / size) + 1).cast("long").alias("chunk"))


def merge_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join after checking that neither side repeats a key."""
    for side, name in ((left, "left"), (right, "right")):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{name} keys are not unique")
    return left.join(right, key, "left")


def merge_years(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of yearly exports."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def missing_ids(master: DataFrame, export: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side they are missing from."""
    a, b = master.select(key).distinct(), export.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unknown")))


def completeness(df: DataFrame, year: str = "year", vector: str = "embedding", finite: bool = False) -> DataFrame:
    """Rows and complete rows by year; finite: infinities do not count as present."""
    ok = vec.complete(F.col(vector)) if finite else vec.present(F.col(vector))
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_complete")).withColumn("fraction", F.col("n_complete") / F.col("n_rows"))


def background_qc(df: DataFrame, vector: str = "embedding", expected: int = 40_000) -> DataFrame:
    """One row: coverage, feature range, norm statistics (population deviation) and the verdict."""
    v = F.col(vector)
    rows = df.select(vec.complete(v).alias("ok"), vec.norm(v).alias("norm"), F.array_min(vec.doubles(v)).alias("lo"), F.array_max(vec.doubles(v)).alias("hi"))
    kept = lambda c: F.when(F.col("ok"), F.col(c))
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_retained"), F.min(kept("lo")).alias("feature_min"), F.max(kept("hi")).alias("feature_max"), F.min(kept("norm")).alias("norm_min"), F.max(kept("norm")).alias("norm_max"), F.avg(kept("norm")).alias("norm_mean"), F.stddev_pop(kept("norm")).alias("norm_std"))
    return out.withColumn("passed", (F.col("n_rows") == expected) & (F.col("n_retained") == expected))


def missing_text(c):
    """Null or blank as <MISSING>, else upper-case and trimmed."""
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("<MISSING>"))
