"""Deliveries: merged exports and their quality, rule tables over plans, catalogues and raster headers, manifests, shards of patches."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import vec
from gridlark.operators import audit, points
from gridlark.plans import budget


def _all_finite(v: Column) -> Column:
    return vec.complete(v)


def checked_exports(master: DataFrame, exports: DataFrame, key: str = "sample_id", year: str = "year") -> DataFrame:
    """exports (key, year, vector), after checks: a year that repeats an id, or an id that the master lacks, is an error."""
    twice = exports.groupBy(year, key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the exports of {twice[0][0]} repeat an id: {twice[0][1]}")
    extra = exports.join(master, key, "left_anti").select(key).limit(5).collect()
    if extra:
        raise ValueError(f"ids that the master lacks: {[r[0] for r in extra]}")
    return exports


def merge_qc(master: DataFrame, exports: DataFrame, key: str = "sample_id", year: str = "year", vector: str = "embedding") -> DataFrame:
    """year, rows, complete rows, master ids without a row and values that are not finite, of long exports."""
    ids = master.select(key).distinct()
    v = F.col(vector)
    bad = F.lit(vec.BANDS) - F.coalesce(F.size(F.filter(v, vec.is_finite)), F.lit(0))
    known = exports.join(ids.withColumn("__known", F.lit(True)), key, "left")
    one = known.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(_all_finite(v)).alias("n_complete"), F.countDistinct(F.when(F.col("__known"), F.col(key))).alias("__met"), F.sum(bad).cast("long").alias("nonfinite_values"))
    total = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    return one.select(year, "n_rows", "n_complete", (total - F.col("__met")).alias("missing_master_ids"), "nonfinite_values")


def complete_rows(master: DataFrame, export: DataFrame, key: str = "sample_id", vector: str = "embedding") -> DataFrame:
    """Every master row with its vector and `retained`: whether the vector is there and finite."""
    return master.join(export.select(key, vector), key, "left").withColumn("retained", _all_finite(F.col(vector)))


def counts_by_tile(rows: DataFrame, tile: str = "tile_id") -> DataFrame:
    """tile, retained and excluded rows of complete_rows' result."""
    return rows.groupBy(tile).agg(F.count_if("retained").alias("n_retained"), F.count_if(~F.col("retained")).alias("n_excluded"))


# ---- rules: each gives rows (rule, subject) of what is broken, so a sound delivery gives none


def _broken(df: DataFrame, rules: list[tuple[str, Column]], subject: Column) -> DataFrame:
    hits = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(rule)) for rule, test in rules]), lambda r: r.isNotNull())
    return df.select(F.explode(hits).alias("rule"), subject.cast("string").alias("subject"))


def point_delivery(report: DataFrame, catalog: DataFrame, files: DataFrame, expected: int) -> DataFrame:
    """Broken rules of a point delivery. report: one row sample_count, complete_rows, incomplete_rows; catalog: path; files: path."""
    c = F.col
    rules = [
        ("sample_count differs from the plan", c("sample_count") != expected),
        ("complete and incomplete rows do not add up", c("complete_rows") + c("incomplete_rows") != expected),
    ]
    gone = catalog.join(files, "path", "left_anti")
    return _broken(report, rules, F.lit(None)).unionByName(gone.select(F.lit("missing shard").alias("rule"), F.col("path").cast("string").alias("subject")))


def grid_delivery(planned: DataFrame, report: DataFrame, catalog: DataFrame, years: list[int], root: str) -> DataFrame:
    """Broken rules of a grid delivery.

    planned: grid_id; report: one row completed, failed; catalog: grid_id, status, path, years, n_bands of each store.
    """
    ids = planned.select("grid_id").distinct()
    got = catalog.select("grid_id").distinct()
    side = lambda a, b, rule: a.join(b, "grid_id", "left_anti").select(F.lit(rule).alias("rule"), F.col("grid_id").cast("string").alias("subject"))
    summed = report.withColumn("__n", ids.agg(F.count(F.lit(1)).alias("n")).scalar())
    c = F.col
    per_run = [("run summary is incomplete", (c("completed") != c("__n")) | (F.coalesce(c("failed"), F.lit(0)) != 0))]
    per_grid = [
        ("not complete", c("status") != "complete"),
        ("path escapes the output folder", ~F.startswith(c("path"), F.lit(root.rstrip("/") + "/")) | F.contains(c("path"), F.lit("/../"))),
        ("years or bands differ from the plan", (F.size("years") != len(years)) | (c("n_bands") != vec.BANDS)),
    ]
    out = side(ids, got, "missing from the catalogue").unionByName(side(got, ids, "not in the plan"))
    out = out.unionByName(_broken(summed, per_run, F.lit(None))).unionByName(_broken(catalog, per_grid, F.col("grid_id")))
    twice = catalog.groupBy("grid_id").count().where("count > 1")
    return out.unionByName(twice.select(F.lit("listed more than once").alias("rule"), F.col("grid_id").cast("string").alias("subject")))


def raster_rules(headers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Broken rules of delivered raster files against their manifest, from headers alone.

    headers: path, bytes, count, dtype, epsg, a to f, width, height, names, nodata, tags (map). manifest: path, bytes, grid_id,
    year, epsg, a to f, width, height, signature.
    """
    same = ("epsg", "width", "height", *"abcdef")
    m = manifest.select("path", F.col("bytes").alias("__bytes"), "grid_id", "year", F.col("signature").alias("__sig"), *[F.col(c).alias(f"__{c}") for c in same])
    met = m.join(headers.withColumn("__there", F.lit(True)), "path", "left")
    c = F.col
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    names = F.array(*[F.lit(f"A{b:02d}") for b in range(vec.BANDS)])
    differs = F.lit(False)
    for k in same:
        differs = differs | ~c(k).eqNullSafe(c(f"__{k}"))
    there = c("__there").isNotNull()
    rules = [
        ("missing file", ~there),
        ("file size differs from the manifest", there & ~c("bytes").eqNullSafe(c("__bytes"))),
        ("not 64 float32 bands", there & ~((c("count") == vec.BANDS) & (c("dtype") == "float32"))),
        ("grid differs from the manifest", there & differs),
        ("band names", there & ~c("names").eqNullSafe(names)),
        ("no-data value is not NaN", there & ~F.coalesce(F.isnan(c("nodata").cast("double")), F.lit(False))),
        ("tags", there & ~((tag("year") == c("year").cast("string")) & (tag("grid_id") == c("grid_id")) & (tag("signature") == c("__sig")))),
    ]
    extra = headers.join(manifest.select("path"), "path", "left_anti").select(F.lit("not in the manifest").alias("rule"), F.col("path").alias("subject"))
    return _broken(met, rules, F.col("path")).unionByName(extra)


def export_manifest(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """One row per complete grid: its contract and the sorted files (year, path, bytes, signature). A grid that lacks a year is an error.

    catalog: grid_id, scheme, epsg, x0, y0, width, height, years, status; files: grid_id, year, path, bytes.
    """
    c = F.col
    sig = F.sha2(F.concat_ws("|", "grid_id", F.col("epsg").cast("string"), F.col("x0").cast("string"), F.col("y0").cast("string"), F.col("width").cast("string"), F.col("height").cast("string"), F.col("year").cast("string")).cast("binary"), 256)
    kept = catalog.where(c("status") == "complete")
    met = kept.join(files, "grid_id", "left").withColumn("signature", sig)
    out = met.groupBy("grid_id", "scheme", "epsg", "x0", "y0", "width", "height", "years").agg(F.array_sort(F.collect_list(F.when(c("year").isNotNull(), F.struct("year", "path", "bytes", "signature")))).alias("files"))
    whole = F.transform("files", lambda f: f["year"]) == F.array_sort("years")
    return out.withColumn("grid_id", F.when(whole, c("grid_id")).otherwise(F.raise_error(F.concat(F.lit("years of files differ from the plan: "), "grid_id"))))


# ---- files


def write_canonical(df: DataFrame, path: str, years: list[int], chunk_size: int = 10_000) -> DataFrame:
    """A point table as Parquet or CSV (by suffix) and the preflight report beside it as JSON; a table with errors is not written."""
    report = points.preflight_report(df, years, chunk_size)
    row = report.first()  # one row
    if not row["valid"]:
        raise ValueError("; ".join(row["errors"]))
    out = df.withColumn("sample_id", F.trim(F.col("sample_id").cast("string"))).withColumn("lon", F.col("lon").cast("double")).withColumn("lat", F.col("lat").cast("double"))
    (out.write.option("header", True).csv(path) if path.lower().endswith(".csv") else out.write.parquet(path))
    report.write.json(f"{path}.report")
    return report


def merge_shards(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """All shards of a store as one Parquet table in shard order, and a report row: shards, rows, complete rows."""
    from gridlark.operators import store

    rows = store.open_points(spark, folder)
    order = [c for c in ("chunk", "sample_id") if c in rows.columns]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(target)
    return spark.read.parquet(target).agg(F.countDistinct("chunk").alias("n_shards"), F.count(F.lit(1)).alias("n_rows"), F.count_if("complete").alias("n_complete"))


def patch_signature(samples: DataFrame, catalog: DataFrame, size: int, years: list[int], key: str = "sample_id") -> str:
    """Signature of a patch run: its samples, the catalogue's grids and its parameters, whatever the rows' order."""
    a = audit.sample_signature(samples, key).first()
    b = audit.content_signature(catalog, ["grid_id", "epsg", "x0", "y0", "width", "height"]).first()
    text = json.dumps({"samples": a["signature"], "catalog": b["signature"], "size": size, "years": list(years)}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def write_patches(patches: DataFrame, folder: str, signature: str, shard_of: Column) -> int:
    """Patches as Parquet by shard, with the run's signature beside them. Returns the number of shards written.

    Shards that are already there are left as they are; a folder of another run is an error.
    """
    spark = patches.sparkSession
    shards = patches.withColumn("shard", shard_of.cast("long"))
    try:
        stored = spark.read.text(f"{folder}/run").first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if budget.resumable(stored, signature):
        have = spark.read.parquet(f"{folder}/shards").select("shard").distinct()
        shards = shards.join(F.broadcast(have), "shard", "left_anti")
    else:
        spark.createDataFrame([(signature,)], "value string").coalesce(1).write.text(f"{folder}/run")
    new = shards.select("shard").distinct().count()
    if new:
        shards.repartition("shard").sortWithinPartitions("shard").write.mode("append").partitionBy("shard").parquet(f"{folder}/shards")
    return new


def coverage_summary(stats: DataFrame, by: list[str], slack: float = 1.0) -> DataFrame:
    """by, areas in km2 and percentages, from rows total_m2, valid_m2, missing_m2.

    Areas that are not finite or negative, a total of 0, or parts that miss the total by more than `slack` m2 are an error.
    """
    c = F.col
    names = ("total_m2", "valid_m2", "missing_m2")
    bad = F.lit(False)
    for n in names:
        bad = bad | ~vec.is_finite(c(n).cast("double")) | (c(n) < 0)
    bad = bad | (c("total_m2") <= 0) | (F.abs(c("total_m2") - c("valid_m2") - c("missing_m2")) > slack)
    checked = stats.withColumn("total_m2", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("areas are not sound"))).otherwise(c("total_m2")))
    km = [(c(n) / 1e6).alias(n.replace("_m2", "_km2")) for n in names]
    return checked.select(*by, *km, (c("valid_m2") * 100 / c("total_m2")).alias("valid_percent"), (c("missing_m2") * 100 / c("total_m2")).alias("missing_percent"))
