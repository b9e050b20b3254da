"""Point results as shards with a catalogue: writing, opening, checking, comparing, projecting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions import vec
from gridlark.operators import points, ranks


def shards(df: DataFrame, order: str, size: int, key: str = "sample_id", vector: str = "embedding") -> DataFrame:
    """df with chunk (from 1, by ordinal in input order) and complete (all bands present)."""
    return points.assign_chunks(df, order, size, key, tuple(df.columns)).withColumn("complete", vec.present(F.col(vector)))


def shard_catalog(shards: DataFrame) -> DataFrame:
    """chunk, rows, complete_rows: what a catalogue says of each shard."""
    return shards.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.count_if("complete").alias("complete_rows"))


def write_points(shards: DataFrame, folder: str) -> None:
    """One partition of Parquet by chunk and the catalogue beside it; both appear when their commit does."""
    shards.repartition("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").parquet(f"{folder}/shards", compression="zstd")
    shard_catalog(shards.sparkSession.read.parquet(f"{folder}/shards")).write.parquet(f"{folder}/catalog")


def verify_counts(shards: DataFrame, catalog: DataFrame) -> DataFrame:
    """chunk, expected, actual, matches: rows that the catalogue promises and that are there, of either side."""
    have = shards.groupBy("chunk").agg(F.count(F.lit(1)).alias("actual"))
    met = catalog.select("chunk", F.col("rows").alias("expected")).join(have, "chunk", "full")
    met = met.select("chunk", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return met.withColumn("matches", F.col("expected") == F.col("actual"))


def open_points(spark: SparkSession, folder: str, require_complete: bool = False, check_ids: bool = True, key: str = "sample_id") -> DataFrame:
    """Shards as one lazy table. A shard of another length than promised, or a repeated id, is an error."""
    got, catalog = spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/catalog")
    bad = verify_counts(got, catalog).where("NOT matches").orderBy("chunk").limit(5).collect()
    if bad:
        raise ValueError(f"shards differ from the catalogue: {[(r.chunk, r.expected, r.actual) for r in bad]}")
    if check_ids and (n := points.duplicate_ids(got, key).first().duplicate_rows):
        raise ValueError(f"{n} rows share an id")
    return got.where("complete") if require_complete else got


def project(df: DataFrame, columns: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """Named columns and the bands of the named years of a wide table; an unknown one is an error."""
    wanted = [*(columns or [c for c in df.columns if not c.startswith(vec.PREFIX)]), *(b for y in years or [] for b in vec.band_columns(y))]
    if unknown := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"unknown columns: {unknown[:5]}")
    return df.select(*dict.fromkeys(wanted))


def compare_coordinates(expected: DataFrame, actual: DataFrame, key: str, names: list[str], tolerance: float = 1e-7) -> DataFrame:
    """One row: shared ids, ids of one side, and shared ids of which a value lies further off than the tolerance."""
    a = expected.select(key, *[F.col(c).alias(f"__a{i}") for i, c in enumerate(names)], F.lit(True).alias("__a"))
    b = actual.select(key, *[F.col(c).alias(f"__b{i}") for i, c in enumerate(names)], F.lit(True).alias("__b"))
    far = F.lit(False)
    for i in range(len(names)):
        near = F.abs(F.col(f"__a{i}") - F.col(f"__b{i}")) <= tolerance
        far = far | ~F.coalesce(near, F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return a.join(b, key, "full").agg(
        F.count_if(both).alias("n_shared"), F.count_if(F.col("__b").isNull()).alias("n_missing"), F.count_if(F.col("__a").isNull()).alias("n_unexpected"), F.count_if(both & far).alias("n_moved")
    )


def label_rows(df: DataFrame, label: str = "label", value: float = 1.0) -> DataFrame:
    """Rows whose label reads as the number; all rows where there is no such column."""
    return df.where(F.col(label).try_cast("double") == value) if label in df.columns else df


def identify(df: DataFrame, order: str, id_field: str | None = None) -> DataFrame:
    """df with sample_id: the id field, else its own sample_id, else feature_ and the row's ordinal from 1."""
    if id_field or "sample_id" in df.columns:
        out = df.withColumn("sample_id", F.trim(F.col(id_field or "sample_id").cast("string")))
        return out.withColumn("sample_id", F.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", F.raise_error(F.lit("empty id"))).otherwise(F.col("sample_id")))
    ranked = points.assign_chunks(df, order, 1, order, tuple(df.columns))
    return ranked.withColumn("sample_id", F.concat(F.lit("feature_"), padded(F.col("chunk"), 8))).select("sample_id", *df.columns)


def padded(n: Column, width: int) -> Column:
    """A whole number with leading zeros; longer ones keep their digits."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def pixel_ids(df: DataFrame, polygon: str = "polygon_id", rank: str = "point_rank") -> DataFrame:
    """df with sample_id of the form polygon_px01; ranks above 99 keep their digits."""
    return df.withColumn("sample_id", F.concat(F.col(polygon).cast("string"), F.lit("_px"), padded(F.col(rank), 2)))


def describe_groups(df: DataFrame, by: str) -> DataFrame:
    """One row about the sizes of groups: number, mean, sample deviation, extremes and quartiles."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = n.agg(F.count("n").alias("groups"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))
    shares = ranks.percentiles(n, [], "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return ranks.joined(one, shares, []).select("groups", "mean", "std", "min", "p25", "p50", "p75", "max")
