"""Vector features: quality counts, prototypes, temporal fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import vec
from gridlark.runtime import materialize


def feature_qc(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: rows, columns, missing and non-finite values, zero-norm and valid rows. Values that are not finite count as 0 in a norm."""
    v = F.col(vector)
    count = lambda test: F.aggregate(v, F.lit(0), lambda n, x: n + test(x).cast("int"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.max(F.size(v)), F.lit(0)).cast("long").alias("n_columns"),
        total(count(lambda x: x.isNull() | F.isnan(x))).alias("missing"),
        total(count(lambda x: ~vec.is_finite(x))).alias("nonfinite"),
        total((vec.norm(F.transform(v, lambda x: F.when(vec.is_finite(x), x).otherwise(0.0))) <= vec.ZERO).cast("int")).alias("zero_norm"),
        total(vec.valid(v).cast("int")).alias("valid"),
    )


def spherical_prototype(df: DataFrame, by: list[str], vector: str = "embedding", weight: Column | None = None, strict: bool = False) -> DataFrame:
    """by, n, resultant and prototype: the unit vector of the (weighted) mean of unit vectors.

    Bands are summed in 64 columns of one partial aggregate: no row is unfolded by band. Rows that are not
    valid are left out; strict: they are an error.
    """
    if strict:
        df = df.where(F.when(~vec.valid(F.col(vector)), F.raise_error(F.lit("vectors have to be finite and not zero"))).isNull())
    w = weight if weight is not None else F.lit(1.0)
    unit = df.where(vec.valid(F.col(vector))).select(*by, vec.l2_normalize(F.col(vector)).alias("__u"), w.cast("double").alias("__w"))
    sums = unit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("__sw"), *[F.sum(F.col("__u")[b] * F.col("__w")).alias(f"__s{b}") for b in range(vec.BANDS)])
    mean = sums.select(*by, "n", F.array(*[F.col(f"__s{b}") / F.col("__sw") for b in range(vec.BANDS)]).alias("__m"))
    out = mean.withColumn("resultant", vec.norm(F.col("__m")))
    return out.select(*by, "n", "resultant", F.when(F.col("resultant") > 2.220446049250313e-16, F.transform("__m", lambda x: x / F.col("resultant"))).alias("prototype"))


def polygon_prototypes(df: DataFrame, polygon: str = "polygon_id", vector: str = "embedding", weight: str = "weight", year: str | None = None, least_fraction: float = 1.0) -> DataFrame:
    """Weighted prototype by polygon (and year) with diagnostics.

    A polygon counts where enough of its rows are valid. Weights count only where all
    of the polygon's valid rows have finite weights with a positive sum.
    """
    if not 0 < least_fraction <= 1:
        raise ValueError("least_fraction must lie in (0, 1]")
    by = [polygon, *([year] if year else [])]
    v = F.col(vector)
    rows = df.select(*by, vec.valid(v).alias("__ok"), vec.l2_normalize(v).alias("__u"), F.col(weight).cast("double").alias("__w"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count_if("__ok").alias("n_valid"),
        F.bool_and(F.when(F.col("__ok"), F.coalesce(vec.is_finite(F.col("__w")), F.lit(False)))).alias("__wok"),
        F.coalesce(F.sum(F.when(F.col("__ok"), F.col("__w"))), F.lit(0.0)).alias("__sw"),
        *[F.sum(F.when(F.col("__ok"), F.col("__u")[b] * F.col("__w"))).alias(f"__s{b}") for b in range(vec.BANDS)],
        *[F.sum(F.when(F.col("__ok"), F.col("__u")[b])).alias(f"__e{b}") for b in range(vec.BANDS)],
    )
    weighed = F.col("__wok") & (F.col("__sw") > 0)
    m = F.array(*[F.when(weighed, F.col(f"__s{b}") / F.col("__sw")).otherwise(F.col(f"__e{b}") / F.col("n_valid")) for b in range(vec.BANDS)])
    tops = materialize(sums.select(*by, "n_expected", "n_valid", weighed.alias("__weighed"), m.alias("__m"))).withColumn("__r", vec.norm(F.col("__m")))
    ok = (F.col("n_valid") > 0) & (F.col("n_valid") / F.col("n_expected") >= least_fraction) & (F.col("__r") > 2.220446049250313e-16)
    tops = tops.select(*by, "n_expected", "n_valid", "__weighed", ok.alias("prototype_valid"), F.when(ok, F.col("__r")).alias("resultant_length"), F.when(ok, F.transform("__m", lambda x: x / F.col("__r"))).alias("prototype"))
    tops = materialize(tops)  # one row per polygon; used twice, and its expressions are too wide to plan twice
    near = tops.select(*[F.col(c).alias(f"__{c}") for c in by], "__weighed", F.col("prototype").alias("__p"))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    cos = rows.where("__ok").join(near, cond).where("__p is not null")
    cos = cos.select(*by, F.when(F.col("__weighed"), F.col("__w")).otherwise(1.0).alias("__w"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), vec.dot(F.col("__u"), F.col("__p")))).alias("__c"))
    spread = cos.groupBy(*by).agg(
        (F.sum(F.col("__w") * F.col("__c")) / F.sum("__w")).alias("mean_cosine"),
        F.percentile("__c", 0.1).alias("p10_cosine"),
        (F.sum(F.col("__w") * F.degrees(F.acos("__c"))) / F.sum("__w")).alias("mean_angle"),
    )
    spread = spread.select(*[F.col(c).alias(f"__{c}") for c in by], "mean_cosine", "p10_cosine", "mean_angle")
    return tops.join(spread, cond, "left").select(*by, "n_expected", "n_valid", "prototype_valid", "resultant_length", "mean_cosine", "p10_cosine", "mean_angle", "prototype")


def prototype_rows(df: DataFrame, key: str = "sample_id", label: str = "label") -> DataFrame:
    """The rows that prototypes are made of: those of label 1 where there is such a column; a repeated id is an error."""
    out = df.where(F.col(label).try_cast("double") == 1.0) if label in df.columns else df
    twice = out.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} repeats: {twice[0][0]}")
    return out


def anchors(df: DataFrame, polygon: str = "polygon_id", key: str = "sample_id", order: str | None = None) -> DataFrame:
    """One row of each polygon: one flagged as anchor first, else the first by input order (the `order` column, or the id);
    without flags the first by rank, and without ranks by id. A polygon's own tile goes before its row's."""
    given = F.col(order) if order else F.col(key)
    if "is_anchor" in df.columns:
        by = [F.when(F.lower(F.col("is_anchor").cast("string")).isin("true", "1", "yes"), 0).otherwise(1), given]
    elif "point_rank" in df.columns:
        by = [F.col("point_rank"), F.col(key)]
    else:
        by = [F.col(key)]
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(polygon).orderBy(*by, F.xxhash64(*df.columns)))).where("__r = 1").drop("__r")
    if "polygon_tile_id" in df.columns:
        first = first.withColumn("tile_id", F.coalesce("polygon_tile_id", "tile_id") if "tile_id" in df.columns else F.col("polygon_tile_id"))
    return first


def polygon_table(prototypes: DataFrame, anchor_rows: DataFrame, years: list[int], polygon: str = "polygon_id", year: str = "year") -> DataFrame:
    """One row of each polygon: its anchor's columns, n_points_polygon, and whether every year asked for has a valid prototype."""
    ok = F.countDistinct(F.when(F.col("prototype_valid") & F.col(year).isin(years), F.col(year))) == len(set(years))
    one = prototypes.groupBy(polygon).agg(F.max("n_expected").alias("n_points_polygon"), ok.alias("complete_all_requested_years"))
    return one.join(anchor_rows, polygon, "left")


def fuse_years(df: DataFrame, key: str = "sample_id", year: str = "year", vector: str = "embedding", mode: str = "temporal_stats") -> DataFrame:
    """One row per id over its ordered years: concat, or per band mean, population std, last - first and slope."""
    series = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(year), F.col(vector).alias("v")))), lambda s: s["v"]).alias("__s"))
    if mode == "concat":
        return series.select(key, F.flatten("__s").alias("fused"))
    if mode != "temporal_stats":
        raise ValueError("mode must be concat or temporal_stats")
    t = F.size("__s")
    band = lambda b: F.transform("__s", lambda v: F.element_at(v, b + 1).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def stats(b):
        x = band(b)
        mean = total(x) / t
        var = total(F.transform(x, lambda v: (v - mean) * (v - mean))) / t
        mid = (t - 1) / 2
        num = total(F.transform(x, lambda v, i: (i - mid) * v))
        den = total(F.transform(x, lambda v, i: (i - mid) * (i - mid)))
        return F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), (F.element_at(x, -1) - F.element_at(x, 1)).alias("delta"), F.when(t > 1, num / den).otherwise(0.0).alias("slope"))

    return series.select(key, F.transform(F.sequence(F.lit(0), F.lit(vec.BANDS - 1)), stats).alias("fused"))


def window_mask(df: DataFrame, years: list[int], key: str = "sample_id", year: str = "year", vector: str = "embedding") -> DataFrame:
    """key and usable: every requested year is there and valid."""
    if years != sorted(set(years)) or not years:
        raise ValueError("years must increase and not be empty")
    ok = F.col(year).isin(years) & vec.valid(F.col(vector))
    return df.groupBy(key).agg((F.countDistinct(F.when(ok, F.col(year))) == len(years)).alias("usable"))


def trailing_windows(years: DataFrame, lengths: list[int], year: str = "year") -> DataFrame:
    """end_year, length, first_year of every run of consecutive years that ends at an available year."""
    have = years.select(F.col(year).cast("int").alias("y")).distinct()
    asked = have.withColumn("length", F.explode(F.array(*[F.lit(n) for n in sorted(set(lengths))])))
    need = asked.withColumn("y2", F.explode(F.sequence(F.col("y") - F.col("length") + 1, F.col("y"))))
    met = need.join(have.withColumnRenamed("y", "y2"), "y2", "left_semi")
    return met.groupBy("y", "length").agg(F.count(F.lit(1)).alias("n")).where("n = length").select(F.col("y").alias("end_year"), "length", (F.col("y") - F.col("length") + 1).alias("first_year"))


def discover_years(columns: list[str], spatial: str = "center") -> list[int]:
    """Years of which a wide table has all bands."""
    import re

    found: dict[int, set[str]] = {}
    for c in columns:
        if m := re.fullmatch(rf"{vec.PREFIX}(\d{{4}})_{spatial}_A(\d\d)", c):
            found.setdefault(int(m[1]), set()).add(m[2])
    return sorted(y for y, b in found.items() if len(b) == vec.BANDS)


def wide_to_long(df: DataFrame, keys: list[str], spatial: str = "center") -> DataFrame:
    """keys, year, embedding: one row per id and year."""
    years = discover_years(df.columns, spatial)
    rows = F.array(*[F.struct(F.lit(y).alias("year"), F.array(*[F.col(c) for c in vec.band_columns(y, spatial)]).alias("embedding")) for y in years])
    return df.select(*keys, F.explode(rows).alias("__y")).select(*keys, "__y.year", "__y.embedding")


def long_to_wide(df: DataFrame, keys: list[str], years: list[int], spatial: str = "center") -> DataFrame:
    """One column per year and band, with completeness flags."""
    one = df.groupBy(*keys).agg(*[F.first(F.when(F.col("year") == y, F.col("embedding")), ignorenulls=True).alias(f"__{y}") for y in years])
    cols = [F.col(f"__{y}")[b].alias(c) for y in years for b, c in enumerate(vec.band_columns(y, spatial))]
    flags = [vec.present(F.col(f"__{y}")).alias(f"{vec.PREFIX}{y}_complete") for y in years]
    every = F.lit(True)
    for y in years:
        every = every & vec.present(F.col(f"__{y}"))
    return one.select(*keys, *cols, *flags, every.alias(f"{vec.PREFIX}_complete_all_years"))


def nth_rank(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """point_rank by group, from 1."""
    return df.withColumn("point_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
