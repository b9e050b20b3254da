"""Equal keys for containment joins: boxes are dealt into square buckets of a size in proportion to their own.

A box takes buckets of span * 2^level, the level chosen so that it reaches into a hundred of them at most; points take one
bucket of every level that boxes have. So a large box is not unfolded into thousands of rows, nor are small ones thrown together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["__lv", "__bx", "__by"]
ACROSS = 8


def boxes(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, span: float) -> DataFrame:
    """df with the keys of every bucket that the boxes reach into; boxes without finite bounds give no row."""
    reach = F.greatest(x1 - x0, y1 - y0) / F.lit(float(span * ACROSS))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(reach, F.lit(1.0))))).cast("int")
    cell = lambda c: F.floor(c / (F.lit(float(span)) * F.pow(F.lit(2.0), F.col("__lv")))).cast("long")
    out = df.withColumns({"__x0": x0, "__x1": x1, "__y0": y0, "__y1": y1}).where("__x0 <= __x1 AND __y0 <= __y1 AND abs(__x0) < double('Infinity') AND abs(__x1) < double('Infinity') AND abs(__y0) < double('Infinity') AND abs(__y1) < double('Infinity')")
    out = out.withColumn("__lv", level).withColumn("__bx", F.explode(F.sequence(cell(F.col("__x0")), cell(F.col("__x1")))))
    return out.withColumn("__by", F.explode(F.sequence(cell(F.col("__y0")), cell(F.col("__y1"))))).drop("__x0", "__x1", "__y0", "__y1")


def levels(dealt: DataFrame) -> list[int]:
    """The levels in use: a few numbers."""
    return sorted(r[0] for r in dealt.select("__lv").distinct().collect())


def points(df: DataFrame, x: Column, y: Column, span: float, used: list[int]) -> DataFrame:
    """df with the keys of each point's bucket on every level in use; points that are not finite give no row."""
    from gridlark.functions.vec import is_finite

    out = df.withColumns({"__px": x.cast("double"), "__py": y.cast("double")}).where(is_finite(F.col("__px")) & is_finite(F.col("__py")))
    out = out.withColumn("__lv", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>")))
    cell = lambda c: F.floor(F.col(c) / (F.lit(float(span)) * F.pow(F.lit(2.0), F.col("__lv")))).cast("long")
    return out.withColumn("__bx", cell("__px")).withColumn("__by", cell("__py")).drop("__px", "__py")
