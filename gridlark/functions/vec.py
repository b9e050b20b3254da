"""Vector algebra on array<float> columns, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 64
ZERO = 1e-8
#: Fixed value: prefix of a year in wide tables' column names.
PREFIX = "aef"


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def complete(v: Column) -> Column:
    """All bands present and finite."""
    return F.coalesce((F.size(v) == BANDS) & F.forall(v, is_finite), F.lit(False))


def present(v: Column) -> Column:
    """All bands present; infinities count as present."""
    return F.coalesce((F.size(v) == BANDS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def valid(v: Column) -> Column:
    """Complete and not close to the zero vector."""
    return complete(v) & (norm(v) > ZERO)


def l2_normalize(v: Column) -> Column:
    """Unit vector; null where the row is not valid."""
    n = norm(v)
    return F.when(complete(v) & (n > ZERO), F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (norm(a) * norm(b))))


def angle_degrees(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(cosine(a, b)))


def band_columns(year: int, spatial: str = "center") -> list[str]:
    """Names of a year's bands in a wide table."""
    return [f"{PREFIX}{year}_{spatial}_A{b:02d}" for b in range(BANDS)]
