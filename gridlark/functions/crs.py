"""WGS84 to UTM and back by the Krueger series, as column expressions; equal-area cylindrical forward."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
N = FLAT / (2 - FLAT)
R = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
E1 = math.sqrt(FLAT * (2 - FLAT))
#: Coefficients of the series in the third flattening, forward and inverse.
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone; south adds the false northing of the zone's hemisphere."""
    phi = F.radians(lat)
    lam = F.radians(F.pmod(lon - (zone * 6 - 183) + 180, F.lit(360.0)) - 180)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E1 * F.atanh(E1 * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * R * e, F.when(south, 10000000.0).otherwise(0.0) + K0 * R * n


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    xi = (y - F.when(south, 10000000.0).otherwise(0.0)) / (K0 * R)
    eta = (x - 500000) / (K0 * R)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(q), F.cos(p))) + zone * 6 - 183, F.degrees(lat)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area coordinates with standard parallels at 30 degrees."""
    e2 = E1 * E1
    k = math.cos(math.radians(30)) / math.sqrt(1 - e2 * 0.25)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(E1 * s) / E1)
    return A * k * F.radians(lon), A * q / (2 * k)


#: Letters of latitude bands, and of rows and columns of 100 km squares.
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"
COLUMN_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"


def mgrs_zone(lon: Column, lat: Column) -> Column:
    """UTM zone with the wider zones of south-west Norway and Svalbard."""
    plain = F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))
    north = lat >= 72
    span = lambda a, b: (lon >= a) & (lon < b)
    return (
        F.when((lat >= 56) & (lat < 64) & span(3, 12), 32)
        .when(north & span(0, 9), 31)
        .when(north & span(9, 21), 33)
        .when(north & span(21, 33), 35)
        .when(north & span(33, 42), 37)
        .otherwise(plain)
    )


def mgrs_tiles(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with mgrs_tile, the five characters of the 100 km square; null outside 80 S to 84 N or where not finite."""
    ok = (F.abs(F.col(lon)) <= 180) & F.col(lat).between(-80.0, 84.0)
    # Coordinates that are out become null, and so does their tile: a branch around the series would keep generated
    # code from computing its shared parts once.
    z = df.withColumn("__x", F.when(ok, F.col(lon))).withColumn("__y", F.when(ok, F.col(lat)))
    lon, lat = F.col("__x"), F.col("__y")
    z = z.withColumn("__z", mgrs_zone(lon, lat))
    x, y = utm(lon, lat, F.col("__z"), lat < 0)
    letter = lambda s, k: F.substr(F.lit(s), (k + 1).cast("int"), F.lit(1))
    band = F.least(F.lit(19), F.floor((lat + 80) / 8))
    column = (F.col("__z") - 1) % 3 * 8 + F.floor(x / 100000) - 1
    row = (F.floor(y / 100000) + F.when(F.col("__z") % 2 == 0, 5).otherwise(0)) % 20
    tile = F.concat(F.lpad(F.col("__z").cast("string"), 2, "0"), letter(BAND_LETTERS, band), letter(COLUMN_LETTERS, column), letter(ROW_LETTERS, row))
    # least() skips nulls, so the band letter alone would not be null.
    return z.withColumn("mgrs_tile", F.concat(tile, F.when(lat.isNotNull(), ""))).drop("__x", "__y", "__z")
