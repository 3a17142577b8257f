"""Angles, vectors and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(x: Column, y: Column) -> Column:
    """atan2(y, x) in degrees, in [0, 360)."""
    a = F.degrees(F.atan2(y, x))
    return F.when(a < 0, a + 360.0).otherwise(a)


def zenith(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.acos(z / F.sqrt(x * x + y * y + z * z + F.lit(1e-12))))


def incident_zenith(x: Column, y: Column, z: Column) -> Column:
    """Zenith of the axis, folded to 0-90; null for a vector of no length."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n >= 1e-12, F.degrees(F.acos(F.least(F.greatest(F.abs(z) / n, F.lit(0.0)), F.lit(1.0)))))


def incident_azimuth(x: Column, y: Column, z: Column) -> Column:
    """Azimuth that the axis comes from; null for a vector of no length."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(n >= 1e-12, azimuth(-x, -y))


def unit_vector(zenith_deg: Column, azimuth_deg: Column) -> Column:
    t, p = F.radians(zenith_deg), F.radians(azimuth_deg)
    return F.struct((F.sin(t) * F.cos(p)).alias("x"), (F.sin(t) * F.sin(p)).alias("y"), F.cos(t).alias("z"))


def uv(azimuth_deg: Column) -> Column:
    return F.struct(F.cos(F.radians(azimuth_deg)).alias("u"), F.sin(F.radians(azimuth_deg)).alias("v"))


def azimuth_of_uv(u: Column, v: Column) -> Column:
    return azimuth(u, v)


#: Offset between the survey's origin and the array's.
SHIFT_X, SHIFT_Y, SHIFT_Z = 3455.6213993713604, 1277.747, -24.02


def shifted(x: Column, y: Column, z: Column) -> Column:
    return F.struct((x + SHIFT_X).alias("x"), (y + SHIFT_Y).alias("y"), (z + SHIFT_Z).alias("z"))


def true_azimuth(a: Column) -> Column:
    """The azimuth a shower comes from, given where it goes."""
    return F.pmod(a + 180.0, F.lit(360.0))


def true_zenith(z: Column) -> Column:
    return F.when(z > 90.0, 180.0 - z).otherwise(z)


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def axis_distance(p: tuple[Column, Column, Column], source: tuple[Column, Column, Column], d: tuple[Column, Column, Column]) -> Column:
    """Distance of a point from the line along `d` through the ground point below the source; null if d has no length."""
    core = (source[0] - d[0] * source[2] / d[2], source[1] - d[1] * source[2] / d[2])
    x, y, z = p[0] - core[0], p[1] - core[1], p[2]
    cx, cy, cz = y * d[2] - z * d[1], z * d[0] - x * d[2], x * d[1] - y * d[0]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return F.when((n > 0) & (d[2] != 0), F.sqrt(cx * cx + cy * cy + cz * cz) / n)


def radius(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def distance_limit(zenith_deg: Column, base: float = 800.0, knee: float = 75.0, slope: float = 300.0, top: float = 90.0) -> Column:
    """Largest distance from the centre: `base`, and above the knee `slope` more for each degree up to `top`."""
    return F.when(zenith_deg < knee, F.lit(base)).otherwise((F.least(zenith_deg, F.lit(top)) - knee) * slope + base)
