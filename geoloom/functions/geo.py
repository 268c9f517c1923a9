"""Geometry as native columns. Coordinates are degrees times 1e7 as integers; vectors are structs of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
#: Centre of the gnomonic plane, degrees.
CENTRE_LAT, CENTRE_LON = 51.0, 10.0
#: Tolerance of boundary tests in the plane, and the least cosine to the centre that projects.
EPS, HORIZON = 1e-12, 1e-6
RAD = math.pi / 180.0

_LAT, _LON = CENTRE_LAT * RAD, CENTRE_LON * RAD
CENTRE = (math.cos(_LAT) * math.cos(_LON), math.cos(_LAT) * math.sin(_LON), math.sin(_LAT))
EAST = (-math.sin(_LON), math.cos(_LON), 0.0)
NORTH = (
    CENTRE[1] * EAST[2] - CENTRE[2] * EAST[1],
    CENTRE[2] * EAST[0] - CENTRE[0] * EAST[2],
    CENTRE[0] * EAST[1] - CENTRE[1] * EAST[0],
)

Vector = tuple[Column, Column, Column]


def number(x: float) -> Column:
    return F.lit(float(x))


def e7_to_radians(e7: Column) -> Column:
    return e7.cast("double") * number(1e-7) * number(RAD)


def degrees_to_e7(degrees: Column) -> Column:
    """Rounds half away from zero."""
    return F.round(degrees * number(1e7)).cast("int")


def unit(lat_e7: Column, lon_e7: Column) -> Vector:
    lat, lon = e7_to_radians(lat_e7), e7_to_radians(lon_e7)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def fields(prefix: str) -> Vector:
    """The vector in columns <prefix>x, <prefix>y and <prefix>z."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def constant(v: tuple[float, float, float]) -> Vector:
    return number(v[0]), number(v[1]), number(v[2])


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def times(a: Vector, s: Column) -> Vector:
    return a[0] * s, a[1] * s, a[2] * s


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Vector, b: Vector) -> Column:
    return F.atan2(norm(cross(a, b)), dot(a, b))


def metres(a: Vector, b: Vector) -> Column:
    return number(EARTH_RADIUS_M) * angle(a, b)


def vector_to_e7(v: Vector) -> tuple[Column, Column]:
    lat = F.atan2(v[2], F.hypot(v[0], v[1])) / number(RAD) * number(1e7)
    return F.round(lat).cast("long"), F.round(F.atan2(v[1], v[0]) / number(RAD) * number(1e7)).cast("long")


def gnomonic(lat_e7: Column, lon_e7: Column) -> tuple[Column, Column]:
    """Plane coordinates, null without a point; fails for points on or beyond the horizon of the centre."""
    u = unit(lat_e7, lon_e7)
    c = dot(u, constant(CENTRE))
    c = F.when(c.isNull() | (c > number(HORIZON)), c).otherwise(F.raise_error(F.lit("a point lies outside the hemisphere that is supported")).cast("double"))
    return dot(u, constant(EAST)) / c, dot(u, constant(NORTH)) / c


def orient(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def on_segment(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Whether p lies on a-b, within a tolerance that scales with the segment's length."""
    eps, length = number(EPS), F.hypot(bx - ax, by - ay)
    inside = (px >= F.least(ax, bx) - eps) & (px <= F.greatest(ax, bx) + eps) & (py >= F.least(ay, by) - eps) & (py <= F.greatest(ay, by) + eps)
    return F.when(length == 0, F.hypot(px - ax, py - ay) <= eps).otherwise((F.abs(orient(ax, ay, bx, by, px, py)) <= eps * length) & inside)


def crosses_ray(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Whether edge a-b is crossed by the ray from p; half-open, so that a vertex counts once."""
    return F.coalesce(((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by != ay, by - ay) + ax), F.lit(False))


def segments_meet(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether a-b and c-d, in boxes that overlap, cross properly or touch at an end."""
    apart = (F.greatest(a[0], b[0]) < F.least(c[0], d[0])) | (F.least(a[0], b[0]) > F.greatest(c[0], d[0])) | (F.greatest(a[1], b[1]) < F.least(c[1], d[1])) | (F.least(a[1], b[1]) > F.greatest(c[1], d[1]))
    x, y, z, w = orient(*a, *b, *c), orient(*a, *b, *d), orient(*c, *d, *a), orient(*c, *d, *b)
    proper = ((x < 0) != (y < 0)) & ((z < 0) != (w < 0))
    return ~apart & (proper | on_segment(*a, *b, *c) | on_segment(*a, *b, *d) | on_segment(*c, *d, *a) | on_segment(*c, *d, *b))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[Column, Column]:
    """Whether a-b and c-d, in boxes that overlap, cross properly, and whether they may touch at an end: where neither is so, segments_meet is false."""
    x, y, z, w = orient(*a, *b, *c), orient(*a, *b, *d), orient(*c, *d, *a), orient(*c, *d, *b)
    slack = lambda u, v: number(2 * EPS) * (F.abs(v[0] - u[0]) + F.abs(v[1] - u[1]))  # noqa: E731  twice a bound on what on_segment allows
    near = (F.least(F.abs(x), F.abs(y)) <= slack(a, b)) | (F.least(F.abs(z), F.abs(w)) <= slack(c, d))
    return ((x < 0) != (y < 0)) & ((z < 0) != (w < 0)), near


def with_nearest_on_arc(df: DataFrame, q: str = "q", u: str = "u", v: str = "v", out: str = "n") -> DataFrame:
    """Adds the point of the minor arc u-v that is closest to q: the foot of q on its plane if that lies between, else the closer end.

    Each step is a projection of its own, so that no value is worked out more than once.
    """

    def put(df: DataFrame, name: str, vector: Vector) -> DataFrame:
        return df.withColumns({f"{name}{c}": x for c, x in zip("xyz", vector, strict=True)})

    at = fields
    df = put(df, "_m", cross(at(u), at(v))).withColumn("_ml", norm(at("_m")))
    df = put(df, "_m", times(at("_m"), 1 / F.when(F.col("_ml") > number(1e-15), F.col("_ml"))))
    df = df.withColumn("_h", dot(at(q), at("_m")))
    df = put(df, "_f", minus(at(q), times(at("_m"), F.col("_h")))).withColumn("_fl", norm(at("_f")))
    df = put(df, "_f", times(at("_f"), 1 / F.when(F.col("_fl") > number(1e-15), F.col("_fl"))))
    df = df.withColumns({"_au": angle(at(q), at(u)), "_av": angle(at(q), at(v)), "_af": angle(at(q), at("_f"))})
    between = (dot(cross(at(u), at("_f")), at("_m")) >= number(-1e-14)) & (dot(cross(at("_f"), at(v)), at("_m")) >= number(-1e-14)) & (F.col("_af") < F.least("_au", "_av"))
    df = df.withColumn("_pick", F.when(F.coalesce(between, F.lit(False)), 2).when(F.col("_au") <= F.col("_av"), 0).otherwise(1))
    df = put(df, out, tuple(F.when(F.col("_pick") == 2, F.col(f"_f{c}")).when(F.col("_pick") == 0, F.col(f"{u}{c}")).otherwise(F.col(f"{v}{c}")) for c in "xyz"))
    df = df.withColumn("distance_m", number(EARTH_RADIUS_M) * F.when(F.col("_pick") == 2, F.col("_af")).otherwise(F.least("_au", "_av")))
    return df.drop(*[f"{n}{c}" for n in ("_m", "_f") for c in "xyz"], "_ml", "_fl", "_h", "_au", "_av", "_af", "_pick")


def bbox_centre(lo: Column, hi: Column) -> Column:
    """The middle of two integers, truncated towards zero."""
    total = lo.cast("long") + hi.cast("long")
    return (F.signum(total.cast("double")) * F.floor(F.abs(total).cast("double") / 2)).cast("long")


def level_scale(zoom: int) -> float:
    """Tolerance of simplified lines in degrees: a quarter of a pixel of a tile of 256."""
    return math.ldexp(360.0, -zoom) / 1024.0
