"""Grids that turn spatial conditions into equal keys: cells in the gnomonic plane and cubes on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geo

#: Cells in which edges meet edges are as large as the median edge, within these bounds: about 25 km and 100 m.
COARSEST_MEETING, FINEST_MEETING = 256.0, 65536.0
#: Slabs of the plane for each unit of it: about 3 km.
SLABS = 2048
#: Cubes on the sphere have edges of 2**-level; the finest is about 100 m.
FINEST = 16


def floor_cell(v: Column, per_unit: float | Column) -> Column:
    return F.floor(v * (per_unit if isinstance(per_unit, Column) else geo.number(per_unit)))


def covered(lo: Column, hi: Column, per_unit: float | Column) -> Column:
    """All cells that the interval meets, with the boundary tolerance."""
    return F.sequence(floor_cell(lo - geo.number(geo.EPS), per_unit), floor_cell(hi + geo.number(geo.EPS), per_unit))


def projected(df: DataFrame, lat: str = "lat_e7", lon: str = "lon_e7", prefix: str = "g") -> DataFrame:
    x, y = geo.gnomonic(F.col(lat), F.col(lon))
    return df.withColumn(f"{prefix}x", x).withColumn(f"{prefix}y", y)


def sphered(df: DataFrame, prefix: str, lat: str = "lat_e7", lon: str = "lon_e7") -> DataFrame:
    x, y, z = geo.unit(F.col(lat), F.col(lon))
    return df.withColumns({f"{prefix}x": x, f"{prefix}y": y, f"{prefix}z": z})


def cube(x: Column, y: Column, z: Column, level: Column) -> Column:
    """One number for the cube of a level that a point of the sphere is in."""
    at = [F.floor((v + 1) * F.pow(F.lit(2.0), level)).cast("long") for v in (x, y, z)]
    return cube_key(*at)


def cube_key(i: Column, j: Column, k: Column) -> Column:
    return (i * F.lit(1 << 20) + j) * F.lit(1 << 20) + k


def segments(vertices: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """Edges between consecutive vertices (by pos) of each path; closed: also from the last to the first. Columns a.., b.. with e7 and plane coordinates."""
    path = Window.partitionBy(*keys).orderBy("pos")
    whole = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = projected(vertices).select(*keys, "pos", F.struct("lat_e7", "lon_e7", "gx", "gy").alias("a"))
    after = F.lead("a").over(path)
    if closed:
        after = F.coalesce(after, F.first("a").over(whole))
    return here.withColumn("b", after).where("b is not null").selectExpr(
        *keys, "pos", "a.lat_e7 alat", "a.lon_e7 alon", "a.gx ax", "a.gy ay", "b.lat_e7 blat", "b.lon_e7 blon", "b.gx bx", "b.gy by"
    )


def extent(a: str = "a", b: str = "b") -> Column:
    """The longer side of an edge's box in the plane."""
    return F.greatest(F.abs(F.col(f"{b}x") - F.col(f"{a}x")), F.abs(F.col(f"{b}y") - F.col(f"{a}y")))


def in_cells(edges: DataFrame, per_unit: float | Column) -> DataFrame:
    """A row for each cell that the boxes of an edge's pieces meet; pieces are at most as long as a cell, so a long edge has cells along its line only."""
    n = F.greatest(F.lit(1), F.ceil(extent() * per_unit)).cast("int")
    out = edges.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def span(c: str, at: Column) -> tuple[Column, Column]:
        ends = [F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * i / F.col("_n") for i in (at, at + 1)]
        return floor_cell(F.least(*ends) - geo.number(geo.EPS), per_unit), floor_cell(F.greatest(*ends) + geo.number(geo.EPS), per_unit)

    for c in "xy":
        (lo, hi), (lo_before, hi_before) = span(c, F.col("_i")), span(c, F.col("_i") - 1)
        out = out.withColumns({f"_lo{c}": lo, f"_hi{c}": hi, f"_was_lo{c}": lo_before, f"_was_hi{c}": hi_before})
    out = out.withColumn("cx", F.explode(F.sequence("_lox", "_hix"))).withColumn("cy", F.explode(F.sequence("_loy", "_hiy")))
    # A cell that the piece before has, too, has been given.
    given = (F.col("_i") > 0) & F.col("cx").between(F.col("_was_lox"), F.col("_was_hix")) & F.col("cy").between(F.col("_was_loy"), F.col("_was_hiy"))
    return out.where(~given).drop("_n", "_i", *[f"{n}{c}" for n in ("_lo", "_hi", "_was_lo", "_was_hi") for c in "xy"])


def meeting_cells(edges: DataFrame) -> float:
    """Cells for each unit of the plane that suit these edges."""
    median = edges.agg(F.percentile_approx(extent(), 0.5, 1000)).first()[0]
    return min(FINEST_MEETING, max(COARSEST_MEETING, 1.0 / median if median else FINEST_MEETING))
