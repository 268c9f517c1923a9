"""What a map shows: objects in a box, by zoom, with limits, sampling and level of detail."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.operators.cells import projected
from geoloom.operators.regions import area_ordinals
from geoloom.plans.settle import settled

REGION_LIMIT = 50
MIN_HOUSE_ZOOM, MIN_STREET_ZOOM = 16, 14


@dataclass(frozen=True)
class Box:
    """Inclusive bounds in degrees times 1e7."""

    min_lat: int
    min_lon: int
    max_lat: int
    max_lon: int


def points_in(df: DataFrame, box: Box) -> DataFrame:
    """Both conditions are pushed to the scan of a stored table."""
    return df.where(F.col("lat_e7").between(box.min_lat, box.max_lat) & F.col("lon_e7").between(box.min_lon, box.max_lon))


def _numbered(found: DataFrame) -> DataFrame:
    """Adds _n, a row's number from 0 by type and id: rows are dealt by ranges, each task numbers its own, and the ranges' totals (a row for each task) say where it begins."""
    dealt = settled(found.repartitionByRange("type_rank", "id").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("type_rank", "id")) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def houses(buildings: DataFrame, box: Box, limit: int = 10_000, stride: int = 1) -> DataFrame:
    """Every stride-th building in the box, by type and id, at most limit; limit 0 is nothing, stride 0 an error."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    found = points_in(buildings.where("has_point"), box)
    if stride > 1:
        found = _numbered(found).where(F.col("_n") % stride == 0).drop("_n")
    return found.orderBy("type_rank", "id").limit(limit)


def house_counts(buildings: DataFrame, box: Box, limit: int = 10_000, stride: int = 1) -> DataFrame:
    """One row: matched (at most limit + 1), returned, threshold_reached, matched_exact, sampled."""
    n = houses(buildings, box, limit + 1, stride).agg(F.count("*").alias("matched"))
    over = F.col("matched") > limit
    return n.select("matched", F.least("matched", F.lit(limit)).alias("returned"), over.alias("threshold_reached"), (~over & F.lit(stride == 1)).alias("matched_exact"), F.lit(stride > 1).alias("sampled"))


def scan(buildings: DataFrame, box: Box, threshold: int) -> DataFrame:
    """The exhaustive count: matched, returned (at most threshold) and whether the threshold was passed."""
    n = points_in(buildings.where("has_point"), box).agg(F.count("*").alias("matched"))
    return n.select("matched", F.least("matched", F.lit(threshold)).alias("returned"), (F.col("matched") > threshold).alias("threshold_reached"))


def plane_box(box: Box) -> tuple[float, float, float, float]:
    """A box of the gnomonic plane that holds all of the lat/lon box: its centre's image, padded by the radius over the squared cosine of its extent."""
    from geoloom.functions import geo

    rad = geo.RAD * 1e-7
    lat, lon = (box.min_lat + box.max_lat) / 2 * rad, (box.min_lon + box.max_lon) / 2 * rad
    radius = ((box.max_lat - box.min_lat) + (box.max_lon - box.min_lon)) / 2 * rad + 1e-8
    u = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    c = sum(a * b for a, b in zip(u, geo.CENTRE, strict=True))
    extent = math.acos(max(-1.0, min(1.0, c))) + radius
    if extent >= math.pi / 2 - 1e-6:
        return (-math.inf, -math.inf, math.inf, math.inf)
    x, y = (sum(a * b for a, b in zip(u, axis, strict=True)) / c for axis in (geo.EAST, geo.NORTH))
    pad = radius / math.cos(extent) ** 2
    return x - pad, y - pad, x + pad, y + pad


def boxes(vertices: DataFrame, key: list[str]) -> DataFrame:
    """Each path's box in the plane. Worth storing, sorted, when many boxes are asked for."""
    return projected(vertices).groupBy(*key).agg(F.min("gx").alias("x0"), F.max("gx").alias("x1"), F.min("gy").alias("y0"), F.max("gy").alias("y1"))


def _meets(df: DataFrame, box: Box) -> DataFrame:
    x0, y0, x1, y1 = plane_box(box)
    inf = float("inf")
    for column, least, most in (("x", x0, x1), ("y", y0, y1)):
        if least > -inf:
            df = df.where((F.col(f"{column}1") >= F.lit(least)) & (F.col(f"{column}0") <= F.lit(most)))
    return df


def street_limit(zoom: int) -> int:
    return 1000 if zoom <= 16 else 4000


def streets(street_vertices: DataFrame, box: Box, zoom: int) -> DataFrame:
    """Ids of streets whose box may meet the view: none below MIN_STREET_ZOOM, by id, as many as the zoom shows. May hold some just outside."""
    found = _meets(boxes(street_vertices, ["id"]), box).where(F.lit(zoom >= MIN_STREET_ZOOM))
    return found.select("id").orderBy("id").limit(street_limit(zoom))


def level_shown(zoom: int):
    if zoom <= 8:
        return F.col("admin_level").between(0, 6)
    if zoom <= 11:
        return F.col("admin_level").between(0, 8)
    return F.lit(True)


def regions(areas: DataFrame, area_vertices: DataFrame, box: Box, zoom: int) -> DataFrame:
    """Areas whose box may meet the view, of the zoom's levels: by level (unknown last), then ordinal, at most REGION_LIMIT."""
    found = _meets(boxes(area_vertices, ["type_rank", "id"]), box).select("type_rank", "id")
    shown = area_ordinals(areas).join(found, ["type_rank", "id"], "left_semi").where(level_shown(zoom))
    rank = F.when(F.col("admin_level") < 0, 100).otherwise(F.col("admin_level"))
    return shown.orderBy(rank, "area_ord").limit(REGION_LIMIT).select("type_rank", "id", "name", "admin_level", "area_ord")


def layer_plan(zoom: int) -> dict:
    """What a client asks for at a zoom: layers, and the houses' limit and stride."""
    return {"houses": zoom >= MIN_HOUSE_ZOOM, "streets": zoom >= MIN_STREET_ZOOM, "regions": True, "limit": 4000 if zoom <= 17 else 10_000, "stride": 5 if zoom <= 17 else 1}


def clamped(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> tuple[float, float, float, float]:
    return max(-180.0, min_lon), max(-90.0, min_lat), min(180.0, max_lon), min(90.0, max_lat)
