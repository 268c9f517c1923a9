"""Addresses, JSON and GeoJSON of what was found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions import text as tx
from geoloom.operators.regions import AREA, area_ordinals, regions_at
from geoloom.plans.settle import settled


def building_regions(memberships: DataFrame, areas: DataFrame) -> DataFrame:
    """(obj_type, obj_id, regions) for memberships (obj_type, obj_id, area): regions as structs, in area order."""
    named = area_ordinals(areas).select(F.col("type_rank").alias("area_type"), F.col("id").alias("area_id"), "area_ord", "name", "admin_level", "postcode")
    region = F.struct("area_ord", tx.typed_id(F.col("area_type"), F.col("area_id")).alias("id"), "name", "admin_level", "postcode")
    return memberships.join(named, AREA).groupBy("obj_type", "obj_id").agg(F.sort_array(F.collect_list(region)).alias("regions"))


def hit_addresses(hits: DataFrame, tables) -> DataFrame:
    """Completes the address of hits (query_id, place, kind, type_rank, id, lat_e7, lon_e7): street .. country, full_address, address_complete.

    Own tags hold first; what is missing comes from the areas that cover the hit's point, in area
    order: the first postcode, the first name of level 2 (country), 4 (state) and 8 (city; not for a
    building with a city of its own). Hits are found once, though they are read twice.
    """
    hits = settled(hits)
    own = tables.buildings.select(F.lit("building").alias("kind"), "type_rank", "id", "street", "house_number", "postcode", "city", "state", "country")
    roads = tables.streets.select(F.lit("street").alias("kind"), F.lit(1).alias("type_rank"), "id", F.col("name").alias("street"), *[F.lit(None).cast("string").alias(c) for c in ("house_number", "postcode", "city", "state", "country")])
    tagged = hits.join(own.unionByName(roads), ["kind", "type_rank", "id"], "left")
    named = area_ordinals(tables.areas).select(F.col("type_rank").alias("area_type"), F.col("id").alias("area_id"), "area_ord", "name", "admin_level", F.col("postcode").alias("area_postcode"))
    context = regions_at(hits.select("query_id", "place", "lat_e7", "lon_e7"), tables.area_vertices, ["query_id", "place"]).join(named, AREA)

    def first(value: Column, condition: Column) -> Column:
        return F.min_by(F.when(condition, value), F.when(condition, F.col("area_ord")))

    of_level = lambda n: first(F.col("name"), (F.col("admin_level") == n) & tx.filled(F.col("name")).isNotNull())
    found = context.groupBy("query_id", "place").agg(
        first(F.col("area_postcode"), tx.filled(F.col("area_postcode")).isNotNull()).alias("_postcode"), of_level(2).alias("_country"), of_level(4).alias("_state"), of_level(8).alias("_city")
    )
    out = tagged.join(found, ["query_id", "place"], "left")
    has_city = (F.col("kind") == "building") & tx.filled(F.col("city")).isNotNull()
    out = out.withColumns({
        "postcode": F.coalesce(tx.filled(F.col("postcode")), "_postcode"), "country": F.coalesce(tx.filled(F.col("country")), "_country"),
        "state": F.coalesce(tx.filled(F.col("state")), "_state"), "city": F.when(has_city, F.col("city")).otherwise(F.coalesce("_city", tx.filled(F.col("city")))),
    }).drop("_postcode", "_country", "_state", "_city")
    c = F.col
    return out.withColumn("full_address", tx.full_address(c("street"), c("house_number"), c("postcode"), c("city"), c("state"), c("country"))).withColumn(
        "address_complete", tx.address_complete(c("street"), c("house_number"), c("postcode"), c("city"), c("country"))
    )


def position(lat: Column, lon: Column) -> Column:
    """[lon, lat] with seven decimals, as JSON text."""
    return F.concat(F.lit("["), F.format_string("%.7f", lon / geo.number(1e7)), F.lit(","), F.format_string("%.7f", lat / geo.number(1e7)), F.lit("]"))


def line_geojson(vertices: DataFrame, key: list[str]) -> DataFrame:
    """(key, geometry): a LineString of the vertices by pos."""
    path = F.sort_array(F.collect_list(F.struct("pos", position(F.col("lat_e7"), F.col("lon_e7")).alias("p"))))
    text = F.array_join(F.transform(path, lambda v: v["p"]), ",")
    return vertices.groupBy(*key).agg(F.concat(F.lit('{"type":"LineString","coordinates":['), text, F.lit("]}")).alias("geometry"))


def area_geojson(area_vertices: DataFrame) -> DataFrame:
    """(type_rank, id, geometry): a MultiPolygon, a polygon for each component, its outer ring first, rings closed."""
    corner = F.struct("pos", position(F.col("lat_e7"), F.col("lon_e7")).alias("p"))
    path = F.sort_array(F.collect_list(corner))
    ring = area_vertices.groupBy("type_rank", "id", "component", "ring", "is_inner").agg(F.transform(path, lambda v: v["p"]).alias("p"))
    ring = ring.withColumn("p", F.concat(F.lit("["), F.array_join(F.concat("p", F.slice("p", 1, 1)), ","), F.lit("]")))
    parts = ring.groupBy("type_rank", "id", "component").agg(F.sort_array(F.collect_list(F.struct("is_inner", "ring", "p"))).alias("rings"))
    parts = parts.withColumn("p", F.concat(F.lit("["), F.array_join(F.transform("rings", lambda r: r["p"]), ","), F.lit("]")))
    whole = parts.groupBy("type_rank", "id").agg(F.sort_array(F.collect_list(F.struct("component", "p"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda r: r["p"]), ",")
    return whole.select("type_rank", "id", F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), text, F.lit("]}")).alias("geometry"))


def features(objects: DataFrame, properties: list[str]) -> DataFrame:
    """One feature of JSON text for each row of objects (type_rank, id, geometry, properties)."""
    props = F.to_json(F.struct(tx.typed_id(F.col("type_rank"), F.col("id")).alias("id"), *properties), {"ignoreNullFields": "false"})
    return objects.select("type_rank", "id", F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.col("geometry"), F.lit("}")).alias("feature"))


def kept_points(lat: np.ndarray, lon: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line a simplification keeps: ends, and between two kept ones the farthest if it is farther than the tolerance, again and again.

    Distances are in the plane of longitude and latitude, to the segment.
    """
    n = len(lat)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        x, y = lon[a + 1 : b] - lon[a], lat[a + 1 : b] - lat[a]
        dx, dy = lon[b] - lon[a], lat[b] - lat[a]
        size = dx * dx + dy * dy
        t = np.clip((x * dx + y * dy) / size, 0.0, 1.0) if size > 0 else 0.0
        d2 = (x - t * dx) ** 2 + (y - t * dy) ** 2
        far = int(np.argmax(d2))
        if d2[far] > tolerance * tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplified(vertices: DataFrame, key: list[str], zoom: int, ring: bool = False) -> DataFrame:
    """The vertices that lines keep at a zoom. A ring (its corners do not repeat the first) that would keep fewer than three corners keeps all."""
    tolerance = geo.level_scale(zoom) * 1e7
    path = F.sort_array(F.collect_list(F.struct("pos", "lat_e7", "lon_e7")))
    lines = vertices.groupBy(*key).agg(path.alias("path")).select(*key, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(len(key))
            ends = paths.offsets.to_numpy() - paths.offsets[0].as_py()
            flat = paths.flatten()
            lat, lon = flat.field("lat_e7").to_numpy().astype(np.float64), flat.field("lon_e7").to_numpy().astype(np.float64)
            keep = np.zeros(len(flat), dtype=bool)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                own_lat, own_lon = lat[lo:hi], lon[lo:hi]
                if ring:
                    own_lat, own_lon = np.append(own_lat, own_lat[0]), np.append(own_lon, own_lon[0])
                chosen = kept_points(own_lat, own_lon, tolerance)
                keep[lo:hi] = True if ring and chosen.sum() < 4 else chosen[: hi - lo]
            owner = np.repeat(np.arange(len(paths)), np.diff(ends))[keep]
            kept = flat.filter(pa.array(keep))
            own = batch.select(list(range(len(key)))).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*own.columns, kept.field("pos"), kept.field("lat_e7"), kept.field("lon_e7")], names=[*key, "pos", "lat_e7", "lon_e7"])

    return lines.mapInArrow(run, vertices.select(*key, "pos", "lat_e7", "lon_e7").schema)
