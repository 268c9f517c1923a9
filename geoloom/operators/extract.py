"""From raw nodes, ways and relations to buildings, streets and areas."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions import text as tx

BOUNDARIES = ("administrative", "postal_code")
POINTS = "array<struct<lat_e7: long, lon_e7: long>>"


@dataclass
class Extraction:
    buildings: DataFrame
    streets: DataFrame
    areas: DataFrame
    report: tuple[DataFrame, ...]

    @property
    def stats(self) -> DataFrame:
        return extraction_stats(self.buildings, self.streets, self.areas, self.report)


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-900000000, 900000000) & lon.between(-1800000000, 1800000000), F.lit(False))


def relation_way_ids(relations: DataFrame) -> DataFrame:
    """Ways that any relation refers to."""
    return relations.select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()


def ways_with_geometry(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Ways whose points are needed: buildings, streets, boundaries, and members of relations."""
    needed = tx.has_key("building") | tx.has_key("highway") | F.coalesce(tx.tag("boundary").isin(*BOUNDARIES), F.lit(False))
    member = ways.where(~needed).join(relation_way_ids(relations), "id", "left_semi")
    return ways.where(needed).unionByName(member)


def required_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Nodes that the ways refer to."""
    return nodes.join(ways.select(F.explode("node_refs").alias("id")).distinct(), "id", "left_semi")


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, points, missing): each way's valid locations in order of its refs, and how many refs have none."""
    refs = ways.select("id", F.posexplode("node_refs").alias("pos", "ref"))
    placed = refs.join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7"), "ref", "left")
    ok = valid(F.col("lat_e7"), F.col("lon_e7"))
    point = F.struct("pos", F.col("lat_e7").cast("long").alias("lat_e7"), F.col("lon_e7").cast("long").alias("lon_e7"))
    found = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.when(ok, point))).alias("p"), F.count_if(~ok).alias("missing"))
    found = found.select("id", F.transform("p", lambda v: F.struct(v["lat_e7"].alias("lat_e7"), v["lon_e7"].alias("lon_e7"))).alias("points"), "missing")
    return ways.select("id").join(found, "id", "left").select("id", F.coalesce("points", F.expr(f"cast(array() as {POINTS})")).alias("points"), F.coalesce("missing", F.lit(0)).alias("missing"))


def box_centre(points: Column) -> Column:
    lat, lon = F.transform(points, lambda v: v["lat_e7"]), F.transform(points, lambda v: v["lon_e7"])
    return F.when(F.size(points) > 0, F.struct(geo.bbox_centre(F.array_min(lat), F.array_max(lat)).alias("lat_e7"), geo.bbox_centre(F.array_min(lon), F.array_max(lon)).alias("lon_e7")))


def closed(points: Column) -> Column:
    return (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))


def _shoelace(points: Column) -> Column:
    """Twice the area and the sums for the centroid, in degrees from the first point."""
    first = F.element_at(points, 1)
    rel = F.transform(points, lambda v: F.struct(((v["lon_e7"] - first["lon_e7"]) / 1e7).alias("x"), ((v["lat_e7"] - first["lat_e7"]) / 1e7).alias("y")))
    steps = F.zip_with(F.slice(rel, F.lit(1), F.size(rel) - 1), F.slice(rel, F.lit(2), F.size(rel) - 1), lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("w"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(steps, zero, lambda t, s: F.struct((t["w"] + s["w"]).alias("w"), (t["x"] + s["x"] * s["w"]).alias("x"), (t["y"] + s["y"] * s["w"]).alias("y")))


def ring_area(points: Column) -> Column:
    """Twice the absolute area in square degrees; 0 under four points."""
    return F.when(F.size(points) >= 4, F.abs(_shoelace(points)["w"])).otherwise(F.lit(0.0))


def representative_point(points: Column) -> Column:
    """The centroid of a closed ring with an area, else the middle of the box."""
    first, s = F.element_at(points, 1), _shoelace(points)
    centroid = F.struct(
        (first["lat_e7"] + F.round(s["y"] / (3 * s["w"]) * 1e7)).cast("long").alias("lat_e7"), (first["lon_e7"] + F.round(s["x"] / (3 * s["w"]) * 1e7)).cast("long").alias("lon_e7")
    )
    return F.when(closed(points) & (F.abs(s["w"]) >= geo.number(1e-12)), centroid).otherwise(box_centre(points))


def building_fields() -> list[Column]:
    return [
        tx.best_name().alias("name"), tx.tag("building").alias("building_type"), tx.tag("addr:street").alias("street"), tx.tag("addr:housenumber").alias("house_number"),
        tx.tag("addr:postcode").alias("postcode"), tx.tag("addr:city").alias("city"), tx.tag("addr:state").alias("state"), tx.tag("addr:country").alias("country"),
    ]


def assemble(ways: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]] | None:
    """Joins lines end to end into closed rings, in the order they come; None if one stays open."""
    rings, open_lines = [], [list(w) for w in ways if len(w) > 1]
    ends: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, w in enumerate(open_lines):
        ends[w[0]].add(i)
        ends[w[-1]].add(i)
    used: set[int] = set()
    for i, w in enumerate(open_lines):
        if i in used:
            continue
        used.add(i)
        ring = list(w)
        while ring[0] != ring[-1]:
            after = min((j for j in ends[ring[-1]] if j not in used), default=None)
            if after is None:
                return None
            used.add(after)
            line = open_lines[after]
            ring += (line if line[0] == ring[-1] else line[::-1])[1:]
        rings.append(ring)
    return rings


def _inside(p: tuple[int, int], ring: list[tuple[int, int]]) -> bool:
    inside = False
    for (ay, ax), (by, bx) in zip(ring, ring[1:], strict=False):
        if (ay > p[0]) != (by > p[0]) and (p[1] - ax) * (by - ay) * (1 if by > ay else -1) < (bx - ax) * (p[0] - ay) * (1 if by > ay else -1):
            inside = not inside
    return inside


def nested(rings: list[list[tuple[int, int]]]) -> list[tuple[int, bool, list[tuple[int, int]]]]:
    """(component, is_inner, ring): rings at even depth are outer, each followed by the inner ones just inside it. Rings under four points are dropped, inner ones also without their outer."""
    depth = [sum(_inside(r[0], other) for k, other in enumerate(rings) if k != i) for i, r in enumerate(rings)]
    out, component = [], 0
    for i, r in enumerate(rings):
        if depth[i] % 2 or len(r) < 4:
            continue
        component += 1
        out.append((component, False, r))
        out += [(component, True, h) for k, h in enumerate(rings) if depth[k] == depth[i] + 1 and len(h) >= 4 and _inside(h[0], r)]
    return out


RINGS = "type_rank int, id long, component int, ring int, is_inner boolean, points array<struct<lat_e7: long, lon_e7: long>>"


def relation_rings(relations: DataFrame, geometry: DataFrame) -> DataFrame:
    """Rings of complete multipolygon and boundary relations, one task's rows for each relation; a relation with a missing or an open way has none."""
    typed = relations.where(F.coalesce(tx.tag("type").isin("multipolygon", "boundary"), F.lit(False)))
    members = typed.select(F.col("id").alias("relation"), F.posexplode("members").alias("at", "m")).where("m.type = 'way'").select("relation", "at", F.col("m.ref").alias("id"))
    placed = members.join(geometry.where("missing = 0"), "id", "left").select("relation", "at", "points")

    def rings(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        lines = [None if p is None else [(v["lat_e7"], v["lon_e7"]) for v in p] for p in group["points"]]
        found = None if any(line is None for line in lines) else assemble(lines)
        rows = [(2, int(group["relation"].iloc[0]), c, i, inner, [{"lat_e7": a, "lon_e7": b} for a, b in r]) for i, (c, inner, r) in enumerate(nested(found or []))]
        return pd.DataFrame(rows, columns=["type_rank", "id", "component", "ring", "is_inner", "points"])

    return placed.groupBy("relation").applyInPandas(rings, RINGS)


def extract(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> Extraction:
    """nodes (id, lat_e7, lon_e7, tags), ways (id, node_refs, tags), relations (id, members, tags)."""
    needed = ways_with_geometry(ways, relations)
    geometry = way_geometry(needed, required_nodes(nodes, needed))
    shaped = needed.join(geometry, "id")
    point_fields = lambda p: [p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7"), p.isNotNull().alias("has_point")]
    from_nodes = nodes.where((tx.has_key("building") | tx.has_address()) & valid(F.col("lat_e7"), F.col("lon_e7")))
    from_nodes = from_nodes.select(F.lit(0).alias("type_rank"), "id", F.col("lat_e7").cast("long").alias("lat_e7"), F.col("lon_e7").cast("long").alias("lon_e7"), F.lit(True).alias("has_point"), *building_fields())
    from_ways = shaped.where(tx.has_key("building")).withColumn("p", representative_point(F.col("points")))
    from_ways = from_ways.select(F.lit(1).alias("type_rank"), "id", *point_fields(F.col("p")), *building_fields())
    rings = relation_rings(relations, geometry)

    tagged = relations.where(tx.has_key("building"))
    lines = tagged.select("id", F.explode("members").alias("m")).where("m.type = 'way'").select("id", F.col("m.ref").alias("way")).join(geometry.select(F.col("id").alias("way"), "points"), "way")
    closed_line = F.when(closed(F.col("points")), F.struct(ring_area(F.col("points")).alias("area"), (-F.col("way")).alias("o"), F.col("points").alias("points")))
    every = lines.groupBy("id").agg(F.max(closed_line).alias("largest"), F.flatten(F.collect_list("points")).alias("all"))
    outer = rings.where("not is_inner").groupBy("id").agg(F.max(F.struct(ring_area(F.col("points")).alias("area"), (-F.col("ring")).alias("o"), "points")).alias("outer"))
    placed = tagged.join(every, "id", "left").join(outer, "id", "left")
    spot = F.coalesce(representative_point(F.col("outer.points")), F.when(F.col("largest").isNotNull(), representative_point(F.col("largest.points"))), box_centre(F.col("all")))
    from_relations = placed.withColumn("p", spot).select(F.lit(2).alias("type_rank"), "id", *point_fields(F.col("p")), *building_fields())
    buildings = from_nodes.unionByName(from_ways).unionByName(from_relations)

    streets = shaped.where(tx.has_key("highway") & (F.size("points") >= 2)).select("id", tx.best_name().alias("name"), tx.tag("highway").alias("highway_class"), "points")

    is_area = F.coalesce(tx.tag("boundary").isin(*BOUNDARIES), F.lit(False))
    area_fields = [tx.best_name().alias("name"), tx.admin_level(F.col("tags")["admin_level"]).alias("admin_level"), tx.tag("postal_code").alias("postcode")]
    ring_list = F.sort_array(F.collect_list(F.struct("ring", "component", "is_inner", "points"))).alias("rings")
    shapes = rings.groupBy("id").agg(ring_list, F.count_if("is_inner").alias("inner_ring_count"), F.count_if(~F.col("is_inner")).alias("outer_ring_count"))
    of_relations = relations.where(is_area).join(shapes, "id", "left").select(F.lit(2).alias("type_rank"), "id", *area_fields, F.coalesce(F.col("outer_ring_count") > 0, F.lit(False)).alias("has_geometry"), F.coalesce("outer_ring_count", F.lit(0)).alias("outer_ring_count"), F.coalesce("inner_ring_count", F.lit(0)).alias("inner_ring_count"), "rings")
    own = F.array(F.struct(F.lit(0).alias("ring"), F.lit(1).alias("component"), F.lit(False).alias("is_inner"), "points"))
    of_ways = shaped.where(is_area & closed(F.col("points")) & (F.col("missing") == 0)).select(F.lit(1).alias("type_rank"), "id", *area_fields, F.lit(True).alias("has_geometry"), F.lit(1).cast("long").alias("outer_ring_count"), F.lit(0).cast("long").alias("inner_ring_count"), own.alias("rings"))
    areas = of_relations.unionByName(of_ways)
    report = (processed(nodes, ways, relations), relation_faults(relations.where(is_area), geometry), geometry.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("invalid_way_nodes")))
    return Extraction(buildings, streets, areas, report)


def processed(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: how many raw nodes, ways and relations there are."""
    n, w, r = (df.agg(F.count("*").alias(f"processed_{name}")) for name, df in (("nodes", nodes), ("ways", ways), ("relations", relations)))
    return n.join(w, F.lit(True)).join(r, F.lit(True))


def relation_faults(relations: DataFrame, geometry: DataFrame) -> DataFrame:
    """One row: of relations whose type makes rings, how many lack a member way (or a point of one), and how many line ends of complete ones meet no other."""
    typed = relations.where(F.coalesce(tx.tag("type").isin("multipolygon", "boundary"), F.lit(False)))
    members = typed.select(F.col("id").alias("relation"), F.explode("members").alias("m")).where("m.type = 'way'").select("relation", F.col("m.ref").alias("id"))
    placed = members.join(geometry.where("missing = 0"), "id", "left")
    whole = placed.groupBy("relation").agg(F.count_if(F.col("points").isNull()).alias("lacking"))
    ends = placed.where(F.size("points") > 1).select("relation", F.explode(F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("end"))
    odd = ends.groupBy("relation", "end").agg(F.count("*").alias("n")).where("n % 2 = 1").join(whole.where("lacking = 0"), "relation", "left_semi")
    incomplete = whole.agg(F.coalesce(F.count_if(F.col("lacking") > 0), F.lit(0)).alias("incomplete_relations"))
    return incomplete.join(odd.agg(F.floor(F.count("*") / 2).alias("open_rings")), F.lit(True))


def extraction_stats(buildings: DataFrame, streets: DataFrame, areas: DataFrame, report: tuple[DataFrame, ...] = ()) -> DataFrame:
    """One row: buildings (without name, without point), streets, areas (their rings, how many have none), and the rows of report."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = buildings.agg(F.count("*").alias("buildings"), zero(F.count_if(F.col("name").isNull())).alias("buildings_without_name"), zero(F.count_if(~F.col("has_point"))).alias("buildings_without_point"))
    out = out.join(streets.agg(F.count("*").alias("streets")), F.lit(True))
    rings = [zero(F.sum(f"{kind}_ring_count")).alias(f"{kind}_rings") for kind in ("outer", "inner")]
    out = out.join(areas.agg(F.count("*").alias("areas"), zero(F.count_if(~F.col("has_geometry"))).alias("areas_without_geometry"), *rings), F.lit(True))
    for part in report:
        out = out.join(part, F.lit(True))  # one row each
    return out


def area_vertices(areas: DataFrame) -> DataFrame:
    """Corners of all rings, the closing one left out, as the spatial operators take them."""
    rows = areas.where("has_geometry").select("type_rank", "id", F.explode("rings").alias("r"))
    rows = rows.select("type_rank", "id", "r.component", "r.ring", "r.is_inner", F.size("r.points").alias("n"), F.posexplode("r.points").alias("pos", "p"))
    return rows.where("pos < n - 1").select("type_rank", "id", "component", "ring", "is_inner", "pos", "p.lat_e7", "p.lon_e7")


def street_vertices(streets: DataFrame) -> DataFrame:
    return streets.select("id", F.posexplode("points").alias("pos", "p")).select("id", "pos", "p.lat_e7", "p.lon_e7")
