"""Which areas cover points, meet streets and overlap areas: cell joins with exact refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geo
from geoloom.operators.cells import SLABS, covered, floor_cell, in_cells, meeting_cells, projected, segments
from geoloom.plans.settle import settled

AREA = ["area_type", "area_id"]
#: The finest level of cells that cover areas; cells have edges of 2**-level in the plane.
FINEST_COVER = 24
#: Cells of a level, and edges in them, that go to the points, at most.
SMALL = 20_000
#: Rows of edges in cells that go to the segments that may meet them, at most.
FEW_MEETING = 1_500_000


def area_ordinals(areas: DataFrame) -> DataFrame:
    """A canonical number for each area, by type and id. One row for each area: a global sort of a small table."""
    return areas.withColumn("area_ord", F.row_number().over(Window.orderBy("type_rank", "id")).cast("long"))


def area_edges(area_vertices: DataFrame) -> DataFrame:
    """Edges of all rings in the plane. Ring corners do not repeat the first."""
    edges = segments(area_vertices, ["type_rank", "id", "component", "ring", "is_inner"], closed=True)
    return settled(edges.withColumnsRenamed({"type_rank": "area_type", "id": "area_id"}))


def _slabs(edges: DataFrame) -> DataFrame:
    return edges.withColumn("slab", F.explode(covered(F.least("ay", "by"), F.greatest("ay", "by"), SLABS)))


def refine(candidates: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Of candidates (key, gx, gy, area), those whose point the area covers.

    A point is covered if it lies on any ring, or if it is inside the outer ring of a component and
    in none of that component's holes. Only edges in the point's slab are met.
    """
    met = candidates.withColumn("slab", floor_cell(F.col("gy"), SLABS)).join(_slabs(edges).drop("pos"), [*AREA, "slab"])
    p = [F.col(c) for c in ("ax", "ay", "bx", "by", "gx", "gy")]
    ring = met.groupBy(*key, *AREA, "component", "ring", "is_inner").agg((F.sum(F.when(geo.crosses_ray(*p), 1).otherwise(0)) % 2 == 1).alias("inside"), F.bool_or(geo.on_segment(*p)).alias("touches"))
    part = ring.groupBy(*key, *AREA, "component").agg(F.bool_or("touches").alias("touches"), F.bool_or(~F.col("is_inner") & F.col("inside")).alias("outer"), F.bool_or(F.col("is_inner") & F.col("inside")).alias("hole"))
    return part.groupBy(*key, *AREA).agg(F.bool_or(F.col("touches") | (F.col("outer") & ~F.col("hole"))).alias("covers")).where("covers").drop("covers")


def _covered_by(edges: Column, gx: Column, gy: Column) -> Column:
    """Whether the rings of these edges cover the point, as `refine` says it; edges left of the point and beyond its row may be missing."""
    ends = lambda e: [e[c] for c in ("ax", "ay", "bx", "by")]
    crossed = F.transform(F.filter(edges, lambda e: geo.crosses_ray(*ends(e), gx, gy)), lambda e: F.struct(e["component"], e["ring"], e["is_inner"]))
    odd = F.filter(F.array_distinct(crossed), lambda r: F.size(F.filter(crossed, lambda o: o == r)) % 2 == 1)
    part = lambda inner: F.transform(F.filter(odd, lambda r: r["is_inner"] == F.lit(inner)), lambda r: r["component"])
    return F.exists(edges, lambda e: geo.on_segment(*ends(e), gx, gy)) | (F.size(F.array_except(part(False), part(True))) > 0)


def cover_cells(edges: DataFrame) -> DataFrame:
    """(level, cx, cy, area, edges) for each cell that an area may cover, on the level of the area's largest part.

    edges are null where the cell lies inside as a whole, else those that decide on its points: the
    ones of its row that reach as far right. Cells outside are left out.
    """
    c = F.col
    box = edges.groupBy(*AREA, "component").agg(F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"))
    extent = F.greatest(F.max(c("x1") - c("x0")), F.max(c("y1") - c("y0")), F.lit(1e-9))
    # Cells are a quarter to a 16th as large as the part, on every second level.
    level = (F.greatest(F.lit(-12), F.least(F.lit(FINEST_COVER), F.ceil((2 - F.log2(extent)) / 2) * 2))).cast("int")
    leveled = settled(box.groupBy(*AREA).agg(level.alias("level"), F.collect_list(F.struct("x0", "x1", "y0", "y1")).alias("boxes")))
    per_unit = F.pow(F.lit(2.0), c("level"))
    every = leveled.withColumn("b", F.explode("boxes")).withColumn("cx", F.explode(covered(c("b.x0"), c("b.x1"), per_unit))).withColumn("cy", F.explode(covered(c("b.y0"), c("b.y1"), per_unit)))
    every = every.select(*AREA, "level", "cx", "cy").distinct()
    of_level = edges.join(leveled.select(*AREA, "level"), AREA)
    met = in_cells(of_level, per_unit).select(*AREA, "cx", "cy").distinct().withColumn("met", F.lit(True))
    rows = of_level.withColumn("cy", F.explode(covered(F.least("ay", "by"), F.greatest("ay", "by"), per_unit)))
    rows = rows.groupBy(*AREA, "cy").agg(F.collect_list(F.struct("component", "ring", "is_inner", "ax", "ay", "bx", "by")).alias("edges"))
    cells = every.join(met, [*AREA, "cx", "cy"], "left").join(rows, [*AREA, "cy"])
    right = F.filter("edges", lambda e: F.greatest(e["ax"], e["bx"]) >= c("cx") / per_unit - 2 * geo.EPS)
    cells = cells.withColumn("edges", right)
    inside = _covered_by(c("edges"), (c("cx") + 0.5) / per_unit, (c("cy") + 0.5) / per_unit)
    return cells.where(c("met") | inside).select("level", "cx", "cy", *AREA, F.when(c("met"), c("edges")).alias("edges"))


def regions_at(points: DataFrame, area_vertices: DataFrame, key: list[str]) -> DataFrame:
    """(key, area_type, area_id) for every area that covers a point (key, lat_e7, lon_e7). Points are joined by cell; those in cells that an edge meets are decided by the cell's edges. A key has one point."""
    cells = settled(cover_cells(area_edges(area_vertices)))
    held = cells.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("edges"), F.lit(0))).alias("e")).collect()  # at most some 20 levels
    placed = settled(projected(points.select(*dict.fromkeys([*key, "lat_e7", "lon_e7"])).distinct()).select(*dict.fromkeys([*key, "gx", "gy"])))
    small = [r["level"] for r in held if r["n"] <= SMALL and r["e"] <= SMALL]
    out = None
    for levels in filter(None, (small, *([r["level"]] for r in held if r["level"] not in small))):  # one join for all small ones keeps the plan short
        per_unit = F.pow(F.lit(2.0), F.col("level"))
        own = cells.where(F.col("level").isin(levels))
        own = F.broadcast(own) if levels is small else own.hint("merge")
        met = placed.withColumn("level", F.explode(F.lit(levels))).withColumn("cx", floor_cell(F.col("gx"), per_unit)).withColumn("cy", floor_cell(F.col("gy"), per_unit)).join(own, ["level", "cx", "cy"])
        met = met.where(F.col("edges").isNull() | _covered_by(F.col("edges"), F.col("gx"), F.col("gy"))).select(*key, *AREA)
        out = met if out is None else out.unionByName(met)
    if out is None:
        out = placed.join(cells, F.lit(False)).select(*key, *AREA)
    return out


def covers(pairs: DataFrame, area_vertices: DataFrame, key: list[str]) -> DataFrame:
    """Adds `covers` to pairs (key, area_type, area_id, lat_e7, lon_e7); an unknown area covers nothing."""
    hits = refine(projected(pairs).select(*key, "gx", "gy", *AREA), area_edges(area_vertices), key).withColumn("covers", F.lit(True))
    return pairs.join(hits, [*key, *AREA], "left").withColumn("covers", F.coalesce("covers", F.lit(False)))


def _meeting(paths: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Paths' segments (key, a, b) that meet area edges, by cells as large as the median area edge; boxes are compared first.

    Area edges go to the segments if they have few rows in cells. Most pairs cross or are apart, which
    four signs tell; only the others are measured, in a step of its own, as its code is long.
    """
    per_unit = meeting_cells(edges)
    c = F.col
    cell = (c("cx") * F.lit(1 << 32) + c("cy")).alias("cell")
    ends = ("ax", "ay", "bx", "by")
    given = settled(in_cells(edges, per_unit).select(*AREA, cell, *ends))
    given = F.broadcast(given) if given.count() <= FEW_MEETING else given.hint("merge")
    met = in_cells(paths, per_unit).select(*key, cell, *[c(v).alias(f"p{v}") for v in ends]).join(given, "cell")
    for v in "xy":
        met = met.where((F.greatest(f"pa{v}", f"pb{v}") >= F.least(f"a{v}", f"b{v}")) & (F.least(f"pa{v}", f"pb{v}") <= F.greatest(f"a{v}", f"b{v}")))
    p, q, a, b = ((c(f"{v}x"), c(f"{v}y")) for v in ("pa", "pb", "a", "b"))
    proper, near = geo.segments_cross(p, q, a, b)
    met = met.where(proper | near)
    # A number of each row keeps the next condition out of the join's.
    met = met.select(*key, *AREA, *[f"p{v}" for v in ends], *ends, proper.alias("proper"), F.monotonically_increasing_id().alias("_row"))
    touches = F.exists(F.array(F.col("_row")), lambda r: (r >= 0) & geo.segments_meet(p, q, a, b))
    return met.where(F.col("proper") | touches).select(*key, *AREA).distinct()


def street_regions(street_vertices: DataFrame, area_vertices: DataFrame) -> DataFrame:
    """(street_id, area) for every area that a street crosses, touches, or begins or ends in."""
    vertices = street_vertices.withColumnRenamed("id", "street_id")
    crossing = _meeting(segments(vertices, ["street_id"], closed=False), area_edges(area_vertices), ["street_id"])
    ends = vertices.groupBy("street_id").agg(F.min_by(F.struct("lat_e7", "lon_e7"), "pos").alias("a"), F.max_by(F.struct("lat_e7", "lon_e7"), "pos").alias("b"))
    ends = ends.select("street_id", F.explode(F.array("a", "b")).alias("p")).select("street_id", "p.lat_e7", "p.lon_e7").distinct()
    inside = regions_at(ends, area_vertices, ["street_id", "lat_e7", "lon_e7"]).select("street_id", *AREA)
    return crossing.unionByName(inside).distinct()


def area_overlap(area_vertices: DataFrame) -> DataFrame:
    """(own, area) for all areas that overlap: rings meet, or one holds the first corner of the other's ring."""
    own = ["own_type", "own_id"]
    edges = area_edges(area_vertices)
    paths = edges.withColumnsRenamed({"area_type": "own_type", "area_id": "own_id"})
    crossing = _meeting(paths, edges, own)
    corners = area_vertices.where("pos = 0").select(F.col("type_rank").alias("own_type"), F.col("id").alias("own_id"), F.col("ring").alias("own_ring"), F.col("is_inner").alias("own_inner"), "lat_e7", "lon_e7")
    within = regions_at(corners, area_vertices, [*own, "own_ring", "own_inner"])
    holds = within.where("not own_inner").select(F.col("area_type").alias("own_type"), F.col("area_id").alias("own_id"), F.col("own_type").alias("area_type"), F.col("own_id").alias("area_id"))
    return crossing.unionByName(within.select(*own, *AREA)).unionByName(holds).where("own_type <> area_type or own_id <> area_id").distinct()


def memberships(buildings: DataFrame, street_vertices: DataFrame, area_vertices: DataFrame) -> DataFrame:
    """The assignment of every object to its regions: kind (building, street, area), obj_type, obj_id and the area."""
    points = buildings.where("has_point").select(F.col("type_rank").alias("obj_type"), F.col("id").alias("obj_id"), "lat_e7", "lon_e7")
    b = regions_at(points, area_vertices, ["obj_type", "obj_id"]).withColumn("kind", F.lit("building"))
    s = street_regions(street_vertices, area_vertices).select(F.lit("street").alias("kind"), F.lit(1).alias("obj_type"), F.col("street_id").alias("obj_id"), *AREA)
    a = area_overlap(area_vertices).select(F.lit("area").alias("kind"), F.col("own_type").alias("obj_type"), F.col("own_id").alias("obj_id"), *AREA)
    return b.select("kind", "obj_type", "obj_id", *AREA).unionByName(s).unionByName(a)
