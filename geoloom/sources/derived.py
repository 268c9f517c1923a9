"""Geographic tables derived from the star schema by integer arithmetic, so that any engine gets the same coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corners of an octagon and of a diamond, in steps of latitude and longitude.
OCTAGON = ((2, -1), (2, 1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (-1, -2), (1, -2))
DIAMOND = ((1, 0), (0, 1), (-1, 0), (0, -1))
SQUARE = ((1, -1), (1, 1), (-1, 1), (-1, -1))


@dataclass
class Tables:
    """buildings, streets (id, name, highway_class), street_vertices (id, pos, ...), areas and area_vertices (one row for each corner)."""

    buildings: DataFrame
    streets: DataFrame
    street_vertices: DataFrame
    areas: DataFrame
    area_vertices: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = _read(spark, sf_dir, "customer").selectExpr("cast(c_custkey as bigint) k", "c_name", "c_mktsegment").selectExpr(
        "cast(1 as int) type_rank", "k id",
        "475000000 + ((k * 7919 + 13) * 104729) % 22000000 lat_e7", "75000000 + (k * 15485863) % 30000000 lon_e7",
        "k % 97 <> 0 has_point", "c_name name",
        "case k % 10 when 0 then null when 1 then 'no' else lower(c_mktsegment) end building_type",
        "case when k % 3 <> 0 then concat('Street ', k % 41) end street", "case when k % 4 <> 0 then cast(k % 90 as string) end house_number",
        "case when k % 5 = 0 then cast(70000 + k % 300 as string) end postcode", "case when k % 7 = 0 then concat('City ', k % 13) end city",
        "cast(null as string) state", "cast(null as string) country",
    )
    nodes = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) k", "s_name").selectExpr(
        "cast(0 as int) type_rank", "k id",
        "475000000 + ((k * 7907 + 7) * 104729) % 22000000 lat_e7", "75000000 + (k * 32452843) % 30000000 lon_e7",
        "true has_point", "s_name name", "case when k % 2 = 0 then 'yes' end building_type",
        "concat('Alley ', k % 23) street", "cast(k % 50 as string) house_number", "cast(null as string) postcode", "cast(null as string) city",
        "cast(null as string) state", "cast(null as string) country",
    )
    return ways.unionByName(nodes)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query point for every event."""
    return _read(spark, sf_dir, "events").selectExpr("cast(event_id as bigint) query_id").selectExpr(
        "query_id", "475000000 + ((query_id * 6133 + 5) * 104729) % 22000000 lat_e7", "75000000 + (query_id * 49979687) % 30000000 lon_e7"
    )


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query point for every supplier, some of them away from all data."""
    return _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) query_id").selectExpr(
        "query_id", "474000000 + ((query_id * 7477 + 11) * 104729) % 26000000 lat_e7", "72000000 + (query_id * 32452867) % 40000000 lon_e7"
    )


def _rings(areas: DataFrame, parts: list[tuple[str, str, str, int, int, bool, tuple]]) -> DataFrame:
    """parts: (which areas, dlat, dlon, step, component, inner, corners); ring numbers follow the order of parts."""
    out = None
    for ring, (which, dlat, dlon, step, component, inner, corners) in enumerate(parts):
        points = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners])).alias("pos", "p")
        rows = areas.where(which).select("type_rank", "id", F.lit(component).alias("component"), F.lit(ring).alias("ring"), F.lit(inner).alias("is_inner"), "lat0", "lon0", points)
        rows = rows.selectExpr("type_rank", "id", "component", "ring", "is_inner", "pos", f"lat0 + {dlat} + p.a * {step} lat_e7", f"lon0 + {dlon} + p.b * {step} lon_e7")
        out = rows if out is None else out.unionByName(rows)
    return out


def areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Areas of levels 2, 4 (octagons with a hole), 8 (some of two parts) and -1 (postal), and their corners."""
    region = _read(spark, sf_dir, "region").selectExpr("cast(r_regionkey as bigint) k", "r_name n")
    nation = _read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) k", "n_name n")
    supplier = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) k")
    two = region.selectExpr("2 type_rank", "100 + k id", "n name", "cast(2 as int) admin_level", "cast(null as string) postcode", "482000000 + k * 3000000 lat0", "84000000 + k * 3000000 lon0")
    four = nation.selectExpr("2 type_rank", "1000 + k id", "n name", "cast(4 as int) admin_level", "cast(null as string) postcode", "485000000 + (k % 5) * 4000000 lat0", "85000000 + (k div 5) * 4000000 lon0")
    post = nation.selectExpr("2 type_rank", "500000 + k id", "concat('Post ', k) name", "cast(-1 as int) admin_level", "cast(70000 + k as string) postcode", "484000000 + (k % 5) * 3000000 lat0", "84000000 + (k div 5) * 3000000 lon0")
    eight = supplier.selectExpr("1 type_rank", "100000 + k id", "concat('Town ', k) name", "cast(8 as int) admin_level", "cast(null as string) postcode", "475500000 + (k * 733103) % 21000000 lat0", "75500000 + (k * 1299709) % 29000000 lon0")
    every = two.unionByName(four).unionByName(post).unionByName(eight)
    parts = [
        ("admin_level = 2", "0", "0", 5000000, 1, False, SQUARE),
        ("admin_level = 4", "0", "0", 1500000, 1, False, OCTAGON),
        ("admin_level = 4", "0", "0", 400000, 1, True, DIAMOND),
        ("admin_level = -1", "0", "0", 900000, 1, False, DIAMOND),
        ("admin_level = 8", "0", "0", 200000, 1, False, DIAMOND),
        ("admin_level = 8 and id % 5 = 0", "0", "1000000", 150000, 2, False, DIAMOND),
    ]
    return every.drop("lat0", "lon0"), _rings(every, parts)


def street_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines, in order, as the vertices of a street; those of one vertex are no streets."""
    rows = _read(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) id", "cast(l_linenumber as bigint) ln", "cast(l_partkey as bigint) pk", "cast(l_suppkey as bigint) sk")
    return rows.selectExpr(
        "id", "cast(row_number() over (partition by id order by ln, pk, sk) - 1 as int) pos", "count(*) over (partition by id) n",
        "475000000 + (id * 245489) % 22000000 + (pk * 31 % 2000) * 200 lat_e7", "75000000 + (id * 15485867) % 30000000 + (sk * 37 % 2000) * 200 lon_e7",
    ).where("n >= 2").drop("n")


def streets(vertices: DataFrame) -> DataFrame:
    return vertices.select("id").distinct().selectExpr("id", "concat('Road ', id % 997) name", "element_at(array('residential', 'primary', 'service'), cast(id % 3 as int) + 1) highway_class")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    found, corners = areas(spark, sf_dir)
    vertices = street_vertices(spark, sf_dir)
    return Tables(buildings(spark, sf_dir), streets(vertices), vertices, found, corners)


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw nodes (parts), ways (orders, their lines' parts as refs) and relations (suppliers, their orders as members) with tags."""
    nodes = _read(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) id", "p_name", "p_brand").selectExpr(
        "id", "case when id % 101 = 0 then 950000000 else 475000000 + (id * 104729) % 22000000 end lat_e7", "75000000 + (id * 1299709) % 30000000 lon_e7",
        """map_filter(map('building', case when id % 5 = 0 then p_brand end, 'addr:street', case when id % 3 = 0 then concat('Street ', id % 41) end,
           'addr:housenumber', case when id % 6 = 0 then cast(id % 90 as string) end, 'name', case when id % 7 <> 0 then p_name end), (k, v) -> v is not null) tags""",
    )
    lines = _read(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey as bigint) id", "cast(l_linenumber as bigint) ln", "cast(l_partkey as bigint) pk", "cast(l_suppkey as bigint) sk")
    refs = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ln", "pk", "sk"))).alias("l")).selectExpr("id", "transform(l, v -> v.pk) r")
    ways = refs.selectExpr(
        "id", "case when id % 2 = 0 then concat(r, array(r[0])) else r end node_refs",
        """map_filter(map('highway', case when id % 3 = 0 then element_at(array('residential', 'primary', 'service'), cast(id % 7 % 3 as int) + 1) end,
           'building', case when id % 4 = 0 then 'yes' end, 'name', case when id % 5 <> 0 then concat('Way ', id) end,
           'boundary', case when id % 11 = 0 then 'administrative' when id % 13 = 0 then 'postal_code' end), (k, v) -> v is not null) tags""",
    )
    member = lines.selectExpr("sk", "id").distinct()
    joined = member.groupBy("sk").agg(F.sort_array(F.collect_list("id")).alias("m"))
    relations = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) id", "s_name").join(joined, F.col("id") == F.col("sk"), "left").selectExpr(
        "id", "transform(coalesce(m, array()), v -> struct('way' as type, v as ref, element_at(array('outer', 'inner', ''), cast(v % 3 as int) + 1) as role)) members",
        """map_filter(map('type', case when id % 2 = 0 then 'multipolygon' else 'boundary' end, 'building', case when id % 3 = 0 then 'yes' end,
           'boundary', case when id % 5 = 0 then 'administrative' when id % 7 = 0 then 'postal_code' end, 'admin_level', cast(id % 12 as string),
           'name', case when id % 4 <> 0 then s_name end), (k, v) -> v is not null) tags""",
    )
    return nodes, ways, relations


#: Sides of the shapes' squares, and how far apart the shapes stand.
SHAPE, SHAPE_STEP = 4000, 20000


def shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw nodes, ways and relations, one relation for each supplier k, whose rings are known.

    A square's outline is in two ways (100 k + 1 and, written backwards, 100 k + 2), a smaller one in it
    is way 100 k + 3, one far off 100 k + 4. Relations are areas and buildings with both outlines and,
    where k % 5 = 0, the far one; where k % 7 = 0 a member is not in the file, where k % 11 = 0 the
    outline stays open. Where k % 4 = 3 the relation is a building of no type that makes rings.
    """
    k = _read(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as bigint) k", "s_name")
    at = k.selectExpr("*", f"480000000 + (k % 100) * {SHAPE_STEP} lat0", f"90000000 + (k div 100) * {SHAPE_STEP} lon0")
    a, b = SHAPE, SHAPE // 4
    corners = [(0, 0), (a, 0), (a, a), (0, a), (b, b), (3 * b, b), (3 * b, 3 * b), (b, 3 * b), (2 * a, 0), (2 * a + b, 0), (2 * a + b, b), (2 * a, b)]
    points = ", ".join(f"struct({i} as i, {y} as y, {x} as x)" for i, (y, x) in enumerate(corners))
    nodes = at.selectExpr("k", "lat0", "lon0", f"inline(array({points}))").selectExpr("100 * k + i id", "lat0 + y lat_e7", "lon0 + x lon_e7", "cast(map() as map<string, string>) tags")
    lines = ", ".join(f"struct({w} as w, array({', '.join(map(str, refs))}) as refs)" for w, refs in ((1, (0, 1, 2)), (2, (0, 3, 2)), (3, (4, 5, 6, 7, 4)), (4, (8, 9, 10, 11, 8))))
    ways = k.selectExpr("k", f"inline(array({lines}))").selectExpr("100 * k + w id", "transform(refs, r -> 100 * k + r) node_refs", "cast(map() as map<string, string>) tags")
    members = "filter(array(1, if(k % 11 = 0, null, 2), 3, if(k % 5 = 0, 4, null), if(k % 7 = 0, 9, null)), w -> w is not null)"
    relations = k.selectExpr(
        "k id", f"transform({members}, w -> struct('way' as type, 100 * k + w as ref, '' as role)) members",
        "map_filter(map('type', if(k % 4 = 3, 'site', 'multipolygon'), 'building', 'yes', 'boundary', if(k % 4 = 3, null, 'administrative'), 'name', if(k % 3 = 0, null, s_name)), (x, v) -> v is not null) tags",
    )
    return nodes, ways, relations
