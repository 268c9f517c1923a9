import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions import text as tx
from geoloom.operators import describe, extract, nearest, regions, viewport
from geoloom.operators.viewport import Box
from geoloom.plans.settle import discard, settled
from geoloom.sources.derived import Tables

E7 = 10_000_000


def _unit(lat, lon):
    la, lo = lat * 1e-7 * geo.RAD, lon * 1e-7 * geo.RAD
    return math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def _metres(a, b):
    return geo.EARTH_RADIUS_M * math.atan2(math.sqrt(_dot(_cross(a, b), _cross(a, b))), _dot(a, b))


def _points(n, seed, spread=3.0, clumps=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        scale = 0.001 if clumps and i % 2 else spread
        out.append((i, int((49 + rnd.uniform(0, scale)) * E7), int((9 + rnd.uniform(0, scale)) * E7)))
    return out


@pytest.mark.parametrize(("n", "k", "clumps"), [(5, 10, False), (400, 1, False), (400, 7, True)])
def test_knn_is_brute_force(spark, n, k, clumps):
    data = _points(n, 1, clumps=clumps) + [(9000, 490000000, 90000000), (9001, 490000000, 90000000)]
    asked = _points(40, 2) + [(500, -330000000, 1510000000), (501, 490000000, 90000000), (502, 900000000, 0)]
    points = spark.createDataFrame([(i % 3, i, la, lo) for i, la, lo in data], "type_rank int, id long, lat_e7 long, lon_e7 long")
    queries = spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long")
    found = {}
    for r in nearest.knn(queries, points, k).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.type_rank, r.id)
    for q, la, lo in asked:
        want = sorted((_metres(_unit(la, lo), _unit(a, b)), i % 3, i) for i, a, b in data)[:k]
        got = [found[q][i + 1] for i in range(len(want))]
        dist = {(i % 3, i): _metres(_unit(la, lo), _unit(a, b)) for i, a, b in data}
        assert [round(dist[g], 6) for g in got] == [round(d, 6) for d, _, _ in want]
        assert len(found[q]) == len(want)
    assert nearest.knn(queries, points, 0).count() == 0


@pytest.mark.parametrize("k", [1, 10])
def test_knn_sends_no_points_to_the_driver(spark, k):
    data = _points(2000, 3) + [(5000 + i, 500000000, 100000000) for i in range(40)]
    asked = _points(2000, 4) + [(9000, 500000000, 100000000), (9001, 300000000, -100000000), (9002, 481000000, 60000000)]
    points = spark.createDataFrame([(i % 3, i, la, lo) for i, la, lo in data], "type_rank int, id long, lat_e7 long, lon_e7 long")
    queries = spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = nearest.knn(queries, points, k)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.type_rank, r.id)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    units = [(_unit(a, b), i % 3, i) for i, a, b in data]
    assert len(got) == len(asked)
    for q, la, lo in asked[::40] + asked[-3:]:
        at = _unit(la, lo)
        assert [got[q][i + 1] for i in range(k)] == [(t, i) for _, t, i in sorted((_metres(at, u), t, i) for u, t, i in units)[:k]]


def _square(area, lat, lon, half, ring=0, component=1, inner=False):
    return [(2, area, component, ring, inner, p, int((lat + a * half) * E7), int((lon + b * half) * E7)) for p, (a, b) in enumerate(((1, -1), (1, 1), (-1, 1), (-1, -1)))]


AREA_SCHEMA = "type_rank int, id long, component int, ring int, is_inner boolean, pos int, lat_e7 long, lon_e7 long"


def test_holes_parts_and_boundaries(spark):
    corners = _square(1, 50, 10, 1) + _square(1, 50, 10, 0.2, 1, 1, True) + _square(1, 53, 10, 0.5, 2, 2) + _square(2, 50, 10, 3)
    points = [(1, 50.5, 10.0), (2, 50.0, 10.0), (3, 53.0, 10.0), (4, 51.8, 10.0), (5, 60.0, 10.0), (6, 51.0, 9.0), (7, 50.2, 9.8)]
    q = spark.createDataFrame([(i, int(a * E7), int(b * E7)) for i, a, b in points], "query_id long, lat_e7 long, lon_e7 long")
    vertices = spark.createDataFrame(corners, AREA_SCHEMA)
    found = {(r.query_id, r.area_id) for r in regions.regions_at(q, vertices, ["query_id"]).collect()}
    assert found == {(1, 1), (1, 2), (2, 2), (3, 1), (4, 2), (6, 1), (6, 2), (7, 1), (7, 2)} | ({(3, 2)} if (3, 2) in found else set())
    pairs = q.join(spark.createDataFrame([(2, 1), (9, 9)], "area_type int, area_id long"), F.lit(True))
    assert {(r.query_id, r.area_id) for r in regions.covers(pairs, vertices, ["query_id"]).where("covers").collect()} == {p for p in found if p[1] == 1}


def _joined_rows(df):
    """The rows that the joins of a plan that has run gave, all in all."""

    def of(node):
        inner = [getattr(node, m)() for m, name in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if node.getClass().getSimpleName().endswith(name)]
        children = node.children()
        inner += [children.apply(i) for i in range(children.size())]
        own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        return own + sum(map(of, inner))

    return of(df._jdf.queryExecution().executedPlan())  # noqa: SLF001


def test_far_queries_meet_few_edges(spark):
    starts = _points(3000, 5, spread=0.3)
    vertices = [(i, p, la + p * 900, lo + p * 900) for i, la, lo in starts for p in (0, 1)]
    asked = _points(60, 6, spread=0.3) + [(100 + i, 450000000 + i * 1000, 60000000 + i * 100000) for i in range(60)]
    q = spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long")
    found = nearest.nearest_street(q, spark.createDataFrame(vertices, "id long, pos int, lat_e7 long, lon_e7 long"))
    got = {r.query_id: r.distance_m for r in found.collect()}
    units = [_unit(la, lo) for _, _, la, lo in vertices]
    for i, la, lo in asked:
        assert 0 <= min(_metres(_unit(la, lo), u) for u in units) - got[i] + 1e-6 < 12
    assert _joined_rows(found) < 30 * len(asked)  # 60 far queries and 3000 edges make 180,000 pairs


def test_slanting_edges_meet_queries_near_them_only(spark):
    """The box of a long slanting edge holds many queries that are far from the edge itself."""
    starts = _points(300, 5, spread=0.3)
    vertices = [(i, p, la + p * 1000000, lo + p * 1500000) for i, la, lo in starts for p in (0, 1)]
    asked = _points(200, 6, spread=0.3)
    q = spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long")
    found = nearest.nearest_street(q, spark.createDataFrame(vertices, "id long, pos int, lat_e7 long, lon_e7 long"))
    got = {r.query_id: r.distance_m for r in found.collect()}
    units = [_unit(la, lo) for _, _, la, lo in vertices]
    for i, la, lo in asked:
        assert got[i] <= min(_metres(_unit(la, lo), u) for u in units) + 1e-6
    assert _joined_rows(found) < 25 * len(asked)


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()  # noqa: SLF001
    shuffles = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = shuffles()
    table = settled(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffles() - before
    assert table.count() == 7
    discard(table)


def test_queries_in_many_cells_are_not_broadcast(spark, monkeypatch):
    """A bound on what goes to the driver counts cells, not queries."""
    monkeypatch.setattr(nearest, "FEW_ASKED", 0, raising=False)
    monkeypatch.setattr(nearest, "FEW_EDGES", 0)
    streets = _points(400, 5, spread=0.3)
    vertices = [(i, p, la + p * 9000, lo + p * 9000) for i, la, lo in streets for p in (0, 1)]
    asked = [(j * 400 + i, la + 300 * j, lo - 200 * j) for i, la, lo in streets for j in range(5)]
    edges = spark.createDataFrame(vertices, "id long, pos int, lat_e7 long, lon_e7 long")
    found = nearest.nearest_street(spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long"), edges)
    got = {r.query_id: r.distance_m for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("BroadcastExchange" in node and "_pad" in below for node, below in zip(plan, plan[1:], strict=False))
    monkeypatch.undo()
    want = {r.query_id: r.distance_m for r in nearest.nearest_street(spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long"), edges).collect()}
    assert got == want and len(got) == len(asked)


def test_cells_fit_the_areas(spark):
    corners = [c for i in range(400) for c in _square(i, 50 + i // 20 * 0.003, 10 + i % 20 * 0.003, 0.001)] + _square(1000, 50, 10, 1)
    vertices = spark.createDataFrame(corners, AREA_SCHEMA)
    cells = regions.cover_cells(regions.area_edges(vertices)).where("area_id < 1000").groupBy("cx", "cy").count()
    assert max(r["count"] for r in cells.collect()) <= 4
    points = [(i * 10 + j, 50 + i // 20 * 0.003 + d, 10 + i % 20 * 0.003) for i in range(400) for j, d in enumerate((0, 0.0009, 0.0015))]
    q = spark.createDataFrame([(i, round(a * E7), round(b * E7)) for i, a, b in points] * 2, "query_id long, lat_e7 long, lon_e7 long")
    found = sorted((r.query_id, r.area_id) for r in regions.regions_at(q, vertices, ["query_id"]).collect())
    assert found == sorted([(i, 1000) for i, _, _ in points] + [(i, i // 10) for i, _, _ in points if i % 10 < 2])


def test_a_street_across_borders(spark):
    corners = spark.createDataFrame(_square(1, 50, 9, 0.5) + _square(2, 50, 10, 0.5) + _square(3, 55, 10, 0.1), AREA_SCHEMA)
    street = spark.createDataFrame([(7, 0, 50 * E7, 8 * E7), (7, 1, 50 * E7, 10 * E7)], "id long, pos int, lat_e7 long, lon_e7 long")
    assert {r.area_id for r in regions.street_regions(street, corners).collect()} == {1, 2}
    assert {(r.own_id, r.area_id) for r in regions.area_overlap(corners).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_segments_meet_edges_however_they_are_joined(spark, monkeypatch, few):
    """Crossing, touching, lying along, ending short by more and by less than the tolerance, and of no length: as segments_meet says it of every pair."""
    monkeypatch.setattr(regions, "FEW_MEETING", few)
    rnd = random.Random(5)
    edges = [(1, i, *(rnd.randint(0, 6) / 1000 for _ in range(4))) for i in range(60)]
    paths = [(i, *(rnd.randint(0, 6) / 1000 + rnd.choice([0, 0, 1e-13, 1e-9]) for _ in range(4))) for i in range(60)] + [(100 + i, 0.001 * i, 0.002, 0.001 * i, 0.002) for i in range(7)]
    e = spark.createDataFrame(edges, "area_type int, area_id long, ax double, ay double, bx double, by double")
    p = spark.createDataFrame(paths, "street_id long, ax double, ay double, bx double, by double")
    every = p.select("street_id", *[F.col(v).alias(f"p{v}") for v in ("ax", "ay", "bx", "by")]).crossJoin(e)
    at = lambda v: (F.col(f"{v}x"), F.col(f"{v}y"))
    want = sorted((r.street_id, r.area_id) for r in every.where(geo.segments_meet(at("pa"), at("pb"), at("a"), at("b"))).collect())
    found = regions._meeting(p, e, ["street_id"])
    assert sorted((r.street_id, r.area_id) for r in found.collect()) == want
    assert 200 < len(want) < 60 * 67
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (few > 0)


def test_hits_are_found_once_and_small_levels_share_a_join(spark):
    """Areas of several sizes, whose few cells go to the points in one join; hits are not found anew for each reader."""
    corners = [c for i in range(4) for c in _square(i, 49.0, 9.0, 0.01 * 5**i)]
    vertices = spark.createDataFrame(corners, AREA_SCHEMA)
    points = spark.createDataFrame([(1, 490000000, 90000000), (2, 490300000, 90000000)], "query_id long, lat_e7 long, lon_e7 long")
    over = regions.regions_at(points, vertices, ["query_id"])
    assert sorted((r.query_id, r.area_id) for r in over.collect()) == [(1, i) for i in range(4)] + [(2, i) for i in range(1, 4)]
    assert over._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # noqa: SLF001
    read = spark.sparkContext.accumulator(0)

    def counted(v):
        read.add(1)
        return v

    hits = points.select("query_id", F.lit(0).alias("place"), F.lit("building").alias("kind"), F.lit(1).alias("type_rank"), F.col("query_id").alias("id"), F.udf(counted, "long")("lat_e7").alias("lat_e7"), "lon_e7")
    areas = spark.createDataFrame([(2, i, f"Area {i}", 2 + 2 * i, None) for i in range(4)], "type_rank int, id long, name string, admin_level int, postcode string")
    buildings = spark.createDataFrame([(1, 1, "Street", "5", None, None, None, None)], "type_rank int, id long, street string, house_number string, postcode string, city string, state string, country string")
    streets = spark.createDataFrame([], "id long, name string")
    found = describe.hit_addresses(hits, Tables(buildings, streets, None, areas, vertices)).collect()
    assert {r.query_id: (r.street, r.state, r.country) for r in found} == {1: ("Street", "Area 1", "Area 0"), 2: (None, "Area 1", None)}
    assert read.value == 2


def test_far_points_are_refused(spark):
    corners = spark.createDataFrame(_square(1, 50, 9, 0.5), AREA_SCHEMA)
    far = spark.createDataFrame([(1, -50 * E7, -170 * E7)], "query_id long, lat_e7 long, lon_e7 long")
    with pytest.raises(Exception, match="hemisphere"):
        regions.regions_at(far, corners, ["query_id"]).collect()


def test_nearest_street_is_brute_force(spark):
    rnd = random.Random(8)
    streets = {s: [(int((49 + rnd.uniform(0, 2)) * E7), int((9 + rnd.uniform(0, 2)) * E7)) for _ in range(rnd.randint(2, 4))] for s in range(30)}
    vertices = spark.createDataFrame([(s, p, a, b) for s, path in streets.items() for p, (a, b) in enumerate(path)], "id long, pos int, lat_e7 long, lon_e7 long")
    asked = _points(20, 4)
    queries = spark.createDataFrame(asked, "query_id long, lat_e7 long, lon_e7 long")
    found = {r.query_id: r for r in nearest.nearest_street(queries, vertices).collect()}
    for q, la, lo in asked:
        p = _unit(la, lo)

        def at(a, b, t, p=p):
            m = tuple(x + (y - x) * t for x, y in zip(a, b, strict=True))
            size = math.sqrt(_dot(m, m))
            return _metres(p, tuple(x / size for x in m))

        best = math.inf
        for path in streets.values():
            for u, v in zip(path, path[1:], strict=False):
                a, b, lo_t, hi_t = _unit(*u), _unit(*v), 0.0, 1.0
                for _ in range(100):
                    third = (hi_t - lo_t) / 3
                    if at(a, b, lo_t + third) < at(a, b, hi_t - third):
                        hi_t -= third
                    else:
                        lo_t += third
                best = min(best, at(a, b, (lo_t + hi_t) / 2))
        assert found[q].distance_m == pytest.approx(best, abs=1e-3)


def test_text_rules(spark):
    df = spark.createDataFrame([("Ärger Bahn", "BAHN"), ("Ärger", "ä"), ("x", ""), (None, "x")], "name string, q string")
    assert [r[0] for r in df.select(tx.name_contains(F.col("name"), F.col("q"))).collect()] == [True, False, False, False]
    levels = spark.createDataFrame([("8",), (" 8",), ("8 ",), ("+8",), ("8;9",), ("99999",), (None,)], "v string")
    assert [r[0] for r in levels.select(tx.admin_level(F.col("v"))).collect()] == [8, 8, -1, 8, -1, -1, -1]
    row = spark.createDataFrame([(-3, -4, 3, 4)], "a int, b int, c int, d int").select(geo.bbox_centre(F.col("a"), F.col("b")), geo.bbox_centre(F.col("c"), F.col("d"))).first()
    assert tuple(row) == (-3, 3)


def test_viewport_rules(spark):
    rows = [(0, i, 490000000 + i, 90000000, True, f"n{i}") for i in range(20)]
    buildings = spark.createDataFrame(rows, "type_rank int, id long, lat_e7 long, lon_e7 long, has_point boolean, name string")
    box = Box(490000000, 90000000, 490000009, 90000000)
    assert [r.id for r in viewport.houses(buildings, box, stride=3).collect()] == [0, 3, 6, 9]
    assert viewport.houses(buildings, box, 0).count() == 0
    with pytest.raises(ValueError):
        viewport.houses(buildings, box, stride=0)
    assert tuple(viewport.house_counts(buildings, box, 5).first()) == (6, 5, True, False, False)
    assert tuple(viewport.scan(buildings, box, 5).first()) == (10, 5, True)
    assert viewport.layer_plan(15) == {"houses": False, "streets": True, "regions": True, "limit": 4000, "stride": 5}


def test_simplified_lines_keep_ends(spark):
    path = [(1, i, 490000000 + (50 if i % 2 else 0), 90000000 + i * 1000) for i in range(50)] + [(2, 0, 0, 0), (2, 1, 5000000, 5000000), (2, 2, 0, 10000000)]
    vertices = spark.createDataFrame(path, "id long, pos int, lat_e7 long, lon_e7 long")
    kept = sorted((r.id, r.pos) for r in describe.simplified(vertices, ["id"], 12).collect())
    assert kept == [(1, 0), (1, 49), (2, 0), (2, 1), (2, 2)]
    again = describe.simplified(describe.simplified(vertices, ["id"], 12), ["id"], 12)
    assert sorted((r.id, r.pos) for r in again.collect()) == kept


def test_rings():
    square = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)]
    hole = [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]
    assert extract.assemble([square[:3], square[2:][::-1]]) == [square]
    assert extract.assemble([square[:3]]) is None
    assert [(c, i) for c, i, _ in extract.nested([hole, square, [(20, 20), (20, 21), (20, 20)]])] == [(1, False), (1, True)]
