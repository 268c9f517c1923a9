"""Every query of the engine by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions import geo
from geoloom.functions import text as tx
from geoloom.operators import describe, extract, nearest, profile, regions, search, viewport
from geoloom.operators.viewport import Box
from geoloom.plans import oracle as o
from geoloom.sources import derived, textfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The view of the viewport queries.
VIEW = Box(480000000, 80000000, 490000000, 95000000)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = re.sub(r"\bby\b", '"by"', sql)  # a column; the keyword is in capitals
        return f

    return add


def _distance(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_m", F.round("distance_m", 3))


@query(o.knn(10))
def knn_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(nearest.knn_buildings(derived.event_points(spark, sf_dir), derived.buildings(spark, sf_dir), 10))


@query(o.knn(1))
def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(nearest.knn_buildings(derived.event_points(spark, sf_dir), derived.buildings(spark, sf_dir), 1))


@query(o.knn(0))
def knn_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(nearest.knn_buildings(derived.event_points(spark, sf_dir), derived.buildings(spark, sf_dir), 0))


@query(f"WITH {o.BUILDINGS}, {o.EVENTS}, {o.KNN_PARTS} SELECT query_id, string_agg({o.TYPED}, ', ' ORDER BY d, type_rank, id) AS ids FROM kd WHERE rank <= 10 GROUP BY query_id")
def revgeo_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.knn_buildings(derived.event_points(spark, sf_dir), derived.buildings(spark, sf_dir), 10)
    hits = F.sort_array(F.collect_list(F.struct("rank", tx.typed_id(F.col("type_rank"), F.col("id")).alias("t"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(hits, lambda h: h["t"]), ", ").alias("ids"))


_EDGES = f"{o.AREAS}, {o._EDGE}"  # noqa: SLF001
_QP = f"qp AS (SELECT query_id, {o.plane()} FROM q)"


@query(f"WITH {o.EVENTS}, {_EDGES}, {_QP}, {o.covering('qp', 'query_id')} SELECT query_id, area_type, area_id FROM pip")
def pip_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, corners = derived.areas(spark, sf_dir)
    return regions.regions_at(derived.event_points(spark, sf_dir), corners, ["query_id"])


@query(
    f"WITH {o.SITES}, {_EDGES}, {_QP}, {o.covering('qp', 'query_id')}, pairs AS (SELECT query_id, unnest([1, 2, 2, 2, 9]) AS area_type, unnest([100000 + query_id, 100 + query_id % 5, 1000 + query_id % 25, 500000 + query_id % 25, 9]) AS area_id FROM q)"
    " SELECT p.query_id, p.area_type, p.area_id, pip.query_id IS NOT NULL AS covers FROM pairs p LEFT JOIN pip USING (query_id, area_type, area_id)"
)
def covers_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point with a town, one area of each other kind and one that does not exist, so that every area is asked about."""
    _, corners = derived.areas(spark, sf_dir)
    asked = ("1", "100000 + query_id"), ("2", "100 + query_id % 5"), ("2", "1000 + query_id % 25"), ("2", "500000 + query_id % 25"), ("9", "9")
    each = ", ".join(f"named_struct('area_type', {t}, 'area_id', cast({i} as bigint))" for t, i in asked)
    pairs = derived.supplier_points(spark, sf_dir).selectExpr("*", f"inline(array({each}))")
    return regions.covers(pairs, corners, ["query_id"]).select("query_id", "area_type", "area_id", "covers")


_BP = f"bp AS (SELECT type_rank AS obj_type, id AS obj_id, {o.plane()} FROM b WHERE has_point)"


@query(f"WITH {o.BUILDINGS}, {_EDGES}, {_BP}, {o.covering('bp', 'obj_type, obj_id')} SELECT obj_type, obj_id, area_type, area_id FROM pip")
def memberships_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, corners = derived.areas(spark, sf_dir)
    points = derived.buildings(spark, sf_dir).where("has_point").select(F.col("type_rank").alias("obj_type"), F.col("id").alias("obj_id"), "lat_e7", "lon_e7")
    return regions.regions_at(points, corners, ["obj_type", "obj_id"])


_ENDS = "ends AS (SELECT id AS street_id, pos AS spot, gx, gy FROM svp QUALIFY pos = min(pos) OVER (PARTITION BY id) OR pos = max(pos) OVER (PARTITION BY id))"
_P = "SELECT s.street_id, s.ax AS px, s.ay AS py, s.bx AS qx, s.by AS qy, e.area_type, e.area_id, e.ax, e.ay, e.bx, e.by FROM sg s, e"


@query(
    f"WITH {o.STREETS}, {_EDGES}, {_ENDS}, {o.covering('ends', 'street_id, spot')}, pe AS ({_P} WHERE greatest(s.ax, s.bx) >= least(e.ax, e.bx) AND least(s.ax, s.bx) <= greatest(e.ax, e.bx)"
    f" AND greatest(s.ay, s.by) >= least(e.ay, e.by) AND least(s.ay, s.by) <= greatest(e.ay, e.by))"
    f" SELECT DISTINCT street_id, area_type, area_id FROM pe WHERE {o.meets('p', 'q', 'a', 'b')} UNION SELECT street_id, area_type, area_id FROM pip"
)
def street_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, corners = derived.areas(spark, sf_dir)
    return regions.street_regions(derived.street_vertices(spark, sf_dir), corners)


_CORNER = "corner AS (SELECT type_rank AS own_type, id AS own_id, ring AS own_ring, is_inner AS own_inner, gx, gy FROM avp WHERE pos = 0)"
_OVERLAP = f"""WITH {_EDGES}, {_CORNER}, {o.covering('corner', 'own_type, own_id, own_ring, own_inner')},
pe AS (SELECT s.area_type AS own_type, s.area_id AS own_id, s.ax AS px, s.ay AS py, s.bx AS qx, s.by AS qy, e.area_type, e.area_id, e.ax, e.ay, e.bx, e.by FROM e s, e),
u AS (SELECT own_type, own_id, area_type, area_id FROM pe WHERE {o.meets('p', 'q', 'a', 'b')} UNION SELECT own_type, own_id, area_type, area_id FROM pip
  UNION SELECT area_type, area_id, own_type, own_id FROM pip WHERE NOT own_inner)
SELECT DISTINCT own_type, own_id, area_type, area_id FROM u WHERE own_type <> area_type OR own_id <> area_id"""


@query(_OVERLAP)
def area_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.area_overlap(derived.areas(spark, sf_dir)[1])


_QU = f"qu AS (SELECT query_id, {o.unit('q')} FROM q)"


@query(f"WITH {o.SITES}, {_QU}, {o.STREETS}, {o.arc('sg', 'street_id')} SELECT query_id, street_id, round(d, 3) AS distance_m FROM nearest")
def nearest_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(nearest.nearest_street(derived.supplier_points(spark, sf_dir), derived.street_vertices(spark, sf_dir)).select("query_id", "street_id", "distance_m"))


@query(f"WITH {o.EVENTS}, {_QU}, {_EDGES}, {o.arc('e', 'area_type, area_id')} SELECT query_id, round(min(d), 3) AS distance_m FROM nearest GROUP BY query_id")
def nearest_area_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, corners = derived.areas(spark, sf_dir)
    return _distance(nearest.nearest_area_edge(derived.event_points(spark, sf_dir), corners).select("query_id", "distance_m"))


_IN = f"lat_e7 BETWEEN {VIEW.min_lat} AND {VIEW.max_lat} AND lon_e7 BETWEEN {VIEW.min_lon} AND {VIEW.max_lon}"
_SHOWN = "type_rank, id, lat_e7, lon_e7, name"


@query(f"WITH {o.BUILDINGS} SELECT {_SHOWN} FROM b WHERE has_point AND {_IN} ORDER BY type_rank, id LIMIT 10000")
def viewport_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.houses(derived.buildings(spark, sf_dir), VIEW).select("type_rank", "id", "lat_e7", "lon_e7", "name")


@query(f"WITH {o.BUILDINGS}, n AS (SELECT *, row_number() OVER (ORDER BY type_rank, id) AS n FROM b WHERE has_point AND {_IN}) SELECT {_SHOWN} FROM n WHERE (n - 1) % 5 = 0 ORDER BY type_rank, id LIMIT 4000")
def viewport_houses_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.houses(derived.buildings(spark, sf_dir), VIEW, 4000, 5).select("type_rank", "id", "lat_e7", "lon_e7", "name")


@query(f"WITH {o.BUILDINGS} SELECT least(count(*), 101) AS matched, least(count(*), 100) AS returned, count(*) > 100 AS threshold_reached, count(*) <= 100 AS matched_exact, false AS sampled FROM b WHERE has_point AND {_IN}")
def viewport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.house_counts(derived.buildings(spark, sf_dir), VIEW, 100)


@query(f"WITH {o.BUILDINGS} SELECT count(*) AS matched, least(count(*), 100) AS returned, count(*) > 100 AS threshold_reached FROM b WHERE has_point AND {_IN}")
def viewport_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.scan(derived.buildings(spark, sf_dir), VIEW, 100)


_MEETS = "max(gx) >= (SELECT x - pad FROM seen) AND min(gx) <= (SELECT x + pad FROM seen) AND max(gy) >= (SELECT y - pad FROM seen) AND min(gy) <= (SELECT y + pad FROM seen)"
_SEEN = o.view(VIEW.min_lat, VIEW.min_lon, VIEW.max_lat, VIEW.max_lon)


@query(f"WITH {o.STREETS}, {_SEEN} SELECT id FROM svp GROUP BY id HAVING {_MEETS} ORDER BY id LIMIT 1000")
def viewport_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewport.streets(derived.street_vertices(spark, sf_dir), VIEW, 15)


@query(
    f"WITH {_EDGES}, {_SEEN}, shown AS (SELECT type_rank, id FROM avp GROUP BY type_rank, id HAVING {_MEETS}) SELECT type_rank, id, name, admin_level, area_ord FROM ao JOIN shown USING (type_rank, id)"
    " WHERE admin_level BETWEEN 0 AND 8 ORDER BY admin_level, area_ord LIMIT 50"
)
def viewport_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, corners = derived.areas(spark, sf_dir)
    return viewport.regions(found, corners, VIEW, 10)


SEARCHES = ["RING", "00012", "Blue w", "", "Ärger", "customer#0000000", "the "]
_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEARCHES))
_FOLD = f"translate({{}}, '{tx.UPPER}', '{tx.LOWER}')"


@query(
    f"""WITH s(line, query) AS (VALUES {_VALUES}), names AS (SELECT 1 AS type_rank, CAST(c_custkey AS BIGINT) AS id, c_name AS name FROM customer UNION ALL SELECT 0, p_partkey, p_name FROM part UNION ALL SELECT 2, doc_id, text FROM documents),
hits AS (SELECT DISTINCT line, type_rank, id FROM s, names WHERE query <> '' AND contains({_FOLD.format('name')}, {_FOLD.format('query')})),
joined AS (SELECT line, string_agg({o.TYPED}, ', ' ORDER BY type_rank, id) AS ids FROM hits GROUP BY line)
SELECT line, query, coalesce(ids, '') AS ids FROM s LEFT JOIN joined USING (line)"""
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(SEARCHES)), "line int, query string")
    ways = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("1 type_rank", "cast(c_custkey as bigint) id", "c_name name")
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("0 type_rank", "cast(p_partkey as bigint) id", "p_name name")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("2 type_rank", "cast(doc_id as bigint) id", "text name")
    return search.name_search(lines, ways, nodes, texts)


@query("SELECT coalesce(nullif(o_orderpriority, ''), '<missing>') AS value, count(*) AS cnt FROM orders GROUP BY ALL ORDER BY cnt DESC, value LIMIT 12")
def inspect_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority")


@query("SELECT c_mktsegment, CAST(c_custkey AS BIGINT) AS id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rank FROM customer) WHERE rank <= 3")
def inspect_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.samples(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_custkey").select("c_mktsegment", F.col("c_custkey").cast("long").alias("id"), "rank")


@query(
    f"""WITH {o.BUILDINGS} SELECT type_rank, id, concat_ws(', ', nullif(concat_ws(' ', street, house_number), ''), nullif(concat_ws(' ', postcode, city), '')) AS shown,
  street IS NOT NULL OR house_number IS NOT NULL OR postcode IS NOT NULL OR city IS NOT NULL AS addressed, concat_ws(', ', street, house_number, postcode, city) AS full_address,
  street IS NOT NULL AND house_number IS NOT NULL AND postcode IS NOT NULL AND city IS NOT NULL AS complete FROM b"""
)
def address_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("street", "house_number", "postcode", "city")]
    addressed = F.lit(False)
    for c in parts:
        addressed = addressed | tx.filled(c).isNotNull()
    return derived.buildings(spark, sf_dir).select(
        "type_rank", "id", tx.display_address(*parts).alias("shown"), addressed.alias("addressed"),
        tx.full_address(*parts, F.col("state"), F.col("country")).alias("full_address"), tx.address_complete(*parts, F.lit("x")).alias("complete"),
    )


LEVELS = ["8", " 8", "8 ", "+8", "-1", "8;9", "99999", "-32768", "32768", "", "x", None]
_LEVEL_ROWS = ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(LEVELS))


@query(rf"WITH v(i, value) AS (VALUES {_LEVEL_ROWS}) SELECT i, value, coalesce(CASE WHEN regexp_full_match(value, '[ \t\n\x0B\f\r]*[+-]?[0-9]+') THEN try_cast(trim(value) AS SMALLINT) END, -1) AS admin_level FROM v")
def admin_level_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LEVELS)), "i int, value string").select("i", "value", tx.admin_level(F.col("value")).cast("int").alias("admin_level"))


@query(
    f"""WITH {o.RAW},
n AS (SELECT count(*) AS nodes, count(*) FILTER (lat_e7 > 900000000) AS invalid_nodes, count(*) FILTER (addressed) AS address_nodes, count(*) FILTER (addressed AND NOT building) AS address_only_nodes,
  count(*) FILTER (building) AS building_nodes, count(*) FILTER (building AND addressed) AS building_address_nodes FROM rn),
w AS (SELECT count(*) AS ways, count(*) FILTER (building) AS building_ways, count(*) FILTER (highway) AS street_ways, count(*) FILTER (highway AND named) AS named_streets, count(*) FILTER (highway AND NOT named) AS unnamed_streets,
  count(*) FILTER (boundary = 'administrative') AS admin_ways, CAST(sum(refs) AS BIGINT) AS way_refs, CAST(coalesce(sum(refs) FILTER (building), 0) AS BIGINT) AS building_refs,
  CAST(coalesce(sum(refs) FILTER (highway), 0) AS BIGINT) AS street_refs, CAST(coalesce(sum(refs) FILTER (boundary = 'administrative'), 0) AS BIGINT) AS admin_refs FROM rw),
r AS (SELECT count(*) AS relations, count(*) FILTER (building) AS building_relations, count(*) FILTER (multipolygon) AS multipolygons, count(*) FILTER (boundary = 'administrative') AS admin_relations,
  count(*) FILTER (boundary = 'administrative' AND NOT named) AS unnamed_admin FROM rr),
m AS (SELECT count(*) AS members, count(*) FILTER (ref % 3 = 0) AS outer_members, count(*) FILTER (ref % 3 = 1) AS inner_members, count(*) FILTER (ref % 3 = 2) AS other_members FROM mem),
l AS (SELECT count(*) FILTER (NOT addressed) AS without_address, count(*) FILTER (NOT named) AS without_name FROM (SELECT addressed, named FROM rn WHERE building UNION ALL SELECT false, named FROM rw WHERE building UNION ALL SELECT false, named FROM rr WHERE building))
SELECT * FROM n, w, r, m, l"""
)
def inspect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = derived.raw(spark, sf_dir)
    out = profile.node_counts(nodes)
    for part in (profile.way_counts(ways), profile.relation_counts(relations), profile.buildings_lacking(nodes, ways, relations)):
        out = out.join(part, F.lit(True))  # one row each
    return out


@query(f"WITH {o.RAW} SELECT id FROM rn WHERE id IN (SELECT ref FROM refs JOIN needed USING (id))")
def semi_required_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = derived.raw(spark, sf_dir)
    return extract.required_nodes(nodes, extract.ways_with_geometry(ways, relations)).select("id")


@query(f"WITH {o.RAW} SELECT id FROM needed")
def semi_relation_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ways, relations = derived.raw(spark, sf_dir)
    return extract.ways_with_geometry(ways, relations).select("id")


@query(
    f"""WITH {o.RAW}, pl AS (SELECT id, pos, lat_e7, lon_e7, coalesce(lat_e7 <= 900000000, false) AS ok FROM refs JOIN needed USING (id) LEFT JOIN (SELECT id AS ref, lat_e7, lon_e7 FROM rn) USING (ref))
SELECT id, coalesce(string_agg(lat_e7 || ' ' || lon_e7, ', ' ORDER BY pos) FILTER (ok), '') AS points, count(*) FILTER (NOT ok) AS missing FROM pl GROUP BY id"""
)
def way_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = derived.raw(spark, sf_dir)
    found = extract.way_geometry(extract.ways_with_geometry(ways, relations), nodes)
    return found.select("id", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["lat_e7"].cast("string"), p["lon_e7"].cast("string"))), ", ").alias("points"), "missing")


@query(
    f"""WITH {o.RAW}, pt AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS i, count(*) OVER (PARTITION BY id) AS n, lat_e7 AS la, lon_e7 AS lo FROM refs JOIN rw USING (id) JOIN (SELECT id AS ref, lat_e7, lon_e7 FROM rn WHERE lat_e7 <= 900000000) USING (ref) WHERE building),
rel AS (SELECT *, (lo - first_value(lo) OVER w) / 1e7::DOUBLE AS x, (la - first_value(la) OVER w) / 1e7::DOUBLE AS y, first_value(la) OVER w AS la0, first_value(lo) OVER w AS lo0 FROM pt WINDOW w AS (PARTITION BY id ORDER BY i)),
st AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rel WINDOW w AS (PARTITION BY id ORDER BY i)),
ar AS (SELECT id, any_value(n) AS n, any_value(la0) AS la0, any_value(lo0) AS lo0, arg_max(la, i) = any_value(la0) AND arg_max(lo, i) = any_value(lo0) AS shut, sum(x * y2 - x2 * y) AS w, sum((x + x2) * (x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) AS cy,
  min(la) + max(la) AS la, min(lo) + max(lo) AS lo FROM st GROUP BY id)
SELECT id, n >= 4 AND shut AND abs(w) >= 1e-12 AS centroid, CASE WHEN n >= 4 AND shut AND abs(w) >= 1e-12 THEN CAST(la0 + round(cy / (3 * w) * 1e7) AS BIGINT) // 10 ELSE la // 2 // 10 END AS lat_e6,
  CASE WHEN n >= 4 AND shut AND abs(w) >= 1e-12 THEN CAST(lo0 + round(cx / (3 * w) * 1e7) AS BIGINT) // 10 ELSE lo // 2 // 10 END AS lon_e6 FROM ar"""
)
def representative_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, _ = derived.raw(spark, sf_dir)
    found = extract.way_geometry(ways.where(tx.has_key("building")), nodes).where(F.size("points") > 0)
    points = F.col("points")
    p = extract.representative_point(points)
    shaped = found.withColumn("centroid", extract.closed(points) & (extract.ring_area(points) >= 1e-12)).withColumn("p", p)
    return shaped.select("id", "centroid", F.expr("p.lat_e7 div 10").alias("lat_e6"), F.expr("p.lon_e7 div 10").alias("lon_e6"))


@query(
    f"""WITH {o.RAW}, {o.SHAPES}, pl AS (SELECT refs.id, coalesce(lat_e7 <= 900000000, false) AS ok FROM refs JOIN needed USING (id) LEFT JOIN (SELECT id AS ref, lat_e7 FROM rn) USING (ref)),
g AS (SELECT id, count(*) FILTER (ok) AS points, count(*) FILTER (NOT ok) AS missing FROM pl GROUP BY id), w AS (SELECT rw.*, points, missing FROM rw JOIN g USING (id)),
rl AS (SELECT rr.*, count(ref) FILTER (missing = 0) AS good, count(ref) AS members, coalesce(sum(points), 0) AS points FROM rr LEFT JOIN mem ON relation = id LEFT JOIN g ON g.id = ref GROUP BY ALL),
b AS (SELECT named, true AS placed FROM rn WHERE (building OR addressed) AND lat_e7 <= 900000000 UNION ALL SELECT named, points > 0 FROM w WHERE building UNION ALL SELECT named, points > 0 FROM rl WHERE building
  UNION ALL SELECT k % 3 <> 0, true FROM k),
cw AS (SELECT w.id FROM w JOIN (SELECT id, arg_min(ref, pos) = arg_max(ref, pos) AS shut, count(*) AS n FROM refs GROUP BY id) USING (id) WHERE boundary IS NOT NULL AND missing = 0 AND shut AND n >= 4),
ends AS (SELECT relation, unnest([f, t]) AS ref FROM mem JOIN (SELECT id, arg_min(ref, pos) AS f, arg_max(ref, pos) AS t FROM refs GROUP BY id) e ON e.id = mem.ref JOIN rl ON rl.id = relation WHERE rl.boundary IS NOT NULL AND good = members),
odd AS (SELECT relation, ref FROM ends GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT (SELECT count(*) FROM b) AS buildings, (SELECT count(*) FROM b WHERE NOT named) AS buildings_without_name, (SELECT count(*) FROM b WHERE NOT placed) AS buildings_without_point,
  (SELECT count(*) FROM w WHERE highway AND points >= 2) AS streets, (SELECT count(*) FROM rr WHERE boundary IS NOT NULL) + (SELECT count(*) FROM cw) + (SELECT count(*) FROM k WHERE k % 4 <> 3) AS areas,
  (SELECT count(*) FROM rr WHERE boundary IS NOT NULL) + (SELECT count(*) FROM k WHERE k % 4 <> 3) - (SELECT count(*) FROM whole) AS areas_without_geometry,
  (SELECT count(*) FROM cw) + (SELECT CAST(coalesce(sum(CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END), 0) AS BIGINT) FROM whole) AS outer_rings, (SELECT count(*) FROM whole) AS inner_rings,
  (SELECT count(*) FROM rn) + 12 * (SELECT count(*) FROM k) AS processed_nodes, (SELECT count(*) FROM rw) + 4 * (SELECT count(*) FROM k) AS processed_ways, (SELECT count(*) FROM rr) + (SELECT count(*) FROM k) AS processed_relations,
  (SELECT count(*) FROM rl WHERE boundary IS NOT NULL AND good < members) + (SELECT count(*) FROM k WHERE k % 4 <> 3 AND k % 7 = 0) AS incomplete_relations,
  (SELECT count(*) // 2 FROM odd) + (SELECT count(*) FROM k WHERE k % 4 <> 3 AND k % 7 <> 0 AND k % 11 = 0) AS open_rings, (SELECT CAST(sum(missing) AS BIGINT) FROM g) AS invalid_way_nodes"""
)
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = derived.raw(spark, sf_dir)
    more = derived.shapes(spark, sf_dir)
    apart = 1 << 40  # the shapes' ids
    moved = lambda c: (F.col(c) + apart).alias(c)
    nodes = nodes.unionByName(more[0].select(moved("id"), "lat_e7", "lon_e7", "tags"))
    ways = ways.unionByName(more[1].select(moved("id"), F.transform("node_refs", lambda r: r + apart).alias("node_refs"), "tags"))
    member = lambda m: F.struct(m["type"].alias("type"), (m["ref"] + apart).alias("ref"), m["role"].alias("role"))
    relations = relations.unionByName(more[2].select(moved("id"), F.transform("members", member).alias("members"), "tags"))
    return extract.extract(nodes, ways, relations).stats


_RING = "SELECT 2 AS type_rank, k AS id, {} AS component, {} AS ring, {} AS is_inner, {} AS points FROM whole"


@query(
    f"WITH {o.SHAPES} {_RING.format(1, 0, 'false', o.ring(o.OUTER))} UNION ALL {_RING.format(1, 1, 'true', o.ring(o.INNER))} UNION ALL {_RING.format(2, 2, 'false', o.ring(o.FAR))} WHERE k % 5 = 0"
)
def relation_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways, relations = derived.shapes(spark, sf_dir)
    rings = extract.relation_rings(relations, extract.way_geometry(extract.ways_with_geometry(ways, relations), nodes))
    return rings.withColumn("points", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["lat_e7"].cast("string"), p["lon_e7"].cast("string"))), ", "))


@query(
    # The middle of the outline, and of the closed way in it; where only the far way is closed beside it, the larger one's.
    f"WITH {o.SHAPES} SELECT k AS id, lat0 + 2000 AS lat_e7, lon0 + 2000 AS lon_e7, true AS has_point FROM k"
)
def largest_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(*derived.shapes(spark, sf_dir)).buildings.where("type_rank = 2").select("id", "lat_e7", "lon_e7", "has_point")


LINES = ["48.732025 9.149272", "48.734109  9.104308", "1 2 3", "91 0", "0 -180.1", "", "nan 1", "  5 6  ", "1e1 -2.5", "x 1", "-90 180", "12"]
_LINE_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(LINES))


@query(
    rf"""WITH v(line, value) AS (VALUES {_LINE_ROWS}), p AS (SELECT line, value, regexp_split_to_array(trim(value), '\s+') AS t FROM v),
d AS (SELECT line, value, len(t) = 2 AS two, CASE WHEN len(t) = 2 AND regexp_full_match(t[1], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(t[1] AS DOUBLE) END AS lat,
  CASE WHEN len(t) = 2 AND regexp_full_match(t[2], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(t[2] AS DOUBLE) END AS lon FROM p)
SELECT line, value, coalesce(abs(lat) <= 90 AND abs(lon) <= 180, false) AS ok, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN CAST(round(lat * 1e7) AS INT) ELSE 0 END AS lat_e7,
  CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN CAST(round(lon * 1e7) AS INT) ELSE 0 END AS lon_e7 FROM d"""
)
def parse_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textfiles.parsed_coordinates(spark.createDataFrame(list(enumerate(LINES)), "line int, value string")).select("line", "value", "ok", F.coalesce("lat_e7", F.lit(0)).alias("lat_e7"), F.coalesce("lon_e7", F.lit(0)).alias("lon_e7"))


_REVERSE = f"""{o.BUILDINGS}, {o.SITES}, {o.KNN_PARTS}, {o.STREETS}, {o.arc('sg', 'street_id')}, {_EDGES}, {_QP}, {o.covering('qp', 'query_id')},
near AS (SELECT query_id, 1 AS o, 'building' AS kind, type_rank, id, d FROM kd WHERE rank = 1 UNION ALL SELECT query_id, 2, 'street', 1, street_id, d FROM nearest),
far AS (SELECT q.query_id, min(d) AS best FROM q LEFT JOIN near USING (query_id) GROUP BY 1 HAVING coalesce(min(d), 1e18) > 1000),
over AS (SELECT query_id, 0 AS o, 'area' AS kind, area_type AS type_rank, area_id AS id, 0.0 AS d FROM pip JOIN far USING (query_id) JOIN ao ON ao.type_rank = area_type AND ao.id = area_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY admin_level DESC, area_ord) = 1)"""
_AREA_ARC = o.arc("e", "area_type, area_id")
for _name in ("eu", "en", "el", "eh", "f0", "f1", "f2", "f3", "f4", "f5", "nearest"):
    _AREA_ARC = re.sub(rf"\b{_name}\b", f"{_name}_area", _AREA_ARC)


@query(
    f"""WITH {_REVERSE}, {_AREA_ARC},
edge AS (SELECT query_id, 0 AS o, 'area' AS kind, area_type AS type_rank, area_id AS id, d FROM nearest_area JOIN far USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM over) AND (best IS NULL OR d < best)),
every AS (SELECT * FROM near UNION ALL SELECT * FROM over UNION ALL SELECT * FROM edge)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY least(o, 1), d, o) - 1 AS INT) AS place, kind, type_rank, id, round(d, 3) AS distance_m FROM every"""
)
def reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.reverse(derived.supplier_points(spark, sf_dir), derived.tables(spark, sf_dir))
    return _distance(found).select("query_id", "place", "kind", "type_rank", "id", "distance_m")


@query(
    f"""WITH {o.BUILDINGS}, {o.EVENTS}, {o.KNN_PARTS}, {_EDGES}, hp AS (SELECT query_id, type_rank AS ht, id AS hid, b.street, b.house_number, b.postcode, b.city, {o.plane()} FROM kd JOIN b USING (type_rank, id) WHERE rank = 1),
{o.covering('hp', 'query_id')}, cx AS (SELECT query_id, area_ord, name, admin_level, postcode FROM pip JOIN ao ON ao.type_rank = area_type AND ao.id = area_id),
ag AS (SELECT query_id, arg_min(postcode, area_ord) FILTER (postcode IS NOT NULL) AS pc, arg_min(name, area_ord) FILTER (admin_level = 2) AS country, arg_min(name, area_ord) FILTER (admin_level = 4) AS state, arg_min(name, area_ord) FILTER (admin_level = 8) AS town FROM cx GROUP BY 1)
SELECT query_id, ht AS type_rank, hid AS id, street, house_number, coalesce(postcode, pc) AS postcode, coalesce(city, town) AS city, state, country, concat_ws(', ', street, house_number, coalesce(postcode, pc), coalesce(city, town), state, country) AS full_address,
  street IS NOT NULL AND house_number IS NOT NULL AND coalesce(postcode, pc) IS NOT NULL AND coalesce(city, town) IS NOT NULL AND country IS NOT NULL AS address_complete FROM hp LEFT JOIN ag USING (query_id)"""
)
def reverse_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = derived.tables(spark, sf_dir)
    hits = nearest.knn_buildings(derived.event_points(spark, sf_dir), tables.buildings, 1).withColumn("kind", F.lit("building")).withColumn("place", F.lit(0))
    hits = hits.join(tables.buildings.select("type_rank", "id", "lat_e7", "lon_e7"), ["type_rank", "id"])
    found = describe.hit_addresses(hits.select("query_id", "place", "kind", "type_rank", "id", "lat_e7", "lon_e7"), tables)
    return found.select("query_id", "type_rank", "id", "street", "house_number", "postcode", "city", "state", "country", "full_address", "address_complete")


@query(
    f"""WITH {o.BUILDINGS}, {_EDGES}, {_BP}, {o.covering('bp', 'obj_type, obj_id')}, m AS (SELECT obj_type, obj_id, area_ord, name || ' (' || admin_level || ')' AS t FROM pip JOIN ao ON ao.type_rank = area_type AND ao.id = area_id)
SELECT obj_type, obj_id, string_agg(t, ', ' ORDER BY area_ord) AS regions FROM m GROUP BY ALL"""
)
def building_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = derived.areas(spark, sf_dir)
    rows = describe.building_regions(memberships_buildings(spark, sf_dir), found)
    text = F.transform("regions", lambda r: F.concat(r["name"], F.lit(" ("), r["admin_level"].cast("string"), F.lit(")")))
    return rows.select("obj_type", "obj_id", F.array_join(text, ", ").alias("regions"))


_PAIR = "'[' || printf('%.7f', lon_e7 / 1e7::DOUBLE) || ',' || printf('%.7f', lat_e7 / 1e7::DOUBLE) || ']'"


@query(
    f"""WITH {o.STREETS}, line AS (SELECT id, string_agg({_PAIR}, ',' ORDER BY pos) AS c FROM sv GROUP BY id)
SELECT 1 AS type_rank, id, '{{"type":"Feature","properties":{{"id":"way/' || id || '","name":"Road ' || (id % 997) || '"}},"geometry":{{"type":"LineString","coordinates":[' || c || ']}}}}' AS feature FROM line"""
)
def geojson_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = derived.street_vertices(spark, sf_dir)
    rows = describe.line_geojson(vertices, ["id"]).join(derived.streets(vertices), "id").withColumn("type_rank", F.lit(1))
    return describe.features(rows, ["name"])


@query(
    f"""WITH {o.AREAS}, pt AS (SELECT *, {_PAIR} AS p FROM av),
rings AS (SELECT type_rank, id, component, ring, is_inner, '[' || string_agg(p, ',' ORDER BY pos) || ',' || arg_min(p, pos) || ']' AS r FROM pt GROUP BY ALL),
polygons AS (SELECT type_rank, id, component, '[' || string_agg(r, ',' ORDER BY is_inner, ring) || ']' AS r FROM rings GROUP BY ALL),
shapes AS (SELECT type_rank, id, string_agg(r, ',' ORDER BY component) AS r FROM polygons GROUP BY ALL)
SELECT type_rank, id, '{{"type":"Feature","properties":{{"id":"' || {o.TYPED} || '","name":"' || name || '","admin_level":' || admin_level || '}},"geometry":{{"type":"MultiPolygon","coordinates":[' || r || ']}}}}' AS feature FROM shapes JOIN a USING (type_rank, id)"""
)
def geojson_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, corners = derived.areas(spark, sf_dir)
    return describe.features(describe.area_geojson(corners).join(found, ["type_rank", "id"]), ["name", "admin_level"])


_ALONG = "least(greatest(((lo[i] - lo[a]) * (lo[b] - lo[a]) + (la[i] - la[a]) * (la[b] - la[a])) / nullif(pow(lo[b] - lo[a], 2) + pow(la[b] - la[a], 2), 0), 0.0), 1.0)"
_OFF = " + ".join(f"pow({v}[i] - {v}[a] - coalesce({_ALONG}, 0.0) * ({v}[b] - {v}[a]), 2)" for v in ("lo", "la"))


@query(
    f"""WITH RECURSIVE {o.STREETS}, path AS (SELECT id, list(lat_e7::DOUBLE ORDER BY pos) AS la, list(lon_e7::DOUBLE ORDER BY pos) AS lo FROM sv GROUP BY id),
part AS (SELECT id, la, lo, 1::BIGINT AS a, len(la)::BIGINT AS b FROM path
  UNION ALL SELECT id, la, lo, unnest([a, far]), unnest([far, b]) FROM (SELECT *, a + list_position(d, list_max(d)) AS far FROM (SELECT *, list_transform(range(a + 1, b), lambda i: {_OFF}) AS d FROM part WHERE b - a >= 2)) WHERE list_max(d) > {o.num((geo.level_scale(12) * 1e7) ** 2)}),
kept AS (SELECT id, a AS i FROM part UNION SELECT id, b FROM part)
SELECT sv.id, CAST(sv.pos AS INT) AS pos, lat_e7, lon_e7 FROM sv JOIN kept ON kept.id = sv.id AND i = pos + 1"""
)
def simplify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.simplified(derived.street_vertices(spark, sf_dir), ["id"], 12)
