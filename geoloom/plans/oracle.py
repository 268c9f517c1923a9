"""The queries in DuckDB's SQL. Each is self-contained: common table expressions over the star schema."""

from __future__ import annotations

from geoloom.functions import geo

E7, RAD, R = "CAST(1e-7 AS DOUBLE)", f"CAST({geo.RAD!r} AS DOUBLE)", f"CAST({geo.EARTH_RADIUS_M!r} AS DOUBLE)"


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def unit(p: str, lat: str = "lat_e7", lon: str = "lon_e7") -> str:
    la, lo = f"({lat} * {E7} * {RAD})", f"({lon} * {E7} * {RAD})"
    return f"cos({la}) * cos({lo}) AS {p}x, cos({la}) * sin({lo}) AS {p}y, sin({la}) AS {p}z"


def dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def cross_norm(a: str, b: str) -> str:
    return f"sqrt(pow({a}y * {b}z - {a}z * {b}y, 2) + pow({a}z * {b}x - {a}x * {b}z, 2) + pow({a}x * {b}y - {a}y * {b}x, 2))"


def angle(a: str, b: str) -> str:
    return f"atan2({cross_norm(a, b)}, {dot(a, b)})"


def plane(lat: str = "lat_e7", lon: str = "lon_e7", x: str = "gx", y: str = "gy") -> str:
    la, lo = f"({lat} * {E7} * {RAD})", f"({lon} * {E7} * {RAD})"
    v = (f"cos({la}) * cos({lo})", f"cos({la}) * sin({lo})", f"sin({la})")

    def d(c: tuple) -> str:
        return "(" + " + ".join(f"{a} * {num(b)}" for a, b in zip(v, c, strict=True)) + ")"

    return f"{d(geo.EAST)} / {d(geo.CENTRE)} AS {x}, {d(geo.NORTH)} / {d(geo.CENTRE)} AS {y}"


BUILDINGS = """b AS (
  SELECT 1 AS type_rank, k AS id, 475000000 + ((k * 7919 + 13) * 104729) % 22000000 AS lat_e7, 75000000 + (k * 15485863) % 30000000 AS lon_e7,
    k % 97 <> 0 AS has_point, c_name AS name, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'no' ELSE lower(c_mktsegment) END AS building_type,
    CASE WHEN k % 3 <> 0 THEN 'Street ' || (k % 41) END AS street, CASE WHEN k % 4 <> 0 THEN CAST(k % 90 AS VARCHAR) END AS house_number,
    CASE WHEN k % 5 = 0 THEN CAST(70000 + k % 300 AS VARCHAR) END AS postcode, CASE WHEN k % 7 = 0 THEN 'City ' || (k % 13) END AS city
  FROM (SELECT CAST(c_custkey AS BIGINT) AS k, c_name, c_mktsegment FROM customer)
  UNION ALL
  SELECT 0, k, 475000000 + ((k * 7907 + 7) * 104729) % 22000000, 75000000 + (k * 32452843) % 30000000, true, s_name, CASE WHEN k % 2 = 0 THEN 'yes' END,
    'Alley ' || (k % 23), CAST(k % 50 AS VARCHAR), NULL, NULL
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, s_name FROM supplier))"""

EVENTS = """q AS (SELECT k AS query_id, 475000000 + ((k * 6133 + 5) * 104729) % 22000000 AS lat_e7, 75000000 + (k * 49979687) % 30000000 AS lon_e7
  FROM (SELECT CAST(event_id AS BIGINT) AS k FROM events))"""

SITES = """q AS (SELECT k AS query_id, 474000000 + ((k * 7477 + 11) * 104729) % 26000000 AS lat_e7, 72000000 + (k * 32452867) % 40000000 AS lon_e7
  FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier))"""

AREAS = """a AS (
  SELECT 2 AS type_rank, 100 + CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 2 AS admin_level, NULL AS postcode, 482000000 + r_regionkey * 3000000 AS lat0, 84000000 + r_regionkey * 3000000 AS lon0 FROM region
  UNION ALL SELECT 2, 1000 + n_nationkey, n_name, 4, NULL, 485000000 + (n_nationkey % 5) * 4000000, 85000000 + (n_nationkey // 5) * 4000000 FROM nation
  UNION ALL SELECT 2, 500000 + n_nationkey, 'Post ' || n_nationkey, -1, CAST(70000 + n_nationkey AS VARCHAR), 484000000 + (n_nationkey % 5) * 3000000, 84000000 + (n_nationkey // 5) * 3000000 FROM nation
  UNION ALL SELECT 1, 100000 + k, 'Town ' || k, 8, NULL, 475500000 + (k * 733103) % 21000000, 75500000 + (k * 1299709) % 29000000 FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)),
ao AS (SELECT *, row_number() OVER (ORDER BY type_rank, id) AS area_ord FROM a),
octagon(pos, p, r) AS (VALUES (0, 2, -1), (1, 2, 1), (2, 1, 2), (3, -1, 2), (4, -2, 1), (5, -2, -1), (6, -1, -2), (7, 1, -2)),
diamond(pos, p, r) AS (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)),
square(pos, p, r) AS (VALUES (0, 1, -1), (1, 1, 1), (2, -1, 1), (3, -1, -1)),
av AS (
  SELECT type_rank, id, 1 AS component, 0 AS ring, false AS is_inner, pos, lat0 + p * 5000000 AS lat_e7, lon0 + r * 5000000 AS lon_e7 FROM a, square WHERE admin_level = 2
  UNION ALL SELECT type_rank, id, 1, 1, false, pos, lat0 + p * 1500000, lon0 + r * 1500000 FROM a, octagon WHERE admin_level = 4
  UNION ALL SELECT type_rank, id, 1, 2, true, pos, lat0 + p * 400000, lon0 + r * 400000 FROM a, diamond WHERE admin_level = 4
  UNION ALL SELECT type_rank, id, 1, 3, false, pos, lat0 + p * 900000, lon0 + r * 900000 FROM a, diamond WHERE admin_level = -1
  UNION ALL SELECT type_rank, id, 1, 4, false, pos, lat0 + p * 200000, lon0 + r * 200000 FROM a, diamond WHERE admin_level = 8
  UNION ALL SELECT type_rank, id, 2, 5, false, pos, lat0 + p * 150000, lon0 + 1000000 + r * 150000 FROM a, diamond WHERE admin_level = 8 AND id % 5 = 0)"""

_EDGE = f"""avp AS (SELECT *, {plane()} FROM av),
e AS (SELECT * FROM (SELECT type_rank AS area_type, id AS area_id, component, ring, is_inner, pos, lat_e7 AS alat, lon_e7 AS alon, gx AS ax, gy AS ay,
    coalesce(lead(lat_e7) OVER w, first_value(lat_e7) OVER w) AS blat, coalesce(lead(lon_e7) OVER w, first_value(lon_e7) OVER w) AS blon,
    coalesce(lead(gx) OVER w, first_value(gx) OVER w) AS bx, coalesce(lead(gy) OVER w, first_value(gy) OVER w) AS by
  FROM avp WINDOW w AS (PARTITION BY type_rank, id, ring ORDER BY pos)))"""

STREETS = f"""sv AS (SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ln, pk, sk) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n,
    475000000 + (id * 245489) % 22000000 + (pk * 31 % 2000) * 200 AS lat_e7, 75000000 + (id * 15485867) % 30000000 + (sk * 37 % 2000) * 200 AS lon_e7
  FROM (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_partkey AS BIGINT) AS pk, CAST(l_suppkey AS BIGINT) AS sk FROM lineitem)) WHERE n >= 2),
svp AS (SELECT *, {plane()} FROM sv),
sg AS (SELECT * FROM (SELECT id AS street_id, pos, lat_e7 AS alat, lon_e7 AS alon, gx AS ax, gy AS ay, lead(lat_e7) OVER w AS blat, lead(lon_e7) OVER w AS blon, lead(gx) OVER w AS bx, lead(gy) OVER w AS by
  FROM svp WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE bx IS NOT NULL)"""


def orient(a: str, b: str, c: str) -> str:
    return f"(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def on_segment(a: str, b: str, p: str) -> str:
    eps, length = num(geo.EPS), f"sqrt(pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2))"
    return (
        f"(CASE WHEN {length} = 0 THEN sqrt(pow({p}x - {a}x, 2) + pow({p}y - {a}y, 2)) <= {eps} ELSE abs({orient(a, b, p)}) <= {eps} * {length}"
        f" AND {p}x >= least({a}x, {b}x) - {eps} AND {p}x <= greatest({a}x, {b}x) + {eps} AND {p}y >= least({a}y, {b}y) - {eps} AND {p}y <= greatest({a}y, {b}y) + {eps} END)"
    )


def covering(points: str, key: str) -> str:
    """CTE pip: (key, area_type, area_id) of points, a table with key, gx and gy."""
    crossing = "(ay > gy) <> (by > gy) AND gx < (bx - ax) * (gy - ay) / (by - ay) + ax"
    return f"""box AS (SELECT area_type, area_id, min(ax) - 1e-9 AS x0, max(ax) + 1e-9 AS x1, min(ay) - 1e-9 AS y0, max(ay) + 1e-9 AS y1 FROM e GROUP BY ALL),
met AS (SELECT DISTINCT {key}, gx, gy, area_type, area_id FROM {points}, box WHERE gx BETWEEN x0 AND x1 AND gy BETWEEN y0 AND y1),
rings AS (SELECT {key}, area_type, area_id, component, ring, is_inner, count(*) FILTER ({crossing}) % 2 = 1 AS inside, bool_or({on_segment("a", "b", "g")}) AS touches
  FROM met JOIN e USING (area_type, area_id) GROUP BY ALL),
parts AS (SELECT {key}, area_type, area_id, component, bool_or(touches) AS touches, bool_or(inside AND NOT is_inner) AS outside, bool_or(inside AND is_inner) AS hole FROM rings GROUP BY ALL),
pip AS (SELECT {key}, area_type, area_id FROM parts GROUP BY ALL HAVING bool_or(touches OR (outside AND NOT hole)))"""


def meets(p: str, q: str, a: str, b: str) -> str:
    o = [orient(p, q, a), orient(p, q, b), orient(a, b, p), orient(a, b, q)]
    return (
        f"greatest({p}x, {q}x) >= least({a}x, {b}x) AND least({p}x, {q}x) <= greatest({a}x, {b}x) AND greatest({p}y, {q}y) >= least({a}y, {b}y) AND least({p}y, {q}y) <= greatest({a}y, {b}y)"
        f" AND ((({o[0]} < 0) <> ({o[1]} < 0) AND ({o[2]} < 0) <> ({o[3]} < 0)) OR {on_segment(p, q, a)} OR {on_segment(p, q, b)} OR {on_segment(a, b, p)} OR {on_segment(a, b, q)})"
    )


def view(lat0: int, lon0: int, lat1: int, lon1: int) -> str:
    """CTE seen: the middle of a lat/lon box in the plane, and how far the plane's box reaches from it: the box's half sides together, over the squared cosine of the angle at which they end."""
    return f"""mid AS (SELECT ({lat0} + {lat1}) / 2 AS lat_e7, ({lon0} + {lon1}) / 2 AS lon_e7, ({lat1} - {lat0} + {lon1} - {lon0}) / 2 * {E7} * {RAD} + {num(1e-8)} AS r),
centre AS (SELECT r, {unit("u")}, {plane(x="x", y="y")} FROM mid),
seen AS (SELECT x, y, r / pow(cos(acos(ux * {num(geo.CENTRE[0])} + uy * {num(geo.CENTRE[1])} + uz * {num(geo.CENTRE[2])}) + r), 2) AS pad FROM centre)"""


KNN_PARTS = f"""bu AS (SELECT type_rank, id, {unit("b")} FROM b WHERE has_point AND building_type IS NOT NULL AND building_type <> 'no'),
qu AS (SELECT query_id, {unit("q")} FROM q),
kd AS (SELECT query_id, type_rank, id, {R} * {angle("q", "b")} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {R} * {angle("q", "b")}, type_rank, id) AS rank FROM qu, bu)"""

TYPED = "CASE type_rank WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '/' || id"


def knn(k: int, points: str = EVENTS) -> str:
    return f"WITH {BUILDINGS}, {points}, {KNN_PARTS} SELECT query_id, CAST(rank AS INT) AS rank, type_rank, id, round(d, 3) AS distance_m FROM kd WHERE rank <= {k}"


def arc(edges: str, key: str) -> str:
    """CTE nearest: (query_id, key, d) of the edge nearest each row of qu."""
    u, v = unit("u", "alat", "alon"), unit("v", "blat", "blon")
    return f"""eu AS (SELECT {key}, {u}, {v} FROM {edges}),
en AS (SELECT *, uy * vz - uz * vy AS mx, uz * vx - ux * vz AS my, ux * vy - uy * vx AS mz FROM eu),
el AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS ml FROM en),
eh AS (SELECT * EXCLUDE (mx, my, mz), mx * (1 / nullif(ml, 0)) AS nx, my * (1 / nullif(ml, 0)) AS ny, mz * (1 / nullif(ml, 0)) AS nz FROM el),
f0 AS (SELECT *, qx * nx + qy * ny + qz * nz AS h FROM qu, eh),
f1 AS (SELECT *, qx - nx * h AS fx0, qy - ny * h AS fy0, qz - nz * h AS fz0 FROM f0),
f2 AS (SELECT *, sqrt(fx0 * fx0 + fy0 * fy0 + fz0 * fz0) AS fl FROM f1),
f3 AS (SELECT *, fx0 * (1 / nullif(fl, 0)) AS fx, fy0 * (1 / nullif(fl, 0)) AS fy, fz0 * (1 / nullif(fl, 0)) AS fz FROM f2),
f4 AS (SELECT query_id, {key}, least({angle("q", "u")}, {angle("q", "v")}) AS ends, {angle("q", "f")} AS foot,
  ml > 1e-15 AND fl > 1e-15 AND (uy * fz - uz * fy) * nx + (uz * fx - ux * fz) * ny + (ux * fy - uy * fx) * nz >= -1e-14
    AND (fy * vz - fz * vy) * nx + (fz * vx - fx * vz) * ny + (fx * vy - fy * vx) * nz >= -1e-14 AS between FROM f3),
f5 AS (SELECT query_id, {key}, {R} * CASE WHEN between AND foot < ends THEN foot ELSE ends END AS d FROM f4),
nearest AS (SELECT * FROM f5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, {key}) = 1)"""

RAW = """rn AS (SELECT id, CASE WHEN id % 101 = 0 THEN 950000000 ELSE 475000000 + (id * 104729) % 22000000 END AS lat_e7, 75000000 + (id * 1299709) % 30000000 AS lon_e7,
    id % 5 = 0 AS building, id % 3 = 0 OR id % 6 = 0 AS addressed, id % 7 <> 0 AS named, p_brand FROM (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand FROM part)),
ln AS (SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS ln, CAST(l_partkey AS BIGINT) AS pk, CAST(l_suppkey AS BIGINT) AS sk FROM lineitem),
wr AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY ln, pk, sk) - 1 AS pos, pk AS ref, count(*) OVER (PARTITION BY id) AS n, first_value(pk) OVER (PARTITION BY id ORDER BY ln, pk, sk) AS head FROM ln),
refs AS (SELECT id, pos, ref FROM wr UNION ALL SELECT DISTINCT id, n, head FROM wr WHERE id % 2 = 0),
rw AS (SELECT id, id % 3 = 0 AS highway, id % 4 = 0 AS building, id % 5 <> 0 AS named, CASE WHEN id % 11 = 0 THEN 'administrative' WHEN id % 13 = 0 THEN 'postal_code' END AS boundary, count(*) AS refs FROM refs GROUP BY id),
mem AS (SELECT DISTINCT sk AS relation, id AS ref FROM ln),
rr AS (SELECT id, id % 2 = 0 AS multipolygon, id % 3 = 0 AS building, CASE WHEN id % 5 = 0 THEN 'administrative' WHEN id % 7 = 0 THEN 'postal_code' END AS boundary, id % 4 <> 0 AS named FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier)),
needed AS (SELECT id FROM rw WHERE highway OR building OR boundary IS NOT NULL OR id IN (SELECT ref FROM mem))"""

SHAPES = """k AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 480000000 + (CAST(s_suppkey AS BIGINT) % 100) * 20000 AS lat0, 90000000 + (CAST(s_suppkey AS BIGINT) // 100) * 20000 AS lon0, s_name FROM supplier),
whole AS (SELECT * FROM k WHERE k % 4 <> 3 AND k % 7 <> 0 AND k % 11 <> 0)"""


def ring(corners: list[tuple[int, int]]) -> str:
    return " || ', ' || ".join(f"(lat0 + {y}) || ' ' || (lon0 + {x})" for y, x in [*corners, corners[0]])


OUTER, INNER, FAR = [(0, 0), (4000, 0), (4000, 4000), (0, 4000)], [(1000, 1000), (3000, 1000), (3000, 3000), (1000, 3000)], [(8000, 0), (9000, 0), (9000, 1000), (8000, 1000)]
