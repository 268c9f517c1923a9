import json
import struct
import zlib

import pytest
from geoloom import cli, server
from geoloom.engine import Engine
from geoloom.sources import osmpbf, textfiles

E7 = 10_000_000


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data if isinstance(data, bytes) else varint(number << 3) + varint(data)


def steps(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values, strict=False))


def write_pbf(path, nodes, ways, relations):
    strings = [""]

    def s(text):
        if text not in strings:
            strings.append(text)
        return strings.index(text)

    flat = b"".join(b"".join(varint(s(k)) + varint(s(v)) for k, v in t.items()) + b"\0" for *_, t in nodes)
    dense = field(1, steps([n[0] for n in nodes])) + field(8, steps([n[1] for n in nodes])) + field(9, steps([n[2] for n in nodes])) + field(10, flat)

    def tagged(i, tags):
        return field(1, i) + field(2, b"".join(varint(s(k)) for k in tags)) + field(3, b"".join(varint(s(v)) for v in tags.values()))

    groups = [field(2, dense)]
    groups += [field(3, tagged(i, t) + field(8, steps(refs))) for i, refs, t in ways]
    kinds = {"node": 0, "way": 1, "relation": 2}
    groups += [field(4, tagged(i, t) + field(8, b"".join(varint(s(m[2])) for m in ms)) + field(9, steps([m[1] for m in ms])) + field(10, b"".join(varint(kinds[m[0]]) for m in ms))) for i, ms, t in relations]
    body = b"".join(field(2, g) for g in groups)
    block = field(1, b"".join(field(1, x.encode()) for x in strings)) + body
    with open(path, "wb") as f:
        for kind, data in ((b"OSMHeader", field(4, b"OsmSchema-V0.6")), (b"OSMData", block)):
            blob = field(2, len(data)) + field(3, zlib.compress(data))
            header = field(1, kind) + field(3, len(blob))
            f.write(struct.pack(">I", len(header)) + header + blob)


@pytest.fixture(scope="module")
def pbf(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("osm") / "small.osm.pbf")
    at = lambda i, lat, lon, **t: (i, int(lat * E7), int(lon * E7), {k.replace("__", ":"): v for k, v in t.items()})
    nodes = [
        at(1, 48.5, 9.5, building="yes", name="Haus", addr__street="Weg", addr__housenumber="1"), at(2, 48.6, 9.6, addr__place="Ort"), at(3, 48.7, 9.7, building="no"), at(4, 48.55, 9.55, shop="x"),
        at(11, 48.0, 9.0), at(12, 48.0, 10.0), at(13, 49.0, 10.0), at(14, 49.0, 9.0), at(21, 48.40, 9.40), at(22, 48.40, 9.41), at(23, 48.41, 9.41), at(24, 48.41, 9.40),
        at(31, 48.2, 9.2), at(32, 48.2, 9.3), at(33, 48.3, 9.3), at(34, 48.3, 9.2),
    ]
    ways = [
        (100, [11, 12, 13], {}), (101, [13, 14, 11], {}), (102, [21, 22, 23, 24, 21], {"building": "house", "name": "A", "name:de": ""}), (103, [1, 2, 999], {"highway": "service", "name": "Road"}),
        (104, [4, 999], {"highway": "path"}), (105, [999], {"building": "yes"}), (106, [31, 32, 33, 34, 31], {}), (107, [1, 4], {"highway": "track", "building": "roof"}), (108, [1, 2], {"addr:street": "Weg"}),
    ]
    relations = [
        (200, [("way", 100, "outer"), ("way", 101, "outer"), ("way", 106, "inner")], {"type": "boundary", "boundary": "administrative", "admin_level": "4", "name": "Land"}),
        (201, [("way", 100, "outer"), ("way", 555, "outer")], {"type": "boundary", "boundary": "postal_code", "postal_code": "70000", "admin_level": "8 "}),
        (202, [("way", 102, "outer")], {"type": "multipolygon", "building": "yes"}),
    ]
    write_pbf(path, nodes, ways, relations)
    return path


@pytest.fixture(scope="module")
def engine(spark, pbf):
    return Engine.load(spark, pbf)


def test_extraction(engine):
    t = engine.tables
    buildings = {(r.type_rank, r.id): r for r in t.buildings.collect()}
    assert set(buildings) == {(0, 1), (0, 2), (0, 3), (1, 102), (1, 105), (1, 107), (2, 202)}
    assert not buildings[1, 105].has_point and buildings[1, 102].name == "A"
    assert (buildings[1, 102].lat_e7, buildings[1, 102].lon_e7) == (484050000, 94050000) == (buildings[2, 202].lat_e7, buildings[2, 202].lon_e7)
    assert {r.id for r in t.streets.collect()} == {103, 107}
    areas = {r.id: r for r in t.areas.collect()}
    assert areas[200].has_geometry and (areas[200].outer_ring_count, areas[200].inner_ring_count, areas[200].admin_level) == (1, 1, 4)
    assert not areas[201].has_geometry and (areas[201].admin_level, areas[201].postcode) == (-1, "70000")
    stats = engine.stats.first().asDict()
    assert stats["buildings"] == 7 and stats["buildings_without_point"] == 1 and stats["areas_without_geometry"] == 1
    assert (stats["processed_nodes"], stats["processed_ways"], stats["processed_relations"]) == (16, 9, 3)
    assert (stats["outer_rings"], stats["inner_rings"], stats["incomplete_relations"], stats["open_rings"], stats["invalid_way_nodes"]) == (1, 1, 1, 0, 3)
    assert engine.membership_count() == engine.memberships.count() > 0
    assert ("building", 0, 1, 200) in {(r.kind, r.obj_type, r.obj_id, r.area_id) for r in engine.memberships.collect()}


def test_reverse_and_views(engine):
    found = engine.reverse_json(48.5, 9.5)
    assert found["nearest"]["id"] == "node/1" and found["nearest"]["state"] == "Land" and found["nearest"]["regions"][0]["id"] == "relation/200"
    assert [b["id"] for b in found["buildings"]][0] == "node/1" and found["regions"][0]["name"] == "Land"
    status, body = server.answer(engine, "GET", "/houses?bbox=9,48,10,49&zoom=17")
    assert status == 200 and body["returned"] == 6 and body["scan_ms"] > 0 and body["matched_exact"] and any(h["name"] is None for h in body["houses"])
    status, body = server.answer(engine, "GET", "/regions?bbox=9,48,10,49&zoom=12")
    assert status == 200 and body["features"][0]["geometry"]["type"] == "MultiPolygon" and len(body["features"][0]["geometry"]["coordinates"][0]) == 2
    status, body = server.answer(engine, "GET", "/streets?bbox=9,48,10,49&zoom=15")
    assert status == 200 and {f["properties"]["id"] for f in body["features"]} == {"way/103", "way/107"}
    json.dumps(body)


@pytest.mark.parametrize(("method", "target", "status"), [
    ("POST", "/health", 405), ("GET", "/health", 200), ("GET", "/nothing", 404), ("GET", "/reverse?lat=1", 400), ("GET", "/reverse?lat=91&lon=0", 400), ("GET", "/houses", 400),
    ("GET", "/houses?bbox=1,2,3", 400), ("GET", "/houses?bbox=3,2,1,4", 400), ("GET", "/houses?bbox=1,2,3,4&zoom=16.5", 400), ("GET", "/houses?bbox=1,2,3,4&limit=10001", 400),
    ("GET", "/streets?bbox=1,2,3,4&stride=0", 400), ("GET", "/streets?bbox=1,2,3,4&zoom=13", 200),
])
def test_statuses(method, target, status):
    assert server.answer(None, method, target)[0] == status


def test_kinds_and_packed_numbers(spark, pbf):
    whole = {r.id for df in osmpbf.read(spark, pbf) for r in df.collect()}
    apart = {r.id for kind in ("node", "way", "relation") for r in osmpbf.read_kind(spark, pbf, kind).collect()}
    assert whole == apart and len(whole) == 28
    values = [0, 1, 127, 128, 300, 2**31, 2**63, 2**64 - 1] * 60
    data = b"".join(varint(v) for v in values)
    assert osmpbf.packed(data) == values and osmpbf.unpacked_numbers(data[:6]).tolist() == [0, 1, 127, 128, 300][:5][: len(osmpbf.unpacked_numbers(data[:6]))]
    sums = [5, -3, 10**12, -(10**12), 0]
    assert osmpbf.running_numbers(steps(sums)).tolist() == sums


def test_a_failing_engine_is_not_a_bad_request(monkeypatch):
    class Broken:
        def reverse_json(self, lat, lon):
            raise RuntimeError("spark is gone")

    with pytest.raises(RuntimeError):
        server.answer(Broken(), "GET", "/reverse?lat=48&lon=9")
    assert server.answer(Broken(), "GET", "/reverse?lat=-51&lon=-170")[0] == 400


def test_batch_modes(spark, pbf, tmp_path, capsys):
    names, points, out = tmp_path / "names", tmp_path / "points", tmp_path / "out"
    names.write_bytes(b"HAUS\r\n\r\nroad\nLand\n")
    assert cli.main(["--pbf", pbf, "--search", str(names), str(out)]) == 0
    assert out.read_text() == "node/1\n\nway/103\nrelation/200\n"
    points.write_text("48.5 9.5\n")
    assert cli.main(["--pbf", pbf, "--reverse", str(points), str(out)]) == 0
    assert out.read_text().startswith("node/1, ")
    points.write_text("48.5 9.5\n91 0\n")
    assert cli.main(["--pbf", pbf, "--reverse", str(points), str(out)]) == 1
    assert cli.main(["--pbf", pbf, "--reverse", str(points), str(points)]) == 1
    assert cli.main(["--pbf", pbf, "--inspect", "--samples", "1"]) == 0
    told = capsys.readouterr().out
    assert "node/1: Haus" in told and "way/102: A, building=house" in told and "relation/200: Land, admin_level=4" in told and "node/2" not in told
    assert cli.main(["--pbf", pbf, "--serve", "--search", "a", "b"]) == 1


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no such"):
        osmpbf.read(spark, str(tmp_path / "none"))
    empty = tmp_path / "empty"
    empty.write_text("")
    with pytest.raises(ValueError):
        textfiles.check_paths(str(empty), str(empty))
    assert textfiles.numbered_lines(spark, str(empty)).count() == 0
