"""A small HTTP API over an engine: /health, /reverse, /houses, /streets and /regions."""

from __future__ import annotations

import json
import math
import re
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote_plus, urlsplit

from geoloom.functions import geo
from geoloom.operators.viewport import MIN_STREET_ZOOM, Box


#: Bytes of a request's head, and requests that wait, at most.
HEAD, BACKLOG = 8192, 16


class BadRequest(ValueError):
    """Answered with 400 and its text."""


def parameters(query: str) -> dict[str, str]:
    """The first value of each key; a bad escape makes a value that is not there."""
    out: dict[str, str] = {}
    for part in query.split("&"):
        key, _, value = part.partition("=")
        if key not in out and not re.search(r"%(?![0-9A-Fa-f]{2})", value):
            out[key] = unquote_plus(value)
    return out


def finite(text: str | None) -> float | None:
    if text is None or not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    value = float(text)
    return value if math.isfinite(value) else None


def whole(found: dict[str, str], key: str, default: int, most: int) -> int:
    """A whole number from 1 to most, or the default where there is none."""
    if key not in found:
        return default
    value = finite(found[key])
    if value is None or value != int(value) or not 1 <= value <= most:
        raise BadRequest(f"{key} must be a whole number from 1 to {most}")
    return int(value)


def e7(degrees: float) -> int:
    return int(math.copysign(math.floor(abs(degrees) * 1e7 + 0.5), degrees))


def box(found: dict[str, str]) -> Box:
    """bbox=minLon,minLat,maxLon,maxLat in degrees."""
    if "bbox" not in found:
        raise BadRequest("bbox is missing")
    numbers = [finite(x) for x in found["bbox"].split(",")]
    if len(numbers) != 4 or any(n is None for n in numbers):
        raise BadRequest("bbox must be four numbers")
    x0, y0, x1, y1 = numbers
    if abs(x0) > 180 or abs(x1) > 180 or abs(y0) > 90 or abs(y1) > 90 or x0 > x1 or y0 > y1:
        raise BadRequest("bbox must be four numbers")
    return Box(e7(y0), e7(x0), e7(y1), e7(x1))


def in_hemisphere(lat: float, lon: float) -> bool:
    """Whether the gnomonic plane has the point."""
    a, b = lat * geo.RAD, lon * geo.RAD
    u = (math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a))
    return sum(x * y for x, y in zip(u, geo.CENTRE, strict=True)) > geo.HORIZON


def answer(engine, method: str, target: str) -> tuple[int, dict]:
    """Status and body of a request."""
    if method != "GET":
        return 405, {"error": "only GET"}
    url = urlsplit(target)
    found = parameters(url.query)
    try:
        if url.path == "/health":
            return 200, {"status": "ok"}
        if url.path == "/reverse":
            lat, lon = finite(found.get("lat")), finite(found.get("lon"))
            if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180:
                raise BadRequest("lat and lon must be numbers in range")
            if not in_hemisphere(lat, lon):
                raise BadRequest("the point lies outside the hemisphere that is supported")
            return 200, engine.reverse_json(lat, lon)
        if url.path not in ("/houses", "/streets", "/regions"):
            return 404, {"error": "not found"}
        view = box(found)
        zoom, limit, stride = whole(found, "zoom", 19, 19), whole(found, "limit", 10_000, 10_000), whole(found, "stride", 1, 100)
        if url.path == "/houses":
            began = time.perf_counter()
            body = engine.houses_json(view, zoom, limit, stride)
            return 200, {**body, "scan_ms": round((time.perf_counter() - began) * 1000, 3)}
        if url.path == "/streets" and zoom < MIN_STREET_ZOOM:
            return 200, {"type": "FeatureCollection", "features": []}
        return 200, engine.geometry_json(view, url.path[1:], zoom)
    except BadRequest as e:
        return 400, {"error": str(e)}


def serve(engine, port: int, max_requests: int | None = None) -> None:
    """Answers on the loopback interface, one request at a time, until max_requests are done."""

    class Handler(BaseHTTPRequestHandler):
        timeout = 5

        def parse_request(self) -> bool:
            """Requests whose head is over HEAD bytes are refused."""
            if len(self.raw_requestline) > HEAD or not super().parse_request():
                return False
            if len(self.raw_requestline) + sum(len(k) + len(v) + 4 for k, v in self.headers.items()) > HEAD:
                self.send_error(400)
                return False
            return True

        def _any(self) -> None:
            try:
                status, body = answer(engine, self.command, self.path)
            except Exception as e:  # noqa: BLE001
                status, body = 500, {"error": type(e).__name__}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Connection", "close")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = do_HEAD = do_OPTIONS = do_PATCH = _any

        def log_message(self, *args) -> None:
            pass

    class Server(HTTPServer):
        request_queue_size = BACKLOG

    with Server(("127.0.0.1", port), Handler) as server:
        served = 0
        while max_requests is None or served < max_requests:
            server.handle_request()
            served += 1
