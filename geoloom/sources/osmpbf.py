"""OSM PBF files as a Spark data source: spark.read.format("osmpbf").option("entity", "node").load(path)."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.plans.settle import settled

SCHEMAS = {
    "node": "id long, lat_e7 long, lon_e7 long, tags map<string, string>",
    "way": "id long, node_refs array<long>, tags map<string, string>",
    "relation": "id long, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>",
    "all": "kind string, id long, lat_e7 long, lon_e7 long, node_refs array<long>, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>",
}
#: Blobs of a task, and from how many bytes on a packed field is decoded at once.
BLOBS, LONG = 8, 256
_TAGS = pa.map_(pa.string(), pa.string())
_ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat_e7", pa.int64()), ("lon_e7", pa.int64()), ("tags", _TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("node_refs", pa.list_(pa.int64())), ("tags", _TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", _TAGS)]),
}
_ARROW["all"] = pa.schema([("kind", pa.string()), *_ARROW["node"].remove(3), _ARROW["way"].field(1), _ARROW["relation"].field(1), ("tags", _TAGS)])


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: a number, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, value
        elif kind == 2:
            size, at = varint(data, at)
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


def packed(data: bytes) -> list[int]:
    """The numbers of a packed field; long ones are decoded for all numbers at once."""
    if len(data) >= LONG:
        return unpacked_numbers(data).tolist()
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def unpacked_numbers(data: bytes) -> np.ndarray:
    """The numbers of a packed field as unsigned 64-bit integers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    out = np.zeros(len(last), dtype=np.uint64)
    for i in range(int(size.max(initial=0))):
        own = size > i
        out[own] |= (raw[first[own] + i] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * i)
    return out


def running_numbers(data: bytes) -> np.ndarray:
    """Sums of the zigzag differences of a packed field."""
    n = unpacked_numbers(data)
    return np.cumsum((n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64))


def zigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def running(values: list[int]) -> list[int]:
    """Sums of zigzag differences."""
    total, out = 0, []
    for v in values:
        total += zigzag(v)
        out.append(total)
    return out


def blob_places(path: str) -> list[tuple[int, int]]:
    """(offset, size) of each data blob; only headers are read."""
    if not os.path.isfile(path):
        raise ValueError(f"no such PBF file: {path}")
    out, end = [], os.path.getsize(path)
    with open(path, "rb") as f:
        while f.tell() < end:
            header = dict(fields(f.read(struct.unpack(">I", f.read(4))[0])))
            if header[1] == b"OSMData":
                out.append((f.tell(), header[3]))
            f.seek(header[3], os.SEEK_CUR)
    return out


def unpacked(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("a blob is packed in a way that is not supported")


def every_entity(block: bytes) -> Iterator[tuple]:
    """Rows of all kinds in a block of primitives: kind, id, lat_e7, lon_e7, node_refs, members, tags."""
    for i, lat, lon, tags in entities(block, "node"):
        yield "node", i, lat, lon, None, None, tags
    for i, refs, tags in entities(block, "way"):
        yield "way", i, None, None, refs, None, tags
    for i, members, tags in entities(block, "relation"):
        yield "relation", i, None, None, None, members, tags


def entities(block: bytes, entity: str) -> Iterator[tuple]:
    """Rows of one kind in a block of primitives, or of all."""
    if entity == "all":
        yield from every_entity(block)
        return
    strings: list[str] = []
    granularity, lat_offset, lon_offset = 100, 0, 0
    groups = []
    for number, value in fields(block):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for n, s in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat_offset = signed(value)
        elif number == 20:
            lon_offset = signed(value)

    def e7(offset: int, n: int) -> int:
        nano = offset + granularity * n
        return (abs(nano) + 50) // 100 * (1 if nano >= 0 else -1)

    def tags(keys: bytes, values: bytes) -> list[tuple[str, str]]:
        return list({strings[k]: strings[v] for k, v in zip(packed(keys), packed(values), strict=True)}.items())

    for group in groups:
        for number, value in fields(group):
            if entity == "node" and number == 1:
                f = dict(fields(value))
                yield zigzag(f[1]), e7(lat_offset, zigzag(f[8])), e7(lon_offset, zigzag(f[9])), tags(f.get(2, b""), f.get(3, b""))
            elif entity == "node" and number == 2:
                f = dict(fields(value))
                ids, lats, lons = (running_numbers(f[n]) for n in (1, 8, 9))
                nano = [lat_offset + granularity * lats, lon_offset + granularity * lons]
                lats, lons = (((np.abs(v) + 50) // 100 * np.where(v >= 0, 1, -1)).tolist() for v in nano)
                flat, at = packed(f.get(10, b"")), 0
                if not any(flat):
                    yield from zip(ids.tolist(), lats, lons, ([] for _ in lats), strict=True)
                    continue
                for i, lat, lon in zip(ids.tolist(), lats, lons, strict=True):
                    own = {}
                    while at < len(flat) and flat[at]:
                        own[strings[flat[at]]] = strings[flat[at + 1]]
                        at += 2
                    at += 1
                    yield i, lat, lon, list(own.items())
            elif entity == "way" and number == 3:
                f = dict(fields(value))
                yield f[1], running(packed(f.get(8, b""))), tags(f.get(2, b""), f.get(3, b""))
            elif entity == "relation" and number == 4:
                f = dict(fields(value))
                kinds = ("node", "way", "relation")
                members = [{"type": kinds[k], "ref": r, "role": strings[s]} for s, r, k in zip(packed(f.get(8, b"")), running(packed(f.get(9, b""))), packed(f.get(10, b"")), strict=True)]
                yield f[1], members, tags(f.get(2, b""), f.get(3, b""))


class Blobs(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class PbfReader(DataSourceReader):
    def __init__(self, path: str, entity: str):
        self.path, self.entity = path, entity

    def partitions(self) -> list[Blobs]:
        places = blob_places(self.path)
        return [Blobs(places[i : i + BLOBS]) for i in range(0, len(places), BLOBS)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        schema = _ARROW[self.entity]
        with open(self.path, "rb") as f:
            for offset, size in partition.places:
                f.seek(offset)
                rows = list(entities(unpacked(f.read(size)), self.entity))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class OsmPbf(DataSource):
    """Options: path, and entity (node, way, relation or all). The file is at the same place on every executor."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "node")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], self.options.get("entity", "node"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations of a file, which is decoded once and stored as a table of all three."""
    blob_places(path)
    spark.dataSource.register(OsmPbf)
    every = settled(spark.read.format("osmpbf").option("entity", "all").load(path))
    return (
        every.where("kind = 'node'").select("id", "lat_e7", "lon_e7", "tags"),
        every.where("kind = 'way'").select("id", "node_refs", "tags"),
        every.where("kind = 'relation'").select("id", "members", "tags"),
    )


def read_kind(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """One kind of a file's objects (node, way or relation), or all, decoded as they are read."""
    blob_places(path)
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osmpbf").option("entity", entity).load(path)
