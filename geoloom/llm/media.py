"""Media columns: payloads cut where a rolling gear hash says, chunks stored once, media rebuilt from ordered chunk lists."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, stored

#: Chunks have MIN to MAX bytes (a last one may be shorter) and about MIN + 2 ** BITS on average.
MIN, MAX, BITS = 256, 8192, 10
#: Bits of the filter of shared digests: for each of them, and at most. With more digests than that
#: holds well, more chunks that are not shared pass as shared, which costs bytes moved only.
BITS_EACH, MOST_BITS = 16, 1 << 28
BLOCK = 64
MAGIC = b"GCDC"
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of BLOCK."""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def cuts(data: bytes, least: int = MIN, most: int = MAX, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data.

    The gear hash at a byte is the sum over the last 32 bytes of their gear numbers, each shifted
    left by its distance, modulo 2**32: doubling windows give it for all places at once. A chunk
    ends where the hash's top bits are 0, least bytes after its start at the earliest, most at the
    latest; least is over 32, so a cut depends on bytes of its chunk only.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        end = min(int(marks[i]) if i < len(marks) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def digest_of(piece: bytes) -> bytes:
    """The first 128 bits of a chunk's SHA-256."""
    return hashlib.sha256(piece).digest()[:16]


def chunked(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk, in order."""
    at, out = 0, []
    for end in cuts(data):
        piece = data[at:end]
        out.append((digest_of(piece), piece))
        at = end
    return out


def container(n_bytes: int, chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form: magic, unpadded length, number of chunks, each chunk's digest and length, then their samples of 8 bits."""
    head = MAGIC + struct.pack("<QI", n_bytes, len(chunks))
    return head + b"".join(d + struct.pack("<I", len(b)) for d, b in chunks) + b"".join(b for _, b in chunks)


def opened(media: bytes) -> tuple[int, bytes]:
    """The unpadded length and the payload of a stored form; every chunk's digest is verified."""
    if media[:4] != MAGIC:
        raise ValueError("no chunk container")
    n_bytes, n = struct.unpack_from("<QI", media, 4)
    at, body = 16, 16 + 20 * n
    parts = []
    for _ in range(n):
        digest, size = media[at : at + 16], struct.unpack_from("<I", media, at + 16)[0]
        piece = media[body : body + size]
        if digest_of(piece) != digest:
            raise ValueError("a chunk does not match its digest")
        parts.append(piece)
        at, body = at + 20, body + size
    return n_bytes, b"".join(parts)


def feature(samples: bytes) -> str:
    """Of the samples: mean, standard deviation, entropy in bits and how often neighbours differ."""
    x = np.frombuffer(samples, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    return f"{x.mean():.4f}|{x.std():.4f}|{abs((share * np.log2(share)).sum()):.4f}|{int(np.count_nonzero(np.diff(x)))}"


_COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, n_shared int"


def described(media: bytes, n_chunks: int, n_shared: int) -> tuple:
    """Reads a stored form back and describes what was read."""
    n_bytes, data = opened(media)
    return n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(data), n_chunks, n_shared


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def _positions(digest: bytes, bits: int) -> tuple[int, int]:
    a, b = struct.unpack("<QQ", digest)
    return a % bits, b % bits


def shared_filter(texts: DataFrame) -> np.ndarray:
    """A Bloom filter of the digests of chunks that occur more than once in texts (text), as 64-bit words.

    It has BITS_EACH bits for each such digest and MOST_BITS at most; the driver gets no more than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([d for text in _texts(batch.column(0)) for d, _ in chunked(payload(text))], pa.binary())], names=["digest"])

    counts = texts.mapInArrow(run, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    shared = stored(counts, "media-shared")
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_EACH * shared.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [p for d in batch.column(0).to_pylist() for p in _positions(d, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([p >> 6 for p in at], pa.int32()), pa.array([(1 << (p & 63)) - (1 << 64 if p & 63 == 63 else 0) for p in at], pa.int64())], names=["word", "bits"])

    words = shared.mapInArrow(place, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The chunk store of docs: packs, with a row for each row of docs, and the shared chunks.

    packs: row (its number), doc_id, n_bytes (of the text), chunks (digest, size and whether it is
    shared, in order) and own, the bytes of the chunks that are not shared, one after the other.
    shared: digest, data (compressed by zlib) and uses (places in packs) of every other chunk, once.
    A chunk is told to be shared by a filter of all digests that occur twice or more; one that the
    filter takes in by mistake is in the shared table with one use.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bits = spark.sparkContext.broadcast(shared_filter(rows.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            sizes, lists, own, common = [], [], [], []
            for text in _texts(batch.column(2)):
                chunks = chunked(payload(text))
                met = [all(int(table[p >> 6]) >> (p & 63) & 1 for p in _positions(d, 64 * len(table))) for d, _ in chunks]
                sizes.append(len(text))
                lists.append([{"digest": d, "size": len(b), "met": m} for (d, b), m in zip(chunks, met, strict=True)])
                own.append(b"".join(b for (_, b), m in zip(chunks, met, strict=True) if not m))
                common.append([{"digest": d, "data": zlib.compress(b, 1)} for (d, b), m in zip(chunks, met, strict=True) if m])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(lists, _LIST), pa.array(own, pa.binary()), pa.array(common, _COMMON)], names=["row", "doc_id", "n_bytes", "chunks", "own", "common"])

    found = rows.mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, chunks array<struct<digest: binary, size: int, met: boolean>>, own binary, common array<struct<digest: binary, data: binary>>")
    found = stored(found, "media-packs", "zstd")
    shared = found.select(F.inline("common")).groupBy("digest").agg(F.first("data").alias("data"), F.count("*").alias("uses"))
    return found.drop("common"), stored(shared, "media-chunks")


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The chunk store of docs as two plain tables: ordered lists of chunks, and every chunk once.

    lists: row (a number of each row of docs), doc_id, n_bytes (of the text), n_seq (its chunks),
    seq, digest. chunks: digest, data (the chunk, compressed by zlib), uses (places in lists).
    """
    packs, shared = packed(docs, id_col, text_col)
    lists = packs.select("row", "doc_id", "n_bytes", F.size("chunks").alias("n_seq"), F.posexplode("chunks").alias("seq", "chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, datas = [], []
            for chunks, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for c in chunks:
                    if not c["met"]:
                        digests.append(c["digest"])
                        datas.append(zlib.compress(own[at : at + c["size"]], 1))
                        at += c["size"]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(datas, pa.binary()), pa.array([1] * len(digests), pa.int64())], names=["digest", "data", "uses"])

    alone = packs.select("chunks", "own").mapInArrow(run, "digest binary, data binary, uses long")
    return lists.select("row", "doc_id", "n_bytes", "n_seq", "seq", "chunk.digest"), alone.unionByName(shared)


def rebuilt_media(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """row, doc_id, what described() says and media, the stored form, of every row of packs, made of its own chunks and of the shared ones in the order of its list, and read back.

    Rows without shared chunks are rebuilt where they lie; for the others the shared chunks are
    joined by digest and brought to their row.
    """
    kind = packs.schema["doc_id"].dataType.simpleString()
    some = F.exists("chunks", lambda c: c["met"])
    places = packs.where(some).select("row", F.posexplode("chunks").alias("seq", "chunk")).where("chunk.met").select("row", "seq", "chunk.digest")
    fetched = places.join(shared, "digest").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "data", "uses"))).alias("fetched"))
    met = packs.where(some).join(fetched, "row", "left")
    none = F.expr("cast(null as array<struct<seq: int, data: binary, uses: bigint>>)")
    columns = ["row", "doc_id", "n_bytes", "chunks", "own", "fetched"]

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, media = [], []
            for n_bytes, chunks, own, fetched in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                there = {f["seq"]: zlib.decompress(f["data"]) for f in fetched or []}
                at, parts = 0, []
                for seq, c in enumerate(chunks):
                    if c["met"]:
                        if seq not in there:
                            raise ValueError("a chunk is missing")
                        parts.append((c["digest"], there[seq]))
                    else:
                        parts.append((c["digest"], own[at : at + c["size"]]))
                        at += c["size"]
                media.append(container(n_bytes, parts))
                found.append(described(media[-1], len(parts), sum(f["uses"] > 1 for f in fetched or [])))
            made = list(zip(*found, strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, f.type) for c, f in zip(made, _DONE, strict=True)], pa.array(media, pa.binary())], names=["row", "doc_id", *_NAMES, "media"])

    every = packs.where(~some).withColumn("fetched", none).select(*columns).unionByName(met.select(*columns))
    return every.mapInArrow(rebuilt, f"row long, doc_id {kind}, {_COLUMNS}, media binary")


def chunk_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every row's text as deduplicated chunks, rebuilds its media from its chunk list and describes it.

    The media are in the column media, for opened(); packed() and chunk_store() have the tables they
    are made of. Null and empty texts are one block of zeros. Equal texts get equal values, and
    repeated rows come back as often as they came. Other columns of docs are not read.
    """
    return rebuilt_media(*packed(docs, id_col, text_col)).drop("row")


_LIST = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("met", pa.bool_())]))
_COMMON = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_DONE = pa.struct([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in _COLUMNS.split(", "))])
_NAMES = [f.name for f in _DONE]


def op9_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rebuilt media of every document say."""
    return chunk_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("media")
