"""Fixed windows filled closest to capacity: minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .shared import bounded_batches, stored
from .tokencount import byte_letters, pretokens

#: Pretokens whose ids a worker keeps, of at most KEPT_LENGTH characters each: twice so many, those used last.
KEPT, KEPT_LENGTH = 250_000, 32
#: A table of sums over tasks with at most so many rows is broadcast.
SMALL = 400_000


class Ids(dict):
    """The ids of each pretoken as little-endian 32-bit numbers, made by the model of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = dict(enumerate(byte_letters()))
        self.specials = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        strings = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                letters = piece.replace(" ", self.letters[32])
            else:
                letters = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str) -> bytes:
        if self.special is None or self.special.search(text) is None:
            return b"".join(map(self.__getitem__, pretokens(text)))
        parts = (self.specials.get(part) or b"".join(map(self.__getitem__, pretokens(part))) for part in self.special.split(text))
        return b"".join(parts)


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the counted lengths whose sum is the largest up to room, as length: count.

    Bit s of reach says that some multiset sums to s. Lengths enter from the longest, each in
    powers of two up to its count; going back from the best sum, a step is taken only where the sum
    was out of reach before it, so long pieces are used first.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        part = 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + part
            best -= length * part
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Windows for pieces of the counted lengths: (how many alike, length: pieces in each).

    Each window takes the longest remaining piece and the multiset of the rest that leaves least
    slack, and is repeated while the counts allow, so that each step uses up a length. The work
    depends on the number of lengths, not on that of pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = fill({k: n for k, n in left.items() if n > 0}, capacity - longest) if capacity > longest else {}
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        times = min(left[length] // k for length, k in window.items())
        out.append((times, window))
        for length, k in window.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return out


def _plan(windows: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, pieces in a window, first sequence, offset) that say where each piece of a length goes."""
    rows, used, sequence = [], {}, 0
    for times, window in windows:
        offset = 0
        for length in sorted(window, reverse=True):
            k = window[length]
            first = used.get(length, 0)
            rows.append((length, first, first + k * times, k, sequence, offset))
            used[length] = first + k * times
            offset += k * length
        sequence += times
    return rows


#: Bytes of text whose ids are made before they are handed on, about, so that their bytes have offsets of 32 bits.
HANDED_ON = 1 << 28


def _bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts with at most HANDED_ON bytes in the column, or of one row."""
    half = batch.num_rows // 2
    if half and batch.column(column).nbytes > HANDED_ON:
        yield from _bounded(batch.slice(0, half), column)
        yield from _bounded(batch.slice(half), column)
    else:
        yield batch


def tokenized(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """For every row: part (the task's number), doc_id, doc_tokens (with the end), full (whole windows), rest, the ids in cuts of window, as little-endian 32-bit numbers, and how many whole windows and how many rests of this length the task has had before it.

    What a task counts is only right together with the rows of the same attempt, so store the result before use.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(path), array("I", [end_id]).tobytes()
        fulls, rests = 0, [0] * window
        for batch in (part for whole in batches for part in _bounded(whole, 2)):
            datas, sizes, inner, outer, at = [], [], [0], [0], 0
            before, ranks = [], []
            for text in batch.column(2):
                data = (ids.of(text.as_py()) if text.is_valid else b"") + end
                n = len(data) // 4
                datas.append(data)
                sizes.append(n)
                inner.extend(at + i for i in range(window, n, window))
                at += n
                inner.append(at)
                outer.append(len(inner) - 1)
                before.append(fulls)
                ranks.append(rests[n % window])
                fulls += n // window
                rests[n % window] += 1
            ends = np.array(inner, dtype=np.int64) * 4
            cut_ids = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(datas))])
            cuts = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), cut_ids)
            size = np.array(sizes, dtype=np.int64)
            columns = [size, size // window, size % window, np.array(before, dtype=np.int64), np.array(ranks, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns), cuts], names=["part", "doc_id", "doc_tokens", "full", "rest", "before", "rank", "cuts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"part int, doc_id {kind}, doc_tokens long, full long, rest long, before long, rank long, cuts array<binary>")


def with_checksum(pieces: DataFrame) -> DataFrame:
    """pieces, their ids as numbers instead of little-endian bytes of 32 bits each, and, after ids, ids_crc32: the CRC of these bytes."""
    at = pieces.columns.index("ids") + 1
    columns = [*pieces.columns[:at], "ids_crc32", *pieces.columns[at:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = batch.column(at - 1)
            _, offsets, data = cut.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32)[cut.offset : cut.offset + len(cut) + 1]
            view = memoryview(data)
            crcs = pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
            ids = pa.ListArray.from_arrays(pa.array(ends // 4), pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, data]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: at - 1], ids, crcs, *batch.columns[at:]], names=columns)

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema} | {"ids": "array<int>", "ids_crc32": "long"}
    return pieces.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it has at most SMALL rows; beyond, Spark joins it as it sees fit."""
    return F.broadcast(table) if table.count() <= SMALL else table


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every row into sequences of at most window tokens; one row per piece, with its ids.

    A document's ids, then end_id, are cut into full windows, which are sequences of their own, and
    a rest, which goes where minimum_slack says. A null or empty text is the end alone. Repeated
    rows are packed each. Other columns are not read. A sequence is the ids of its pieces by offset.
    ids_crc32 is a piece's checksum, made of ids. Which pieces share a sequence depends on how docs
    is dealt to tasks. The driver sees only how many rests have each length (at most window - 1
    numbers). A piece's place follows from what its task counted and from the sums over the tasks
    before, of a row for each task and length; ids stay where they were written.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = stored(tokenized(docs, path, window, end_id, id_col, text_col), "pack-tokens", "zstd")
    by_part = stored(rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "pack-counts")
    counts = {r["rest"]: r["n"] for r in by_part.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    windows = minimum_slack(counts, window)
    plan = spark.createDataFrame(_plan(windows), "_length long, _lo long, _hi long, _k long, _seq long, _off long")
    shared = sum(times for times, _ in windows)
    earlier = lambda w: w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_rest = by_part.select("part", "rest", F.coalesce(F.sum("n").over(earlier(Window.partitionBy("rest"))), F.lit(0)).alias("_rests"))
    of_full = by_part.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(earlier(Window.partitionBy(F.lit(0)))), F.lit(0)).alias("_fulls"))
    placed = rows.join(_small(of_rest), ["part", "rest"]).join(_small(of_full), "part").withColumn("_rank", F.col("rank") + F.col("_rests"))
    placed = placed.join(F.broadcast(plan), (F.col("rest") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")), "left")
    at = F.col("_rank") - F.col("_lo")
    placed = placed.withColumn("_rest_sequence", F.col("_seq") + F.floor(at / F.col("_k"))).withColumn("_rest_offset", F.col("_off") + at % F.col("_k") * F.col("rest"))

    def piece(ids: Column, i: Column) -> Column:
        whole = i < F.col("full")
        return F.struct(
            (i.cast("long") * window).alias("start"), (F.octet_length(ids) / 4).cast("long").alias("length"), ids.alias("ids"),
            F.when(whole, F.lit(shared).cast("long") + F.col("_fulls") + F.col("before") + i).otherwise(F.col("_rest_sequence")).alias("sequence_id"),
            F.when(whole, F.lit(0).cast("long")).otherwise(F.col("_rest_offset")).alias("offset"),
        )

    pieces = placed.select("doc_id", "doc_tokens", F.inline(F.transform("cuts", piece)))
    return with_checksum(pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"))


def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, by checksum, and their places."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
