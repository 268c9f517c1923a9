"""Shards of near equal size whose groups stay together: longest processing time first, over a heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, stored

#: A group of at least a shard's mean size divided by this is placed alone. There are at most shards x ALONE of them.
ALONE = 1024
#: Smaller groups are gathered into 2 ** 16 bundles by the first bits of their digest; a bundle is placed
#: as one. A bundle is not larger than a 1024th of a shard by much, unless all small groups together
#: are more than 64 shards, so loads differ by about the largest group or bundle at most.


def longest_first(units: Iterable[tuple[int, object]], shards: int) -> dict[object, int]:
    """units: (size, key). The largest goes first, each to the shard with the least so far (the lower number on ties)."""
    heap = [(0, i) for i in range(shards)]
    placed = {}
    for size, key in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def lpt_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Puts every row into a shard so that the shards' bytes are near equal and equal texts share a shard.

    Size of a row: UTF-8 bytes of its text plus overhead; a null text has only the overhead, its
    CRC is null, and null texts are one group, apart from empty ones. Repeated rows are rows of
    their own with slots of their own. A group that is larger than a mean shard makes its shard
    larger than the others, as it may not be cut. Columns of docs other than the two are not read.

    The driver places at most shards x ALONE + 65,536 units, whatever the input: groups that
    matter for balance go alone, the others in bundles that are each a small part of a shard.
    Texts are not shuffled; only digests, sizes and ids are.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("_group"),
    )
    rows = stored(rows, "shard-rows")
    bundle = F.coalesce(F.conv(F.substring(F.hex("_group"), 1, 4), 16, 10).cast("int"), F.lit(0))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = max(1, total // (shards * ALONE))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"))
    units = groups.groupBy(F.when(F.col("size") >= least, F.coalesce("_group", F.lit(b""))).alias("alone"), F.when(F.col("size") < least, bundle).alias("bundle")).agg(F.sum("size").alias("size")).collect()
    alone = longest_first(((u["size"], (1, u["bundle"]) if u["alone"] is None else (0, bytes(u["alone"]))) for u in units), shards)
    big = spark.createDataFrame([(bytearray(k), s) for (kind, k), s in alone.items() if kind == 0], "_alone binary, _shard_alone int")
    small = spark.createDataFrame([(k, s) for (kind, k), s in alone.items() if kind == 1], "_bundle int, _shard_bundle int")
    placed = (
        rows.join(F.broadcast(big), F.coalesce("_group", F.lit(b"")) == F.col("_alone"), "left")
        .join(F.broadcast(small), bundle == F.col("_bundle"), "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_shard_alone", "_shard_bundle").alias("shard"))
    )
    placed = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, of 40, and its slot there."""
    return lpt_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
