"""Mixing sources to target weights: pivotal rounding of copies by a distributed tree of reductions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Each source is cut into FAN * FAN parts by a hash; each leaves at most one fractional document,
#: FAN of these meet in a task of the next level, and the FAN that are left meet in the last.
FAN = 64
#: Up to so many sources, their targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float, most: float) -> DataFrame:
    """sizes: (source, source_size). Adds target: epochs times all sizes, by weight, at most `most` times a source's own size.

    What a capped source leaves goes to the others by weight until none is above its cap. Sources
    stand in order of the ratio of cap to weight; all before the first whose cap exceeds its share
    of what the earlier ones leave are capped. One row per source, so the windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("source_size").cast("double"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(epochs) * F.sum("source_size").over(everything)
    share = (total - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("_share", share).withColumn("_rank", F.row_number().over(order))
    level = F.min_by(F.when(F.col("_share") <= F.col("_ratio"), F.col("_share")), F.when(F.col("_share") <= F.col("_ratio"), F.col("_rank"))).over(everything)
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w")).alias("target"))


def _uniform(a: int, b: int) -> float:
    """A number from 0 to 1 that the two rows' hashes decide: 52 bits of a digest of both."""
    return int(hashlib.md5(f"{a}/{b}".encode()).hexdigest()[:13], 16) / (1 << 52)


def duel(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Moves words between two documents of s and t words taken with chances p and q until one chance is 0 or 1.

    p * s + q * t stays as it is, and u, uniform, picks the direction so that both chances stay as
    they were on average.
    """
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:  # to the first
        return (1.0, q - up / t) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, q + down / t) if p * s <= (1 - q) * t else (p - down / s, 1.0)


def _round_within(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by _key; in each key, a fractional row meets the next until one is left, which stays fractional (last: is rounded)."""
    carry: pa.Table | None = None
    for batch in _then_none(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if carry is not None:
            table = carry if table is None else pa.concat_tables([carry, table])
        carry = None
        if table is None or not table.num_rows:
            continue
        key = table.column("_key").to_pylist()
        p, size, h = table.column("_p").to_pylist(), table.column("size").to_pylist(), table.column("_hash").to_pylist()
        open_at = None
        for i in range(len(p)):
            if open_at is not None and key[i] != key[open_at]:
                if last:
                    p[open_at] = 1.0 if _uniform(h[open_at], 1) < p[open_at] else 0.0
                open_at = None
            if not 0.0 < p[i] < 1.0:
                continue
            if open_at is None:
                open_at = i
                continue
            p[open_at], p[i] = duel(p[open_at], size[open_at], p[i], size[i], _uniform(h[open_at], h[i]))
            open_at = i if 0.0 < p[i] < 1.0 else open_at if 0.0 < p[open_at] < 1.0 else None
        if batch is None and open_at is not None and last:
            p[open_at] = 1.0 if _uniform(h[open_at], 1) < p[open_at] else 0.0
        table = table.set_column(table.column_names.index("_p"), "_p", pa.array(p, pa.float64()))
        if batch is not None and open_at is not None:
            carry = table.slice(open_at, 1)
            table = pa.concat_tables([table.slice(0, open_at), table.slice(open_at + 1)])
        yield from table.to_batches()


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _level(rows: DataFrame, key: Column, last: bool) -> DataFrame:
    keyed = rows.withColumn("_key", key)
    dealt = keyed.repartition("_key").sortWithinPartitions("_key", "_hash", "size")
    return stored(dealt.mapInArrow(lambda batches: _round_within(batches, last), keyed.schema), "mix-level")


def pivotal_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = 1.5, most: int = 2, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """Adds to every row of docs how often the mix takes it: size, source_size, target, copies and taken (copies times size).

    A source's rows all have the same mean number of copies, target / source_size; the whole part
    is taken for sure, and the fraction is rounded pivotally, weighted by size, so a source's taken
    words differ from its target by less than one document. size: words of `text` unless given;
    rows without words take nothing. A null source is a source of its own, last in order. Repeated
    rows are rounded each. The result depends on the rows' ids, sizes and texts and on seed only,
    not on partitions. Columns of docs stay, but size, source_size, target, copies and taken are
    written anew if they are there, and names with a leading underscore are the operator's.
    """
    told = [F.col(id_col).cast("string"), *([F.xxhash64("text").cast("string")] if "text" in docs.columns else []), F.lit(str(seed))]
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *told).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.withColumn("size", word_count(F.col("text")) if size is None else size).withColumn("_hash", own)
    sizes = rows.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, epochs, float(most)).select(F.col("source").alias("_source"), "source_size", "target")
    targets = stored(targets, "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = rows.drop("source_size", "target").join(targets, F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")
    mean = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_base", F.floor(mean)).withColumn("_p", mean - F.floor(mean)).withColumn("_part", (F.col("_hash") % (FAN * FAN)).cast("int"))
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    fractional = (F.col("_p") > 0) & (F.col("_p") < 1)
    first = _level(rows, F.concat_ws("/", F.col("_part").cast("string"), name), False)
    second = _level(first.where(fractional), F.concat_ws("/", (F.col("_part") % FAN).cast("string"), name), False)
    third = _level(second.where(fractional), name, True)
    whole = first.where(~fractional).unionByName(second.where(~fractional)).unionByName(third)
    whole = whole.withColumn("copies", (F.col("_base") + F.col("_p")).cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return whole.drop("_hash", "_base", "_p", "_part", "_key")


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's size and target and the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return pivotal_mix(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
