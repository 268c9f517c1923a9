"""What several operators need: written intermediate tables and numbering of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Each group of rows that is numbered is cut into so many parts by a hash, so that a group that
#: holds most rows is numbered by many tasks.
SALTS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of texts that go to Python at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python in batches of BATCH_ROWS at most, so that long texts need little memory on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Lists of paths that stored() writes to while a collecting() block is open, innermost last.
_collected: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Gathers the paths of all tables stored inside the block, so that their owner can discard them with the last reader done."""
    paths: list[str] = []
    _collected.append(paths)
    try:
        yield paths
    finally:
        _collected.remove(paths)


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(discard_path, spark, path)
    if _collected:
        _collected[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geoloom_path = path  # noqa: SLF001
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm  # noqa: SLF001
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001
    except Exception:  # noqa: BLE001  the session has ended; the folder is temporary
        pass


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote. Only for tables that no later plan reads."""
    discard_path(df.sparkSession, df._geoloom_path)  # noqa: SLF001


#: Bits of a filter of keys: so many for each key, and at most so many whatever the input.
BITS_PER_KEY, MOST_BITS = 16, 1 << 25


def maybe_among(rows: DataFrame, key: Column, keys: DataFrame, expected: int, out: str) -> DataFrame:
    """Adds a boolean `out`: false where key (a hash of 64 bits) is not in keys (one column of such), true where it is and at few other rows.

    The filter that is broadcast has at most MOST_BITS bits, as MOST_BITS / 64 rows; with more keys
    than that holds well, more rows come out true, so true rows go on to an exact join.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (expected * BITS_PER_KEY).bit_length()))
    own = keys.select(F.col(keys.columns[0]).alias("_key"))
    place = lambda c: F.pmod(c, F.lit(bits))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(c, F.lit(bits)) % 64).cast("int"))
    words = own.select(F.floor(place(F.col("_key")) / 64).alias("_word"), bit(F.col("_key")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.join(F.broadcast(words), F.floor(place(key) / 64) == F.col("_word"), "left")
    return met.withColumn(out, F.coalesce(F.col("_bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("_word", "_bits")


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str, salt_on: list[str], weight: str | None = None, salts: int = SALTS) -> DataFrame:
    """Adds a gapless number from 0 within each group (with weight: the sum of the weights before the row).

    No task sees a whole group: rows go to `salts` parts of their group by a hash of salt_on, the
    parts' totals (at most groups x salts rows) give each part its first number, and a window
    numbers the rows of each part. rows is evaluated twice, so pass a stored table.
    """
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in salt_on]).cast("binary"))
    salted = rows.withColumn("_salt", (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % salts).cast("int"))
    totals = salted.groupBy(*group, "_salt").agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    keys = [*group, "_salt"]
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_start")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    own = F.row_number().over(inside) - 1 if weight is None else F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("_own", own.cast("long"))
    return ranked.join(F.broadcast(starts), same, "left").withColumn(out, F.col("_start") + F.col("_own")).drop("_salt", "_own", "_start", *[f"_k{i}" for i in range(len(keys))])
