"""The corpus pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.mixing import pivotal_mix, word_count
from geoloom.llm.ngramjoin import jaccard_components
from geoloom.llm.packing import pack
from geoloom.llm.pseudonyms import pseudonymise, session_key
from geoloom.llm.quality import Resampler
from geoloom.llm.shared import collecting, discard_path, maybe_among, stored


#: Tables that the stage called last has stored; its rows still come from them.
_held: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f, which first discards what the stage called before it stored: that one's rows have been written and read again by then."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _held:
            discard_path(spark, _held.pop())
        with collecting() as paths:
            out = f(spark, docs, sf_dir)
        _held.extend(paths)
        return out

    return call


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, with all columns.

    Null and empty texts have a log ratio of 0. Rows of one id and text are drawn or rejected
    together; so are rows tied with the last drawn. An empty table stays empty.
    """
    return Resampler(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filtered(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: that of the least doc_id (a null one is larger than any), then of the least hash of its text.

    Rows without words link with nothing and all stay. Of rows of the same id and text that are kept
    one stays, whichever. Texts are shuffled only of rows that go or may go: the others are known to
    stay by a filter.
    """
    groups = stored(jaccard_components(docs).where("component is not null").select("doc_id", "text_hash", "component"), "duplicate-groups")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    own = groups.join(first, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    some = own.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.bool_or("stays").alias("_stays"), F.count("*").alias("_n")).where("not _stays or _n > 1")
    some = stored(some, "duplicates")
    key = lambda i, th: F.xxhash64(i, th)
    marked = maybe_among(docs, key(F.col("doc_id"), F.xxhash64("text")), some.select(key(F.col("_id"), F.col("_th"))), some.count(), "_maybe")
    columns = docs.columns
    met = marked.where("_maybe").drop("_maybe").withColumn("_text", F.xxhash64("text")).join(some, (F.col("_text") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    out = marked.where("not _maybe").select(*columns).unionByName(met.where("_stays is null").select(*columns))
    if not some.where("_stays").isEmpty():
        out = out.unionByName(met.where("_stays").groupBy("_id", "_th").agg(F.first(F.struct(*columns)).alias("row")).select("row.*"))
    return out


@_stage
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal numbers, dates and addresses. Null and empty texts and other columns stay as they are."""
    return pseudonymise(docs, session_key(spark))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice.

    Copies are decided on ids, sources and sizes; texts are joined to them once. A null source is a
    source of its own; rows without words are taken as often as their source's size says, which is
    never. Rows of the same id and text are one document, whose copies are counted together.
    """
    light = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    mixed = pivotal_mix(light, size=F.col("size"))
    taken = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_n")).where("_copies > 0")
    taken = stored(taken, "mix-copies")
    met = docs.withColumn("_text", F.xxhash64("text")).join(taken, (F.col("_text") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy")
    out = met.where("_n = 1").select(*docs.columns, copies).drop("_copy")
    if not taken.where("_n > 1").isEmpty():
        once = met.where("_n > 1").groupBy("_id", "_th", "_copies").agg(F.first(F.struct(*docs.columns)).alias("row"))
        out = out.unionByName(once.select("row", copies).select("row.*"))
    return out


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of 1024 tokens. A null or empty text is the end token alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", mixture),
    ("packing", packing),
]

#: Hashing, pseudonyms and tokens are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
