"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, stored
from .wordstream import Words, chunks, mix

#: Labelled rows that the target model and the cut are fitted on, at most: those of the smallest hashes.
FIT_ROWS = 20_000
BUCKETS = 10_000
#: Pseudo-counts of each bucket of the target model on average, spread as the raw model is: they pull
#: the ratio of what a small sample has hardly seen towards 1.
SMOOTHING = 30.0
#: Letters, digits and all bytes beyond ASCII make words; other printable ASCII makes runs of signs.
_CLASSES = np.zeros(256, dtype=np.uint8)
_CLASSES[0x21:0x80] = 2
_CLASSES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the documents, and the document of each.

    For every word: the word, the pair with the next one, and the same two over shapes (class,
    length up to 12, share of capitals). In a pair, a word that repeats the one before it is written
    as a mark, so that any stutter is the same pair.
    """
    h = words.hashes()
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    size = words.end - words.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[words.data])])
    capitals = upper[words.end] - upper[words.start]
    shape = (_CLASSES[words.data[words.start]].astype(np.uint64) * np.uint64(64) + np.minimum(size, 12).astype(np.uint64) * np.uint64(4)) + np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(capitals * 2 < size, 2, 3))).astype(np.uint64)
    same = doc[1:] == doc[:-1]
    k = np.uint64(0x9FB21C651E98DF25)
    pair = (h[:-1] * k + np.where(h[1:] == h[:-1], np.uint64(7), h[1:]))[same]
    shapes = (shape[:-1] * np.uint64(4096) + shape[1:])[same]
    values = np.concatenate([mix(h + np.uint64(1)), mix(pair + np.uint64(2)), mix(shape * k + np.uint64(3)), mix(shapes * k + np.uint64(4))])
    return (values % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[1:][same], doc, doc[1:][same]])


def fit_sample(labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", quality_col: str = "quality") -> list[tuple[int, int]]:
    """(id, quality) of at most `rows` labelled documents, those of the smallest hashes; where labels of an id differ, the lower one holds."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(quality_col).alias("quality"))
    return [(r["id"], r["quality"]) for r in one.orderBy(F.xxhash64("id"), "id").limit(rows).collect()]


def fit(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratios of target to raw by bucket. docs: (id, text); good: (_id), broadcast, at most FIT_ROWS rows.

    Raw counts are over all documents, target counts over those in good. The driver gets `buckets`
    rows. One is added to each raw count, and SMOOTHING per bucket, in proportion to raw, to the target counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            is_good = np.array(batch.column(1).to_pylist(), dtype=bool)
            for lo, hi, words in chunks(batch.column(0), _CLASSES):
                bucket, doc = features(words, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[is_good[lo:hi][doc]], minlength=buckets)
        kept = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(raw[kept]), pa.array(target[kept])], names=["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(good), F.col("id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("good"))
    found = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(buckets), np.zeros(buckets)
    for r in found:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] = r["target"]
    raw /= raw.sum()
    target += raw * buckets * SMOOTHING
    return np.log(target / target.sum()) - np.log(raw)


def _scores(batch_texts: pa.Array, noise: np.ndarray, table: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    ratio = np.zeros(len(batch_texts))
    for lo, hi, words in chunks(batch_texts, _CLASSES):
        bucket, doc = features(words, len(table))
        ratio[lo:hi] = np.bincount(doc, weights=table[bucket], minlength=hi - lo)
    u = ((noise.view(np.uint64) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
    return ratio, ratio / temperature - np.log(-np.log(u))


def sort_key(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a column `key` of longs, exactly, by 16 bits a pass; the driver gets at most 65,536 counts a pass."""
    if k <= 0:
        return None
    prefix, shift = 0, 48
    rest = keys.select((F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).alias("u"))
    while shift >= 0:
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        counts = {r["d"]: r["n"] for r in rest.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if k <= counts[d]:
                break
            k -= counts[d]
        else:
            return None
        prefix = prefix << 16 | d
        rest = rest.where(digit == d)
        shift -= 16
    return prefix - (1 << 63)


def best_cut(scored: list[tuple[float, int]]) -> float:
    """The log ratio from which documents count as fit: the middle of the gap that separates labelled good from bad ones with the least sum of both error rates."""
    good = sum(1 for _, q in scored if q)
    bad = len(scored) - good
    if not good or not bad:
        return -np.inf if good or not scored else np.inf
    scored = sorted(scored)
    best, cut, kept_bad, lost_good = 1.0, scored[0][0] - 1.0, bad, 0
    for i, (ratio, q) in enumerate(scored):
        lost_good += q
        kept_bad -= not q
        if i + 1 < len(scored) and scored[i + 1][0] == ratio:
            continue
        error = kept_bad / bad + lost_good / good
        if error < best:
            best, cut = error, ratio if i + 1 == len(scored) else (ratio + scored[i + 1][0]) / 2
    return cut


class Resampler:
    """A fitted importance resampler: how to score a document and from which key on it is drawn."""

    def __init__(self, docs: DataFrame, labels: DataFrame, temperature: float = 0.25, seed: int = 0, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text"):
        """docs and labels (doc_id, quality 0 or 1). The number drawn, k, is that of documents whose ratio is at
        least best_cut's; which k those are is drawn by Gumbel top-k of ratio / temperature.
        """
        bounded_batches(docs.sparkSession)
        spark = docs.sparkSession
        self.temperature, self.seed, self.id_col, self.text_col = temperature, seed, id_col, text_col
        sample = fit_sample(labels, fit_rows)
        kind = docs.schema[id_col].dataType.simpleString()
        good = spark.createDataFrame([(i,) for i, q in sample if q], f"_id {kind}")
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.table = fit(rows, good, buckets)
        self.scored = stored(self._score(docs), "resample-scores")
        chosen = spark.createDataFrame(sample, f"_id {kind}, quality int")
        on_labels = self.scored.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("log_ratio", "quality").collect()
        self.cut = float(best_cut([(r["log_ratio"], int(r["quality"] > 0)) for r in on_labels]))
        self.k = self.scored.where(F.col("log_ratio") >= self.cut).count()
        self.least = kth_largest(self.scored, self.k)

    def _score(self, docs: DataFrame) -> DataFrame:
        table = docs.sparkSession.sparkContext.broadcast(self.table)
        temperature = self.temperature

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ratio, score = _scores(batch.column(1), batch.column(2).to_numpy(), table.value, temperature)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio), pa.array(sort_key(score)), pa.array(score)], names=["doc_id", "log_ratio", "key", "score"])

        kind = docs.schema[self.id_col].dataType.simpleString()
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text"), F.xxhash64(F.col(self.id_col), F.lit(self.seed)).alias("noise"))
        return rows.mapInArrow(run, f"doc_id {kind}, log_ratio double, key long, score double")

    def kept(self) -> DataFrame:
        """doc_id, log_ratio, score (with Gumbel noise) and kept of every row."""
        least = F.lit(False) if self.least is None else F.col("key") >= F.lit(self.least)
        return self.scored.select("doc_id", "log_ratio", "score", least.alias("kept"))

    def filtered(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are drawn, with all columns. Texts are scored again rather than shuffled."""
        if self.least is None:
            return docs.limit(0)
        table, temperature, least = docs.sparkSession.sparkContext.broadcast(self.table), self.temperature, self.least
        columns = docs.columns
        at = columns.index(self.text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, score = _scores(batch.column(at), batch.column(len(columns)).to_numpy(), table.value, temperature)
                yield batch.select(columns).filter(pa.array(sort_key(score) >= least))

        return docs.withColumn("_noise", F.xxhash64(F.col(self.id_col), F.lit(self.seed))).mapInArrow(run, docs.schema)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log ratio and whether it is drawn.

    A null or empty text has no n-gram and a log ratio of 0. Rows of one id and text share their
    noise and so their fate; rows tied with the last drawn are drawn too.
    """
    return Resampler(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).kept()
