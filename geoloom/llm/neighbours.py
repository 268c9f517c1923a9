"""Near duplicates among vectors: spherical-cap filters from random product codes, joined on filters and verified."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import stored

#: Independent codes, each after a rotation of its own: so many at least, and as many as RECALL takes.
CODES, MOST_CODES = 3, 256
#: Of SAMPLED random pairs whose cosine is just the threshold, so many meet in a filter.
RECALL, SAMPLED = 0.97, 300
#: Filters of a code that a vector exceeds, about.
LISTED = 32


@lru_cache(16)
def _code(dim: int, size: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation, and `size` random directions for each half of the coordinates; a filter is a pair of them, of length 1 together."""
    rng = np.random.Generator(np.random.PCG64([dim, size, code]))
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    halves = []
    for d in (dim - dim // 2, dim // 2):
        c = rng.normal(size=(size, d))
        halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / math.sqrt(2))
    return rotation, halves[0], halves[1]


def code_size(n: int) -> int:
    """Directions per half: their square, the number of filters, is four times that of vectors, so the vectors in a filter do not grow."""
    return max(8, math.ceil(2 * math.sqrt(n)))


@lru_cache(64)
def cap_height(dim: int, share: float) -> float:
    """The height that a random unit vector's product with a fixed one exceeds with probability share (at most a half).

    A filter has length 1, so this holds for product codes as for any. The angle from the equator
    has density cos(angle) ** (dim - 2), summed here from the pole down.
    """
    angle = np.linspace(0.0, math.pi / 2, 200_001)
    tail = np.cumsum((np.cos(angle) ** (dim - 2))[::-1])[::-1]
    return math.sin(angle[np.flatnonzero(tail >= 2 * share * tail[0])[-1]])


def codes_needed(dim: int, size: int, least: float, listed: float = LISTED) -> int:
    """The least number of codes, from CODES, by which RECALL of SAMPLED random pairs at cosine `least` share a filter."""
    rng = np.random.Generator(np.random.PCG64([dim, size]))
    x, y = unit(rng.normal(size=(SAMPLED, dim))), rng.normal(size=(SAMPLED, dim))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    y = least * x + math.sqrt(max(0.0, 1 - least**2)) * y
    met = np.zeros(SAMPLED, dtype=bool)
    for code in range(MOST_CODES):
        for (i, f), (_, g) in zip(decoded(x, size, range(code, code + 1), listed), decoded(y, size, range(code, code + 1), listed), strict=True):
            met[i] |= bool(np.isin(f, g).any())
        if code + 1 >= CODES and met.mean() >= RECALL:
            return code + 1
    raise ValueError(f"{MOST_CODES} codes do not find {RECALL} of the pairs at cosine {least} in {dim} dimensions; say how many codes to take, or list more filters")


def decoded(x: np.ndarray, size: int, codes: Iterable[int] = range(CODES), listed: float = LISTED) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit vector (row of x) the numbers of all filters that its product with them exceeds the cap's height.

    The height is such that random vectors exceed `listed` of the size * size filters of a code. Of
    the sums of two half products only those are formed that can reach it.
    """
    n, dim = x.shape
    share = min(0.5, listed / size**2)
    height = cap_height(dim, share)
    for code in codes:
        rotation, first, second = _code(dim, size, code)
        y = x @ rotation.T
        a, b = y[:, : dim - dim // 2] @ first.T, y[:, dim - dim // 2 :] @ second.T
        top_a, top_b = a.max(axis=1), b.max(axis=1)
        for i in range(n):
            rows = np.flatnonzero(a[i] + top_b[i] >= height)
            columns = np.flatnonzero(b[i] + top_a[i] >= height)
            hit = a[i][rows][:, None] + b[i][columns][None, :] >= height
            at_row, at_column = np.nonzero(hit)
            yield i, (code * size + rows[at_row]).astype(np.int64) * size + columns[at_column]


def around(x: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit vector of few dimensions the cells of its first coordinates, at most three, that it is in or next to; vectors of a cosine of `least` or more share one."""
    width = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    at = np.floor((x[:, :3] + 1) / width).astype(np.int64) + 1
    near = np.array(np.meshgrid(*[[-1, 0, 1]] * at.shape[1], indexing="ij")).reshape(at.shape[1], -1).T
    side = math.ceil(2 / width) + 4
    for i in range(len(x)):
        yield i, (at[i] + near) @ side ** np.arange(at.shape[1], dtype=np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", codes: int | None = None, listed: float = LISTED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; rows link when labels are equal and the cosine is at least `least`.

    Rows without label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; so do vectors of different length. Equal vectors of one label are
    one class, told by a hash of 64 bits, and link with each other; classes are compared by their
    caps. Links of fewer than 8 dimensions are all found, by cells of up to three coordinates. Of
    others the caps find about RECALL or more whatever the number of
    rows: unless codes is given, as many codes are taken as that needs, by a sample of pairs at
    `least` for each length of vectors. Every link found is verified in double precision, so none
    below is returned. Repeated rows are rows of their own, and so are rows
    that share an id. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = stored(rows.where("usable").groupBy("label", "v").agg(F.count("*").alias("copies")).withColumn("rep", F.xxhash64("label", "v")), "vector-classes")
    size = code_size(classes.count())
    lengths = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    taken = {d: codes or codes_needed(d, size, least, listed) for d in lengths if d >= 8}

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(1)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = batch.take(pa.array(at))
                x = unit(_matrix(own.column(1)))
                for lo in range(0, len(x), 1024):
                    owner, found = [], []
                    for i, f in decoded(x[lo : lo + 1024], size, range(taken[dim]), listed) if dim >= 8 else around(x[lo : lo + 1024], least):
                        owner.append(np.full(len(f), lo + i))
                        found.append(f)
                    owners = own.take(pa.array(np.concatenate(owner)))
                    yield pa.RecordBatch.from_arrays([owners.column(0), pa.array(np.full(len(owners), dim, dtype=np.int32)), pa.array(np.concatenate(found)), owners.column(2)], names=["label", "dim", "cap", "rep"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    caps = stored(classes.select("label", "v", "rep").repartition("rep").mapInArrow(filters, f"label {kinds['label']}, dim int, cap long, rep {kinds['rep']}"), "caps")
    other = caps.withColumnRenamed("rep", "b")
    met = caps.withColumnRenamed("rep", "a").join(other, ["label", "dim", "cap"]).where("a < b").select("a", "b").distinct()
    side = classes.select("rep", "v", "copies")
    pairs = met.join(side.select(F.col("rep").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na")), "a").join(side.select(F.col("rep").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(1)])
            keep = np.zeros(len(dims), dtype=bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 4096):
                    part = pa.array(at[lo : lo + 4096])
                    x, y = unit(_matrix(batch.column(1).take(part))), unit(_matrix(batch.column(2).take(part)))
                    keep[at[lo : lo + 4096]] = (x * y).sum(axis=1) >= least
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    checked = pairs.select("a", "va", "vb", "b", "na", "nb").mapInArrow(verify, f"a {kinds['rep']}, b {kinds['rep']}, na long, nb long")
    links = stored(checked, "vector-links")
    degree = links.select(F.col("a").alias("rep"), F.col("nb").alias("n")).unionAll(links.select("b", "na")).groupBy("rep").agg(F.sum("n").alias("n"))
    group = components(links.select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = classes.join(degree, "rep", "left").join(group, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    good = stored(rows.where("usable").select("vec_id", F.xxhash64("label", "v").alias("rep")).join(known, "rep").select("vec_id", "n_links", "component"), "vector-components")
    good = good.join(good.groupBy("component").agg(F.min("vec_id").alias("component_id")), "component").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among vectors of its label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
