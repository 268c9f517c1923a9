"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: Links that the driver joins by itself, at most; more take rounds over the executors.
FEW_LINKS = 100_000
#: A bound on rounds, far beyond the logarithm of any table's size; reaching it is an error, not a result.
ROUNDS = 200


def _joined(links: pa.Table) -> tuple[list, list]:
    """The nodes of links (a, b) and the least node of each one's component."""
    over: dict = {}

    def top(node):
        while (up := over.setdefault(node, node)) != node:
            over[node] = node = over[up]
        return node

    for a, b in zip(*(c.to_pylist() for c in links.columns), strict=True):
        a, b = top(a), top(b)
        over[max(a, b)] = min(a, b)
    return list(over), [top(node) for node in over]


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, component) for every node of a link; component is the least node that can be reached.

    Up to FEW_LINKS links are joined in the driver. Of more, each round, a node takes the least label among its own and its neighbours', then its label's
    label; labels only fall, and when none fell, all of a component's are its least node. Tables are
    joined by shuffles, which Spark splits where one node has most links, and each round's labels
    are written, so lineage stays short; nothing is collected but the number of changes.
    """
    once = stored(links.select("a", "b").where("a <> b"), "links")
    if once.count() <= FEW_LINKS:
        few = once.toArrow()
        kind = few.schema.field("a").type
        labels = pa.table({name: pa.array(of, kind) for name, of in zip(("node", "component"), _joined(few), strict=True)})
        discard(once)
        return stored(links.sparkSession.createDataFrame(labels), "labels")
    both = stored(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    discard(once)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component"), F.lit(True).alias("changed")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        parents = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        fresh = stored(hooked.join(parents, "component").select("node", F.least("component", "further").alias("component"), (F.least("component", "further") < F.col("was")).alias("changed")), "labels")
        moved = fresh.where("changed").count()
        discard(labels)
        labels = fresh
        if not moved:
            discard(both)
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
