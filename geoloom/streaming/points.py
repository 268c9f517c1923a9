"""Query points that arrive as a stream, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from geoloom.operators.nearest import knn_buildings
from geoloom.operators.regions import regions_at


def answer_stream(points: DataFrame, buildings: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10) -> StreamingQuery:
    """Hands the k nearest buildings of each micro-batch of points (query_id, lat_e7, lon_e7) to sink(df, batch_id)."""
    return points.writeStream.foreachBatch(lambda batch, i: sink(knn_buildings(batch, buildings, k), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regions_stream(points: DataFrame, area_vertices: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the regions of each micro-batch of points to sink(df, batch_id)."""
    return points.writeStream.foreachBatch(lambda batch, i: sink(regions_at(batch, area_vertices, ["query_id"]), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
