"""Name search: substrings of the names of buildings, streets and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.text import ascii_fold, typed_id


def name_search(queries: DataFrame, *sources: DataFrame) -> DataFrame:
    """(line, query, ids) for every query (line, query): typed ids of all objects (type_rank, id, name) whose name holds it, by type and id, joined by ", ".

    Queries are few; where they are checked to be, they are broadcast and names stream past them.
    A query without match, an empty one among them, has an empty list.
    """
    names = None
    for s in sources:
        part = s.select("type_rank", "id", "name").where("name is not null")
        names = part if names is None else names.unionByName(part)
    few = queries.limit(100_001).count() <= 100_000
    q = queries.where("query <> ''").select("line", ascii_fold(F.col("query")).alias("_query"))
    names = names.select("type_rank", "id", ascii_fold(F.col("name")).alias("_name"))  # once for each name, not for each pair
    hits = names.join(F.broadcast(q) if few else q, F.contains(F.col("_name"), F.col("_query"))).select("line", "type_rank", "id").distinct()
    joined = hits.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("type_rank", "id"))).alias("hits"))
    text = F.array_join(F.transform("hits", lambda h: typed_id(h["type_rank"], h["id"])), ", ")
    return queries.join(joined, "line", "left").select("line", "query", F.coalesce(text, F.lit("")).alias("ids"))
