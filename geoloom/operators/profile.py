"""One-pass profiles of raw nodes, ways and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.text import best_name, has_address, has_key, printable, tag, typed_id


def _count(condition) -> F.Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def node_counts(nodes: DataFrame) -> DataFrame:
    b, a = has_key("building"), has_address()
    valid = F.col("lat_e7").between(-900000000, 900000000) & F.col("lon_e7").between(-1800000000, 1800000000)
    return nodes.agg(
        F.count("*").alias("nodes"), _count(~F.coalesce(valid, F.lit(False))).alias("invalid_nodes"), _count(a).alias("address_nodes"),
        _count(a & ~b).alias("address_only_nodes"), _count(b).alias("building_nodes"), _count(a & b).alias("building_address_nodes"),
    )


def way_counts(ways: DataFrame) -> DataFrame:
    b, s = has_key("building"), has_key("highway")
    admin = F.coalesce(tag("boundary") == "administrative", F.lit(False))
    refs = F.coalesce(F.size("node_refs"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(c, refs)), F.lit(0))
    return ways.agg(
        F.count("*").alias("ways"), _count(b).alias("building_ways"), _count(s).alias("street_ways"), _count(s & best_name().isNotNull()).alias("named_streets"),
        _count(s & best_name().isNull()).alias("unnamed_streets"), _count(admin).alias("admin_ways"), total(F.lit(True)).alias("way_refs"),
        total(b).alias("building_refs"), total(s).alias("street_refs"), total(admin).alias("admin_refs"),
    )


def relation_counts(relations: DataFrame) -> DataFrame:
    admin = F.coalesce(tag("boundary") == "administrative", F.lit(False))
    role = lambda test: F.coalesce(F.sum(F.size(F.filter("members", test))), F.lit(0))
    return relations.agg(
        F.count("*").alias("relations"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("members"), _count(has_key("building")).alias("building_relations"),
        _count(F.coalesce(tag("type") == "multipolygon", F.lit(False))).alias("multipolygons"), _count(admin).alias("admin_relations"), _count(admin & best_name().isNull()).alias("unnamed_admin"),
        role(lambda m: m["role"] == "outer").alias("outer_members"), role(lambda m: m["role"] == "inner").alias("inner_members"),
        role(lambda m: ~m["role"].isin("outer", "inner")).alias("other_members"),
    )


def buildings_lacking(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Buildings of all kinds without address and without name."""
    every = nodes.select("tags").unionByName(ways.select("tags")).unionByName(relations.select("tags")).where(has_key("building"))
    return every.agg(_count(~has_address()).alias("without_address"), _count(best_name().isNull()).alias("without_name"))


def top_values(df: DataFrame, value: str, n: int = 12) -> DataFrame:
    """(value, cnt): the n most frequent values, `<missing>` for empty ones; ties by value."""
    return df.groupBy(printable(F.col(value)).alias("value")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "value").limit(n)


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    """One row: how many values top_values would tell apart."""
    return df.agg(F.count_distinct(printable(F.col(value))).alias("n"))


def first_objects(objects: DataFrame, kind: int, condition: F.Column, description: F.Column, n: int = 3) -> DataFrame:
    """(typed_id, description) of the first n objects by id that meet a condition."""
    return objects.where(condition).select("id", typed_id(F.lit(kind), F.col("id")).alias("typed_id"), description.alias("description")).orderBy("id").limit(n).drop("id")


def samples(df: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """The first n rows of each group by key."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
