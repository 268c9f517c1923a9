"""Text files of queries in, text files of answers out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions.text import strict_double


def check_paths(source: str, target: str, data: str | None = None) -> None:
    """Refuses a missing source, and a target that is the source or the data under any name."""
    if not os.path.isfile(source):
        raise ValueError(f"no such input: {source}")
    for other in (source, data):
        if other is None:
            continue
        if os.path.abspath(other) == os.path.abspath(target) or (os.path.exists(target) and os.path.exists(other) and os.path.samefile(other, target)):
            raise ValueError(f"output would overwrite {other}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines from 0 without their carriage return. The file is a person's list of queries and is read by the driver, in order."""
    with open(path, encoding="utf-8", newline="\n") as f:
        text = f.read()
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return spark.createDataFrame([(i, s.removesuffix("\r")) for i, s in enumerate(lines)], "line int, value string")


def parsed_coordinates(lines: DataFrame) -> DataFrame:
    """Adds ok, lat_e7 and lon_e7: two numbers separated by white space, within 90 and 180 degrees."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    lat, lon = (F.when(F.size(parts) == 2, strict_double(F.get(parts, i))) for i in (0, 1))
    ok = F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))
    out = lines.withColumn("ok", ok)
    return out.withColumn("lat_e7", F.when(ok, geo.degrees_to_e7(lat))).withColumn("lon_e7", F.when(ok, geo.degrees_to_e7(lon)))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, lat_e7, lon_e7) of a file of `lat lon` lines; the first bad line is an error."""
    found = parsed_coordinates(numbered_lines(spark, path))
    bad = found.where(~F.col("ok")).agg(F.min("line")).first()[0]
    if bad is not None:
        raise ValueError(f"{path}: line {bad + 1} is no coordinate")
    return found.select(F.col("line").cast("long").alias("query_id"), F.col("lat_e7").cast("long").alias("lat_e7"), F.col("lon_e7").cast("long").alias("lon_e7"))


def write_lines(answers: DataFrame, order: str, text: str, path: str) -> None:
    """One answer a line, in order, empty ones too."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{r[text] or ''}\n" for r in answers.select(order, text).orderBy(order).toLocalIterator())
