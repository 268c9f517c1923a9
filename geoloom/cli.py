"""python -m geoloom.cli --pbf FILE [--search IN OUT | --reverse IN OUT | --serve [--port N] [--max-requests N] | --inspect]"""

from __future__ import annotations

import argparse
import resource
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoloom.functions.text import best_name, has_address, has_key, printable, tag
from geoloom.operators import profile
from geoloom.server import serve
from geoloom.sources import osmpbf, textfiles


def _port(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 65535:
        raise argparse.ArgumentTypeError("a port is 1 to 65535")
    return n


def options(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="geoloom", description=__doc__)
    parser.add_argument("--pbf", required=True)
    mode = parser.add_mutually_exclusive_group()
    mode.add_argument("--search", nargs=2, metavar=("IN", "OUT"))
    mode.add_argument("--reverse", nargs=2, metavar=("IN", "OUT"))
    mode.add_argument("--serve", action="store_true")
    mode.add_argument("--inspect", action="store_true")
    parser.add_argument("--port", type=_port, default=8080)
    parser.add_argument("--max-requests", type=int)
    parser.add_argument("--samples", type=int, default=3)
    return parser.parse_args(argv)


def usage() -> dict[str, float]:
    """CPU seconds and peak memory (MiB) of this process, the driver; executors have their own."""
    own = resource.getrusage(resource.RUSAGE_SELF)
    return {"cpu_seconds": round(own.ru_utime + own.ru_stime, 3), "peak_memory_mib": round(own.ru_maxrss / 1024, 3)}


def inspect(spark: SparkSession, pbf: str, sample_limit: int = 3) -> None:
    began = time.perf_counter()
    nodes, ways, relations = osmpbf.read(spark, pbf)
    for part in (profile.node_counts(nodes), profile.way_counts(ways), profile.relation_counts(relations), profile.buildings_lacking(nodes, ways, relations)):
        for name, value in part.first().asDict().items():
            print(f"{name}: {value}")
    for title, df, key, n in (("building", ways, "building", 12), ("highway", ways, "highway", 12), ("admin_level", relations.where(F.col("tags")["boundary"] == "administrative"), "admin_level", 20)):
        print(f"{title}:")
        values = df.where(F.map_contains_key("tags", key)).select(tag(key).alias("v"))
        shown = profile.top_values(values, "v", n).collect()
        for r in shown:
            print(f"  {r['value']}: {r['cnt']}")
        more = profile.distinct_values(values, "v").first()["n"] - len(shown)
        if more > 0:
            print(f"  ... {more} more values")
    admin = F.coalesce(tag("boundary") == "administrative", F.lit(False))
    name = printable(best_name())
    for title, df, kind, condition, told in (
        ("node samples", nodes, 0, has_key("building") | has_address(), name), ("building samples", ways, 1, has_key("building"), F.concat(name, F.lit(", building="), printable(tag("building")))),
        ("street samples", ways, 1, has_key("highway"), F.concat(name, F.lit(", highway="), printable(tag("highway")))),
        ("area samples", relations, 2, admin, F.concat(name, F.lit(", admin_level="), printable(tag("admin_level")))),
    ):
        print(f"{title}:")
        rows = profile.first_objects(df, kind, condition, told, sample_limit).collect()
        for r in rows:
            print(f"  {r['typed_id']}: {r['description']}")
        if not rows:
            print("  <none found>")
    for key, value in {"wall_seconds": round(time.perf_counter() - began, 3), **usage()}.items():
        print(f"{key}: {value}")


def main(argv: list[str] | None = None) -> int:
    from geoloom.engine import Engine

    try:
        args = options(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        if args.inspect:
            inspect(spark, args.pbf, args.samples)
            return 0
        job = args.search or args.reverse
        if job:
            textfiles.check_paths(*job, args.pbf)
            if args.reverse:
                queries = textfiles.coordinates(spark, job[0])  # before any output is opened
        began = time.perf_counter()
        engine = Engine.load(spark, args.pbf)
        report = {**engine.stats.first().asDict(), "memberships": engine.membership_count(), "wall_seconds": round(time.perf_counter() - began, 3), **usage()}
        for name, value in report.items():
            print(f"{name}: {value}")
        if args.search:
            textfiles.write_lines(engine.search_lines(textfiles.numbered_lines(spark, job[0]).withColumnRenamed("value", "query")), "line", "ids", job[1])
        elif args.reverse:
            textfiles.write_lines(engine.nearest_lines(queries), "query_id", "ids", job[1])
        elif args.serve:
            serve(engine, args.port, args.max_requests)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"geoloom: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
