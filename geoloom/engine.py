"""A loaded dataset: extracted once, cached, and asked for places, views and names."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.functions import text as tx
from geoloom.operators import describe, extract, nearest, regions, search, viewport
from geoloom.operators.viewport import Box
from geoloom.plans.settle import settled
from geoloom.sources import osmpbf
from geoloom.sources.derived import Tables


@dataclass
class Engine:
    spark: SparkSession
    tables: Tables
    stats: DataFrame
    memberships: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, pbf: str) -> Engine:
        """Extracts a PBF file and assigns regions; the tables are written, so a lost executor costs no second extraction."""
        found = extract.extract(*osmpbf.read(spark, pbf))
        buildings, streets, areas = settled(found.buildings), settled(found.streets), settled(found.areas)
        tables = Tables(buildings, streets.select("id", "name", "highway_class"), extract.street_vertices(streets), areas.drop("rings"), extract.area_vertices(areas))
        members = regions.memberships(tables.buildings, tables.street_vertices, tables.area_vertices)
        return cls(spark, tables, settled(extract.extraction_stats(buildings, streets, areas, found.report)), settled(members))

    def membership_count(self) -> int:
        """Assignments of objects to areas."""
        return self.memberships.count()

    def point(self, lat: float, lon: float) -> DataFrame:
        return self.spark.createDataFrame([(0, lat, lon)], "query_id long, lat double, lon double").select("query_id", geo.degrees_to_e7(F.col("lat")).cast("long").alias("lat_e7"), geo.degrees_to_e7(F.col("lon")).cast("long").alias("lon_e7"))

    def nearest_lines(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, ids): typed ids of the nearest buildings, joined by ", "."""
        found = nearest.knn_buildings(queries, self.tables.buildings, k)
        hits = F.sort_array(F.collect_list(F.struct("rank", tx.typed_id(F.col("type_rank"), F.col("id")).alias("t"))))
        text = found.groupBy("query_id").agg(F.array_join(F.transform(hits, lambda h: h["t"]), ", ").alias("ids"))
        return queries.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("ids", F.lit("")).alias("ids"))

    def search_lines(self, queries: DataFrame) -> DataFrame:
        t = self.tables
        return search.name_search(queries, t.buildings, t.streets.withColumn("type_rank", F.lit(1)), t.areas)

    def _described(self, hits: DataFrame) -> list[dict]:
        rows = describe.hit_addresses(hits, self.tables)
        own = self.tables.buildings.select(F.lit("building").alias("kind"), "type_rank", "id", "name").unionByName(
            self.tables.streets.select(F.lit("street").alias("kind"), F.lit(1).alias("type_rank"), "id", "name")
        ).unionByName(self.tables.areas.select(F.lit("area").alias("kind"), "type_rank", "id", "name"))
        stored = describe.building_regions(self.memberships.select("kind", F.col("obj_type").alias("t"), F.col("obj_id").alias("i"), *regions.AREA).select(F.concat_ws("/", "kind", "t").alias("obj_type"), F.col("i").alias("obj_id"), *regions.AREA), self.tables.areas)
        rows = rows.join(own, ["kind", "type_rank", "id"], "left").withColumn("obj_type", F.concat_ws("/", "kind", F.col("type_rank").cast("string"))).join(stored.withColumnRenamed("obj_id", "id"), ["obj_type", "id"], "left")
        lines = describe.line_geojson(self.tables.street_vertices, ["id"]).select(F.lit("street").alias("kind"), F.lit(1).alias("type_rank"), "id", "geometry")
        shapes = lines.unionByName(describe.area_geojson(self.tables.area_vertices).withColumn("kind", F.lit("area")))
        rows = rows.join(shapes, ["kind", "type_rank", "id"], "left").orderBy("place")
        out = []
        for r in rows.collect():  # one request's hits
            text = {k: r[k] or "" for k in ("name", "street", "house_number", "postcode", "city", "state", "country", "full_address")}
            lat, lon = r["lat_e7"] / 1e7, r["lon_e7"] / 1e7
            out.append({
                "id": f"{tx.TYPES[r['type_rank']]}/{r['id']}", "kind": r["kind"], "distance_m": r["distance_m"], "lat": lat, "lon": lon, **text, "address_complete": r["address_complete"],
                "regions": [{"id": g["id"], "name": g["name"] or "", "admin_level": g["admin_level"], "postcode": g["postcode"] or ""} for g in r["regions"] or []],
                "geometry": json.loads(r["geometry"]) if r["geometry"] else {"type": "Point", "coordinates": [round(lon, 7), round(lat, 7)]},
            })
        return out

    def reverse_json(self, lat: float, lon: float) -> dict:
        """nearest (or null), results, the ten nearest buildings and the covering regions of a point."""
        q = self.point(lat, lon)
        results = self._described(nearest.reverse(q, self.tables))
        near = nearest.knn_buildings(q, self.tables.buildings).join(self.tables.buildings.select("type_rank", "id", "lat_e7", "lon_e7"), ["type_rank", "id"])
        buildings = self._described(near.select("query_id", F.col("rank").alias("place"), F.lit("building").alias("kind"), "type_rank", "id", "distance_m", "lat_e7", "lon_e7"))
        over = regions.regions_at(q, self.tables.area_vertices, ["query_id"]).select(F.lit(0).alias("obj_type"), F.col("query_id").alias("obj_id"), *regions.AREA)
        found = describe.building_regions(over, self.tables.areas).collect()
        covering = [{"id": g["id"], "name": g["name"] or "", "admin_level": g["admin_level"], "postcode": g["postcode"] or ""} for r in found for g in r["regions"]]
        return {"nearest": results[0] if results else None, "results": results, "buildings": buildings, "regions": covering}

    def houses_json(self, box: Box, zoom: int, limit: int, stride: int) -> dict:
        rows = [] if zoom < viewport.MIN_HOUSE_ZOOM else viewport.houses(self.tables.buildings, box, limit + 1, stride).collect()
        shown = rows[:limit]
        own = {}
        if shown:
            keys = self.spark.createDataFrame([(r["type_rank"], r["id"]) for r in shown], "obj_type int, obj_id long")
            some = self.memberships.where("kind = 'building'").select("obj_type", "obj_id", *regions.AREA).join(F.broadcast(keys), ["obj_type", "obj_id"])  # at most limit rows
            own = {(r["obj_type"], r["obj_id"]): [{"id": g["id"], "name": g["name"] or "", "admin_level": g["admin_level"], "postcode": g["postcode"] or ""} for g in r["regions"]] for r in describe.building_regions(some, self.tables.areas).collect()}
        houses = [{
            "id": f"{tx.TYPES[r['type_rank']]}/{r['id']}", "lat": r["lat_e7"] / 1e7, "lon": r["lon_e7"] / 1e7, "name": r["name"], "building": r["building_type"], "street": r["street"],
            "house_number": r["house_number"], "postcode": r["postcode"], "city": r["city"], "regions": own.get((r["type_rank"], r["id"]), []),
        } for r in shown]
        over = len(rows) > limit
        return {"matched": len(rows), "returned": len(shown), "threshold": limit, "sampled": stride > 1, "threshold_reached": over, "matched_exact": not over and stride == 1, "houses": houses}

    def geometry_json(self, box: Box, kind: str, zoom: int) -> dict:
        """A FeatureCollection of streets or regions in view, simplified to the zoom."""
        if kind == "streets":
            found = viewport.streets(self.tables.street_vertices, box, zoom)
            lines = describe.simplified(self.tables.street_vertices.join(found, "id", "left_semi"), ["id"], zoom)
            rows = describe.line_geojson(lines, ["id"]).join(self.tables.streets, "id").withColumn("type_rank", F.lit(1)).orderBy("id")
            made = describe.features(rows, ["name"])
        else:
            found = viewport.regions(self.tables.areas, self.tables.area_vertices, box, zoom)
            rings = self.tables.area_vertices.join(found.select("type_rank", "id"), ["type_rank", "id"], "left_semi")
            made = describe.features(describe.area_geojson(describe.simplified(rings, ["type_rank", "id", "component", "ring", "is_inner"], zoom, ring=True)).join(found, ["type_rank", "id"]).orderBy(F.when(F.col("admin_level") < 0, 100).otherwise(F.col("admin_level")), "area_ord"), ["name", "admin_level"])
        return {"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in made.collect()]}  # at most the zoom's limit
