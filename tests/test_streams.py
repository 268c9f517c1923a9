from geoloom.operators.nearest import knn_buildings
from geoloom.operators.regions import regions_at
from geoloom.sources import derived
from geoloom.streaming import points

SF = "/root/testdata/sf0.001"


def test_streams_answer_as_tables_do(spark, tmp_path):
    rows = derived.event_points(spark, SF).where("query_id <= 40")
    rows.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    buildings, (_, corners) = derived.buildings(spark, SF), derived.areas(spark, SF)
    got: dict[str, list] = {"near": [], "regions": []}
    points.answer_stream(arriving, buildings, lambda df, i: got["near"].extend(map(tuple, df.collect())), str(tmp_path / "a"), 3).awaitTermination()
    points.regions_stream(arriving, corners, lambda df, i: got["regions"].extend(map(tuple, df.collect())), str(tmp_path / "b")).awaitTermination()
    assert sorted(got["near"]) == sorted(map(tuple, knn_buildings(rows, buildings, 3).collect())) and got["near"]
    assert sorted(got["regions"]) == sorted(map(tuple, regions_at(rows, corners, ["query_id"]).collect())) and got["regions"]
