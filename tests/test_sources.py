import json

import numpy as np
from pyspark.sql import functions as F

from lanewright.functions import fixtures as fx
from lanewright.plans.config import MapConfig
from lanewright.plans.generate import generate_map, lane_rings, map_tables
from lanewright.sources import geojson, gpkg, hooks, raster, sinks, wkb
from lanewright.streaming import incremental


def test_geojson_round_trip(spark, sf, tmp_path):
    n, e = fx.nodes(spark, sf).select("id", "x", "y"), fx.edges(spark, sf)
    geojson.write_graph(n, e, str(tmp_path / "n.geojson"), str(tmp_path / "e.geojson"))
    n2, e2 = geojson.read_graph(spark, str(tmp_path / "n.geojson"), str(tmp_path / "e.geojson"))
    assert sorted(n2.collect()) == sorted(n.collect()) and sorted(e2.collect()) == sorted(e.collect())


def test_wkb_round_trip():
    for kind, c in (("Point", (1.0, 2.0)), ("LineString", [(0.0, 0.0), (1.0, 1.0)]), ("Polygon", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]])):
        assert wkb.parse(wkb.write(kind, c)) == (kind, c)


def test_gpkg_round_trip(spark, sf, tmp_path):
    made = generate_map(fx.nodes(spark, sf), fx.edges(spark, sf), MapConfig())
    rows = lane_rings(made["lanes"]).withColumnRenamed("ring", "geometry").withColumn("road_type", F.lit(1))
    gpkg.write_layer(rows, str(tmp_path / "lanes.gpkg"), "lanes")
    back = gpkg.polygons_only(gpkg.read_layer(spark, str(tmp_path / "lanes.gpkg")), "geom")
    assert back.count() == rows.count() and back.filter("road_type = 1 and size(ring) = 5").count() == rows.count()


def test_raster_round_trip(spark, tmp_path):
    v = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    (tmp_path / "a.tif").write_bytes(raster.encode(v, (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)))
    r = raster.read_rasters(spark, str(tmp_path)).first()
    assert (r.height, r.width, r.resolution, r.minx, r.maxy, r.miny) == (3, 4, 0.5, 100.0, 200.0, 198.5)
    assert raster.pixels(raster.read_rasters(spark, str(tmp_path))).filter("row = 2 and col = 3").first().value == 11.0


def test_map_json_and_metrics(spark, sf, tmp_path):
    tables = map_tables(generate_map(fx.nodes(spark, sf), fx.edges(spark, sf), MapConfig()))
    sinks.write_map_json(tables, str(tmp_path / "map.json"))
    m = json.loads((tmp_path / "map.json").read_text())
    nodes = {n["token"] for n in m["node"]}
    assert all(t in nodes for l in m["line"] for t in l["node_tokens"])  # noqa: E741
    assert {p for r in m["lane"] for p in [r["polygon_token"]]} <= {p["token"] for p in m["polygon"]} and m["traffic_light"] == []
    sinks.write_metrics(spark.createDataFrame([(1.0, 0.5)], "iou double, recall double"), str(tmp_path / "metrics.json"))
    assert json.loads((tmp_path / "metrics.json").read_text()) == {"iou": 1.0, "recall": 0.5}
    sinks.write_tables({"node": tables["node"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/node")).count() == len(nodes)


def test_only_missing_lanes_are_computed(spark, sf, tmp_path):
    schema, path = "lane_id long, value double, written long", str(tmp_path / "cache")
    seen = []

    def compute(df):
        seen.append(sorted(r.lane_id for r in df.collect()))
        return df.select("lane_id", F.col("lane_id").cast("double").alias("value"))

    wanted = spark.range(4).select(F.col("id").alias("lane_id"))
    incremental.compute_missing(wanted.filter("lane_id < 2"), path, schema, compute, 1)
    done = incremental.compute_missing(wanted, path, schema, compute, 2)
    assert seen == [[0, 1], [2, 3]] and done.count() == 4
    wanted.union(spark.range(4, 6)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lane_id long").parquet(str(tmp_path / "in"))
    incremental.run_stream(stream, path, schema, compute, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.lane_id for r in incremental.read_cache(spark, path, schema).collect()) == [0, 1, 2, 3, 4, 5]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema, path = "lane_id long, value double, written long", str(tmp_path / "cache")
    compute = lambda df: df.select("lane_id", F.col("lane_id").cast("double").alias("value"))
    wanted = spark.range(3).select(F.col("id").alias("lane_id"))
    first = incremental.compute_missing(wanted, path, schema, compute, 7).collect()
    spark.read.schema(schema).parquet(path).write.mode("append").parquet(str(tmp_path / "copy"))
    spark.read.schema(schema).parquet(str(tmp_path / "copy")).write.mode("append").parquet(path)  # the same batch written again
    assert sorted(incremental.read_cache(spark, path, schema).collect()) == sorted(first)


def test_map_files_round_trip(spark, sf, tmp_path):
    made = generate_map(fx.nodes(spark, sf), fx.edges(spark, sf), MapConfig())
    sinks.write_map_files(made, str(tmp_path / "map"))
    back = sinks.read_map_files(spark, str(tmp_path / "map"))
    lanes = {r.lane_id: r for r in made["lanes"].collect()}
    for r in back["lanes"].collect():
        assert r.boundary_right == lanes[r.lane_id].boundary_right and r.boundary_left == lanes[r.lane_id].boundary_left[::-1] and r.centerline == lanes[r.lane_id].pts and len(r.ring) == 5
    links = made["links"].filter("phase = 0").groupBy("lane_id").agg(F.sort_array(F.collect_list("other")).alias("o"))
    want = {r.lane_id: r.o for r in links.collect()}
    assert {r.lane_id: r.successors for r in back["lanes"].collect() if r.successors} == want
    conns = {r.connector_id: r for r in made["connectors"].collect()}
    got = back["connectors"].collect()
    assert len(got) == len(conns) and all(r.polygon == conns[r.connector_id].polygon and r.legal and len(r.line) == 2 for r in got)
    assert back["polygons"].count() == made["polygons"].count() and {r.type for r in back["polygons"].collect()} == {"intersection"}


def test_arclines_pass_through_the_vertices(spark, sf):
    made = generate_map(fx.nodes(spark, sf), fx.edges(spark, sf), MapConfig(graph="contracted"))
    rows = map_tables(made)["arcline_path_3"].collect()
    assert len(rows) == made["lanes"].count() + made["connectors"].count()
    for r in rows:
        assert r.k == 1 and len(r.t) == len(r.c) + 2 and r.t[0] == r.t[1] == 0.0 and r.t == sorted(r.t)


def test_providers(spark):
    regions = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 9.0)], "region long, west double")

    def features(region, west):
        if region == 2:
            raise RuntimeError("service gone")
        return [(region, west, k) for k in range(region)]

    got = hooks.fetched(regions, features, "region long, west double, k long", empty_on_failure=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0.0, 0), (3, 9.0, 0), (3, 9.0, 1), (3, 9.0, 2)]
    try:
        hooks.fetched(regions, features, "region long, west double, k long").collect()
        raise AssertionError("a failing road graph must end the job")
    except Exception as error:
        assert "service gone" in str(error)
    nodes, edges = hooks.graph_of_regions(regions.filter("region <> 2"), lambda region, west: [(region, 0, west, 0.0), (region, 1, west, 1.0)], lambda region, west: [(region, 0, 0, 1)])
    ids = {r.id for r in nodes.collect()}
    assert len(ids) == 4 and all({r.src, r.dst} <= ids for r in edges.collect())
