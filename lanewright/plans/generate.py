"""The map pipeline: road graph, lanes, connectors and polygons, export; and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions.geom import length
from lanewright.operators import export, graph, lanes, overlay, polyline
from lanewright.plans.config import CONNECTIONS, GRAPHS, SEGMENTATIONS, MapConfig
from lanewright.sources.store import stored


@GRAPHS.add("edges")
def graph_from_edges(nodes: DataFrame, edges: DataFrame, config: MapConfig) -> DataFrame:
    """Every edge is a lane."""
    return lanes.lanes_from_edges(edges, nodes)


@GRAPHS.add("contracted")
def graph_from_chains(nodes: DataFrame, edges: DataFrame, config: MapConfig) -> DataFrame:
    """Chains between junctions are lanes, trimmed at both ends; numbered by their nodes within ranges of start nodes."""
    roads = stored(graph.contract(edges)).withColumn("range", F.shiftright("road_from", 16))
    counts = roads.groupBy("range").agg(F.count(F.lit(1)).alias("k"))
    # One row for each 65,536 ids.
    before = F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("nodes")) - 1
    roads = stored(roads.join(counts.select("range", before.alias("skip")), "range").withColumn("lane_id", F.col("skip") + place).drop("range", "skip"))
    v = roads.select("lane_id", "road_from", "road_to", F.posexplode("nodes").alias("pos", "id")).join(nodes.select("id", "x", "y"), "id")
    pts = polyline.as_arrays(polyline.trim(v.select(F.col("lane_id").alias("line_id"), "pos", "x", "y"), config.trim_distance, config.max_part_trim))
    return roads.join(pts, F.col("lane_id") == F.col("line_id")).select("lane_id", F.col("road_from").alias("from_node"), F.col("road_to").alias("to_node"), F.col("lane_id").alias("lane_group"), "pts")


@SEGMENTATIONS.add("graph")
def lanes_by_width(lane_rows: DataFrame, config: MapConfig) -> DataFrame:
    """Boundaries at half the lane width on both sides of the centre line, simplified by the configured tolerance."""
    points = lane_rows.select(F.col("lane_id").alias("line_id"), F.posexplode("pts").alias("pos", "p")).select("line_id", "pos", "p.x", "p.y")
    side = lambda d, name: polyline.as_arrays(polyline.boundary(points, d, config.boundary_tolerance)).select(F.col("line_id").alias(f"{name}_id"), F.col("pts").alias(name))
    left, right = side(config.lane_width / 2, "boundary_left"), side(-config.lane_width / 2, "boundary_right")
    j = lane_rows.join(left, F.col("lane_id") == F.col("boundary_left_id")).join(right, F.col("lane_id") == F.col("boundary_right_id"))
    return j.drop("boundary_left_id", "boundary_right_id").withColumn("width", F.lit(config.lane_width)).withColumn("length", length(F.col("pts")))


@CONNECTIONS.add("hulls")
def connect(lane_rows: DataFrame, config: MapConfig) -> dict[str, DataFrame]:
    """Links, connectors and intersection polygons."""
    links = graph.connections(lane_rows, config.rtol, config.atol)
    conns = lanes.connectors(lane_rows, links)
    return {"links": links, "connectors": conns, "polygons": lanes.intersection_polygons(conns).filter("ring is not null")}


def generate_map(nodes: DataFrame, edges: DataFrame, config: MapConfig = MapConfig()) -> dict[str, DataFrame]:
    """lanes, links, connectors and polygons of a road graph (nodes: id, x, y; edges: edge_id, src, dst)."""
    rows = SEGMENTATIONS.get(config.segmentation)(GRAPHS.get(config.graph)(nodes, edges, config), config)
    return {"lanes": rows} | CONNECTIONS.get(config.connection)(rows, config)


def map_tables(made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The normalised map's tables from ``generate_map``'s result; those without rows of their own are empty."""
    ls = made["lanes"].withColumn("ring", lanes.lane_polygon(F.col("boundary_left"), F.col("boundary_right")))
    conns, polys = made["connectors"].withColumn("ring", F.col("polygon")), made["polygons"].withColumnRenamed("intersection_id", "element_id").withColumn("type", F.lit("intersection"))
    rings = ls.select("ring").union(conns.select("ring")).union(polys.select("ring"))
    polygons = export.map_polygons(ls, "lane", "lane_id").union(export.map_polygons(conns, "connector", "connector_id")).union(export.map_polygons(polys, "area", "element_id"))
    connector_rows = conns.select(export.token("connector", F.col("connector_id")).alias("token"), export.token("connector_polygon", F.col("connector_id")).alias("polygon_token"))
    tables = {"node": export.map_nodes(rings), "line": export.map_lines(made["lanes"]), "polygon": polygons, "lane": export.map_lanes(made["lanes"]), "lane_connector": connector_rows, "connectivity": export.connectivity(made["connectors"]), "canvas_edge": export.canvas(rings), "arcline_path_3": export.map_arclines(made["lanes"], made["connectors"])}
    empty = tables["lane"].select("token").limit(0)
    return tables | export.map_areas(polys) | {name: empty for name in export.EMPTY_TABLES}


def lane_rings(lane_rows: DataFrame) -> DataFrame:
    return lane_rows.select(lanes.lane_polygon(F.col("boundary_left"), F.col("boundary_right")).alias("ring"))


def evaluate(truth: DataFrame, prediction: DataFrame, config: MapConfig = MapConfig()) -> DataFrame:
    """Coverage metrics of two tables of rings, the mask being the truth grown by the buffer with round joins."""
    return overlay.coverage_metrics(truth, prediction, overlay.buffered(truth, config.buffer), config.cell)


def sections(points: DataFrame, config: MapConfig = MapConfig()) -> DataFrame:
    """Lines cut into sections of at most ``max_section``, numbered within each line."""
    s = polyline.split(points, config.max_section)
    last = Window.partitionBy("line_id")
    return s.withColumn("n_parts", F.max("part").over(last) + 1)
