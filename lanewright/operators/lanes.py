"""From roads to lanes, connectors and intersection polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions.geom import length, point
from lanewright.operators.graph import connections
from lanewright.operators.polyline import hulls


def lanes_from_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lane_id, from_node, to_node, lane_group, pts) for two-point edges."""
    at = lambda end: nodes.select(F.col("id").alias(end), point(F.col("x"), F.col("y")).alias(f"{end}_p"))
    e = edges.join(at("src"), "src").join(at("dst"), "dst")
    return e.select(F.col("edge_id").alias("lane_id"), F.col("src").alias("from_node"), F.col("dst").alias("to_node"), F.col("edge_id").alias("lane_group"), F.array("src_p", "dst_p").alias("pts"))


def lanes_from_osm(edges: DataFrame, nodes: DataFrame, default_width: float = 3.5, default_lanes: int = 1) -> DataFrame:
    """Lanes of a map multigraph: (edge_id, src, dst, geometry, widths, lanes) and (id, x, y).

    The first width, or the default, times the first lane count, or the default,
    is the width of one lane; edges without geometry join their end nodes;
    the length is that of the untrimmed line.
    """
    at = lambda end: nodes.select(F.col("id").alias(end), point(F.col("x"), F.col("y")).alias(f"{end}_p"))
    e = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    width = F.coalesce(F.get("widths", F.lit(0)).cast("double"), F.lit(default_width))
    lanes = F.coalesce(F.get("lanes", F.lit(0)).cast("int"), F.lit(default_lanes))
    pts = F.coalesce("geometry", F.array("src_p", "dst_p"))
    return e.select(F.col("edge_id").alias("lane_id"), F.col("src").alias("from_node"), F.col("dst").alias("to_node"), F.col("edge_id").alias("lane_group"), pts.alias("pts"), (width * lanes).alias("width"), F.lit(1).alias("lanes"), length(pts).alias("length"))


def with_boundaries(lanes: DataFrame, width: float) -> DataFrame:
    """With left and right boundaries of straight two-point lanes, both in driving direction."""
    p, q = F.col("pts")[0], F.element_at("pts", -1)
    n = F.nullif(F.hypot(q["x"] - p["x"], q["y"] - p["y"]), F.lit(0.0))
    ox, oy = -(q["y"] - p["y"]) / n * width / 2, (q["x"] - p["x"]) / n * width / 2
    side = lambda s: F.transform("pts", lambda v: point(v["x"] + s * ox, v["y"] + s * oy))
    return lanes.withColumn("boundary_left", side(1)).withColumn("boundary_right", side(-1))


def lane_polygon(left, right):
    """Right boundary, then the left one backwards."""
    return F.concat(right, F.reverse(left))


def connectors(lanes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(connector_id, source, dest, intersection_id, polygon) for each pair of connected lanes.

    ``lanes`` has boundaries.  A pair can be met from both its lanes: the visit
    of the greater lane, then the predecessor's side, then the later place in
    its list wins.
    """
    links = connections(lanes) if links is None else links
    ends = lanes.select(
        F.col("lane_id").alias("k"), F.col("from_node").alias("k_from"), F.col("to_node").alias("k_to"),
        F.struct(F.col("boundary_left")[0].alias("l"), F.col("boundary_right")[0].alias("r")).alias("first"),
        F.struct(F.element_at("boundary_left", -1).alias("l"), F.element_at("boundary_right", -1).alias("r")).alias("last"),
    )
    side = lambda name: ends.select(*(F.col(c).alias(f"{name}_{c}") for c in ends.columns))
    v = links.join(side("me"), F.col("lane_id") == F.col("me_k")).join(side("it"), F.col("other") == F.col("it_k"))
    ahead = F.col("phase") == 0
    source, dest = F.when(ahead, F.col("lane_id")).otherwise(F.col("other")), F.when(ahead, F.col("other")).otherwise(F.col("lane_id"))
    s = F.when(ahead, F.col("me_last")).otherwise(F.when(F.col("flip"), F.col("it_first")).otherwise(F.col("it_last")))
    d = F.when(ahead, F.when(F.col("flip"), F.col("it_last")).otherwise(F.col("it_first"))).otherwise(F.col("me_first"))
    v = v.select(source.alias("source"), dest.alias("dest"), F.when(ahead, F.col("me_k_to")).otherwise(F.col("me_k_from")).alias("intersection_id"), s.alias("s"), d.alias("d"), F.struct(F.col("lane_id").alias("turn"), "phase", F.col("other").alias("place")).alias("visit"))
    last = v.groupBy("source", "dest").agg(F.max_by(F.struct("intersection_id", "s", "d"), "visit").alias("w"))
    polygon = F.array("w.s.r", "w.d.r", "w.d.l", "w.s.l")
    return last.select(F.concat_ws("_", "source", "dest").alias("connector_id"), "source", "dest", "w.intersection_id", polygon.alias("polygon"))


def intersection_points(conns: DataFrame) -> DataFrame:
    """(intersection_id, x, y): distinct connector corners at each intersection."""
    return conns.select("intersection_id", F.explode("polygon").alias("p")).select("intersection_id", "p.x", "p.y").distinct()


def intersection_polygons(conns: DataFrame) -> DataFrame:
    """(intersection_id, ring, area): hulls of the corners."""
    return hulls(intersection_points(conns), "intersection_id")


def without_connectors(nodes: DataFrame, conns: DataFrame) -> DataFrame:
    return nodes.join(conns.select(F.col("intersection_id").alias("id")), "id", "left_anti")


def combine_sections(sections: DataFrame) -> DataFrame:
    """(lane_id, width, length, has_gap): a lane's sections together; a section without a score makes the lane fall back (null width)."""
    g = sections.groupBy("lane_id").agg(F.max("width").alias("w"), F.sum("length").alias("length"), F.bool_or(F.col("score").isNull()).alias("has_gap"))
    return g.select("lane_id", F.when(~F.col("has_gap"), F.col("w")).alias("width"), "length", "has_gap")
