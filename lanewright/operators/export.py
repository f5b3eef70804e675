"""The normalised map: tokens, nodes, lines, polygons, lanes, connectors, connectivity, canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.geom import point, segment_lengths
from lanewright.operators.lanes import lane_polygon

#: Tables of the map that have no rows of their own.
EMPTY_TABLES = ("traffic_light", "stop_line", "road_divider")


def token(kind: str, *ids: Column) -> Column:
    """32 characters that depend on the kind and the id alone."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(kind), *(c.cast("string") for c in ids)), 256), 1, 32)


def coordinate_text(pts: Column) -> Column:
    """(x, y), (x, y), ..."""
    return F.array_join(F.transform(pts, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(")"))), ", ")


def coordinates(text: Column) -> Column:
    """Points of ``coordinate_text``."""
    pairs = F.split(F.regexp_replace(text, r"^\(|\)$", ""), r"\), \(")
    return F.transform(F.filter(pairs, lambda v: v != ""), lambda v: point(F.split(v, ", ")[0].cast("double"), F.split(v, ", ")[1].cast("double")))


def map_arclines(lanes: DataFrame, conns: DataFrame) -> DataFrame:
    """(token, t, c, k): the centreline of every lane and connector as a spline of degree 1, knots by share of the length, ends twice."""
    middle = lambda a, b: point((F.col("polygon")[a]["x"] + F.col("polygon")[b]["x"]) / 2, (F.col("polygon")[a]["y"] + F.col("polygon")[b]["y"]) / 2)
    rows = lanes.select(token("lane", F.col("lane_id")).alias("token"), "pts").union(conns.select(token("connector", F.col("connector_id")).alias("token"), F.array(middle(0, 3), middle(1, 2)).alias("pts")))
    sums = F.aggregate(segment_lengths(F.col("pts")), F.array(F.lit(0.0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    rows = rows.withColumn("sums", sums)
    share = F.transform("sums", lambda v: F.coalesce(v / F.nullif(F.element_at("sums", -1), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("u", share)
    return rows.select("token", F.concat(F.slice("u", 1, 1), F.col("u"), F.slice("u", -1, 1)).alias("t"), F.transform("pts", lambda p: F.array(p["x"], p["y"])).alias("c"), F.lit(1).alias("k"))


def lanes_table(lanes: DataFrame, links: DataFrame) -> DataFrame:
    """The lane file's columns: ids, neighbours and boundaries as text, polygon."""
    ids = lambda phase: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("phase") == phase, F.col("other"))), lambda v: v.isNotNull())), lambda v: v.cast("string")), ", ")
    near = links.groupBy("lane_id").agg(ids(1).alias("predecessors"), ids(0).alias("successors"))
    rows = lanes.join(near, "lane_id", "left")
    return rows.select(
        F.col("lane_id").alias("element_id"), "lane_id", F.lit(1).alias("road_type"), F.concat(F.lit("i"), F.col("from_node").cast("string")).alias("from_object"), F.concat(F.lit("i"), F.col("to_node").cast("string")).alias("to_object"),
        F.coalesce("predecessors", F.lit("")).alias("predecessors"), F.coalesce("successors", F.lit("")).alias("successors"),
        coordinate_text(F.reverse("boundary_left")).alias("boundary_left"), coordinate_text(F.col("boundary_right")).alias("boundary_right"), coordinate_text(F.col("pts")).alias("centerline"),
        lane_polygon(F.col("boundary_left"), F.col("boundary_right")).alias("geometry"),
    )


def connectors_table(conns: DataFrame) -> DataFrame:
    """The connector file's columns; the line joins the middles of both ends of the polygon."""
    p = lambda i: F.col("polygon")[i]  # noqa: E731  right start, right end, left end, left start
    middle = lambda a, b: point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    return conns.select(
        "connector_id", "source", "dest", F.concat(F.lit("i"), F.col("intersection_id").cast("string")).alias("intersection_id"),
        coordinate_text(F.array(p(3), p(2))).alias("left_boundary"), coordinate_text(F.array(p(0), p(1))).alias("right_boundary"), F.lit(1).alias("lane_type"), F.lit(True).alias("legal"),
        coordinate_text(F.col("polygon")).alias("polygon"), F.array(middle(p(0), p(3)), middle(p(1), p(2))).alias("geometry"),
    )


def polygons_table(polygons: DataFrame) -> DataFrame:
    """The polygon file's columns from (element_id, type, ring); polygons have no road type."""
    return polygons.select("element_id", "type", F.lit(None).cast("int").alias("road_type"), F.col("ring").alias("geometry"))


def map_nodes(rings: DataFrame) -> DataFrame:
    """(token, x, y): distinct corners of all rings."""
    p = rings.select(F.explode("ring").alias("p")).select("p.x", "p.y").distinct()
    return p.select(token("node", F.col("x"), F.col("y")).alias("token"), "x", "y")


def _tokens(pts: Column) -> Column:
    return F.transform(pts, lambda p: token("node", p["x"], p["y"]))


def map_lines(lanes: DataFrame) -> DataFrame:
    """(token, lane_id, side, node_tokens): left, right, start and end line of every lane."""
    left, right = F.col("boundary_left"), F.col("boundary_right")
    sides = {"left": left, "right": right, "start": F.array(left[0], right[0]), "end": F.array(F.element_at(left, -1), F.element_at(right, -1))}
    rows = lanes.select("lane_id", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), v.alias("pts")) for k, v in sides.items()))).alias("s"))
    return rows.select(token("line", F.col("lane_id"), F.col("s.side")).alias("token"), "lane_id", F.col("s.side").alias("side"), _tokens(F.col("s.pts")).alias("node_tokens"))


def map_polygons(rings: DataFrame, kind: str, key: str) -> DataFrame:
    """(token, exterior_node_tokens, holes); polygons have no holes."""
    return rings.select(token(f"{kind}_polygon", F.col(key)).alias("token"), _tokens(F.col("ring")).alias("exterior_node_tokens"), F.array().cast("array<string>").alias("holes"))


def map_lanes(lanes: DataFrame) -> DataFrame:
    line = lambda side: token("line", F.col("lane_id"), F.lit(side))
    return lanes.select(token("lane", F.col("lane_id")).alias("token"), token("lane_polygon", F.col("lane_id")).alias("polygon_token"), F.lit("CAR").alias("lane_type"), line("start").alias("from_edge_line_token"), line("end").alias("to_edge_line_token"), F.array(line("left")).alias("left_lane_divider_segments"), F.array(line("right")).alias("right_lane_divider_segments"))


def map_areas(polygons: DataFrame) -> dict[str, DataFrame]:
    """road_segment, ped_crossing, walkway and drivable_area rows from typed polygons (element_id, type)."""
    own = token("area_polygon", F.col("element_id"))
    of = lambda kind: polygons.filter(F.col("type") == kind)
    drivable = token("drivable_area", F.lit("all"))
    return {
        "road_segment": of("intersection").select(token("road_segment", F.col("element_id")).alias("token"), own.alias("polygon_token"), F.lit(True).alias("is_intersection"), drivable.alias("drivable_area_token")),
        "ped_crossing": of("crosswalk").select(token("ped_crossing", F.col("element_id")).alias("token"), own.alias("polygon_token"), F.lit("").alias("road_segment_token")),
        "walkway": of("offroad").select(token("walkway", F.col("element_id")).alias("token"), own.alias("polygon_token")),
        "drivable_area": of("intersection").groupBy().agg(F.sort_array(F.collect_list(own)).alias("polygon_tokens")).select(drivable.alias("token"), "polygon_tokens"),
    }


def connectivity(conns: DataFrame, legal: Column | None = None) -> DataFrame:
    """(token, incoming, outgoing) of lanes and of legal connectors."""
    c = conns if legal is None else conns.filter(legal)
    own = token("connector", F.col("connector_id"))
    lane = lambda k: token("lane", F.col(k))
    rows = c.select(F.explode(F.array(
        F.struct(own.alias("token"), lane("source").alias("incoming"), lane("dest").alias("outgoing")),
        F.struct(lane("source").alias("token"), F.lit(None).cast("string").alias("incoming"), own.alias("outgoing")),
        F.struct(lane("dest").alias("token"), own.alias("incoming"), F.lit(None).cast("string").alias("outgoing")),
    )).alias("r")).select("r.*")
    return rows.groupBy("token").agg(F.sort_array(F.collect_set("incoming")).alias("incoming"), F.sort_array(F.collect_set("outgoing")).alias("outgoing"))


def canvas(rings: DataFrame) -> DataFrame:
    """minx, maxx, miny, maxy over all rings."""
    p = rings.select(F.explode("ring").alias("p"))
    return p.agg(F.min("p.x").alias("minx"), F.max("p.x").alias("maxx"), F.min("p.y").alias("miny"), F.max("p.y").alias("maxy"))
