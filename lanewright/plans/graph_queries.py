"""Registered queries on graphs, lanes and the map, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.functions import fixtures as fx
from lanewright.operators import export, graph, lanes

_NODES = """nodes AS (SELECT c_custkey AS id, c_custkey % 40 AS gx, c_custkey // 40 AS gy, CAST(593000 + {s} * (c_custkey % 40) AS DOUBLE) AS x,
  CAST(5762000 + {s} * (c_custkey // 40) AS DOUBLE) AS y FROM customer)"""
_EDGES = """edges AS (
  SELECT 2 * a.c_custkey AS edge_id, a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
  WHERE a.c_custkey // 40 = b.c_custkey // 40 AND a.c_nationkey % 2 = 0
  UNION ALL SELECT 2 * a.c_custkey + 1, a.c_custkey, b.c_custkey FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 40
  WHERE a.c_mktsegment IN ('HOUSEHOLD', 'MACHINERY'))"""
_INC = "inc AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)"
_DEG = f"{_INC}, deg AS (SELECT id, count(*) AS deg FROM inc GROUP BY id)"


def _with(*parts, s=50):
    return "WITH " + ", ".join(p.replace("{s}", str(s)) for p in parts) + " "


def nodes(spark, d):
    return fx.nodes(spark, d)


def edges(spark, d):
    return fx.edges(spark, d)


def adjacency(spark, d):
    a = graph.adjacency(fx.edges(spark, d))
    return a.select("id", F.array_join(F.transform("neighbours", lambda v: v.cast("string")), ",").alias("neighbours"))


def _both_ways(spark, d):
    e = fx.edges(spark, d)
    return e.select((2 * F.col("edge_id") + F.col("src") % 2).alias("seq"), "src", "dst").union(e.select(2 * F.col("edge_id") + 1 - F.col("src") % 2, "dst", "src"))


def undirected_dedup(spark, d):
    return graph.undirected(_both_ways(spark, d))


def degree_hist(spark, d):
    return graph.degrees(fx.edges(spark, d)).groupBy("deg").agg(F.count(F.lit(1)).alias("n"))


def junctions(spark, d):
    return graph.junctions(fx.edges(spark, d))


def reverse_dedup(spark, d):
    """Edges, every third one again backwards and every fifth one again, as lines."""
    ls = lanes.lanes_from_edges(fx.edges(spark, d), fx.nodes(spark, d)).select((3 * F.col("lane_id")).alias("line_id"), "pts")
    back = ls.filter("line_id % 9 = 0").select((F.col("line_id") + F.when(F.col("line_id") % 2 == 0, 1).otherwise(-1)).alias("line_id"), F.reverse("pts").alias("pts"))
    again = ls.filter("line_id % 15 = 0").select((F.col("line_id") + 2).alias("line_id"), "pts")
    kept = graph.reverse_dedup(ls.union(back).union(again))
    return kept.select("line_id", F.col("pts")[0]["x"].alias("x0"), F.col("pts")[0]["y"].alias("y0"))


def _lanes(spark, d, spacing=50):
    return lanes.lanes_from_edges(fx.edges(spark, d), fx.nodes(spark, d, spacing))


def connections(spark, d):
    return graph.connections(_lanes(spark, d))


def connections_tol(spark, d):
    return graph.connections(_lanes(spark, d, 25))


def _connectors(spark, d):
    l = lanes.with_boundaries(_lanes(spark, d), 3.5)  # noqa: E741
    return l, lanes.connectors(l)


def connectors(spark, d):
    _, c = _connectors(spark, d)
    p = lambda i, k: F.col("polygon")[i][k].alias(f"{k}{i}")
    return c.select("connector_id", "source", "dest", "intersection_id", *(p(i, k) for i in range(4) for k in "xy"))


def intersection_points(spark, d):
    _, c = _connectors(spark, d)
    return lanes.intersection_points(c).groupBy("intersection_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("x").alias("minx"), F.max("y").alias("maxy"))


def empty_intersections(spark, d):
    _, c = _connectors(spark, d)
    j = graph.junctions(fx.edges(spark, d)).select("id", "deg")
    return lanes.without_connectors(j, c)


def intersection_hulls(spark, d):
    _, c = _connectors(spark, d)
    return lanes.intersection_polygons(c).select("intersection_id", F.round("area", 6).alias("area"))


def contracted_roads(spark, d):
    return graph.contract(fx.edges(spark, d)).select(F.least("road_from", "road_to").alias("a"), F.greatest("road_from", "road_to").alias("b"), F.size("nodes").cast("long").alias("n_vertices"))


def missing_keys(spark, d):
    held = fx.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return graph.missing(fx.table(spark, d, "customer").select("c_custkey"), held, "c_custkey")


def upsert_latest(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return graph.latest(e, ["user_id", "event_type"], "event_id")


def induced_subgraph(spark, d):
    keep = fx.nodes(spark, d).filter("(gx + gy) % 7 <> 0")
    return graph.induced(fx.edges(spark, d), keep)


def near_lane_nodes(spark, d):
    n = fx.nodes(spark, d)
    e = fx.edges(spark, d)
    at = lambda end, i: n.select(F.col("id").alias(end), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    s = e.join(at("src", 1), "src").join(at("dst", 2), "dst")
    moved = n.select("id", (F.col("x") + 10).alias("x"), (F.col("y") + F.col("id") % 50).alias("y"))
    return graph.near_lanes(moved, s, 12.0).select("id")


def stitched_tiles(spark, d):
    """Grid nodes as tiles of 8 columns, edges within a tile."""
    n = fx.nodes(spark, d).withColumn("tile", F.expr("gx div 8")).select("tile", (8 * F.col("gy") + F.col("gx") % 8).alias("local_id"), "id")
    e = fx.edges(spark, d)
    at = lambda end: n.select(F.col("id").alias(end), F.col("tile").alias(f"{end}_tile"), F.col("local_id").alias(f"{end}_local"))
    t = e.join(at("src"), "src").join(at("dst"), "dst").filter("src_tile = dst_tile").select(F.col("src_tile").alias("tile"), F.col("src_local").alias("u"), F.col("dst_local").alias("v"))
    return graph.stitch_tiles(n.select("tile", "local_id"), t)[1]


def osm_lanes(spark, d):
    """Edges whose width and lane count come from order lines of the same key, if any."""
    li = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.array(F.min("l_quantity")).alias("widths"), F.array(F.max("l_linenumber")).alias("lanes"))
    e = fx.edges(spark, d).join(li, "edge_id", "left").withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    return lanes.lanes_from_osm(e, fx.nodes(spark, d)).select("lane_id", "width", "lanes", F.round("length", 6).alias("length"))


def map_nodes(spark, d):
    l, _ = _connectors(spark, d)  # noqa: E741
    rings = l.select(lanes.lane_polygon(F.col("boundary_left"), F.col("boundary_right")).alias("ring"))
    return export.map_nodes(rings).select("x", "y")


def map_lines(spark, d):
    l, _ = _connectors(spark, d)  # noqa: E741
    return export.map_lines(l).select("token", "lane_id", "side", F.size("node_tokens").cast("long").alias("n_nodes"))


def map_connectivity(spark, d):
    _, c = _connectors(spark, d)
    return export.connectivity(c).select("token", F.array_join("incoming", ",").alias("incoming"), F.array_join("outgoing", ",").alias("outgoing"))


def map_lanes(spark, d):
    return export.map_lanes(_lanes(spark, d)).select("token", "polygon_token", "from_edge_line_token", "to_edge_line_token")


def map_canvas(spark, d):
    l, _ = _connectors(spark, d)  # noqa: E741
    return export.canvas(l.select(lanes.lane_polygon(F.col("boundary_left"), F.col("boundary_right")).alias("ring")))


def lane_neighbours(spark, d):
    l, _ = _connectors(spark, d)  # noqa: E741
    t = export.lanes_table(l, graph.connections(l))
    return t.select("element_id", "road_type", "from_object", "to_object", "predecessors", "successors", F.size("geometry").cast("long").alias("n_corners"))


_LANES = "lanes AS (SELECT e.edge_id AS lane_id, e.src AS f, e.dst AS t, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)"
_CONN = """conn AS (
  SELECT l.lane_id, 0 AS phase, c.lane_id AS other, c.f <> l.t AS flip, l.t AS here, l.x0, l.y0, l.x1, l.y1, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1
  FROM lanes l JOIN lanes c ON (c.f = l.t OR c.t = l.t) AND c.lane_id <> l.lane_id
  UNION ALL SELECT l.lane_id, 1, c.lane_id, c.t <> l.f, l.f, l.x0, l.y0, l.x1, l.y1, c.x0, c.y0, c.x1, c.y1
  FROM lanes l JOIN lanes c ON (c.f = l.f OR c.t = l.f) AND c.lane_id <> l.lane_id
), kept AS (SELECT * FROM conn WHERE NOT (abs(x1 - cx0) <= 1e-8 + 1e-5 * abs(cx0) AND abs(y1 - cy0) <= 1e-8 + 1e-5 * abs(cy0)
  AND abs(x0 - cx1) <= 1e-8 + 1e-5 * abs(cx1) AND abs(y0 - cy1) <= 1e-8 + 1e-5 * abs(cy1)))"""
_SIDES = """sides AS (SELECT lane_id, f, t, x0 - (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS lx0, y0 + (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS ly0,
  x1 - (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS lx1, y1 + (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS ly1,
  x0 + (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS rx0, y0 - (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS ry0,
  x1 + (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS rx1, y1 - (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1.75 AS ry1 FROM lanes)"""
_VISITS = """visits AS (
  SELECT CASE WHEN phase = 0 THEN k.lane_id ELSE k.other END AS source, CASE WHEN phase = 0 THEN k.other ELSE k.lane_id END AS dest, k.here AS intersection_id, k.lane_id AS turn, phase, k.other AS place,
    phase = 0 OR NOT flip AS s_last, phase = 0 AND flip AS d_last
  FROM kept k
), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, dest ORDER BY turn DESC, phase DESC, place DESC) AS rn FROM visits) WHERE rn = 1),
cn AS (SELECT source || '_' || dest AS connector_id, source, dest, intersection_id,
  CASE WHEN s_last THEN s.rx1 ELSE s.rx0 END AS x0, CASE WHEN s_last THEN s.ry1 ELSE s.ry0 END AS y0, CASE WHEN d_last THEN d.rx1 ELSE d.rx0 END AS x1, CASE WHEN d_last THEN d.ry1 ELSE d.ry0 END AS y1,
  CASE WHEN d_last THEN d.lx1 ELSE d.lx0 END AS x2, CASE WHEN d_last THEN d.ly1 ELSE d.ly0 END AS y2, CASE WHEN s_last THEN s.lx1 ELSE s.lx0 END AS x3, CASE WHEN s_last THEN s.ly1 ELSE s.ly0 END AS y3
  FROM last JOIN sides s ON s.lane_id = source JOIN sides d ON d.lane_id = dest)"""
_CORNERS = "corners AS (SELECT DISTINCT intersection_id, x, y FROM (SELECT intersection_id, x0 AS x, y0 AS y FROM cn UNION ALL SELECT intersection_id, x1, y1 FROM cn UNION ALL SELECT intersection_id, x2, y2 FROM cn UNION ALL SELECT intersection_id, x3, y3 FROM cn))"
_ALL = (_NODES, _EDGES, _LANES, _CONN, _SIDES, _VISITS)
_RING = "ring AS (SELECT lane_id, rx0 AS x, ry0 AS y FROM sides UNION ALL SELECT lane_id, rx1, ry1 FROM sides UNION ALL SELECT lane_id, lx1, ly1 FROM sides UNION ALL SELECT lane_id, lx0, ly0 FROM sides)"


def _token(kind, *ids):
    return "substr(sha256('" + kind + "'" + "".join(f" || '|' || {i}" for i in ids) + "), 1, 32)"


QUERIES = {
    "nodes": (nodes, _with(_NODES) + "SELECT id, gx, gy, x, y FROM nodes"),
    "edges": (edges, _with(_EDGES) + "SELECT edge_id, src, dst FROM edges"),
    "adjacency": (adjacency, _with(_EDGES) + "SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY dir, edge_id) AS neighbours FROM (SELECT src AS id, 0 AS dir, edge_id, dst AS other FROM edges UNION ALL SELECT dst, 1, edge_id, src FROM edges) GROUP BY id"),
    "undirected_dedup": (undirected_dedup, _with(_EDGES) + ", b AS (SELECT 2 * edge_id + src % 2 AS seq, src, dst FROM edges UNION ALL SELECT 2 * edge_id + 1 - src % 2, dst, src FROM edges) SELECT seq, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY seq) AS rn FROM b) WHERE rn = 1"),
    "degree_hist": (degree_hist, _with(_EDGES, _DEG) + "SELECT deg, count(*) AS n FROM deg GROUP BY deg"),
    "junctions": (junctions, _with(_EDGES, _DEG) + "SELECT id, deg, 'i' || CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS name FROM deg WHERE deg <> 2"),
    "reverse_dedup": (reverse_dedup, _with(_NODES, _EDGES, _LANES) + """, l AS (SELECT 3 * lane_id AS line_id, x0, y0, x1, y1 FROM lanes),
      every AS (SELECT * FROM l UNION ALL SELECT line_id + CASE WHEN line_id % 2 = 0 THEN 1 ELSE -1 END, x1, y1, x0, y0 FROM l WHERE line_id % 9 = 0 UNION ALL SELECT line_id + 2, x0, y0, x1, y1 FROM l WHERE line_id % 15 = 0)
      SELECT line_id, x0, y0 FROM every e WHERE NOT EXISTS (SELECT 1 FROM every r WHERE r.x0 = e.x1 AND r.y0 = e.y1 AND r.x1 = e.x0 AND r.y1 = e.y0
        AND r.line_id < (SELECT min(s.line_id) FROM every s WHERE s.x0 = e.x0 AND s.y0 = e.y0 AND s.x1 = e.x1 AND s.y1 = e.y1))"""),
    "connections": (connections, _with(*_ALL[:4]) + "SELECT lane_id, phase, other, flip FROM kept"),
    "connections_tol": (connections_tol, _with(*_ALL[:4], s=25) + "SELECT lane_id, phase, other, flip FROM kept"),
    "connectors": (connectors, _with(*_ALL) + "SELECT * FROM cn"),
    "intersection_points": (intersection_points, _with(*_ALL, _CORNERS) + "SELECT intersection_id, count(*) AS n_points, min(x) AS minx, max(y) AS maxy FROM corners GROUP BY intersection_id"),
    "empty_intersections": (empty_intersections, _with(*_ALL, _DEG) + "SELECT id, deg FROM deg WHERE deg <> 2 AND id NOT IN (SELECT intersection_id FROM cn)"),
    "intersection_hulls": (intersection_hulls, _with(*_ALL, _CORNERS) + """, pq AS (SELECT p.intersection_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM corners p JOIN corners q ON p.intersection_id = q.intersection_id AND (p.x <> q.x OR p.y <> q.y)
      WHERE NOT EXISTS (SELECT 1 FROM corners r WHERE r.intersection_id = p.intersection_id AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
        OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0))))
      SELECT c.intersection_id, CASE WHEN round(sum(coalesce(px * qy - qx * py, 0)) / 2, 6) > 0 THEN round(sum((px - cx) * (qy - cy) - (qx - cx) * (py - cy)) / 2, 6) END AS area
      FROM (SELECT intersection_id, min(x) AS cx, min(y) AS cy FROM corners GROUP BY intersection_id) c LEFT JOIN pq USING (intersection_id) GROUP BY c.intersection_id"""),
    "contracted_roads": (contracted_roads, "WITH RECURSIVE " + _with(_EDGES, _DEG)[5:] + """, h AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
      walk AS (SELECT h.u AS a, h.v AS first, h.u AS prev, h.v AS cur, 2 AS n FROM h JOIN deg ON deg.id = h.u WHERE deg.deg <> 2
        UNION ALL SELECT w.a, w.first, w.cur, h.v, w.n + 1 FROM walk w JOIN deg ON deg.id = w.cur AND deg.deg = 2 JOIN h ON h.u = w.cur AND h.v <> w.prev)
      SELECT least(a, cur) AS a, greatest(a, cur) AS b, CAST(n AS BIGINT) AS n_vertices FROM walk JOIN deg ON deg.id = cur WHERE deg.deg <> 2 AND (a < cur OR (a = cur AND first <= prev))"""),
    "missing_keys": (missing_keys, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "upsert_latest": (upsert_latest, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "induced_subgraph": (induced_subgraph, _with(_NODES, _EDGES) + "SELECT e.* FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE (a.gx + a.gy) % 7 <> 0 AND (b.gx + b.gy) % 7 <> 0"),
    "near_lane_nodes": (near_lane_nodes, _with(_NODES, _EDGES, _LANES) + """, n AS (SELECT id, x + 10 AS x, y + id % 50 AS y FROM nodes), s AS (SELECT * FROM lanes)
      SELECT DISTINCT id FROM n JOIN s ON n.x BETWEEN least(x0, x1) - 41 AND greatest(x0, x1) + 41 AND n.y BETWEEN least(y0, y1) - 41 AND greatest(y0, y1) + 41
      WHERE sqrt((n.x - (x0 + greatest(0, least(1, ((n.x - x0) * (x1 - x0) + (n.y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) * (x1 - x0))) ** 2
        + (n.y - (y0 + greatest(0, least(1, ((n.x - x0) * (x1 - x0) + (n.y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) * (y1 - y0))) ** 2) < 12"""),
    "stitched_tiles": (stitched_tiles, _with(_NODES, _EDGES) + """, n AS (SELECT id, gx // 8 AS tile, 8 * gy + gx % 8 AS local_id FROM nodes), k AS (SELECT tile, count(*) AS k FROM n GROUP BY tile),
      o AS (SELECT tile, coalesce(sum(k) OVER (ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM k)
      SELECT a.tile, CAST(a.local_id + skip AS BIGINT) AS src, CAST(b.local_id + skip AS BIGINT) AS dst FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst JOIN o ON o.tile = a.tile WHERE a.tile = b.tile"""),
    "osm_lanes": (osm_lanes, _with(_NODES, _EDGES, _LANES) + """, li AS (SELECT l_orderkey, min(l_quantity) AS w, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey)
      SELECT lane_id, coalesce(w, 3.5) * coalesce(n, 1) AS width, 1 AS lanes, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS length FROM lanes LEFT JOIN li ON l_orderkey = lane_id"""),
    "map_nodes": (map_nodes, _with(_NODES, _EDGES, _LANES, _SIDES, _RING) + "SELECT DISTINCT x, y FROM ring"),
    "map_lines": (map_lines, _with(_EDGES) + f"SELECT {_token('line', 'edge_id', 'side')} AS token, edge_id AS lane_id, side, CAST(2 AS BIGINT) AS n_nodes FROM edges CROSS JOIN (VALUES ('left'), ('right'), ('start'), ('end')) v(side)"),
    "map_lanes": (map_lanes, _with(_EDGES) + f"SELECT {_token('lane', 'edge_id')} AS token, {_token('lane_polygon', 'edge_id')} AS polygon_token, {_token('line', 'edge_id', chr(39) + 'start' + chr(39))} AS from_edge_line_token, {_token('line', 'edge_id', chr(39) + 'end' + chr(39))} AS to_edge_line_token FROM edges"),
    "map_connectivity": (map_connectivity, _with(*_ALL) + f""", r AS (SELECT {_token('connector', 'connector_id')} AS token, {_token('lane', 'source')} AS i, {_token('lane', 'dest')} AS o FROM cn
      UNION ALL SELECT {_token('lane', 'source')}, NULL, {_token('connector', 'connector_id')} FROM cn UNION ALL SELECT {_token('lane', 'dest')}, {_token('connector', 'connector_id')}, NULL FROM cn)
      SELECT token, coalesce(string_agg(DISTINCT i, ',' ORDER BY i), '') AS incoming, coalesce(string_agg(DISTINCT o, ',' ORDER BY o), '') AS outgoing FROM r GROUP BY token"""),
    "map_canvas": (map_canvas, _with(_NODES, _EDGES, _LANES, _SIDES, _RING) + "SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM ring"),
    "lane_neighbours": (lane_neighbours, _with(*_ALL[:4]) + """SELECT l.lane_id AS element_id, 1 AS road_type, 'i' || f AS from_object, 'i' || t AS to_object,
      coalesce((SELECT string_agg(CAST(other AS VARCHAR), ', ' ORDER BY other) FROM kept k WHERE k.lane_id = l.lane_id AND phase = 1), '') AS predecessors,
      coalesce((SELECT string_agg(CAST(other AS VARCHAR), ', ' ORDER BY other) FROM kept k WHERE k.lane_id = l.lane_id AND phase = 0), '') AS successors, CAST(4 AS BIGINT) AS n_corners FROM lanes l"""),
}
