"""Registered queries on regions, projections, tiles, rasters and the map's files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import fixtures as fx
from lanewright.functions import geom
from lanewright.operators import candidates, export, lanes, overlay, polyline, raster, regions
from lanewright.plans.geometry_queries import _AFFINE, _M, _P, _PIX, _RECT
from lanewright.plans.graph_queries import _ALL, _EDGES, _NODES, _with

_R6 = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zero


def annotated_edges(spark, d):
    """Edges on the integer grid, every second one with a bent geometry, that touch the inside of a rectangle."""
    n = fx.nodes(spark, d).select("id", (12.0 * F.col("gx")).alias("x"), (9.0 * F.col("gy")).alias("y"))
    e = fx.edges(spark, d)
    at = lambda end, k: n.select(F.col("id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    bent = e.join(at("src", 0), "src").join(at("dst", 1), "dst").withColumn("bend", geom.point((F.col("x0") + F.col("x1")) / 2 + 4, (F.col("y0") + F.col("y1")) / 2 + 4))
    e = bent.withColumn("geometry", F.when(F.col("edge_id") % 2 == 0, F.array(geom.point(F.col("x0"), F.col("y0")), "bend", geom.point(F.col("x1"), F.col("y1")))))
    r = fx.rectangles(spark, d).filter("truth").select(overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    return regions.edges_in_polygons(e, n, r, 64.0).select("edge_id")


def annotation_extent(spark, d):
    r = fx.rectangles(spark, d).select(overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    return regions.extent_of(r).select(*(_R6(c).alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def map_roads(spark, d):
    """Edges between places in degrees, every third one also backwards, as trimmed lanes in metres."""
    n = fx.nodes(spark, d).select("id", (4.35 + 0.0007 * F.col("gx")).alias("x"), (52.0 + 0.0005 * F.col("gy")).alias("y"))
    li = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("of")).agg(F.array(F.min("l_quantity")).alias("widths"), F.array(F.max("l_linenumber")).alias("lanes"))
    e = fx.edges(spark, d)
    e = e.union(e.filter("edge_id % 3 = 0").select((F.col("edge_id") + 10_000_000).alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.join(li, F.col("edge_id") == F.col("of"), "left").withColumn("geometry", F.lit(None).cast("array<struct<x:double,y:double>>"))
    r = regions.roads_from_map(e, n, geom.utm31)
    end = lambda i, c: F.round(F.element_at("pts", i)[c], 3)
    return r.select("lane_id", "from_object", "to_object", "width", F.round("length", 3).alias("length"), end(1, "x").alias("x0"), end(1, "y").alias("y0"), end(-1, "x").alias("x1"), end(-1, "y").alias("y1"))


def mercator(spark, d):
    p = fx.places(spark, d).select("id", "lon", "lat", geom.mercator(F.col("lon"), F.col("lat")).alias("p"))
    back = p.withColumn("q", geom.mercator_inverse(F.col("p.x"), F.col("p.y")))
    return back.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("q.x", 9).alias("lon"), F.round("q.y", 9).alias("lat"))


def utm_zones(spark, d):
    """Places in zone 32, and back in zone 31 as a check of both ways."""
    p = fx.places(spark, d).select("id", "lon", "lat", geom.utm(F.col("lon"), F.col("lat"), 32).alias("p"), geom.utm(F.col("lon"), F.col("lat"), 31).alias("q"))
    p = p.withColumn("back", geom.utm_inverse(F.col("q.x"), F.col("q.y"), 31))
    return p.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("back.x", 7).alias("lon"), F.round("back.y", 7).alias("lat"))


def pixel_graph_places(spark, d):
    """The grid's adjacency lists as pixels, two columns to one place."""
    n = fx.nodes(spark, d).select(F.col("id").alias("of"), F.col("gy").alias("row"), F.expr("gx div 2").alias("col"))
    e = fx.edges(spark, d)
    both = e.select(F.col("src").alias("seq"), F.col("dst").alias("other")).union(e.select("dst", "src"))
    both = both.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("other")) - 1)
    a = both.join(n.withColumnRenamed("of", "seq"), "seq").join(n.select(F.col("of").alias("other"), F.col("row").alias("nrow"), F.col("col").alias("ncol")), "other")
    return regions.pixel_graph_to_places(a, _AFFINE).withColumn("pos", F.col("pos").cast("long"))


def image_tiles(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37).alias("width"), ((51 - F.col("p_size")) * 29).alias("height"))
    t = regions.tiles(p, 512)
    return t.select("id", *(F.col(c).cast("long").alias(c) for c in ("i", "j", "row", "col", "height", "width")))


def resampled_rasters(spark, d):
    p = fx.pixels(spark, d).select("mask_id", "row", "col", F.round(1000 * F.col("value")).alias("value"))
    return regions.resample_bilinear(p, 0.8, 1.1).select("mask_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("value", 5).alias("value"))


def _sections(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("lane_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))
    return e.select("lane_id", "pos", F.lit(0.5).alias("a"), (1000 + 7 * F.col("pos") - F.col("event_id") % 13).cast("double").alias("c"), F.lit(-0.5).alias("e"), (500 - 3 * F.col("pos") + F.col("event_id") % 5).cast("double").alias("f"), (8 + F.col("event_id") % 5).alias("height"), (20 + F.col("event_id") % 7).alias("width"))


def section_canvas(spark, d):
    return regions.section_canvas(_sections(spark, d))


def section_shifts(spark, d):
    return regions.with_shifts(_sections(spark, d)).select("lane_id", F.col("pos").cast("long").alias("pos"), F.col("dr").cast("long").alias("dr"), F.col("dc").cast("long").alias("dc"))


def length_gate(spark, d):
    return regions.long_enough(polyline.as_arrays(fx.lines(spark, d)), 4000.0).select("line_id", "fits")


def spline_knots(spark, d):
    k = regions.spline_knots(fx.lines(spark, d))
    return k.select("line_id", "i", _R6("t").alias("t"))


def _connectors(spark, d):
    return lanes.connectors(lanes.with_boundaries(lanes.lanes_from_edges(fx.edges(spark, d), fx.nodes(spark, d)), 3.5))


def connector_file(spark, d):
    t = export.connectors_table(_connectors(spark, d))
    end = lambda i, c: _R6(F.col("geometry")[i][c])
    points = lambda c: (F.size(F.split(c, r"\), \("))).cast("long")
    return t.select("connector_id", "source", "dest", "intersection_id", "lane_type", "legal", points("polygon").alias("n"), points("left_boundary").alias("n_left"), end(0, "x").alias("x0"), end(0, "y").alias("y0"), end(1, "x").alias("x1"), end(1, "y").alias("y1"))


def _typed(spark, d):
    r = fx.rectangles(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("intersection", "terminal", "crosswalk", "offroad"))), (F.col("id") % 4 + 1).cast("int"))
    return r.select(F.col("id").alias("element_id"), kind.alias("type"), overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))


def polygon_file(spark, d):
    t = export.polygons_table(_typed(spark, d))
    return t.select("element_id", "type", "road_type", F.size("geometry").cast("long").alias("n"), geom.ring_area(F.col("geometry")).alias("area"))


def typed_areas(spark, d):
    """Rows of the tables that typed polygons go to; a drivable area counts its polygons."""
    t = export.map_areas(_typed(spark, d))
    rows = lambda kind, *more: t[kind].select(F.lit(kind).alias("kind"), "token", "polygon_token", *more)
    none = F.lit(None).cast("string").alias("other")
    out = rows("road_segment", F.col("drivable_area_token").alias("other")).union(rows("ped_crossing", F.col("road_segment_token").alias("other"))).union(rows("walkway", none))
    return out.union(t["drivable_area"].select(F.lit("drivable_area"), "token", F.size("polygon_tokens").cast("string"), none))


def _strip_segments(spark, d):
    """A bent line through every mask."""
    m = fx.masks(spark, d).select(F.col("mask_id").alias("line_id"))
    parts = ((0.0, 1.0, 1.5, 5.0, 4.5), (5.0, 5.0, 4.5, 7.0, 1.5))
    e = m.select("line_id", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("before", "px", "py", "x", "y"), p))) for p in parts))).alias("s"))
    return e.select("line_id", "s.*")


def turn_fillers(spark, d):
    """Fillers between sections 40 long that end 3 before and start 3 after every inner vertex of the lines."""
    w = Window.partitionBy("line_id").orderBy("pos")
    p = fx.lines(spark, d).select("line_id", "pos", "x", "y", *(F.lag(c, k).over(w).alias(f"{c}{k}") for c in "xy" for k in (1, 2))).filter("x2 is not null")
    n = lambda ax, ay, bx, by: F.hypot(F.col(bx) - F.col(ax), F.col(by) - F.col(ay))
    p = p.withColumn("ux", (F.col("x1") - F.col("x2")) / n("x2", "y2", "x1", "y1")).withColumn("uy", (F.col("y1") - F.col("y2")) / n("x2", "y2", "x1", "y1"))
    p = p.withColumn("vx", (F.col("x") - F.col("x1")) / n("x1", "y1", "x", "y")).withColumn("vy", (F.col("y") - F.col("y1")) / n("x1", "y1", "x", "y"))
    section = lambda k, ux, uy: F.array(*(geom.point(F.col("x1") + k * F.col(ux) - s * F.col(uy), F.col("y1") + k * F.col(uy) + s * F.col(ux)) for s in (20, -20)))
    p = p.select("line_id", "pos", geom.point(F.col("x2"), F.col("y2")).alias("p0"), geom.point(F.col("x1"), F.col("y1")).alias("p1"), geom.point(F.col("x"), F.col("y")).alias("p2"), section(-3, "ux", "uy").alias("first"), section(3, "vx", "vy").alias("second"))
    p = candidates.turn_fillers(p)
    return p.filter("ring is not null").select("line_id", F.col("pos").cast("long").alias("pos"), F.size("ring").cast("long").alias("n"), F.round(geom.ring_area(F.col("ring")), 4).alias("area"))


def warped_strips(spark, d):
    p = fx.pixels(spark, d).select(F.col("mask_id").alias("line_id"), "row", "col", "is_set")
    w = raster.warp(p, _strip_segments(spark, d), 4)
    return w.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_set"), F.col("row") * 100 + F.col("col")).otherwise(0)).alias("places"))


def unwarped_masks(spark, d):
    s = _strip_segments(spark, d)
    p = fx.pixels(spark, d).select(F.col("mask_id").alias("line_id"), "row", "col", "is_set")
    u = raster.unwarp(raster.warp(p, s, 4), s, 4)
    return u.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row") * 100 + F.col("col")).alias("places"))


_LONLAT = "n AS (SELECT id, 4.35 + 0.0007 * gx AS lon, 52.0 + 0.0005 * gy AS lat FROM nodes)"
_STRIP = f"""{_PIX}, seg AS (SELECT * FROM (VALUES (0.0::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 5.0::DOUBLE, 4.5::DOUBLE), (5.0, 5.0, 4.5, 7.0, 1.5)) t(before, sx, sy, tx, ty)),
  l AS (SELECT *, sqrt((tx - sx) ** 2 + (ty - sy) ** 2) AS len FROM seg), z AS (SELECT *, CAST(trunc(before) AS INT) AS a, CAST(trunc(before + len) AS INT) AS b FROM l),
  cell AS (SELECT *, unnest(range(a, b)) AS c FROM z), strip AS (SELECT c, r, CAST(floor(sy + (c - a) / len * (ty - sy) + (r - 2.0) * (tx - sx) / len + 0.5) AS INT) AS src_row, CAST(floor(sx + (c - a) / len * (tx - sx) - (r - 2.0) * (ty - sy) / len + 0.5) AS INT) AS src_col FROM cell, range(4) q(r)),
  w AS (SELECT e.vec_id AS line_id, s.r, s.c, s.src_row, s.src_col, coalesce(px.is_set, false) AS is_set FROM embeddings e CROSS JOIN strip s LEFT JOIN px ON px.mask_id = e.vec_id AND px.row = s.src_row AND px.col = s.src_col)"""
_SECTION = """s AS (SELECT user_id AS lane_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  v AS (SELECT lane_id, pos, CAST(1000 + 7 * pos - event_id % 13 AS DOUBLE) AS c, CAST(500 - 3 * pos + event_id % 5 AS DOUBLE) AS f, 8 + event_id % 5 AS height, 20 + event_id % 7 AS width FROM s),
  b AS (SELECT lane_id, arg_min(c, pos) AS bc, arg_min(f, pos) AS bf FROM v GROUP BY lane_id), m AS (SELECT *, CAST(trunc((c - bc) / 0.5) AS BIGINT) AS x, CAST(trunc((f - bf) / -0.5) AS BIGINT) AS y FROM v JOIN b USING (lane_id)),
  k AS (SELECT *, y - min(y) OVER (PARTITION BY lane_id) AS dr, x - min(x) OVER (PARTITION BY lane_id) AS dc FROM m)"""
_TYPED = f"{_RECT}, t AS (SELECT id, ['intersection', 'terminal', 'crosswalk', 'offroad'][CAST(id % 4 + 1 AS INT)] AS type, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM r)"
_TOKEN = lambda kind, i: f"substr(sha256('{kind}|' || {i}), 1, 32)"

QUERIES = {
    "annotated_edges": (annotated_edges, _with(_NODES, _EDGES) + f""", p AS (SELECT id, 12.0 * gx AS x, 9.0 * gy AS y FROM nodes), {_RECT.replace("r AS", "rect AS")}, ends AS (SELECT edge_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges JOIN p a ON a.id = src JOIN p b ON b.id = dst),
      v AS (SELECT edge_id, x0 AS x, y0 AS y FROM ends UNION ALL SELECT edge_id, x1, y1 FROM ends UNION ALL SELECT edge_id, (x0 + x1) / 2 + 4, (y0 + y1) / 2 + 4 FROM ends WHERE edge_id % 2 = 0)
      SELECT DISTINCT edge_id FROM v JOIN rect ON truth AND v.x > rect.x0 AND v.x < rect.x1 AND v.y > rect.y0 AND v.y < rect.y1"""),
    "annotation_extent": (annotation_extent, f"WITH {_RECT}, e AS (SELECT min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM r) SELECT round(a - 0.05 * (c - a), 6) AS minx, round(b - 0.05 * (d - b), 6) AS miny, round(c + 0.05 * (c - a), 6) AS maxx, round(d + 0.05 * (d - b), 6) AS maxy FROM e"),
    "map_roads": (map_roads, _with(_NODES, _EDGES, _LONLAT, geom.utm_sql("lon", "lat", "n")) + """, li AS (SELECT l_orderkey, min(l_quantity) AS w, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
      e AS (SELECT edge_id, src, dst, a.ux AS ax, a.uy AS ay, b.ux AS bx, b.uy AS b_y, sqrt((b.ux - a.ux) ** 2 + (b.uy - a.uy) ** 2) AS len FROM edges JOIN u3 a ON a.id = src JOIN u3 b ON b.id = dst), d AS (SELECT *, least(2.5, 0.4 * len) / len AS t FROM e)
      SELECT edge_id AS lane_id, 'i' || src AS from_object, 'i' || dst AS to_object, coalesce(w, 3.5) * coalesce(n, 1) AS width, round(len, 3) AS length, round(ax + t * (bx - ax), 3) AS x0, round(ay + t * (b_y - ay), 3) AS y0, round(bx - t * (bx - ax), 3) AS x1, round(b_y - t * (b_y - ay), 3) AS y1
      FROM d LEFT JOIN li ON l_orderkey = edge_id"""),
    "mercator": (mercator, "WITH p AS (SELECT s_suppkey AS id, 4.35 + 0.0001 * s_suppkey AS lon, 52.0 + 0.0001 * s_suppkey AS lat FROM supplier) SELECT id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, round(CAST(lon AS DOUBLE), 9) AS lon, round(CAST(lat AS DOUBLE), 9) AS lat FROM p"),
    "utm_zones": (utm_zones, "WITH p AS (SELECT s_suppkey AS id, CAST(4.35 + 0.0001 * s_suppkey AS DOUBLE) AS lon, CAST(52.0 + 0.0001 * s_suppkey AS DOUBLE) AS lat FROM supplier), " + geom.utm_sql("lon", "lat", "p", 32) + " SELECT id, round(ux, 3) AS x, round(uy, 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM u3"),
    "pixel_graph_places": (pixel_graph_places, _with(_NODES, _EDGES) + """, b AS (SELECT src AS seq, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges), q AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY other) - 1 AS pos FROM b),
      a AS (SELECT seq, pos, 592900.0 + 0.5 * (s.gx // 2) AS x, 5763500.0 - 0.5 * s.gy AS y, 592900.0 + 0.5 * (o.gx // 2) AS nx, 5763500.0 - 0.5 * o.gy AS ny FROM q JOIN nodes s ON s.id = seq JOIN nodes o ON o.id = other)
      SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, pos, CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny FROM a QUALIFY seq = max(seq) OVER (PARTITION BY x, y)"""),
    "image_tiles": (image_tiles, """WITH p AS (SELECT p_partkey AS id, p_size * 37 AS width, (51 - p_size) * 29 AS height FROM part), n AS (SELECT *, (height + 511) // 512 AS ni, (width + 511) // 512 AS nj FROM p),
      t AS (SELECT id, unnest(range(ni)) AS i, nj, height // ni AS th, width // nj AS tw FROM n), u AS (SELECT id, i, unnest(range(nj)) AS j, th, tw FROM t) SELECT id, i, j, i * th AS row, j * tw AS col, CAST(th AS BIGINT) AS height, CAST(tw AS BIGINT) AS width FROM u"""),
    "resampled_rasters": (resampled_rasters, f"""WITH {_PIX}, o AS (SELECT r, c, greatest(0.0, least(7.0, (r + 0.5) * 8 / 5 - 0.5)) AS fy, greatest(0.0, least(7.0, (c + 0.5) * 8 / 5 - 0.5)) AS fx FROM range(5) a(r), range(5) b(c)),
      k AS (SELECT r, c, y AS row, x AS col, (1 - abs(fy - y)) * (1 - abs(fx - x)) AS k FROM o, range(8) a(y), range(8) b(x) WHERE abs(fy - y) < 1 AND abs(fx - x) < 1)
      SELECT mask_id, r AS row, c AS col, round(sum(k * round(1000 * value)), 5) AS value FROM k JOIN px USING (row, col) GROUP BY mask_id, r, c"""),
    "section_canvas": (section_canvas, f"WITH {_SECTION} SELECT lane_id, max(dr + height) AS height, max(dc + width) AS width, CAST(0.5 AS DOUBLE) AS a, min(c) AS c, CAST(-0.5 AS DOUBLE) AS e, max(f) AS f FROM k GROUP BY lane_id"),
    "section_shifts": (section_shifts, f"WITH {_SECTION} SELECT lane_id, pos, dr, dc FROM k"),
    "length_gate": (length_gate, f"WITH {_M} SELECT line_id, max(cum) >= 4000 AS fits FROM m GROUP BY line_id"),
    "spline_knots": (spline_knots, f"""WITH {_M}, u AS (SELECT line_id, pos, cum / total AS u, max(pos) OVER (PARTITION BY line_id) AS last FROM m)
      SELECT line_id, pos + 1 AS i, round(u, 6) AS t FROM u UNION ALL SELECT line_id, 0, round(u, 6) FROM u WHERE pos = 0 UNION ALL SELECT line_id, pos + 2, round(u, 6) FROM u WHERE pos = last"""),
    "connector_file": (connector_file, _with(*_ALL) + "SELECT connector_id, source, dest, 'i' || intersection_id AS intersection_id, CAST(1 AS INT) AS lane_type, true AS legal, CAST(4 AS BIGINT) AS n, CAST(2 AS BIGINT) AS n_left, round((x0 + x3) / 2, 6) AS x0, round((y0 + y3) / 2, 6) AS y0, round((x1 + x2) / 2, 6) AS x1, round((y1 + y2) / 2, 6) AS y1 FROM cn"),
    "polygon_file": (polygon_file, f"WITH {_TYPED} SELECT id AS element_id, type, CAST(NULL AS INT) AS road_type, CAST(4 AS BIGINT) AS n, area FROM t"),
    "typed_areas": (typed_areas, f"""WITH {_TYPED} SELECT 'road_segment' AS kind, {_TOKEN("road_segment", "id")} AS token, {_TOKEN("area_polygon", "id")} AS polygon_token, {_TOKEN("drivable_area", "'all'")} AS other FROM t WHERE type = 'intersection'
      UNION ALL SELECT 'ped_crossing', {_TOKEN("ped_crossing", "id")}, {_TOKEN("area_polygon", "id")}, '' FROM t WHERE type = 'crosswalk' UNION ALL SELECT 'walkway', {_TOKEN("walkway", "id")}, {_TOKEN("area_polygon", "id")}, NULL FROM t WHERE type = 'offroad'
      UNION ALL SELECT 'drivable_area', {_TOKEN("drivable_area", "'all'")}, CAST(count(*) AS VARCHAR), NULL FROM t WHERE type = 'intersection'"""),
    # s and t say where the lines of both sections meet, from their middles on; a sector of 100 points has 99 triangles
    "turn_fillers": (turn_fillers, f"""WITH {_P}, q AS (SELECT line_id, pos, x, y, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
      u AS (SELECT line_id, pos, (x1 - x2) / sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS ux, (y1 - y2) / sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS uy, (x - x1) / sqrt((x - x1) ** 2 + (y - y1) ** 2) AS vx, (y - y1) / sqrt((x - x1) ** 2 + (y - y1) ** 2) AS vy FROM q WHERE x2 IS NOT NULL),
      m AS (SELECT *, ux * vy - uy * vx AS turn, 3 * (ux + vx) AS dx, 3 * (uy + vy) AS dy FROM u), st AS (SELECT *, (dx * vx + dy * vy) / turn AS s, (dx * ux + dy * uy) / turn AS t, CASE WHEN turn > 0 THEN -20 ELSE 20 END AS side FROM m WHERE turn <> 0),
      c AS (SELECT *, abs(s) <= 20 AND abs(t) <= 20 AS crossed, sign(side - s) AS fs, sign(side - t) AS ft FROM st WHERE abs(s) <= 70 AND abs(t) <= 70),
      a AS (SELECT *, CASE WHEN crossed THEN atan2(fs * ux, -fs * uy) ELSE atan2(-ux, uy) END AS a0, CASE WHEN crossed THEN atan2(ft * vx, -ft * vy) ELSE atan2(-vx, vy) END AS a1 FROM c),
      w AS (SELECT *, CASE WHEN abs(a0 - a1) > pi() THEN abs(abs(a0 - a1) - 2 * pi()) ELSE abs(a0 - a1) END + 0.1 AS sweep FROM a)
      SELECT line_id, pos, CAST(CASE WHEN crossed THEN 101 ELSE 200 END AS BIGINT) AS n, round(99 / 2.0 * sin(sweep / 99) * CASE WHEN crossed THEN least(abs(side - s), abs(side - t)) ** 2
        ELSE abs(least(abs(s) + 20, abs(t) + 20) ** 2 - greatest(greatest(abs(s) - 20, 0), greatest(abs(t) - 20, 0)) ** 2) END, 4) AS area FROM w"""),
    "warped_strips": (warped_strips, f"WITH {_STRIP} SELECT line_id, count(*) AS n, CAST(sum(CASE WHEN is_set THEN r * 100 + c ELSE 0 END) AS BIGINT) AS places FROM w GROUP BY line_id"),
    "unwarped_masks": (unwarped_masks, f"WITH {_STRIP}, o AS (SELECT DISTINCT line_id, src_row, src_col FROM w WHERE is_set) SELECT line_id, count(*) AS n, CAST(sum(src_row * 100 + src_col) AS BIGINT) AS places FROM o GROUP BY line_id"),
}
