"""Registered queries on polylines, places, masks and polygons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.functions import fixtures as fx
from lanewright.functions import geom
from lanewright.operators import lanes, overlay, polyline, raster

_R6 = lambda c: (F.round(c, 6) + 0.0)  # noqa: E731  no negative zero
_P = "p AS (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS y, 10.0 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS x FROM events)"
_W = "WINDOW w AS (PARTITION BY line_id ORDER BY pos)"
_M = f"""{_P}, q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p {_W}), s AS (SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS seg FROM q),
  c AS (SELECT *, sum(seg) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM s),
  m AS (SELECT *, coalesce(lag(cum) OVER w, 0) AS before, max(cum) OVER (PARTITION BY line_id) AS total FROM c {_W})"""


def polyline_length(spark, d):
    a = polyline.as_arrays(fx.lines(spark, d))
    return a.select("line_id", F.size("pts").cast("long").alias("n"), _R6(geom.length(F.col("pts"))).alias("length"))


def cumdist(spark, d):
    return polyline.measured(fx.lines(spark, d)).select("line_id", F.col("pos").cast("long").alias("pos"), _R6("seg").alias("seg"), _R6("cum").alias("cum"))


def line_bounds(spark, d):
    b = polyline.as_arrays(fx.lines(spark, d)).select("line_id", geom.bounds(F.col("pts"), 0.2).alias("b"))
    return b.select("line_id", *(_R6(f"b.{k}").alias(k) for k in ("minx", "miny", "maxx", "maxy")))


def _rounded(df, *keys):
    return df.select(*(F.col(k).cast("long").alias(k) if k == "pos" else F.col(k) for k in keys), _R6("x").alias("x"), _R6("y").alias("y"))


def trim(spark, d):
    return _rounded(polyline.trim(fx.lines(spark, d), 25.0, 0.25), "line_id", "pos")


def split(spark, d):
    return _rounded(polyline.split(fx.lines(spark, d), 120.0), "line_id", "part", "pos")


def resample(spark, d):
    return _rounded(polyline.resample(fx.lines(spark, d), 7.5), "line_id", "pos")


def offset(spark, d):
    return _rounded(polyline.offset(fx.lines(spark, d), 1.75), "line_id", "pos")


def turn_angles(spark, d):
    return polyline.turn_angles(fx.lines(spark, d)).select("line_id", F.col("pos").cast("long").alias("pos"), _R6("angle").alias("angle"))


def line_fit(spark, d):
    return polyline.fit_lines(fx.lines(spark, d)).select("line_id", _R6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), _R6("length").alias("length"))


def simplified(spark, d):
    return polyline.simplify(fx.lines(spark, d), 20.0).withColumn("pos", F.col("pos").cast("long"))


def hulls(spark, d):
    return polyline.hulls(fx.point_groups(spark, d), "grp").select("grp", F.size("ring").cast("long").alias("n"), "area")


def utm(spark, d):
    u = fx.places(spark, d).select("id", geom.utm31(F.col("lon"), F.col("lat")).alias("p"))
    back = u.withColumn("q", geom.utm31_inverse(F.col("p.x"), F.col("p.y")))
    return back.select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("q.x", 6).alias("lon"), F.round("q.y", 6).alias("lat"))


def haversine(spark, d):
    p = fx.places(spark, d)
    return p.select("id", F.round(geom.haversine(F.col("lat"), F.col("lon"), F.lit(52.0), F.lit(4.35)), 3).alias("metres"))


_AFFINE = (0.5, 0.0, 592900.0, 0.0, -0.5, 5763500.0)


def pixel(spark, d):
    n = fx.nodes(spark, d).select("id", geom.geo_to_pixel(F.col("x") + 0.3, F.col("y") + 0.3, _AFFINE).alias("p"))
    g = n.withColumn("g", geom.pixel_to_geo(F.col("p.col"), F.col("p.row"), _AFFINE))
    return g.select("id", "p.col", "p.row", F.col("g.x").alias("gx"), F.col("g.y").alias("gy"))


def point_in_polygon(spark, d):
    """Nodes within the rectangles' union (scaled onto the grid), through a bucket of rectangles."""
    r = fx.rectangles(spark, d).select(F.col("id").alias("rect_id"), overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"), "x0", "y0", "x1", "y1")
    n = fx.nodes(spark, d).select("id", (F.col("gx") * 12 + 0.5).alias("x"), (F.col("gy") * 9 + 0.5).alias("y"))
    cell = lambda v: F.floor(v / 64).cast("long")
    r = r.withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    j = n.join(r, (cell(F.col("x")) == F.col("cx")) & (cell(F.col("y")) == F.col("cy")) & geom.inside(F.col("x"), F.col("y"), F.col("ring")))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n_rects"))


def line_intersections(spark, d):
    """Consecutive segments of each line against the chord of the line's first and last vertex."""
    p = polyline.measured(fx.lines(spark, d))
    e = fx.lines(spark, d).groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    j = p.filter("pos > 0").join(e, "line_id")
    i = geom.line_intersection(F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct("x", "y"), F.col("a"), F.col("b"))
    return j.select("line_id", "pos", i.alias("i")).filter("i.within").select("line_id", F.col("pos").cast("long").alias("pos"), _R6("i.x").alias("x"), _R6("i.y").alias("y"))


def side_of_chord(spark, d):
    e = fx.lines(spark, d).groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    j = fx.lines(spark, d).join(e, "line_id")
    s = geom.side_of_line(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return j.groupBy("line_id").agg(F.sum(F.when(s > 0, 1).otherwise(0)).alias("n_left"), F.sum(F.when(s < 0, 1).otherwise(0)).alias("n_right"))


def extended_segments(spark, d):
    r = fx.rectangles(spark, d).select("id", geom.extend_segment(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), 2.5).alias("s"))
    return r.select("id", *(_R6(F.col("s")[i][k]).alias(f"{k}{i}") for i in (0, 1) for k in "xy"))


def arcs(spark, d):
    r = fx.rectangles(spark, d).select("id", geom.arc(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.lit(0.0), F.radians(F.lit(90.0)), 5).alias("a"))
    return r.select("id", F.posexplode("a").alias("k", "p")).select("id", "k", _R6("p.x").alias("x"), _R6("p.y").alias("y"))


# -- masks ------------------------------------------------------------------------------------------


def _pairs(spark, d, step=1):
    m = fx.masks(spark, d).select("mask_id", "label", "cells")
    other = m.select((F.col("mask_id") - step).alias("mask_id"), F.col("cells").alias("other"))
    return m.join(other, "mask_id")


def mask_iou(spark, d):
    return _pairs(spark, d).select("mask_id", _R6(raster.iou(F.col("cells"), F.col("other"))).alias("iou"))


def mask_union(spark, d):
    return raster.union_of(fx.pixels(spark, d), "label")


def mask_and_or(spark, d):
    p = _pairs(spark, d)
    return p.select("mask_id", raster.count_true(raster.mask_and(F.col("cells"), F.col("other"))).cast("long").alias("n_and"), raster.count_true(raster.mask_or(F.col("cells"), F.col("other"))).cast("long").alias("n_or"))


def band_fit(spark, d):
    b = fx.masks(spark, d).select("mask_id", raster.best_band(F.col("cells"), 8, 8).alias("b"))
    return b.select("mask_id", _R6("b.score").alias("score"), ((F.col("b.lo") + F.col("b.hi")) / 2).alias("center"), (F.col("b.hi") - F.col("b.lo")).cast("long").alias("width"))


def pool_max(spark, d):
    p = fx.pixels(spark, d).withColumn("value", F.when(F.col("is_set"), F.round(1000 * F.col("value"))).otherwise(0.0))
    return raster.pool_blocks(p, 3).select("mask_id", "brow", "bcol", _R6("prob").alias("prob"), "row", "col")


def resample_mean(spark, d):
    p = fx.pixels(spark, d).withColumn("value", F.round(1000 * F.col("value")))
    return raster.resample_mean(p, 2).select("mask_id", "row", "col", _R6("value").alias("value"))


def mask_runs(spark, d):
    return raster.column_runs(fx.pixels(spark, d))


def closed_masks(spark, d):
    c = raster.close_mask(fx.pixels(spark, d).select("mask_id", "row", "col", "is_set"))
    return c.filter("is_set").groupBy("mask_id").agg(F.count(F.lit(1)).alias("n_set"), F.sum(F.col("row") * 8 + F.col("col")).alias("places"))


def opened_masks(spark, d):
    c = raster.open_mask(fx.pixels(spark, d).select("mask_id", "row", "col", "is_set"))
    return c.filter("is_set").groupBy("mask_id").agg(F.count(F.lit(1)).alias("n_set"), F.sum(F.col("row") * 8 + F.col("col")).alias("places"))


def filled_masks(spark, d):
    c = raster.fill_cavities(fx.pixels(spark, d).select("mask_id", "row", "col", "is_set"))
    return c.filter("is_set").groupBy("mask_id").agg(F.count(F.lit(1)).alias("n_set"), F.sum(F.col("row") * 8 + F.col("col")).alias("places"))


def distance_map(spark, d):
    m = fx.masks(spark, d).select("mask_id", F.posexplode(raster.distance_map(F.col("cells"), 8, 8)).alias("i", "dist"))
    return m.groupBy("mask_id").agg(F.max("dist").alias("far"), F.round(F.sum("dist"), 6).alias("total"))


def best_mask(spark, d):
    """Of each label the mask with the best band, among those that overlap three other masks little enough and are wide enough."""
    m = fx.masks(spark, d).select("mask_id", "label", "cells")
    names = ("tree", "house", "water")
    # one exchange: each mask goes to itself and to the three before it
    sent = m.select(F.explode(F.array(*(F.struct((F.col("mask_id") - k).alias("to"), F.lit(k).alias("k")) for k in range(4)))).alias("s"), "label", "cells")
    of = lambda k, c: F.max(F.when(F.col("s.k") == k, F.col(c)))
    m = sent.groupBy(F.col("s.to").alias("mask_id")).agg(of(0, "label").alias("label"), of(0, "cells").alias("cells"), *(of(k, "cells").alias(name) for k, name in enumerate(names, 1)))
    m = m.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("cells", *names)))
    ok = raster.count_true(F.col("cells")) > 0
    for name in names:
        ok = ok & raster.passes(raster.iou(F.col("cells"), F.col(name)), 0.33)
    c = m.filter(ok).select("mask_id", "label", raster.best_band(F.col("cells"), 8, 8).alias("b")).select("mask_id", "label", _R6("b.score").alias("score"), (F.col("b.hi") - F.col("b.lo")).cast("long").alias("width")).filter("width >= 3")
    return raster.select_best(c, "label", "score", "mask_id")


def rasterized(spark, d):
    r = fx.rectangles(spark, d).select("id", overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"))
    return raster.ring_runs(r).groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"), F.min("row").alias("r0"), (F.max("stop") - 1).alias("c1"))


def section_merge(spark, d):
    """Events as sections of lanes; those of one type have no score."""
    e = fx.table(spark, d, "events")
    s = e.select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("lane_id"), F.abs("value").alias("width"), F.lit(2.5).alias("length"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return lanes.combine_sections(s)


def weighted_centres(spark, d):
    """Centre and width means of each label's masks, weighted by squared share of the inverse scores."""
    b = fx.masks(spark, d).select("label", raster.best_band(F.col("cells"), 8, 8).alias("b")).select("label", ((F.col("b.lo") + F.col("b.hi")) / 2).alias("c"), F.round("b.score", 6).alias("s"))
    t = b.groupBy("label").agg(F.sum("s").alias("total"))
    w = F.pow(F.col("total") / F.col("s"), 2)
    return b.join(t, "label").groupBy("label").agg(F.round(F.sum(w * F.col("c")) / F.sum(w), 6).alias("center"))


# -- polygons ---------------------------------------------------------------------------------------


def _rings(spark, d):
    r = fx.rectangles(spark, d)
    return r, r.withColumn("ring", overlay.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def coverage_metrics(spark, d):
    r, g = _rings(spark, d)
    m = overlay.coverage_metrics(g.filter("truth"), g.filter("not truth"), overlay.grown_rectangles(r.filter("truth"), 2.0))
    return m.select(*(_R6(c).alias(c) for c in m.columns))


def overlay_areas(spark, d):
    r, g = _rings(spark, d)
    p = g.select(F.when(F.col("truth"), F.lit("A")).otherwise(F.lit("B")).alias("layer"), "ring")
    return overlay.overlay_areas(p, 64.0).select(*(F.round(c, 4).alias(c) for c in ("a", "b", "a_and_b")))


def area_sums(spark, d):
    _, g = _rings(spark, d)
    return g.groupBy("truth").agg(F.sum(geom.ring_area(F.col("ring"))).alias("area"))


def round_buffers(spark, d):
    _, g = _rings(spark, d)
    b = overlay.buffered(g.select("ring"), 2.0)
    p = g.select(F.lit("A").alias("layer"), "ring").union(b.select(F.lit("M"), "ring"))
    return overlay.overlay_areas(p, 64.0).select(F.round("a", 3).alias("a"), F.round("mask", 3).alias("mask"))


def truth_filter(spark, d):
    """Lanes that aren't cycle lanes: parts of brand 3 go, parts without a type stay."""
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size") % 5).alias("road_type"), F.array().cast("array<struct<x:double,y:double>>").alias("ring"))
    return p.filter(~F.col("road_type").eqNullSafe(3)).select("id", "road_type")


_RECT = "r AS (SELECT p_partkey AS id, p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') AS truth, 10 * (p_partkey % 50) AS x0, 10 * (p_partkey // 50) AS y0, 10 * (p_partkey % 50) + p_size AS x1, 10 * (p_partkey // 50) + 51 - p_size AS y1 FROM part)"
_CELLS = f"""{_RECT}, grid AS (SELECT truth, unnest(range(x0, x1)) AS x, y0, y1, x0, x1 FROM r), cells AS (SELECT DISTINCT truth, x, unnest(range(y0, y1)) AS y FROM grid),
  a AS (SELECT x, y FROM cells WHERE truth), b AS (SELECT x, y FROM cells WHERE NOT truth)"""
_PIX = "px AS (SELECT vec_id AS mask_id, label, i // 8 AS row, i % 8 AS col, CAST(embedding[i + 1] AS DOUBLE) AS value, embedding[i + 1] > 0 AS is_set FROM embeddings, range(64) t(i))"
_PAIR = f"{_PIX}, pair AS (SELECT a.mask_id, sum(CASE WHEN a.is_set AND b.is_set THEN 1 ELSE 0 END) AS i, sum(CASE WHEN a.is_set OR b.is_set THEN 1 ELSE 0 END) AS u FROM px a JOIN px b ON b.mask_id = a.mask_id + 1 AND b.row = a.row AND b.col = a.col GROUP BY a.mask_id)"
_BAND = """rs AS (SELECT mask_id, label, row, sum(CASE WHEN is_set THEN 1 ELSE 0 END) AS n FROM px GROUP BY mask_id, label, row), tot AS (SELECT mask_id, sum(n) AS s FROM rs GROUP BY mask_id),
  ab AS (SELECT rs.mask_id, rs.label, lo, hi, sum(n) AS i FROM rs, range(8) t1(lo), range(1, 9) t2(hi) WHERE lo < hi AND row >= lo AND row < hi GROUP BY rs.mask_id, rs.label, lo, hi),
  sc AS (SELECT ab.mask_id, label, lo, hi, 1 / (i / ((s + (hi - lo) * 8 - i - i) + 1e-8) + 1e-8) AS score FROM ab JOIN tot USING (mask_id)),
  band AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY score, lo, hi) AS rn FROM sc) WHERE rn = 1)"""


def _step(src, how):
    return f"SELECT a.mask_id, a.row, a.col, {'bool_or' if how == 'max' else 'bool_and'}(b.is_set) AS is_set FROM {src} a JOIN {src} b ON a.mask_id = b.mask_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.mask_id, a.row, a.col"


def _morph(first, second):
    """SQL of two steps over 3 x 3 squares: max dilates, min erodes."""
    return f"WITH {_PIX}, s1 AS ({_step('px', first)}), s2 AS ({_step('s1', second)}) SELECT mask_id, count(*) AS n_set, CAST(sum(row * 8 + col) AS BIGINT) AS places FROM s2 WHERE is_set GROUP BY mask_id"


_ENDS = "e AS (SELECT line_id, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS b_y FROM p GROUP BY line_id)"
QUERIES = {
    "polyline_length": (polyline_length, f"WITH {_M} SELECT line_id, count(*) AS n, round(max(cum), 6) AS length FROM m GROUP BY line_id"),
    "cumdist": (cumdist, f"WITH {_M} SELECT line_id, pos, round(seg, 6) AS seg, round(cum, 6) AS cum FROM m"),
    "line_bounds": (line_bounds, f"WITH {_P}, b AS (SELECT line_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY line_id), g AS (SELECT *, 0.2 * greatest(x1 - x0, y1 - y0) AS k FROM b) SELECT line_id, round(x0 - k, 6) AS minx, round(y0 - k, 6) AS miny, round(x1 + k, 6) AS maxx, round(y1 + k, 6) AS maxy FROM g"),
    "trim": (trim, f"""WITH {_M}, d AS (SELECT *, least(25.0, 0.25 * total) AS d FROM m), o AS (
      SELECT line_id, pos, 0 AS k, px + (d - before) / seg * (x - px) AS x, py + (d - before) / seg * (y - py) AS y FROM d WHERE before <= d AND d < cum AND 2 * d < total
      UNION ALL SELECT line_id, pos, 1, x, y FROM d WHERE cum > d AND cum < total - d
      UNION ALL SELECT line_id, pos, 2, px + (total - d - before) / seg * (x - px), py + (total - d - before) / seg * (y - py) FROM d WHERE before < total - d AND total - d <= cum AND 2 * d < total)
      SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos, k) - 1 AS pos, round(x, 6) AS x, round(y, 6) AS y FROM o"""),
    "split": (split, f"""WITH {_M}, n AS (SELECT *, CAST(floor(total / 120) + 1 AS INT) AS n, total / (floor(total / 120) + 1) AS w FROM m),
      k AS (SELECT *, unnest(range(greatest(1, CAST(floor(before / w) AS INT)), CAST(floor(cum / w) AS INT) + 2)) AS k FROM n), cut AS (SELECT * FROM k WHERE k < n AND k * w > before AND k * w <= cum),
      o AS (SELECT line_id, CAST(k - 1 AS INT) AS part, pos, 2 * k AS o, px + (k * w - before) / seg * (x - px) AS x, py + (k * w - before) / seg * (y - py) AS y FROM cut
        UNION ALL SELECT line_id, CAST(k AS INT), pos, 2 * k + 1, px + (k * w - before) / seg * (x - px), py + (k * w - before) / seg * (y - py) FROM cut
        UNION ALL SELECT line_id, least(CAST(floor(cum / w) AS INT), n - 1), pos, 1000000, x, y FROM n WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.line_id = n.line_id AND cut.pos = n.pos AND cut.k * cut.w = n.cum))
      SELECT line_id, part, row_number() OVER (PARTITION BY line_id, part ORDER BY pos, o) - 1 AS pos, round(x, 6) AS x, round(y, 6) AS y FROM o"""),
    "resample": (resample, f"""WITH {_M}, k AS (SELECT *, unnest(range(CAST(floor(before / 7.5) AS INT) + 1, CAST(floor(cum / 7.5) AS INT) + 1)) AS k FROM m WHERE seg > 0)
      SELECT line_id, CAST(k AS BIGINT) AS pos, round(px + (k * 7.5 - before) / seg * (x - px), 6) AS x, round(py + (k * 7.5 - before) / seg * (y - py), 6) AS y FROM k WHERE k * 7.5 < total
      UNION ALL SELECT line_id, 0, round(x, 6), round(y, 6) FROM m WHERE pos = 0 AND total > 0"""),
    "offset": (offset, f"""WITH {_P}, q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p {_W}),
      u AS (SELECT *, (x - px) / sqrt((x - px) ** 2 + (y - py) ** 2) AS ax, (y - py) / sqrt((x - px) ** 2 + (y - py) ** 2) AS ay, (nx - x) / sqrt((nx - x) ** 2 + (ny - y) ** 2) AS bx, (ny - y) / sqrt((nx - x) ** 2 + (ny - y) ** 2) AS b_y FROM q),
      v AS (SELECT line_id, pos, x, y, -(coalesce(ay, b_y) + coalesce(b_y, ay)) AS sx, coalesce(ax, bx) + coalesce(bx, ax) AS sy FROM u),
      t AS (SELECT *, sqrt(sx ** 2 + sy ** 2) AS h FROM v)
      SELECT line_id, pos, round(x + 1.75 * least(3, 2 / greatest(h * h, 1e-9) * h) / greatest(h, 1e-9) * sx, 6) AS x, round(y + 1.75 * least(3, 2 / greatest(h * h, 1e-9) * h) / greatest(h, 1e-9) * sy, 6) AS y FROM t"""),
    "turn_angles": (turn_angles, f"""WITH {_P}, q AS (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS b_y FROM p {_W})
      SELECT line_id, pos, round(acos(greatest(-1, least(1, (ax * bx + ay * b_y) / (sqrt(ax ** 2 + ay ** 2) * sqrt(bx ** 2 + b_y ** 2))))), 6) AS angle FROM q WHERE ax IS NOT NULL AND bx IS NOT NULL"""),
    "line_fit": (line_fit, f"""WITH {_P}, {_ENDS}, a AS (SELECT *, atan2(b_y - ay, bx - ax) AS t FROM e), f AS (SELECT line_id, (x - ax) * cos(t) + (y - ay) * sin(t) AS u, (y - ay) * cos(t) - (x - ax) * sin(t) AS v, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS l FROM p JOIN a USING (line_id))
      SELECT line_id, round(regr_slope(v, u), 6) AS slope, round(regr_intercept(v, u), 4) AS intercept, round(max(l), 6) AS length FROM f GROUP BY line_id"""),
    # a stretch whose farthest vertex is beyond the tolerance is cut there; the ends of all stretches stay
    "simplified": (simplified, f"""WITH RECURSIVE {_P}, seg AS (
      SELECT line_id, CAST(min(pos) AS BIGINT) AS a, CAST(max(pos) AS BIGINT) AS b FROM p GROUP BY line_id
      UNION ALL SELECT line_id, CASE WHEN half = 0 THEN a ELSE k END, CASE WHEN half = 0 THEN k ELSE b END FROM (
        SELECT line_id, a, b, arg_min(pos, (-far, pos)) AS k FROM (
          SELECT line_id, a, b, pos, sqrt((vx - fx - t * (lx - fx)) ** 2 + (vy - fy - t * (ly - fy)) ** 2) AS far FROM (
            SELECT s.line_id, s.a, s.b, v.pos, v.x AS vx, v.y AS vy, f.x AS fx, f.y AS fy, l.x AS lx, l.y AS ly, greatest(0.0, least(1.0, ((v.x - f.x) * (l.x - f.x) + (v.y - f.y) * (l.y - f.y)) / ((l.x - f.x) ** 2 + (l.y - f.y) ** 2))) AS t
            FROM seg s JOIN p f ON f.line_id = s.line_id AND f.pos = s.a JOIN p l ON l.line_id = s.line_id AND l.pos = s.b JOIN p v ON v.line_id = s.line_id AND v.pos > s.a AND v.pos < s.b))
        GROUP BY line_id, a, b HAVING max(far) > 20.0) c, range(2) h(half))
      SELECT line_id, pos, CAST(x AS DOUBLE) AS x, y FROM (SELECT line_id, a AS pos FROM seg UNION SELECT line_id, b FROM seg) JOIN p USING (line_id, pos)"""),
    "hulls": (hulls, """WITH g AS (SELECT DISTINCT label AS grp, round(1e4 * CAST(embedding[1] AS DOUBLE)) AS x, round(1e4 * CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings),
      pq AS (SELECT p.grp, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM g p JOIN g q ON p.grp = q.grp AND (p.x <> q.x OR p.y <> q.y)
        WHERE NOT EXISTS (SELECT 1 FROM g r WHERE r.grp = p.grp AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0))))
      SELECT grp, count(*) AS n, sum(px * qy - qx * py) / 2 AS area FROM pq GROUP BY grp"""),
    "utm": (utm, "WITH p AS (SELECT s_suppkey AS id, CAST(4.35 + 0.0001 * s_suppkey AS DOUBLE) AS lon, CAST(52.0 + 0.0001 * s_suppkey AS DOUBLE) AS lat FROM supplier), " + geom.utm_sql("lon", "lat", "p") + " SELECT id, round(ux, 3) AS x, round(uy, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM u3"),
    "haversine": (haversine, """WITH p AS (SELECT s_suppkey AS id, radians(4.35 + 0.0001 * s_suppkey) AS lon, radians(52.0 + 0.0001 * s_suppkey) AS lat FROM supplier),
      a AS (SELECT id, sin((radians(52.0) - lat) / 2) ** 2 + cos(lat) * cos(radians(52.0)) * sin((radians(4.35) - lon) / 2) ** 2 AS a FROM p) SELECT id, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM a"""),
    "pixel": (pixel, """WITH n AS (SELECT c_custkey AS id, 593000.0 + 50 * (c_custkey % 40) + 0.3 AS x, 5762000.0 + 50 * (c_custkey // 40) + 0.3 AS y FROM customer),
      q AS (SELECT id, CAST(trunc((x - 592900) / 0.5) AS INT) AS col, CAST(trunc((y - 5763500) / -0.5) AS INT) AS row FROM n) SELECT id, col, row, 0.5 * col + 592900.0 AS gx, -0.5 * row + 5763500.0 AS gy FROM q"""),
    "point_in_polygon": (point_in_polygon, f"WITH {_RECT}, n AS (SELECT c_custkey AS id, (c_custkey % 40) * 12 + 0.5 AS x, (c_custkey // 40) * 9 + 0.5 AS y FROM customer) SELECT n.id, count(*) AS n_rects FROM n JOIN r ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY n.id"),
    "line_intersections": (line_intersections, f"""WITH {_P}, {_ENDS}, q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p {_W}), j AS (SELECT line_id, pos, px, py, x - px AS rx, y - py AS ry, bx - ax AS sx, b_y - ay AS sy, ax - px AS dx, ay - py AS dy FROM q JOIN e USING (line_id) WHERE pos > 0),
      t AS (SELECT *, (dx * sy - dy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (dx * ry - dy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM j) SELECT line_id, pos, round(px + t * rx, 6) AS x, round(py + t * ry, 6) AS y FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""),
    "side_of_chord": (side_of_chord, f"WITH {_P}, {_ENDS}, s AS (SELECT line_id, (bx - ax) * (y - ay) - (b_y - ay) * (x - ax) AS s FROM p JOIN e USING (line_id)) SELECT line_id, CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN s < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM s GROUP BY line_id"),
    "extended_segments": (extended_segments, f"WITH {_RECT}, n AS (SELECT *, 2.5 * (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS u, 2.5 * (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS v FROM r) SELECT id, round(x0 - u, 6) AS x0, round(y0 - v, 6) AS y0, round(x1 + u, 6) AS x1, round(y1 + v, 6) AS y1 FROM n"),
    "arcs": (arcs, f"WITH {_RECT}, k AS (SELECT id, x0, y0, x1 - x0 AS r, CAST(k AS INT) AS k, -0.05 + (pi() / 2 + 0.1) * k / 4 AS t FROM r, range(5) g(k)) SELECT id, k, round(x0 + r * cos(t), 6) AS x, round(y0 + r * sin(t), 6) AS y FROM k"),
    "mask_iou": (mask_iou, f"WITH {_PAIR} SELECT mask_id, round(i / nullif(u, 0), 6) AS iou FROM pair"),
    "mask_and_or": (mask_and_or, f"WITH {_PAIR} SELECT mask_id, CAST(i AS BIGINT) AS n_and, CAST(u AS BIGINT) AS n_or FROM pair"),
    "mask_union": (mask_union, f"WITH {_PIX} SELECT DISTINCT label, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM px WHERE is_set"),
    "band_fit": (band_fit, f"WITH {_PIX}, {_BAND} SELECT mask_id, round(score, 6) AS score, (lo + hi) / 2 AS center, CAST(hi - lo AS BIGINT) AS width FROM band"),
    "pool_max": (pool_max, f"""WITH {_PIX}, v AS (SELECT mask_id, row, col, CASE WHEN is_set THEN round(1000 * value) ELSE 0 END AS value FROM px), t AS (SELECT mask_id, sum(value) AS t FROM v GROUP BY mask_id),
      b AS (SELECT *, row // 3 AS brow, col // 3 AS bcol FROM v WHERE row < 6 AND col < 6), s AS (SELECT mask_id, brow, bcol, sum(value) AS s FROM b GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY mask_id, brow, bcol ORDER BY value DESC, row, col) AS rn FROM b)
      SELECT mask_id, CAST(brow AS INT) AS brow, CAST(bcol AS INT) AS bcol, CASE WHEN t = 0 THEN 0 ELSE round(s / t, 6) END AS prob, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM x JOIN s USING (mask_id, brow, bcol) JOIN t USING (mask_id) WHERE rn = 1"""),
    "resample_mean": (resample_mean, f"WITH {_PIX} SELECT mask_id, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(avg(round(1000 * value)), 6) + 0.0 AS value FROM px GROUP BY mask_id, row // 2, col // 2"),
    "mask_runs": (mask_runs, f"""WITH {_PIX}, s AS (SELECT *, row - row_number() OVER (PARTITION BY mask_id, col ORDER BY row) AS g FROM px WHERE is_set) SELECT mask_id, CAST(col AS INT) AS col, CAST(min(row) AS INT) AS start, CAST(max(row) + 1 AS INT) AS stop FROM s GROUP BY mask_id, col, g"""),
    "closed_masks": (closed_masks, _morph("max", "min")),
    "opened_masks": (opened_masks, _morph("min", "max")),
    "filled_masks": (filled_masks, f"""WITH {_PIX}, c1 AS ({_step('px', 'max')}), c2 AS ({_step('c1', 'min')}), o1 AS ({_step('px', 'min')}), o2 AS ({_step('o1', 'max')})
      SELECT mask_id, count(*) AS n_set, CAST(sum(row * 8 + col) AS BIGINT) AS places FROM c2 JOIN o2 USING (mask_id, row, col) WHERE c2.is_set AND o2.is_set GROUP BY mask_id"""),
    "distance_map": (distance_map, f"""WITH {_PIX}, z AS (SELECT mask_id, row, col FROM px WHERE NOT is_set UNION ALL SELECT vec_id, r, c FROM embeddings, range(-1, 9) a(r), range(-1, 9) b(c) WHERE r IN (-1, 8) OR c IN (-1, 8)),
      d AS (SELECT p.mask_id, p.row, p.col, CASE WHEN p.is_set THEN sqrt(min((p.row - z.row) ** 2 + (p.col - z.col) ** 2)) ELSE 0 END AS dist FROM px p JOIN z USING (mask_id) GROUP BY p.mask_id, p.row, p.col, p.is_set)
      SELECT mask_id, max(dist) AS far, round(sum(dist), 6) AS total FROM d GROUP BY mask_id"""),
    "best_mask": (best_mask, f"""WITH {_PIX}, {_BAND}, o AS (SELECT a.mask_id, k, sum(CASE WHEN a.is_set AND b.is_set THEN 1 ELSE 0 END) AS i, sum(CASE WHEN a.is_set OR b.is_set THEN 1 ELSE 0 END) AS u FROM px a, range(1, 4) t(k), px b WHERE b.mask_id = a.mask_id + k AND b.row = a.row AND b.col = a.col GROUP BY a.mask_id, k),
      ok AS (SELECT mask_id FROM o GROUP BY mask_id HAVING count(*) = 3 AND bool_and(u = 0 OR i / u <= 0.33)), c AS (SELECT mask_id, label, round(score, 6) AS score, CAST(hi - lo AS BIGINT) AS width FROM band WHERE mask_id IN (SELECT mask_id FROM ok) AND mask_id IN (SELECT mask_id FROM tot WHERE s > 0) AND hi - lo >= 3)
      SELECT label, mask_id, score, width FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, mask_id) AS rn FROM c) WHERE rn = 1"""),
    "rasterized": (rasterized, f"WITH {_RECT} SELECT id, CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS n, CAST(y0 AS INT) AS r0, CAST(x1 - 1 AS INT) AS c1 FROM r"),
    "section_merge": (section_merge, "SELECT user_id * 100 + event_id % 37 AS lane_id, CASE WHEN NOT bool_or(event_type = 'error' OR value IS NULL) THEN max(abs(value)) END AS width, count(*) * 2.5 AS length, bool_or(event_type = 'error' OR value IS NULL) AS has_gap FROM events GROUP BY 1"),
    "weighted_centres": (weighted_centres, f"WITH {_PIX}, {_BAND}, b AS (SELECT label, (lo + hi) / 2 AS c, round(score, 6) AS s FROM band), t AS (SELECT label, sum(s) AS total FROM b GROUP BY label) SELECT label, round(sum((total / s) ** 2 * c) / sum((total / s) ** 2), 6) AS center FROM b JOIN t USING (label) GROUP BY label"),
    "coverage_metrics": (coverage_metrics, f"""WITH {_CELLS}, gm AS (SELECT unnest(range(x0 - 2, x1 + 2)) AS x, y0, y1 FROM r WHERE truth), m AS (SELECT DISTINCT x, unnest(range(y0 - 2, y1 + 2)) AS y FROM gm), buf AS (SELECT * FROM m EXCEPT SELECT * FROM a), bm AS (SELECT * FROM b INTERSECT SELECT * FROM m)
      SELECT round((SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM buf)) / (SELECT count(*) FROM buf), 6) AS buffer_covered, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM bm)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM bm)), 6) AS iou,
        round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM bm)) / (SELECT count(*) FROM a), 6) AS recall, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM bm)) / (SELECT count(*) FROM bm), 6) AS precision"""),
    "overlay_areas": (overlay_areas, f"WITH {_CELLS} SELECT CAST((SELECT count(*) FROM a) AS DOUBLE) AS a, CAST((SELECT count(*) FROM b) AS DOUBLE) AS b, CAST((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS DOUBLE) AS a_and_b"),
    "area_sums": (area_sums, f"WITH {_RECT} SELECT truth, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area FROM r GROUP BY truth"),
    "round_buffers": (round_buffers, None),
    "truth_filter": (truth_filter, "SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN p_size % 5 END AS road_type FROM part WHERE CASE WHEN p_size > 10 THEN p_size % 5 END IS DISTINCT FROM 3"),
}
