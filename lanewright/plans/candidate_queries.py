"""Registered queries on candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.functions import fixtures as fx
from lanewright.operators import candidates, polyline
from lanewright.plans.geometry_queries import _P, _PIX, _RECT


def small_boxes(spark, d):
    return candidates.small_boxes(fx.rectangles(spark, d), 30.0).select("id")


def boxes_or_image(spark, d):
    """Images are customers; those of one segment have no boxes."""
    c = fx.table(spark, d, "customer")
    images = c.select(F.col("c_custkey").alias("id"), F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    boxes = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x0"), F.lit(1.0).alias("y0"), (F.col("c_nationkey") + 5).cast("double").alias("x1"), F.lit(9.0).alias("y1"))
    return candidates.boxes_or_image(images, boxes, "id")


def _segments(spark, d):
    p = polyline.measured(fx.lines(spark, d)).filter("pos > 0")
    return p.select("line_id", F.col("pos").cast("long").alias("pos"), F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))


def flat_lines(spark, d):
    f = candidates.flat_lines(_segments(spark, d))
    return f.select("line_id", "pos", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def valid_lines(spark, d):
    a = polyline.as_arrays(fx.lines(spark, d))
    return a.select("line_id", candidates.valid_line(F.col("pts"), 1e6, 1e6, 0.05).alias("valid"))


def cluster_means(spark, d):
    p = fx.table(spark, d, "part").select((F.col("p_size") % 8 - 1).alias("label"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    m = candidates.cluster_means(p, "label", ["price", "size"])
    return m.select("label", F.round("price", 4).alias("price"), F.round("size", 6).alias("size"))


def local_maxima(spark, d):
    px = fx.pixels(spark, d).withColumn("value", F.round(1000 * F.col("value")))
    centres = px.filter("row = col").select("mask_id", F.col("row").alias("pos"), "row", "col")
    return candidates.local_maxima(centres, px.select("mask_id", "row", "col", "value"), 2, 0.5)


def centerline_choice(spark, d):
    """Order lines as candidates of their order: the first of each is the road."""
    li = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("l_discount") * 20, 4).alias("score"))
    c = li.select(F.col("l_orderkey").alias("lane_id"), F.when(F.col("l_linenumber") == 1, "road").otherwise(F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))).alias("kind"), "score", F.col("l_linenumber").alias("order"))
    return candidates.choose_centerline(c, "lane_id")


def lane_offsets(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("lane_id"), F.lit(3.5).alias("width"), (F.col("p_size") % 4 + 1).alias("n_lanes"))
    return candidates.lane_offsets(p)


def feature_mask(spark, d):
    """A label's masks are a region's features; one with an id divisible by 50 is multi-part."""
    px = fx.pixels(spark, d).filter("is_set").withColumn("region", F.col("mask_id") % 60)
    f = px.select("region", (F.col("mask_id") % 50 == 0).alias("is_multi"))
    return candidates.feature_mask(f, px, "region").groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def smoothed_lines(spark, d):
    p = fx.lines(spark, d).select("line_id", "x", "y", (1 + F.col("pos") % 3).cast("double").alias("weight"))
    return candidates.smoothed(p, 1e-3)


_SEG = f"{_P}, q AS (SELECT line_id, pos, lag(x) OVER w AS x0, lag(y) OVER w AS y0, x AS x1, y AS y1 FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos)), s AS (SELECT *, (y1 - y0) / (x1 - x0 + 1e-5) AS slope FROM q WHERE pos > 0)"
QUERIES = {
    "small_boxes": (small_boxes, f"WITH {_RECT} SELECT id FROM r WHERE x1 - x0 < 30 AND y1 - y0 < 30"),
    "boxes_or_image": (boxes_or_image, "SELECT c_custkey AS id, CASE WHEN b THEN CAST(c_nationkey AS DOUBLE) ELSE 0 END AS x0, CASE WHEN b THEN 1.0 ELSE 0.0 END::DOUBLE AS y0, CASE WHEN b THEN CAST(c_nationkey + 5 AS DOUBLE) ELSE 640 END AS x1, CASE WHEN b THEN 9.0 ELSE 480.0 END::DOUBLE AS y1 FROM (SELECT *, c_mktsegment <> 'BUILDING' AS b FROM customer)"),
    "flat_lines": (flat_lines, f"WITH {_SEG} SELECT line_id, pos, round(slope, 6) AS slope, round(y0 - slope * x0, 4) AS intercept FROM s WHERE abs(slope) <= 0.08"),
    "valid_lines": (valid_lines, f"""WITH {_SEG}, v AS (SELECT line_id, pos, x1 - x0 AS dx, y1 - y0 AS dy FROM s WHERE x1 <> x0 OR y1 <> y0), t AS (SELECT line_id, dx, dy, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM v WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
      a AS (SELECT line_id, bool_and(pi() - acos(greatest(-1, least(1, (dx * ex + dy * ey) / (sqrt(dx ** 2 + dy ** 2) * sqrt(ex ** 2 + ey ** 2))))) >= 0.05) AS ok FROM t WHERE ex IS NOT NULL GROUP BY line_id), b AS (SELECT line_id, min(y) >= 0 AND max(y) <= 1e6 AND max(x) <= 1e6 AS inside FROM p GROUP BY line_id)
      SELECT line_id, inside AND coalesce(ok, true) AS valid FROM b LEFT JOIN a USING (line_id)"""),
    "cluster_means": (cluster_means, "SELECT p_size % 8 - 1 AS label, round(avg(p_retailprice), 4) AS price, round(avg(p_size), 6) AS size FROM part WHERE p_size % 8 <> 0 GROUP BY 1"),
    "local_maxima": (local_maxima, f"""WITH {_PIX}, v AS (SELECT mask_id, row, col, round(1000 * value) AS value FROM px), j AS (SELECT c.mask_id, c.row AS pos, p.row, p.col, p.value, row_number() OVER (PARTITION BY c.mask_id, c.row ORDER BY p.value DESC, p.row, p.col) AS rn
      FROM v c JOIN v p ON c.mask_id = p.mask_id AND c.row = c.col AND p.row >= c.row - 2 AND p.row < c.row + 2 AND p.col >= c.col - 2 AND p.col < c.col + 2), t AS (SELECT mask_id, max(value) AS top FROM v GROUP BY mask_id)
      SELECT mask_id, CAST(pos AS INT) AS pos, CAST(row AS INT) AS row, CAST(col AS INT) AS col, value FROM j JOIN t USING (mask_id) WHERE rn = 1 AND value > 0.5 * top"""),
    "centerline_choice": (centerline_choice, """WITH c AS (SELECT l_orderkey AS lane_id, CASE WHEN l_linenumber = 1 THEN 'road' ELSE 'line' || l_linenumber END AS kind, round(avg(l_discount) * 20, 4) AS score, l_linenumber AS o FROM lineitem GROUP BY l_orderkey, l_linenumber)
      SELECT lane_id, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY lane_id ORDER BY CASE WHEN kind = 'road' THEN greatest(score, 1.0) ELSE score END, o) AS rn FROM c) WHERE rn = 1"""),
    "lane_offsets": (lane_offsets, "SELECT p_partkey AS lane_id, CAST(i AS INT) AS lane, (i - (p_size % 4) / 2) * 3.5 AS \"offset\" FROM part, range(4) t(i) WHERE i <= p_size % 4"),
    "feature_mask": (feature_mask, f"WITH {_PIX}, f AS (SELECT *, mask_id % 60 AS region FROM px WHERE is_set) SELECT region, count(*) AS n FROM (SELECT DISTINCT region, row, col FROM f WHERE region NOT IN (SELECT region FROM f WHERE mask_id % 50 = 0)) GROUP BY region"),
    "smoothed_lines": (smoothed_lines, None),
}
