"""Candidate boxes, lines and centrelines: predicates, cluster means, local maxima, selection, smoothing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions.geom import angle_between, point

#: Distinct x of a smoothed line for each of its knots.
POINTS_A_KNOT = 4


def small_boxes(boxes: DataFrame, most: float = 200.0) -> DataFrame:
    """Boxes (x0, y0, x1, y1) with both sides strictly below ``most``."""
    return boxes.filter((F.col("x1") - F.col("x0") < most) & (F.col("y1") - F.col("y0") < most))


def boxes_or_image(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Each image's boxes; an image without any (key, w, h) is one box of its own size."""
    b = boxes.select(F.col(key).alias("__k"), "x0", "y0", "x1", "y1")
    j = images.join(b, F.col(key) == F.col("__k"), "left")
    none = F.col("__k").isNull()
    pick = lambda c, other: F.when(none, other).otherwise(F.col(c)).cast("double").alias(c)
    return j.select(key, pick("x0", F.lit(0.0)), pick("y0", F.lit(0.0)), pick("x1", F.col("w")), pick("y1", F.col("h")))


def flat_lines(segments: DataFrame, most: float = 0.08, eps: float = 1e-5) -> DataFrame:
    """Segments (x0, y0, x1, y1) of slope at most ``most``, with slope and intercept at x = 0."""
    s = segments.withColumn("slope", (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0") + eps)).filter(F.abs("slope") <= most)
    return s.withColumn("intercept", F.col("y0") - F.col("slope") * F.col("x0"))


def valid_line(pts: Column, height: float, width: float, least_angle: float = math.pi / 2, swapped: bool = False) -> Column:
    """Whether a pixel line stays in the image and has no inner angle below ``least_angle``.

    ``swapped`` compares x with the height and y with the width.  Steps of no length don't count.
    """
    mx, my = (height, width) if swapped else (width, height)
    good = F.forall(pts, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= mx) & (p["y"] <= my))
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    steps = F.filter(F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda p, q: point(q["x"] - p["x"], q["y"] - p["y"])), lambda v: (v["x"] != 0) | (v["y"] != 0))
    k = F.greatest(F.size(steps) - 1, F.lit(0))
    turns = F.zip_with(F.slice(steps, F.lit(1), k), F.slice(steps, F.lit(2), k), lambda u, v: math.pi - angle_between(u["x"], u["y"], v["x"], v["y"]))
    return good & F.forall(turns, lambda a: a >= least_angle)


def cluster_means(lines: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Means of ``values`` in each cluster; noise (label -1) is left out."""
    return lines.filter(F.col(key) != -1).groupBy(key).agg(*(F.avg(v).alias(v) for v in values))


def local_maxima(centres: DataFrame, pixels: DataFrame, reach: int, factor: float = 0.5) -> DataFrame:
    """(mask_id, pos, row, col, value): the greatest pixel in the window [p - reach, p + reach) around each centre, the first in row order.

    Only those above ``factor`` times the mask's greatest value stay.  Pixels meet centres in buckets of the reach.
    """
    cell = lambda v: F.floor(v / reach).cast("int")
    top = pixels.groupBy(F.col("mask_id").alias("top_id")).agg(F.max("value").alias("top"))
    p = pixels.select("mask_id", "row", "col", "value", cell(F.col("row")).alias("br"), cell(F.col("col")).alias("bc"))
    c = centres.select(F.col("mask_id").alias("c_id"), "pos", F.col("row").alias("cr"), F.col("col").alias("cc"))
    near = lambda v: F.sequence(cell(v) - 1, cell(v) + 1)
    c = c.withColumn("cbr", F.explode(near(F.col("cr")))).withColumn("cbc", F.explode(near(F.col("cc"))))
    within = (F.col("row") >= F.col("cr") - reach) & (F.col("row") < F.col("cr") + reach) & (F.col("col") >= F.col("cc") - reach) & (F.col("col") < F.col("cc") + reach)
    j = c.join(p, (F.col("c_id") == F.col("mask_id")) & (F.col("cbr") == F.col("br")) & (F.col("cbc") == F.col("bc"))).filter(within)
    m = j.groupBy("mask_id", "pos").agg(F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m"))
    m = m.join(top, F.col("mask_id") == F.col("top_id")).filter(F.col("m.value") > factor * F.col("top"))
    return m.select("mask_id", "pos", (-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"), F.col("m.value").alias("value"))


def choose_centerline(candidates: DataFrame, group: str, road_floor: float = 1.0) -> DataFrame:
    """The candidate (kind, score, order) of least score; that of kind ``road`` scores ``road_floor`` at least, so others win only below it."""
    score = F.when((F.col("kind") == "road") & F.col("score").isNotNull(), F.greatest("score", F.lit(road_floor))).otherwise(F.col("score"))
    c = candidates.withColumn("used", score).filter("used is not null")
    best = c.groupBy(group).agg(F.min_by(F.struct("kind", "score"), F.struct("used", "order")).alias("b"))
    return best.select(group, "b.kind", "b.score")


def lane_offsets(lanes: DataFrame) -> DataFrame:
    """(lane_id, lane, offset) of ``lanes`` side by side: (i - (n - 1) / 2) widths from the centre line."""
    e = lanes.select("lane_id", "width", "n_lanes", F.explode(F.sequence(F.lit(0), F.col("n_lanes") - 1)).alias("lane"))
    return e.select("lane_id", "lane", ((F.col("lane") - (F.col("n_lanes") - 1) / 2) * F.col("width")).alias("offset"))


def feature_mask(features: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Pixels (key, row, col) of a region's features; a region with any multi-part feature has none."""
    multi = features.groupBy(F.col(key).alias("__k")).agg(F.bool_or("is_multi").alias("multi")).filter("multi")
    return pixels.join(multi, F.col(key) == F.col("__k"), "left_anti").select(key, "row", "col").distinct()


def _cubic_basis(u: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the four cubic B-splines over ``knots`` (ends four times) that aren't 0 at each u, and the number of the first."""
    span = np.clip(np.searchsorted(knots, u, side="right") - 1, 3, len(knots) - 5)
    n = np.zeros((len(u), 4))
    n[:, 0] = 1
    for j in (1, 2, 3):
        saved = np.zeros(len(u))
        for r in range(j):
            right, left = knots[span + r + 1], knots[span + 1 - j + r]
            part = n[:, r] / (right - left)
            n[:, r], saved = saved + (right - u) * part, (u - left) * part
        n[:, j] = saved
    return span - 3, n


def _solve_band(band: list[list[float]], rhs: list[float]) -> np.ndarray:
    """Solution of a positive definite system; band[i][k] is its element (i, i + k), k up to 3."""
    n, d, low, z = len(rhs), [0.0] * len(rhs), [[0.0] * 4 for _ in rhs], list(rhs)
    for i in range(n):
        for j in range(max(0, i - 3), i):
            v = band[j][i - j] - sum(low[i][i - k] * low[j][j - k] * d[k] for k in range(max(0, i - 3), j))
            low[i][i - j] = v / d[j]
        d[i] = band[i][0] - sum(low[i][i - k] ** 2 * d[k] for k in range(max(0, i - 3), i))
        z[i] -= sum(low[i][i - k] * z[k] for k in range(max(0, i - 3), i))
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / d[i] - sum(low[k][k - i] * z[k] for k in range(i + 1, min(n, i + 4)))
    return np.array(z)


def smooth_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, smoothing: float, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of a cubic spline through weighted points, its squared curvature (x scaled to 0..1) penalised by ``smoothing``.

    Every POINTS_A_KNOT-th distinct x is a knot.
    """
    lo, span = x.min(), max(np.ptp(x), 1e-9)
    scaled = np.unique((x - lo) / span)
    inner = scaled[POINTS_A_KNOT : len(scaled) - POINTS_A_KNOT + 1 : POINTS_A_KNOT]
    knots = np.concatenate([np.zeros(4), inner, np.ones(4)])
    w, m = weight / weight.sum(), len(inner) + 4
    first, n = _cubic_basis((x - lo) / span, knots)
    band, rhs = np.zeros((m, 4)), np.zeros(m)
    for i in range(4):
        np.add.at(rhs, first + i, w * n[:, i] * y)
        for j in range(i, 4):
            np.add.at(band, (first + i, j - i), w * n[:, i] * n[:, j])
    # second derivatives at the distinct knots from coefficients k, k + 1, k + 2; between knots they are straight lines
    k = np.arange(m - 2)
    outer, one, two = 2 / (knots[k + 4] - knots[k + 2]), 3 / (knots[k + 4] - knots[k + 1]), 3 / (knots[k + 5] - knots[k + 2])
    bend = np.stack([outer * one, -outer * (one + two), outer * two, np.zeros(m - 2)], axis=1)
    h = np.diff(knots[3 : m + 1])
    here, there = bend[:-1], np.roll(bend[1:], 1, axis=1)  # both as weights of coefficients k to k + 3
    for i in range(4):
        for j in range(i, 4):
            pair = here[:, i] * here[:, j] + there[:, i] * there[:, j] + (here[:, i] * there[:, j] + there[:, i] * here[:, j]) / 2
            np.add.at(band, (k[:-1] + i, j - i), smoothing * h / 3 * pair)
    band[:, 0] += 1e-12
    c = _solve_band(band.tolist(), rhs.tolist())
    first, n = _cubic_basis((at - lo) / span, knots)
    return sum(c[first + i] * n[:, i] for i in range(4))


def smoothed(points: DataFrame, smoothing: float) -> DataFrame:
    """(line_id, pos, x, y): a smoothed line of each group of weighted points (line_id, x, y, weight), at every x; fewer than four points stay as they are."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        x, y, w = (pdf[c].to_numpy() for c in ("x", "y", "weight"))
        if len(x) >= 4 and w.sum() > 0:
            y = smooth_line(x, y, w, smoothing, x)
        return pd.DataFrame({"line_id": pdf["line_id"], "pos": range(len(pdf)), "x": x, "y": y})

    return points.select("line_id", "x", "y", "weight").groupBy("line_id").applyInPandas(one, f"line_id {points.schema['line_id'].dataType.simpleString()}, pos int, x double, y double")


def wedge(origin: Column, arc: Column, outer: Column | None = None) -> Column:
    """A turn filler: the ring of an arc and its origin, or of an arc and a second one walked backwards."""
    return F.concat(arc, F.reverse(outer)) if outer is not None else F.concat(arc, F.array(origin))


def _crossing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments (rows of two points) meet, and whether within both."""
    r, s, d = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0], b[:, 0] - a[:, 0]
    det = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / det, (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / det
    within = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return a[:, 0] + np.where(within, t, 0)[:, None] * r, within


def filler_rings(road: np.ndarray, first: np.ndarray, second: np.ndarray, reach: float, steps: int) -> list[np.ndarray | None]:
    """``turn_fillers`` of rows of three road points and two sections of two points each."""
    cross = lambda p, q: p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    turn = cross(road[:, 1] - road[:, 0], road[:, 2] - road[:, 1])
    outer = [(cross((road[:, k + 1] - road[:, k])[:, None], pair - road[:, k][:, None]) > 0) == (turn <= 0)[:, None] for k, pair in enumerate((first, second))]
    longer = []
    for pair in (first, second):
        along = pair[:, 1] - pair[:, 0]
        along = along / np.maximum(np.linalg.norm(along, axis=1), 1e-300)[:, None] * reach
        longer.append(np.stack([pair[:, 0] - along, pair[:, 1] + along], axis=1))
    (near, crossed), (far, meets) = _crossing(first, second), _crossing(*longer)
    out: list[np.ndarray | None] = []
    for k in range(len(road)):
        a, b = first[k][outer[0][k]], second[k][outer[1][k]]
        if not (len(a) and len(b) and (crossed[k] or meets[k])):
            out.append(None)
            continue
        o = near[k] if crossed[k] else far[k]
        u, v = (a[0] - o, b[0] - o) if crossed[k] else (first[k][1] - first[k][0], second[k][1] - second[k][0])
        s, e = math.atan2(u[1], u[0]), math.atan2(v[1], v[0])
        if abs(s - e) > math.pi:
            s, e = (s + 2 * math.pi, e) if s < 0 else (s, e + 2 * math.pi)
        at = np.linspace(min(s, e) - 0.05, max(s, e) + 0.05, steps)
        swept = lambda r: o + r * np.stack([np.cos(at), np.sin(at)], axis=1)  # noqa: B023, E731
        if crossed[k]:
            out.append(np.concatenate([swept(min(np.linalg.norm(a - o), np.linalg.norm(b - o))), o[None]]))
            continue
        inner, beside = [], []
        for pair in (first[k], second[k]):
            along = pair[1] - pair[0]
            t = min(1.0, max(0.0, float((o - pair[0]) @ along / max(along @ along, 1e-300))))
            beside.append(np.linalg.norm(o - pair[0] - t * along))
            inner.append(np.linalg.norm(pair - o, axis=1).max())
        out.append(np.concatenate([swept(min(inner)), swept(max(beside))[::-1]]))
    return out


def turn_fillers(turns: DataFrame, reach: float = 50.0, steps: int = 100) -> DataFrame:
    """``turns`` with ``ring``, which fills a turn of a road between two cross sections; null if there is none.

    Columns p0, p1, p2 (the road's points) and first, second (the sections,
    arrays of two points).  Sections that cross leave a wedge from the crossing
    to their outer ends, with the nearer end's distance; others the part of a
    ring around the place where they meet when made ``reach`` longer at both ends.
    """
    flat = F.concat(F.array("p0", "p1", "p2"), "first", "second")

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def ring(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype=object)
        p = np.stack(points.to_list()).reshape(-1, 7, 2)
        rings = filler_rings(p[:, :3], p[:, 3:5], p[:, 5:], reach, steps)
        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in r.tolist()] for r in rings])

    return turns.withColumn("ring", ring(F.flatten(F.transform(flat, lambda p: F.array(p["x"], p["y"])))))
