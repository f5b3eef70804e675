"""Polyline operators on point tables (line_id, pos, x, y): one window for each line, no joins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions import geom

def _by_pos():
    return Window.partitionBy("line_id").orderBy("pos")


def as_arrays(points: DataFrame) -> DataFrame:
    """(line_id, pts)."""
    rows = points.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return rows.select("line_id", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("pts"))


def measured(points: DataFrame) -> DataFrame:
    """With px, py (the vertex before), seg, before and cum (lengths up to the segment's start and end) and total."""
    p = points.withColumn("px", F.lag("x").over(_by_pos())).withColumn("py", F.lag("y").over(_by_pos()))
    p = p.withColumn("seg", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))
    p = p.withColumn("cum", F.sum("seg").over(_by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("before", F.coalesce(F.lag("cum").over(_by_pos()), F.lit(0.0)))
    return p.withColumn("total", F.max("cum").over(Window.partitionBy("line_id")))


def _at(s):
    """The point at length ``s`` on the row's segment."""
    t = (s - F.col("before")) / F.nullif(F.col("seg"), F.lit(0.0))
    return geom.point(F.col("px") + t * (F.col("x") - F.col("px")), F.col("py") + t * (F.col("y") - F.col("py")))


def trim(points: DataFrame, distance: float = 2.5, max_part: float = 0.25) -> DataFrame:
    """(line_id, pos, x, y) without min(distance, max_part of the length) at both ends; lines with nothing left are dropped."""
    m = measured(points).withColumn("d", F.least(F.lit(distance), max_part * F.col("total"))).filter("2 * d < total")
    lo, hi = F.col("d"), F.col("total") - F.col("d")
    cut = lambda s: (F.col("before") <= s) & (s < F.col("cum"))
    keep = (F.col("cum") > lo) & (F.col("cum") < hi)
    part = F.array_compact(F.array(
        F.when(cut(lo), F.struct(F.lit(0).alias("k"), _at(lo).alias("p"))),
        F.when(keep, F.struct(F.lit(1).alias("k"), geom.point(F.col("x"), F.col("y")).alias("p"))),
        F.when((F.col("before") < hi) & (hi <= F.col("cum")), F.struct(F.lit(2).alias("k"), _at(hi).alias("p"))),
    ))
    out = m.select("line_id", "pos", F.explode(part).alias("e"))
    # the vertex of the row that a start cut lies on comes after it, the end cut before its vertex is left out
    order = Window.partitionBy("line_id").orderBy("pos", "e.k")
    return out.select("line_id", (F.row_number().over(order) - 1).alias("pos"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def split(points: DataFrame, max_length: float) -> DataFrame:
    """(line_id, part, pos, x, y): every line in int(length // max_length + 1) parts of equal length, cut points in both parts."""
    m = measured(points).withColumn("n", (F.floor(F.col("total") / max_length) + 1).cast("int")).withColumn("w", F.col("total") / F.col("n"))
    first, last = F.floor(F.col("before") / F.col("w")).cast("int"), F.floor(F.col("cum") / F.col("w")).cast("int")
    cuts = F.filter(F.sequence(F.least(first + 1, last + 1), last + 1), lambda k: (k >= 1) & (k < F.col("n")) & (k * F.col("w") > F.col("before")) & (k * F.col("w") <= F.col("cum")))
    on_cut = F.exists(cuts, lambda k: k * F.col("w") == F.col("cum"))
    at = F.transform(cuts, lambda k: F.array(F.struct((k - 1).alias("part"), (2 * k).alias("k"), _at(k * F.col("w")).alias("p")), F.struct(k.alias("part"), (2 * k + 1).alias("k"), _at(k * F.col("w")).alias("p"))))
    own = F.when(~on_cut, F.array(F.struct(F.least(last, F.col("n") - 1).alias("part"), F.lit(1 << 29).alias("k"), geom.point(F.col("x"), F.col("y")).alias("p")))).otherwise(F.slice(F.flatten(at), 1, 0))
    out = m.select("line_id", "pos", F.explode(F.concat(F.flatten(at), own)).alias("e"))
    order = Window.partitionBy("line_id", "e.part").orderBy("pos", "e.k")
    return out.select("line_id", F.col("e.part").alias("part"), (F.row_number().over(order) - 1).alias("pos"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def resample(points: DataFrame, step: float) -> DataFrame:
    """(line_id, pos, x, y) at lengths 0, step, 2 * step, ... below the total."""
    m = measured(points)
    low, high = F.floor(F.col("before") / step).cast("int"), F.floor(F.col("cum") / step).cast("int")
    ks = F.when((F.col("seg") > 0) & (high > low), F.sequence(low + 1, high)).otherwise(F.array().cast("array<int>"))
    ks = F.filter(ks, lambda k: k * step < F.col("total"))
    start = F.when((F.col("pos") == 0) & (F.col("total") > 0), F.array(F.struct(F.lit(0).alias("k"), geom.point(F.col("x"), F.col("y")).alias("p")))).otherwise(F.array().cast("array<struct<k:int,p:struct<x:double,y:double>>>"))
    e = m.select("line_id", F.explode(F.concat(start, F.transform(ks, lambda k: F.struct(k.alias("k"), _at(k * step).alias("p"))))).alias("e"))
    return e.select("line_id", F.col("e.k").alias("pos"), F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))


def offset(points: DataFrame, distance: float) -> DataFrame:
    """(line_id, pos, x, y): the parallel at ``distance`` to the left (right if negative), mitred at vertices.

    Exact for straight lines and gentle turns; a mitre is at most three times the distance.
    """
    w = _by_pos()
    p = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    unit = lambda dx, dy: (dx / F.nullif(F.hypot(dx, dy), F.lit(0.0)), dy / F.nullif(F.hypot(dx, dy), F.lit(0.0)))
    ax, ay = unit(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    bx, by = unit(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    p = p.withColumn("ax", F.coalesce(ax, bx)).withColumn("ay", F.coalesce(ay, by)).withColumn("bx", F.coalesce(bx, ax)).withColumn("by", F.coalesce(by, ay))
    sx, sy = -(F.col("ay") + F.col("by")), F.col("ax") + F.col("bx")
    scale = distance * F.least(F.lit(3.0), 2 / F.greatest(sx * sx + sy * sy, F.lit(1e-9)) * F.hypot(sx, sy)) / F.greatest(F.hypot(sx, sy), F.lit(1e-9))
    return p.select("line_id", "pos", (F.col("x") + scale * sx).alias("x"), (F.col("y") + scale * sy).alias("y"))


def turn_angles(points: DataFrame) -> DataFrame:
    """(line_id, pos, angle) between the vectors before and after each inner vertex; null where one of them is zero."""
    w = _by_pos()
    p = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    p = p.filter("px is not null and nx is not null")
    return p.select("line_id", "pos", geom.angle_between(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")).alias("angle"))


def fit_lines(points: DataFrame) -> DataFrame:
    """(line_id, slope, intercept, length) by least squares in the frame of each line's first and last vertex; null slope below two points."""
    ends = points.groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    p = points.join(ends, "line_id").withColumn("r", geom.frame_of(F.col("a"), F.col("b"), F.struct("x", "y")))
    return p.groupBy("line_id").agg(F.regr_slope("r.y", "r.x").alias("slope"), F.regr_intercept("r.y", "r.x").alias("intercept"), F.max(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).alias("length"))


def _far(px: float, py: float, dx: float, dy: float) -> float:
    """Distance of a place to the segment from the origin to (dx, dy), rounded as the SQL does: its squares are calls of pow."""
    d2 = math.pow(dx, 2) + math.pow(dy, 2)
    t = max(0.0, min(1.0, (px * dx + py * dy) / d2)) if d2 else 0.0
    return math.sqrt(math.pow(px - t * dx, 2) + math.pow(py - t * dy, 2))


def douglas_peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay; without recursion.  Of several farthest ones the first goes on.

    Distances that rounding can't tell apart, from each other or from the
    tolerance, are computed again by ``_far``.  Vertices without a coordinate are
    passed over, and a stretch with such an end is not cut.
    """
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        d2 = dx * dx + dy * dy
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        t = np.clip((px * dx + py * dy) / d2, 0, 1) if d2 else np.zeros(len(px))
        far = np.hypot(px - t * dx, py - t * dy)
        far[np.isnan(far)] = -1.0
        k = int(far.argmax())
        most = far[k]
        if most < 0:
            continue
        slack = 1e-12 * (abs(dx) + abs(dy) + np.nanmax(np.abs(px)) + np.nanmax(np.abs(py)))
        near = np.flatnonzero(far >= most - slack)
        if len(near) > 1 or abs(most - tolerance) <= slack:
            exact = [_far(float(px[i]), float(py[i]), float(dx), float(dy)) for i in near]
            most = max(exact)
            k = int(near[exact.index(most)])
        if most > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """(line_id, pos, x, y): the vertices that Douglas-Peucker keeps, at their old positions; many lines to a batch."""
    kinds = {f: points.schema[f].dataType.simpleString() for f in ("line_id", "pos")}

    def keep(batches):
        for batch in batches:
            pts = batch.column("p")
            flat, ends = pts.flatten(), np.cumsum([0, *pts.value_lengths().to_pylist()])
            x, y = flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)
            stay = np.concatenate([np.zeros(0, bool), *(douglas_peucker(x[a:b], y[a:b], tolerance) for a, b in zip(ends, ends[1:]))])
            line = batch.column("line_id").take(pa.array(np.repeat(np.arange(len(pts)), np.diff(ends))))
            yield pa.RecordBatch.from_arrays([line, *(flat.field(c) for c in ("pos", "x", "y"))], names=["line_id", "pos", "x", "y"]).filter(pa.array(stay))

    rows = points.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"))
    return rows.mapInArrow(keep, f"line_id {kinds['line_id']}, pos {kinds['pos']}, x double, y double")


def boundary(points: DataFrame, distance: float, tolerance: float = 0.1) -> DataFrame:
    """(line_id, pos, x, y): the parallel at ``distance``, simplified."""
    return simplify(offset(points, distance), tolerance)


def hull_points(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the lowest x; fewer than three points if all lie on a line."""
    pts = sorted(set(zip(x.tolist(), y.tolist())))
    if len(pts) < 3:
        return pts

    def half(points):
        out: list[tuple[float, float]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, ring, area): hull of each group's points; null ring and area for groups on a line; many groups to a batch."""

    def ring_of(batches):
        for batch in batches:
            pts = batch.column("p")
            flat, ends = pts.flatten(), np.cumsum([0, *pts.value_lengths().to_pylist()])
            x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in "xy")
            rings = [hull_points(x[a:b], y[a:b]) for a, b in zip(ends, ends[1:])]
            rings = [r if len(r) > 2 else None for r in rings]
            areas = [r and sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1])) / 2 for r in rings]
            kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
            made = pa.array([r and [{"x": a, "y": b} for a, b in r] for r in rings], kind)
            yield pa.RecordBatch.from_arrays([batch.column(key), made, pa.array(areas, pa.float64())], names=[key, "ring", "area"])

    kind = points.schema[key].dataType.simpleString()
    rows = points.groupBy(key).agg(F.collect_set(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("p"))
    return rows.mapInArrow(ring_of, f"{key} {kind}, ring array<struct<x:double,y:double>>, area double")
