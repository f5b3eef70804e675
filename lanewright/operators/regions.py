"""Regions: annotated polygons, map multigraphs, tiles, resampled rasters, combined sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions.geom import bounds, length, pixel_to_geo, point, strictly_inside
from lanewright.operators.graph import reverse_dedup
from lanewright.operators.polyline import as_arrays, trim


def edge_points(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (edge_id, src, dst, geometry) with pts: the geometry, or the two end nodes where there is none."""
    at = lambda end: nodes.select(F.col("id").alias(end), point(F.col("x"), F.col("y")).alias(f"{end}_p"))
    e = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return e.withColumn("pts", F.coalesce("geometry", F.array("src_p", "dst_p"))).drop("src_p", "dst_p")


def edges_in_polygons(edges: DataFrame, nodes: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """The edges with a vertex strictly inside some polygon (ring), once each; end nodes stand for edges without geometry.

    Vertices meet polygons in the cells of a grid that the polygons' extents touch.
    """
    at = lambda v: F.floor(v / cell).cast("long")
    p = polygons.filter(F.size("ring") > 2).select("ring", bounds(F.col("ring")).alias("b"))
    p = p.withColumn("cx", F.explode(F.sequence(at(F.col("b.minx")), at(F.col("b.maxx"))))).withColumn("cy", F.explode(F.sequence(at(F.col("b.miny")), at(F.col("b.maxy"))))).drop("b")
    v = edge_points(edges, nodes).select("edge_id", F.explode("pts").alias("v")).filter("v is not null")
    v = v.select("edge_id", "v.x", "v.y", at(F.col("v.x")).alias("vx"), at(F.col("v.y")).alias("vy"))
    met = v.join(p, (F.col("vx") == F.col("cx")) & (F.col("vy") == F.col("cy")) & strictly_inside(F.col("x"), F.col("y"), F.col("ring")), "left_semi")
    return edges.join(met.select(F.col("edge_id").alias("__met")).distinct(), F.col("edge_id") == F.col("__met"), "left_semi")


def extent_of(polygons: DataFrame, extend: float = 0.05) -> DataFrame:
    """One row minx, miny, maxx, maxy: the extent of all rings, ``extend`` of its size larger on every side."""
    p = polygons.select(F.explode("ring").alias("p"))
    e = p.agg(F.min("p.x").alias("a"), F.min("p.y").alias("b"), F.max("p.x").alias("c"), F.max("p.y").alias("d"))
    dx, dy = (F.col("c") - F.col("a")) * extend, (F.col("d") - F.col("b")) * extend
    return e.select((F.col("a") - dx).alias("minx"), (F.col("b") - dy).alias("miny"), (F.col("c") + dx).alias("maxx"), (F.col("d") + dy).alias("maxy"))


def roads_from_map(edges: DataFrame, nodes: DataFrame, project: Callable[[Column, Column], Column], default_width: float = 3.5, default_lanes: int = 1, trim_distance: float = 2.5, max_part: float = 0.4) -> DataFrame:
    """Lanes of a map multigraph: (edge_id, src, dst, geometry, widths, lanes) and (id, x, y), both unprojected.

    Vertices are projected, lines whose reverse came before go, the others are
    trimmed; the length is that of the untrimmed line, and the width that of one
    lane (the first listed, or the default) times the lanes (likewise).
    """
    e = edge_points(edges, nodes).withColumn("pts", F.transform("pts", lambda p: project(p["x"], p["y"])))
    e = reverse_dedup(e, "edge_id")
    points = e.select(F.col("edge_id").alias("line_id"), F.posexplode("pts").alias("pos", "p")).select("line_id", "pos", "p.x", "p.y")
    cut = as_arrays(trim(points, trim_distance, max_part)).select("line_id", F.col("pts").alias("cut"))
    width = F.coalesce(F.get("widths", F.lit(0)).cast("double"), F.lit(default_width)) * F.coalesce(F.get("lanes", F.lit(0)).cast("int"), F.lit(default_lanes))
    name = lambda c: F.concat(F.lit("i"), F.col(c).cast("string"))
    rows = e.join(cut, F.col("edge_id") == F.col("line_id"))
    return rows.select(F.col("edge_id").alias("lane_id"), name("src").alias("from_object"), name("dst").alias("to_object"), F.col("edge_id").alias("lane_group"), F.col("cut").alias("pts"), F.col("pts").alias("original"), width.alias("width"), F.lit(1).alias("lanes"), length(F.col("pts")).alias("length"))


def pixel_graph_to_places(adjacency: DataFrame, affine: tuple[float, ...]) -> DataFrame:
    """(x, y, pos, nx, ny) of adjacency lists (seq, row, col, pos, nrow, ncol): pixels are row and column, places x and y.

    Of several nodes at one place the list of the last (by seq) stays.
    """
    here = pixel_to_geo(F.col("col"), F.col("row"), affine)
    there = pixel_to_geo(F.col("ncol"), F.col("nrow"), affine)
    a = adjacency.select("seq", "pos", here.alias("p"), there.alias("q")).select("seq", "pos", "p.x", "p.y", F.col("q.x").alias("nx"), F.col("q.y").alias("ny"))
    last = a.groupBy(F.col("x").alias("lx"), F.col("y").alias("ly")).agg(F.max("seq").alias("last"))
    return a.join(last, (F.col("x") == F.col("lx")) & (F.col("y") == F.col("ly")) & (F.col("seq") == F.col("last"))).select("x", "y", "pos", "nx", "ny")


def tiles(images: DataFrame, size: int) -> DataFrame:
    """(id, i, j, row, col, height, width): equal tiles of at most ``size``, remainders at the far edges left out as they are smaller than a tile row."""
    n = lambda c: F.ceil(F.col(c) / size).cast("int")
    t = images.select("id", n("height").alias("ni"), n("width").alias("nj"), "height", "width")
    t = t.withColumn("th", F.floor(F.col("height") / F.col("ni")).cast("int")).withColumn("tw", F.floor(F.col("width") / F.col("nj")).cast("int"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    return t.select("id", "i", "j", (F.col("i") * F.col("th")).alias("row"), (F.col("j") * F.col("tw")).alias("col"), F.col("th").alias("height"), F.col("tw").alias("width"))


def resample_bilinear(pixels: DataFrame, resolution: float, target: float) -> DataFrame:
    """(mask_id, row, col, value): rasters of int(size * resolution / target) pixels, each from the four nearest of the old.

    Every old pixel goes to the new ones that it is near to, so only sizes are
    joined.  An empty new raster is an error.
    """
    size = pixels.groupBy("mask_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    new = lambda c: (F.col(c) * (resolution / target)).cast("int")
    size = size.withColumn("nh", new("h")).withColumn("nw", new("w"))
    size = size.withColumn("nh", F.when((F.col("nh") > 0) & (F.col("nw") > 0), F.col("nh")).otherwise(F.raise_error(F.lit("the new raster would be empty")).cast("int")))
    p = pixels.select("mask_id", "row", "col", "value").join(size, "mask_id")
    for at, old, now, to, k in (("row", "h", "nh", "r", "ky"), ("col", "w", "nw", "c", "kx")):
        p = _near(p, F.col(at), F.col(old), F.col(now), to, k)
    return p.groupBy("mask_id", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.col("ky") * F.col("kx") * F.col("value")).alias("value"))


def _near(pixels: DataFrame, at: Column, old: Column, now: Column, to: str, k: str) -> DataFrame:
    """``pixels`` for each of ``now`` places on an axis (``to``) of which place ``at`` of ``old`` is one of the two nearest, with its part ``k``, above 0."""
    place = lambda v: (v + 0.5) * now / old - 0.5
    first = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), F.floor(place(at - 1)).cast("int")))
    last = F.when(at == old - 1, now - 1).otherwise(F.least(now - 1, F.ceil(place(at + 1)).cast("int")))
    p = pixels.withColumn(to, F.explode(F.when(first <= last, F.sequence(first, last))))
    f = F.greatest(F.lit(0.0), F.least(old - 1.0, (F.col(to) + 0.5) * old / now - 0.5))
    part = f - F.floor(f)
    return p.withColumn(k, F.when(at == F.floor(f), 1 - part).when(at == F.floor(f) + 1, part).otherwise(0.0)).filter(F.col(k) > 0)


def with_shifts(sections: DataFrame) -> DataFrame:
    """``sections`` (lane_id, pos, a, c, e, f, height, width) with dr, dc: where each starts on its lane's common canvas.

    Shifts are whole pixels from the lane's first section, cut toward zero, the least of them at 0.
    """
    lane = Window.partitionBy("lane_id")
    base = F.first(F.struct("a", "c", "e", "f")).over(lane.orderBy("pos"))
    s = sections.withColumn("b", base)
    s = s.withColumn("dc", ((F.col("c") - F.col("b.c")) / F.col("b.a")).cast("int")).withColumn("dr", ((F.col("f") - F.col("b.f")) / F.col("b.e")).cast("int")).drop("b")
    return s.withColumn("dr", F.col("dr") - F.min("dr").over(lane)).withColumn("dc", F.col("dc") - F.min("dc").over(lane))


def section_canvas(sections: DataFrame) -> DataFrame:
    """(lane_id, height, width, a, c, e, f): the canvas that holds all of a lane's sections, its resolution their mean."""
    g = with_shifts(sections).groupBy("lane_id").agg(
        F.max(F.col("dr") + F.col("height")).alias("height"), F.max(F.col("dc") + F.col("width")).alias("width"), F.avg("a").alias("a"), F.avg("e").alias("e"),
        F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("f").alias("f0"), F.max("f").alias("f1"),
    )
    return g.select("lane_id", "height", "width", "a", F.when(F.col("a") > 0, F.col("c0")).otherwise(F.col("c1")).alias("c"), "e", F.when(F.col("e") > 0, F.col("f0")).otherwise(F.col("f1")).alias("f"))


def long_enough(lines: DataFrame, least: float) -> DataFrame:
    """``lines`` (pts) with fits: whether a line is long enough for centrelines other than its own."""
    return lines.withColumn("fits", length(F.col("pts")) >= least)


def spline_knots(points: DataFrame) -> DataFrame:
    """(line_id, i, t): knots of the degree-1 spline whose coefficients are the line's vertices, by share of the length, ends twice."""
    from lanewright.operators.polyline import measured

    m = measured(points).select("line_id", "pos", F.coalesce(F.col("cum") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)).alias("u"), F.max("pos").over(Window.partitionBy("line_id")).alias("last"))
    own = F.array(F.struct((F.col("pos") + 1).alias("i"), F.col("u").alias("t")))
    ends = F.array_compact(F.array(F.when(F.col("pos") == 0, F.struct(F.lit(0).alias("i"), F.col("u").alias("t"))), F.when(F.col("pos") == F.col("last"), F.struct((F.col("pos") + 2).alias("i"), F.col("u").alias("t")))))
    return m.select("line_id", F.explode(F.concat(own, ends)).alias("k")).select("line_id", F.col("k.i").cast("long").alias("i"), "k.t")
