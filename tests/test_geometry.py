"""Closed forms and plain loops for what SQL doesn't cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.functions import fixtures as fx
from lanewright.functions import geom
from lanewright.operators import graph, lanes, overlay, polyline, raster
from lanewright.plans import geometry_queries


def line(spark, *pts, line_id=1):
    return spark.createDataFrame([(line_id, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "line_id int, pos int, x double, y double")


def points(df):
    return [(r.x, r.y) for r in df.orderBy("pos").collect()]


def test_utm_known_places(spark):
    # the central meridian at the equator, and a place whose grid coordinates follow from the meridian arc
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 52.0), (4.35556, 52.00667)], "lon double, lat double").select("lon", "lat", geom.utm31(F.col("lon"), F.col("lat")).alias("p"))
    df = df.withColumn("q", geom.utm31_inverse(F.col("p.x"), F.col("p.y")))
    rows = df.collect()
    assert (rows[0].p.x, rows[0].p.y) == (500000.0, 0.0)
    assert rows[1].p.x == pytest.approx(500000.0) and rows[1].p.y == pytest.approx(0.9996 * 5763343.550, abs=0.01)
    for r in rows:
        assert r.q.x == pytest.approx(r.lon, abs=1e-9) and r.q.y == pytest.approx(r.lat, abs=1e-9)


def test_trim_straight_and_too_short(spark):
    assert points(polyline.trim(line(spark, (0, 0), (10, 0)), 2.5, 0.25)) == [(2.5, 0), (7.5, 0)]
    assert points(polyline.trim(line(spark, (0, 0), (4, 0)), 2.5, 0.25)) == [(1.0, 0), (3.0, 0)]
    assert points(polyline.trim(line(spark, (0, 0), (2, 0)), 2.5, 0.5)) == []


def test_split_and_resample_on_vertices(spark):
    parts = polyline.split(line(spark, (0, 0), (5, 0), (10, 0)), 6.0)
    assert [points(parts.filter(F.col("part") == k)) for k in (0, 1)] == [[(0, 0), (5, 0)], [(5, 0), (10, 0)]]
    assert points(polyline.resample(line(spark, (0, 0), (5, 0), (10, 0)), 2.5)) == [(0, 0), (2.5, 0), (5, 0), (7.5, 0)]


def test_offset_of_right_angle(spark):
    got = points(polyline.offset(line(spark, (0, 0), (10, 0), (10, 10)), 1.0))
    assert np.allclose(got, [(0, 1), (9, 1), (9, 10)])


def test_simplify_equals_recursion():
    rng = np.random.default_rng(1)

    def recursive(x, y, tol):
        if len(x) < 3:
            return [True] * len(x)
        dx, dy = x[-1] - x[0], y[-1] - y[0]
        d2 = dx * dx + dy * dy
        far = []
        for px, py in zip(x[1:-1], y[1:-1]):
            t = min(1, max(0, ((px - x[0]) * dx + (py - y[0]) * dy) / d2)) if d2 else 0
            far.append(math.hypot(px - x[0] - t * dx, py - y[0] - t * dy))
        k = int(np.argmax(far))
        if far[k] <= tol:
            return [True] + [False] * (len(x) - 2) + [True]
        return recursive(x[: k + 2], y[: k + 2], tol) + recursive(x[k + 1 :], y[k + 1 :], tol)[1:]

    for n in (0, 1, 2, 3, 40):
        x, y = rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()
        assert polyline.douglas_peucker(x, y, 0.7).tolist() == recursive(x.tolist(), y.tolist(), 0.7)


def test_hulls_of_square_and_line(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x in range(3) for y in range(3)] + [(2, float(k), float(k)) for k in range(3)], "grp int, x double, y double")
    rows = {r.grp: r.area for r in polyline.hulls(df, "grp").collect()}
    assert rows == {1: 4.0, 2: None}


def test_contract_chain_loop_and_ring(spark):
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 3), (7, 8), (8, 9), (9, 7)])], "edge_id long, src long, dst long")
    got = sorted(tuple(r.nodes) for r in graph.contract(e).collect())
    assert got == [(1, 2, 3), (3, 4), (3, 5, 6, 3)]
    assert graph.contract(e.limit(0)).count() == 0


def test_contraction_invariant(spark, sf):
    e = fx.edges(spark, sf)
    total = graph.degrees(e).filter("deg <> 2").agg(F.sum("deg")).first()[0]
    assert graph.contract(e).count() == total / 2


def test_connections_are_symmetric(spark, sf):
    c = graph.connections(lanes.lanes_from_edges(fx.edges(spark, sf), fx.nodes(spark, sf)))
    pairs = {(r.lane_id, r.other) for r in c.collect()}
    assert pairs == {(b, a) for a, b in pairs}


def test_reverse_dedup_palindrome(spark):
    p = lambda *xs: [(float(x), 0.0) for x in xs]
    df = spark.createDataFrame([(1, p(1, 2)), (2, p(2, 1)), (3, p(1, 2)), (4, p(1, 2, 1)), (5, p(1, 2, 1))], "line_id int, pts array<struct<x:double,y:double>>")
    assert sorted(r.line_id for r in graph.reverse_dedup(df).collect()) == [1, 3, 4]


def test_overlay_of_triangles_and_round_buffer(spark):
    ring = lambda *pts: [(float(x), float(y)) for x, y in pts]
    df = spark.createDataFrame([("A", ring((0, 0), (10, 0), (0, 10))), ("B", ring((0, 0), (10, 0), (10, 10)))], "layer string, ring array<struct<x:double,y:double>>")
    r = overlay.overlay_areas(df, 3.0).first()
    assert (r.a, r.b, r.a_and_b) == pytest.approx((50, 50, 25))
    square = spark.createDataFrame([(ring((0, 0), (10, 0), (10, 10), (0, 10)),)], "ring array<struct<x:double,y:double>>")
    m = overlay.overlay_areas(overlay.buffered(square, 2.0).select(F.lit("M").alias("layer"), "ring"), 7.0).first()
    assert m.mask == pytest.approx(100 + 80 + math.pi * 4, rel=2e-3)
    assert overlay.coverage_metrics(square.limit(0), square.limit(0)).first().iou == 0.0


def test_round_buffers_take_every_rectangle(spark, tmp_path):
    """Rectangles far apart, most of them with ids of 20 and more: their areas and those of 64-gons at the corners add up."""
    rows = [(0, 1), (10, 7), (30, 25), (1040, 50), (2010, 20), (2030, 33)]
    spark.createDataFrame([(i, "LARGE", n) for i, n in rows], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    r = geometry_queries.round_buffers(spark, str(tmp_path)).first()
    inner = sum(n * (51 - n) for _, n in rows)
    assert r.a == pytest.approx(inner, abs=1e-3)
    assert r.mask == pytest.approx(inner + len(rows) * (2 * 2 * 51 + 32 * 4 * math.sin(2 * math.pi / 64)), abs=1e-3)


def test_quartered_cells_add_up():
    rng = np.random.default_rng(5)
    rings = []
    for k in range(60):
        x, y, r = rng.uniform(0, 64), rng.uniform(0, 64), rng.uniform(2, 12)
        rings.append(("ABM"[k % 3], [(x + r * math.cos(t), y + r * math.sin(t)) for t in np.sort(rng.uniform(0, 2 * math.pi, 20))]))
    whole, parts = overlay.box_areas(rings, 0, 0, 64, 64, overlay.BOX_DEPTH), overlay.box_areas(rings, 0, 0, 64, 64)
    assert whole.keys() == parts.keys() and all(parts[k] == pytest.approx(v) for k, v in whole.items())


def test_overlay_identity_of_random_polygons(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        x, y, r = rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(2, 12)
        rows.append(("AB"[k % 2], [(x + r * math.cos(t), y + r * math.sin(t)) for t in np.sort(rng.uniform(0, 2 * math.pi, 7))]))
    df = spark.createDataFrame(rows, "layer string, ring array<struct<x:double,y:double>>")
    fine, coarse = overlay.overlay_areas(df, 5.0).first(), overlay.overlay_areas(df, 500.0).first()
    assert np.allclose(list(fine), list(coarse))
    assert fine.a_or_b_in_mask == pytest.approx(fine.a + fine.b - fine.a_and_b)


def test_warp_there_and_back(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0, 5.0)], "line_id int, before double, px double, py double, x double, y double")
    px = spark.createDataFrame([(1, r, c, (r, c) in {(5, 3), (4, 7)}) for r in range(12) for c in range(12)], "line_id int, row int, col int, is_set boolean")
    strip = raster.warp(px, seg, 4)
    assert {(r.row, r.col) for r in strip.filter("is_set").collect()} == {(2, 3), (1, 7)}
    assert {(r.row, r.col) for r in raster.unwarp(strip, seg, 4).collect()} == {(5, 3), (4, 7)}


def test_band_of_empty_mask(spark):
    df = spark.createDataFrame([([False] * 16,)], "cells array<boolean>").select(raster.best_band(F.col("cells"), 4, 4).alias("b"))
    assert df.first().b.score == pytest.approx(1e8)
    assert spark.range(1).select(raster.passes(F.lit(None).cast("double"), 0.05).alias("v")).first().v


def test_registry_rejects_unknown():
    from lanewright.plans.config import GRAPHS

    with pytest.raises(ValueError):
        GRAPHS.get("nothing")


def test_ring_runs_are_the_cells_whose_centre_is_inside(spark):
    rng = np.random.default_rng(5)
    rings = [(i, [(float(x), float(y)) for x, y in rng.integers(-6, 7, (n, 2)) * c]) for i, (n, c) in enumerate([(1, 1.0), (3, 1.0), (4, 0.5), (5, 0.77), (9, 1.0), (7, 0.77)])]
    df = spark.createDataFrame([*rings, (6, None), (7, [])], "id long, ring array<struct<x:double,y:double>>")

    def inside(x, y, ring):
        return sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(ring, ring[1:] + ring[:1])) % 2

    for cell in (1.0, 0.3):
        n = int(8 / cell)
        want = sorted((i, r, c) for i, ring in rings for r in range(-n, n) for c in range(-n, n) if inside((c + 0.5) * cell, (r + 0.5) * cell, ring))
        assert want and sorted(map(tuple, raster.rasterize(df, cell).collect())) == want
        for most in (1, 40):  # part of a ring at a time
            cut = raster.ring_runs(df, cell, most).selectExpr("id", "row", "explode(sequence(start, stop - 1)) as col")
            assert sorted(map(tuple, cut.collect())) == want


def test_rasterize_takes_time_by_rows_not_cells(spark):
    side = 200_000.0  # 40 billion cells
    df = spark.createDataFrame([(1, [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)])], "id long, ring array<struct<x:double,y:double>>")
    got = raster.ring_runs(df).selectExpr("count(*) as rows", "sum(cast(stop - start as long)) as n", "max(row) as r", "min(start) as c").first()
    assert tuple(got) == (200_000, 40_000_000_000, 199_999, 0)


def test_resampling_joins_sizes_and_no_pixels(spark):
    """A broadcast of exploded pixels would go through the driver, as explode isn't in Spark's estimate of sizes."""
    from lanewright.operators import regions

    px = spark.range(3).selectExpr("id as mask_id", "explode(sequence(0, 34)) as i").selectExpr("mask_id", "i div 7 as row", "i % 7 as col", "cast(i * i as double) as value").selectExpr("mask_id", "cast(row as int) as row", "cast(col as int) as col", "value")
    for resolution, target in ((0.8, 1.1), (1.0, 1.0), (1.0, 0.3), (1.0, 2.6)):
        out = regions.resample_bilinear(px, resolution, target)
        h, w = int(5 * resolution / target), int(7 * resolution / target)
        want = {}
        for r in range(h):
            for c in range(w):
                y, x = min(4, max(0, (r + 0.5) * 5 / h - 0.5)), min(6, max(0, (c + 0.5) * 7 / w - 0.5))
                want[r, c] = sum(max(0, 1 - abs(y - i // 7)) * max(0, 1 - abs(x - i % 7)) * i * i for i in range(35))
        got = out.collect()
        assert len(got) == 3 * h * w
        assert all(g.value == pytest.approx(want[g.row, g.col], abs=1e-9) for g in got)
        joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
        assert len(joins) == 1 and "col" not in joins[0] and "mask_id" in joins[0]
    with pytest.raises(Exception, match="would be empty"):
        regions.resample_bilinear(px, 1.0, 9.0).collect()


def test_simplified_goes_with_its_sql_where_two_vertices_are_equally_far(spark, tmp_path):
    import duckdb
    from compare import same

    far = [(289.9, 398.34, 399.19, 292.45), (108.48, 242.3, 242.84, 110.1), (71.63, 118.16, 116.31, 66.08), (43.63, 92.06, 93.4, 47.65), (127.75, 210.01, 210.06, 127.9), (278.1, 353.38, 353.3, 277.86), (8.05, 52.0, 51.42, 6.31)]
    lines = [*far, (0.0, None, 90.0, 5.0, 0.0), (None, 80.0, 0.0), (0.0, 80.0, 80.0, 80.0, 0.0)]
    rows = ", ".join(f"({10 * u + i}, TIMESTAMP '2024-01-01' + INTERVAL ({i}) SECOND, {u}, {'NULL' if y is None else y}::DOUBLE)" for u, line in enumerate(lines) for i, y in enumerate(line))
    duckdb.sql(f"COPY (SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, v AS value FROM (VALUES {rows}) r(e, t, u, v)) TO '{tmp_path}/events.parquet'")
    query, sql = geometry_queries.QUERIES["simplified"]
    same(query(spark, str(tmp_path)), sql, str(tmp_path))
