import math

import numpy as np
from pyspark.sql import functions as F

from lanewright.operators import candidates


def pts(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))


def test_smoothing_keeps_a_cubic_and_flattens_noise():
    x = np.linspace(0, 10, 40)
    y = 1 + 2 * x - 0.3 * x**2 + 0.02 * x**3
    assert np.allclose(candidates.smooth_line(x, y, np.ones(40), 0.0, x), y, atol=1e-6)
    noisy = candidates.smooth_line(x, np.random.default_rng(0).normal(size=40), np.ones(40), 1e3, x)
    assert np.abs(np.diff(noisy, 2)).max() < 1e-3


def test_smoothing_follows_many_bends():
    x = np.sort(np.random.default_rng(1).uniform(0, 10, 200))
    y = np.sin(3 * x)
    assert np.abs(candidates.smooth_line(x, y, np.ones(200), 1e-11, x) - y).max() < 1e-2
    # a stiff line is the weighted straight fit
    w = 1 + np.arange(200) % 3
    stiff = candidates.smooth_line(x, y, w, 1e4, x)
    assert np.allclose(stiff, np.polyval(np.polyfit(x, y, 1, w=np.sqrt(w)), x), atol=1e-3)
    few = candidates.smooth_line(np.array([0, 0, 1, 1.0]), np.array([1, 3, 2, 2.0]), np.ones(4), 1e-3, np.array([0, 1.0]))
    assert np.allclose(few, [2, 2], atol=1e-6)


def test_smoothed_lines_have_every_point(spark):
    df = spark.createDataFrame([(1, float(k), float(k % 2), 1.0) for k in range(50)], "line_id int, x double, y double, weight double")
    assert sorted((r.pos, r.x) for r in candidates.smoothed(df, 1e-3).collect()) == [(k, float(k)) for k in range(50)]


def test_validity(spark):
    one = spark.range(1)
    check = lambda line, **k: one.select(candidates.valid_line(line, 10, 20, **k).alias("v")).first().v
    assert check(pts((0, 0), (5, 0), (5, 0), (9, 1))) and check(pts((15, 5)))
    assert not check(pts((15, 5)), swapped=True) and not check(pts((-1, 0), (5, 5))) and not check(pts((0, 0), (5, 0), (1, 0.5)))
    assert check(pts((0, 0), (5, 0), (5, 5))) and not check(pts((0, 0), (5, 0), (5, 5)), least_angle=math.pi / 2 + 0.1)


def test_road_floor(spark):
    df = spark.createDataFrame([(1, "road", 0.2, 0), (1, "spline", 0.5, 1), (2, "road", 0.2, 0), (2, "spline", 1.5, 1), (3, "road", None, 0)], "lane int, kind string, score double, order int")
    assert {r.lane: (r.kind, r.score) for r in candidates.choose_centerline(df, "lane").collect()} == {1: ("spline", 0.5), 2: ("road", 0.2)}


def test_few_points_stay(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 2.0, 3.0, 1.0)], "line_id int, x double, y double, weight double")
    assert sorted((r.pos, r.x, r.y) for r in candidates.smoothed(df, 0.1).collect()) == [(0, 0.0, 1.0), (1, 2.0, 3.0)]


def test_wedges(spark):
    arc, origin = pts((1, 0), (0, 1)), pts((0, 0))[0]
    row = spark.range(1).select(candidates.wedge(origin, arc).alias("a"), candidates.wedge(origin, arc, pts((2, 0), (0, 2))).alias("b")).first()
    assert [(p.x, p.y) for p in row.a] == [(1, 0), (0, 1), (0, 0)] and [(p.x, p.y) for p in row.b] == [(1, 0), (0, 1), (0, 2), (2, 0)]
