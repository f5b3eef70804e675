"""Mask and raster operators: small masks as arrays of cells, larger rasters in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def count_true(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c))


def mask_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p & q)


def mask_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p | q)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null for two empty masks."""
    return count_true(mask_and(a, b)) / F.nullif(count_true(mask_or(a, b)), F.lit(0))


def passes(ratio: Column, most: float) -> Column:
    """Whether an overlap is acceptable: not above ``most``; an undefined one is."""
    return F.coalesce(ratio <= most, F.lit(True))


def union_of(masks: DataFrame, key: str) -> DataFrame:
    """(key, row, col) of pixels that any of the group's masks has set; from long form."""
    return masks.filter("is_set").select(key, "row", "col").distinct()


def best_band(cells: Column, height: int, width: int) -> Column:
    """struct(score, lo, hi): rows [lo, hi) that fit the mask best, over all pairs lo < hi; the least score, then the least rows."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: count_true(F.slice(cells, r * width + 1, F.lit(width))))
    sums = F.aggregate(rows, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    # an array of one, so that the running sums are computed once and not in every place that names them
    return F.transform(F.array(sums), lambda s: _best_of(s, height, width))[0]


def _best_of(sums: Column, height: int, width: int) -> Column:
    def score(lo, hi):
        i = F.get(sums, hi) - F.get(sums, lo)
        rest = F.get(sums, F.lit(height)) + (hi - lo) * width - 2 * i
        return F.struct((1 / (i / (rest + F.lit(1e-8)) + F.lit(1e-8))).alias("score"), lo.alias("lo"), hi.alias("hi"))

    from_lo = lambda lo: F.array_min(F.transform(F.sequence(lo + 1, F.lit(height)), lambda hi: score(lo, hi)))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), from_lo))


def pool_blocks(pixels: DataFrame, k: int) -> DataFrame:
    """(mask_id, brow, bcol, prob, row, col): share of the mask's total and place of the greatest value of each full k x k block.

    Partial blocks at the edges are dropped; the first place in row order wins ties; a mask of zeros has share 0.
    """
    size = pixels.groupBy("mask_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.sum("value").alias("total"))
    p = pixels.join(size, "mask_id").withColumn("brow", F.floor(F.col("row") / k).cast("int")).withColumn("bcol", F.floor(F.col("col") / k).cast("int"))
    p = p.filter((F.col("brow") < F.floor(F.col("h") / k)) & (F.col("bcol") < F.floor(F.col("w") / k)))
    g = p.groupBy("mask_id", "brow", "bcol").agg(F.sum("value").alias("s"), F.max("total").alias("t"), F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m"))
    return g.select("mask_id", "brow", "bcol", F.when(F.col("t") == 0, 0.0).otherwise(F.col("s") / F.col("t")).alias("prob"), (-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"))


def resample_mean(pixels: DataFrame, k: int) -> DataFrame:
    """(mask_id, row, col, value): mean of k x k blocks, partial ones included."""
    return pixels.groupBy("mask_id", F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def column_runs(pixels: DataFrame) -> DataFrame:
    """(mask_id, col, start, stop): runs of set pixels down each column, stop exclusive."""
    down = Window.partitionBy("mask_id", "col").orderBy("row")
    rising = F.when(F.col("is_set") & ~F.coalesce(F.lag("is_set").over(down), F.lit(False)), 1).otherwise(0)
    p = pixels.withColumn("up", rising).withColumn("run", F.sum("up").over(down.rowsBetween(Window.unboundedPreceding, 0))).filter("is_set")
    return p.groupBy("mask_id", "col", "run").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("stop")).select("mask_id", "col", "start", "stop")


def _reach(pixels: DataFrame, radius: int, axis: str) -> DataFrame:
    """Every place within ``radius`` of a pixel along one axis, once."""
    at = pixels.withColumn("d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, F.col(axis) + F.col("d"))
    return at.select("mask_id", "row", "col").distinct()


def _marked(pixels: DataFrame, which: str, radius: int) -> DataFrame:
    """``pixels`` with whether one of those that ``which`` picks is in the square around; down, then across, so 2 (2 radius + 1) rows each."""
    near = _reach(_reach(pixels.filter(which).select("mask_id", "row", "col"), radius, "row"), radius, "col").withColumn("near", F.lit(True))
    return pixels.drop("is_set").join(near, ["mask_id", "row", "col"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def dilate(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Set where any pixel in the square is set; the raster keeps its extent."""
    return _marked(pixels, "is_set", radius).withColumnRenamed("near", "is_set")


def erode(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Unset where any pixel in the square is unset; places beyond the raster don't count."""
    return _marked(pixels, "not is_set", radius).withColumn("is_set", ~F.col("near")).drop("near")


def close_mask(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(pixels, radius), radius)


def open_mask(pixels: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(pixels, radius), radius)


def fill_cavities(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Set where both the closed and the opened mask are."""
    opened = open_mask(pixels, radius).withColumnRenamed("is_set", "opened")
    return close_mask(pixels, radius).join(opened, ["mask_id", "row", "col"]).withColumn("is_set", F.col("is_set") & F.col("opened")).drop("opened")


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest unset one, beyond the edges all are: down the columns, then along the rows."""
    open_ = np.pad(mask, 1)
    down = np.where(open_, np.inf, 0.0)
    for r in range(1, len(down)):
        down[r] = np.minimum(down[r], down[r - 1] + 1)
    for r in range(len(down) - 2, -1, -1):
        down[r] = np.minimum(down[r], down[r + 1] + 1)
    least, square, width = np.full(down.shape, np.inf), down * down, down.shape[1]
    for step in range(width):  # the nearest unset cell is no farther than the best so far
        if step * step >= least.max():
            break
        least[:, step:] = np.minimum(least[:, step:], square[:, : width - step] + step * step)
        least[:, : width - step] = np.minimum(least[:, : width - step], square[:, step:] + step * step)
    return np.sqrt(least)[1:-1, 1:-1]


def distance_map(cells: Column, height: int, width: int) -> Column:
    """Array of distances of each cell to the nearest unset one, a border of unset cells included; 0 where unset."""

    @F.pandas_udf("array<double>")
    def far(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: distances(np.asarray(m, bool).reshape(height, width)).ravel())

    return far(cells)


def _crossings(x: np.ndarray, y: np.ndarray, ring: np.ndarray, cell: float, most: int):
    """Where the lines of cell centres cross rings, given as vertices: (ring, row, x) by ring, row and x, whole rings' rows, about ``most`` at a time."""
    centre = lambda k: (k + 0.5) * cell
    last = np.flatnonzero(np.diff(ring, append=-1))
    nxt = np.arange(1, len(x) + 1)
    nxt[last] = np.append(0, last[:-1] + 1)[: len(last)]
    qx, qy = x[nxt], y[nxt]
    low, high = first_at(np.minimum(y, qy), cell), first_at(np.maximum(y, qy), cell)
    total = np.zeros(len(x), np.int64)  # rows up to the end of each ring
    total[last] = np.diff(np.cumsum(high - low)[last], prepend=0)
    total = np.cumsum(total)
    a = 0
    while a < len(x):
        done = total[a - 1] if a else 0
        fits = last[total[last] <= done + most]
        b = max(int(fits[-1]) if len(fits) else 0, int(last[np.searchsorted(last, a)])) + 1
        bottom, top = int(low[a:b].min()), int(high[a:b].max())
        step = top - bottom if total[b - 1] - done <= most else max(1, most // (b - a))  # one large ring: some rows at a time
        for k0 in range(bottom, top, max(1, step)):
            from_, to = np.clip(low[a:b], k0, k0 + step), np.clip(high[a:b], k0, k0 + step)
            n = to - from_
            e = np.repeat(np.arange(a, b), n)
            row = np.arange(len(e)) + np.repeat(from_ - np.cumsum(n) + n, n)
            at = (qx[e] - x[e]) * (centre(row) - y[e]) / (qy[e] - y[e]) + x[e]
            order = np.lexsort((at, row, ring[e]))
            yield ring[e][order], row[order], at[order]
        a = b


def first_at(v: np.ndarray, cell: float) -> np.ndarray:
    """The first cell whose centre is at ``v`` or beyond."""
    k = np.ceil(v / cell - 0.5).astype(np.int64)
    k -= (k - 0.5) * cell >= v
    return k + ((k + 0.5) * cell < v)


def ring_runs(rings: DataFrame, cell: float = 1.0, most: int = 1 << 19) -> DataFrame:
    """(id, row, start, stop): runs of cells whose centre is in the ring (x along columns, y along rows), stop exclusive.

    Between two crossings of a row's centre line with the ring all centres are
    inside or none is, so the work grows with the rows and not with the cells.
    Vertices without a coordinate are left out.
    """
    kind = rings.schema["id"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            pts = batch.column("ring")
            flat, ring = pts.flatten(), np.repeat(np.arange(len(pts)), pts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x, y = (np.asarray(flat.field(c).to_numpy(zero_copy_only=False), float) for c in "xy")
            there = ~(np.isnan(x) | np.isnan(y) | np.asarray(flat.is_null()))
            x, y, ring = x[there], y[there], ring[there]
            if np.isinf(x).any() or np.isinf(y).any():
                raise ValueError("a ring has an infinite coordinate")
            for of, row, at in _crossings(x, y, ring, cell, most):
                start, stop = first_at(at[0::2], cell), first_at(at[1::2], cell)
                some = start < stop
                ints = [pa.array(v[some]).cast(pa.int32()) for v in (row[0::2], start, stop)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of[0::2][some])), *ints], names=["id", "row", "start", "stop"])

    points = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    # dealt anew, as a file of few blocks holds rings of many rows
    return rings.select("id", points.alias("ring")).repartition("id").mapInArrow(runs, f"id {kind}, row int, start int, stop int")


def rasterize(rings: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id, row, col): cells whose centre is in the ring (x along columns, y along rows)."""
    return ring_runs(rings, cell).select("id", "row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("col"))


def warp_rows(segments: DataFrame, width: int) -> DataFrame:
    """(line_id, strip_row, strip_col, src_row, src_col): for each cell of the straight strip along a line the source pixel.

    ``segments`` has line_id, before (length up to it, pixels), px, py, x, y (its
    ends, pixels).  Strip columns run along the line and a segment fills those
    from int(before) to int(before + length); rows run across, ``width`` of them.
    """
    seg = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    s = segments.withColumn("seg", seg).withColumn("a", F.col("before").cast("int")).withColumn("z", (F.col("before") + F.col("seg")).cast("int")).filter("z > a")
    s = s.withColumn("strip_col", F.explode(F.sequence(F.col("a"), F.col("z") - 1))).withColumn("strip_row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    t, o = (F.col("strip_col") - F.col("a")) / F.col("seg"), F.col("strip_row") - width / 2
    ux, uy = (F.col("x") - F.col("px")) / F.col("seg"), (F.col("y") - F.col("py")) / F.col("seg")
    src_x = F.col("px") + t * (F.col("x") - F.col("px")) - o * uy
    src_y = F.col("py") + t * (F.col("y") - F.col("py")) + o * ux
    return s.select("line_id", "strip_row", "strip_col", F.floor(src_y + 0.5).cast("int").alias("src_row"), F.floor(src_x + 0.5).cast("int").alias("src_col"))


def warp(pixels: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """Strip pixels (line_id, row, col, is_set) looked up in the image of the same line_id; unset beyond it."""
    m = warp_rows(segments, width)
    p = pixels.select(F.col("line_id").alias("l"), F.col("row").alias("src_row"), F.col("col").alias("src_col"), "is_set")
    j = m.join(p, (m["line_id"] == p["l"]) & (m["src_row"] == p["src_row"]) & (m["src_col"] == p["src_col"]), "left")
    return j.select("line_id", F.col("strip_row").alias("row"), F.col("strip_col").alias("col"), F.coalesce("is_set", F.lit(False)).alias("is_set"))


def unwarp(strip: DataFrame, segments: DataFrame, width: int) -> DataFrame:
    """(line_id, row, col): image pixels that some set strip pixel comes from."""
    m = warp_rows(segments, width)
    s = strip.filter("is_set").select(F.col("line_id").alias("l"), F.col("row").alias("strip_row"), F.col("col").alias("strip_col"))
    j = m.join(s, (m["line_id"] == s["l"]) & (m["strip_row"] == s["strip_row"]) & (m["strip_col"] == s["strip_col"]), "left_semi")
    return j.select("line_id", F.col("src_row").alias("row"), F.col("src_col").alias("col")).distinct()


def select_best(candidates: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The candidate of least score in each group, the first by ``order`` on ties; null scores never win."""
    rest = [c for c in candidates.columns if c != group]
    return candidates.filter(F.col(score).isNotNull()).groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(score, order)).alias("b")).select(group, "b.*")
