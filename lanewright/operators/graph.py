"""Graph operators on edge tables: adjacency, dedup, connectivity, chain contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewright.functions.geom import point_segment_distance
from lanewright.sources.store import stored


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): targets of outgoing edges, then sources of incoming ones, each in edge order."""
    both = edges.select(F.col("src").alias("id"), F.lit(0).alias("dir"), "edge_id", F.col("dst").alias("other")).union(edges.select("dst", F.lit(1), "edge_id", "src"))
    return both.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dir", "edge_id", "other"))), lambda s: s["other"]).alias("neighbours"))


def undirected(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each undirected pair, in the orientation that comes first by ``order``."""
    pair = edges.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    first = pair.agg(F.min_by(F.struct("src", "dst"), order).alias("e"), F.min(order).alias(order))
    return first.select(order, "e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, deg) of nodes with an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))


def junctions(edges: DataFrame) -> DataFrame:
    """(id, deg, name): nodes whose degree is neither 0 nor 2, named i<n> by id.

    Names come from counts of id ranges, so no window holds more than a range.
    """
    j = degrees(edges).filter("deg <> 2").withColumn("part", F.shiftright("id", 16))
    counts = j.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    # One row for each 65,536 ids.
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = j.join(counts.select("part", before.alias("skip")), "part")
    n = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1 + F.col("skip")
    return j.select("id", "deg", F.concat(F.lit("i"), n.cast("string")).alias("name"))


def reverse_dedup(lines: DataFrame, key: str = "line_id", pts: str = "pts") -> DataFrame:
    """Drops lines whose reverse was kept before: of each class of a line and its reverse the orientation of the first stays.

    Repeats in that orientation stay; of lines equal to their own reverse only the first.
    Lines are compared by 128 bits of hashes, so no geometry is exchanged as text.
    """
    back = F.reverse(pts)
    ahead, other = ((F.xxhash64(p), F.xxhash64(F.lit("second"), p)) for p in (pts, back))
    named = lines.withColumn("__f", F.struct(ahead[0].alias("a"), ahead[1].alias("b"))).withColumn("__own", ahead[0] == other[0])
    named = named.withColumn("__k1", F.least(ahead[0], other[0])).withColumn("__k2", F.least(ahead[1], other[1]))  # the same for a line and its reverse
    first = named.groupBy("__k1", "__k2").agg(F.min_by("__f", key).alias("__first"), F.min(key).alias("__first_key"))
    kept = named.join(first, ["__k1", "__k2"]).filter((F.col("__f") == F.col("__first")) & (~F.col("__own") | (F.col(key) == F.col("__first_key"))))
    return kept.select(*lines.columns)


def connections(lanes: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(lane_id, phase, other, flip): successors (phase 0) and predecessors (phase 1) of each lane.

    ``lanes`` has lane_id, from_node, to_node, lane_group and pts.  Lanes at a
    node connect unless they are the same, of one group, or reverses of each
    other within the tolerances; a lane from and to one node counts twice there.
    """
    c = lanes.select(F.col("lane_id").alias("other"), F.col("from_node").alias("o_from"), F.col("to_node").alias("o_to"), F.col("lane_group").alias("o_group"), F.col("pts").alias("o_pts"))
    at = c.select("*", F.explode(F.array("o_from", "o_to")).alias("node"))
    ends = lanes.select("*", F.explode(F.array(F.struct(F.lit(0).alias("phase"), F.col("to_node").alias("here")), F.struct(F.lit(1).alias("phase"), F.col("from_node").alias("here")))).alias("end")).select("*", "end.phase", "end.here").drop("end")
    near = lambda a, b: F.abs(a - b) <= atol + rtol * F.abs(b)
    close = F.forall(F.zip_with(F.reverse("pts"), "o_pts", lambda p, q: near(p["x"], q["x"]) & near(p["y"], q["y"])), lambda t: t)
    is_reverse = (F.size("pts") == F.size("o_pts")) & close
    j = ends.join(at, F.col("here") == F.col("node")).filter((F.col("lane_id") != F.col("other")) & (F.col("lane_group") != F.col("o_group"))).filter(~is_reverse)
    flip = F.when(F.col("phase") == 0, F.col("o_from") != F.col("here")).otherwise(F.col("o_to") != F.col("here"))
    return j.select("lane_id", "phase", "other", flip.alias("flip"))


def contract(edges: DataFrame) -> DataFrame:
    """(road_from, road_to, nodes): chains between junctions, each once, with all nodes in order.

    Every edge is two half-edges; a half-edge into a node of degree 2 points at
    the next one.  Pointers are doubled until all that can reach a junction do,
    so the rounds grow with the logarithm of the longest chain.  Chains without
    a junction are left out.  The road starts at the end whose first half-edge is smaller.
    """
    half = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct()
    deg = half.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    into = half.join(deg, half["v"] == deg["id"]).select("u", "v", "deg")
    nxt = half.select(F.col("u").alias("nu"), F.col("v").alias("nv"))
    step = into.filter("deg = 2").join(nxt, (F.col("v") == F.col("nu")) & (F.col("nv") != F.col("u"))).select("u", "v", "nu", "nv", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done"))
    state = step.union(into.filter("deg <> 2").select("u", "v", F.col("u"), F.col("v"), F.lit(0).cast("long"), F.lit(True)))
    left = None
    while True:
        state = stored(state)
        now = state.filter("not done").count()
        if now == 0 or now == left:
            break
        left = now
        to = state.select(F.col("u").alias("tu"), F.col("v").alias("tv"), F.col("nu").alias("t_nu"), F.col("nv").alias("t_nv"), F.col("hops").alias("t_hops"), F.col("done").alias("t_done"))
        moved = state.filter("not done").join(to, (F.col("nu") == F.col("tu")) & (F.col("nv") == F.col("tv")))
        moved = moved.select("u", "v", F.col("t_nu").alias("nu"), F.col("t_nv").alias("nv"), (F.col("hops") + F.col("t_hops")).alias("hops"), F.col("t_done").alias("done"))
        state = state.filter("done").union(moved)
    done = state.filter("done")
    starts = done.join(deg.filter("deg <> 2").select(F.col("id").alias("u")), "u", "left_semi")
    keep = starts.filter((F.col("u") < F.col("nv")) | ((F.col("u") == F.col("nv")) & (F.col("v") <= F.col("nu")))).select(F.col("nu").alias("end_u"), F.col("nv").alias("end_v"), F.col("u").alias("road_from"), F.col("v").alias("road_next"))
    way = done.join(keep, (F.col("nu") == F.col("end_u")) & (F.col("nv") == F.col("end_v"))).groupBy("road_from", "road_next", F.col("end_v").alias("road_to"), "end_u")
    way = way.agg(F.sort_array(F.collect_list(F.struct("hops", "u")), asc=False).alias("w"))
    return way.select("road_from", "road_to", F.concat(F.transform("w", lambda s: s["u"]), F.array("road_to")).alias("nodes"))


def stitch_tiles(tile_nodes: DataFrame, tile_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of tiles (tile, local id) with ids that run over all tiles in order of tile."""
    sizes = tile_nodes.groupBy("tile").agg(F.count(F.lit(1)).alias("k"))
    offset = F.coalesce(F.sum("k").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each tile
    sizes = sizes.select("tile", offset.alias("skip"))
    nodes = tile_nodes.join(sizes, "tile").select("tile", (F.col("local_id") + F.col("skip")).alias("id"))
    edges = tile_edges.join(sizes, "tile").select("tile", (F.col("u") + F.col("skip")).alias("src"), (F.col("v") + F.col("skip")).alias("dst"))
    return nodes, edges


def near_lanes(nodes: DataFrame, segments: DataFrame, threshold: float) -> DataFrame:
    """Nodes (id, x, y) nearer than ``threshold`` to a segment (x1, y1, x2, y2): grid buckets, then exact distances."""
    cell = lambda v: F.floor(v / threshold).cast("long")
    s = segments.select("x1", "y1", "x2", "y2").withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2")) - 1, cell(F.greatest("x1", "x2")) + 1)))
    s = s.withColumn("cy", F.explode(F.sequence(cell(F.least("y1", "y2")) - 1, cell(F.greatest("y1", "y2")) + 1)))
    n = nodes.withColumn("ncx", cell(F.col("x"))).withColumn("ncy", cell(F.col("y")))
    d = point_segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return n.join(s, (F.col("ncx") == F.col("cx")) & (F.col("ncy") == F.col("cy")) & (d < threshold), "left_semi").drop("ncx", "ncy")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: for each key the row of greatest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def missing(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key isn't held yet."""
    return wanted.join(held.select(key), key, "left_anti")
