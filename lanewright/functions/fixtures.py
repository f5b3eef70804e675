"""Road-shaped tables derived from the relational test tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, spacing: int = 50) -> DataFrame:
    """FX1: grid nodes (id, gx, gy, x, y)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    c = c.withColumn("gx", F.col("id") % 40).withColumn("gy", F.expr("id div 40"))
    return c.withColumn("x", (593000 + spacing * F.col("gx")).cast("double")).withColumn("y", (5762000 + spacing * F.col("gy")).cast("double"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: undirected grid edges (edge_id, src, dst), each in its stored orientation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    right = F.when(F.col("c_nationkey") % 2 == 0, F.struct((2 * F.col("k")).alias("edge_id"), F.col("k").alias("src"), (F.col("k") + 1).alias("dst")))
    up = F.when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), F.struct((2 * F.col("k") + 1).alias("edge_id"), F.col("k").alias("src"), (F.col("k") + 40).alias("dst")))
    e = c.select(F.explode(F.array_compact(F.array(right, up))).alias("e")).select("e.*")
    e = e.join(c.select(F.col("k").alias("dst")), "dst", "left_semi")
    return e.filter((F.col("dst") == F.col("src") + 40) | (F.expr("src div 40") == F.expr("dst div 40"))).select("edge_id", "src", "dst")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: polylines as points (line_id, pos, x, y), one line for each user."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return e.select(F.col("user_id").alias("line_id"), "pos", (10 * F.col("pos")).cast("double").alias("x"), F.col("value").alias("y"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: 8 x 8 masks as arrays (mask_id, label, cells)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("mask_id"), "label", F.transform("embedding", lambda v: v > 0).alias("cells"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4 in long form (mask_id, label, row, col, value, is_set)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mask_id"), "label", F.posexplode(F.slice("embedding", 1, 64)).alias("i", "value"))
    return e.select("mask_id", "label", F.expr("i div 8").cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.col("value").cast("double").alias("value"), (F.col("value") > 0).alias("is_set"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: rectangles (id, truth, x0, y0, x1, y1)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM").alias("truth"), "p_size")
    p = p.withColumn("x0", (10 * (F.col("id") % 50)).cast("double")).withColumn("y0", (10 * F.expr("id div 50")).cast("double"))
    return p.select("id", "truth", "x0", "y0", (F.col("x0") + F.col("p_size")).alias("x1"), (F.col("y0") + 51 - F.col("p_size")).alias("y1"))


def point_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: points (grp, x, y)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("grp"), F.round(1e4 * F.col("embedding")[0].cast("double")).alias("x"), F.round(1e4 * F.col("embedding")[1].cast("double")).alias("y"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9: (id, lon, lat)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.withColumn("lon", 4.35 + 0.0001 * F.col("id")).withColumn("lat", 52.0 + 0.0001 * F.col("id"))
