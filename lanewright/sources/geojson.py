"""Road graphs as GeoJSON: nodes (id, point) and edges (id, node1, node2, two-point line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators.graph import undirected

_NODES = "features array<struct<properties:struct<id:bigint>,geometry:struct<type:string,coordinates:array<double>>>>"
_EDGES = "features array<struct<properties:struct<id:bigint,node1:bigint,node2:bigint>,geometry:struct<type:string,coordinates:array<array<double>>>>>"


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """(id, x, y) and (edge_id, src, dst)."""
    f = lambda path, schema: spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    n = f(nodes_path, _NODES).select("f.properties.id", F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"))
    e = f(edges_path, _EDGES).select(F.col("f.properties.id").alias("edge_id"), F.col("f.properties.node1").alias("src"), F.col("f.properties.node2").alias("dst"))
    return n, e


def features(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One GeoJSON feature in each row, as text; each undirected edge once, in the orientation of its least id."""
    point = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    n = nodes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"), point.alias("geometry"))).alias("value"))
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.array("x", "y").alias(name))
    e = undirected(edges, "edge_id").join(at("src", "p"), "src").join(at("dst", "q"), "dst")
    line = F.struct(F.lit("LineString").alias("type"), F.array("p", "q").alias("coordinates"))
    props = F.struct(F.col("edge_id").alias("id"), F.col("src").alias("node1"), F.col("dst").alias("node2"))
    return n, e.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), line.alias("geometry"))).alias("value"))


def write_graph(nodes: DataFrame, edges: DataFrame, nodes_path: str, edges_path: str) -> None:
    """Two GeoJSON files on the driver's file system, streamed partition by partition."""
    for rows, path in zip(features(nodes, edges), (nodes_path, edges_path)):
        with open(path, "w", encoding="utf-8") as out:
            out.write('{"type": "FeatureCollection", "features": [')
            for k, row in enumerate(rows.toLocalIterator()):
                out.write(("," if k else "") + row["value"])
            out.write("]}")
