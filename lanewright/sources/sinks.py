"""Writers of finished maps and metrics."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators import export
from lanewright.sources import gpkg


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_map_json(tables: dict[str, DataFrame], path: str, version: str = "1.3") -> None:
    """One JSON file on the driver's file system; rows are streamed, so no table is held whole."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"version": ' + json.dumps(version))
        for name, df in tables.items():
            rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator()
            out.write(f",\n{json.dumps(name)}: [")
            for k, row in enumerate(rows):
                out.write((",\n  " if k else "\n  ") + row["v"])
            out.write("]")
        out.write("}\n")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one row of ``metrics`` as a JSON object."""
    row = metrics.first()
    with open(path, "w", encoding="utf-8") as out:
        json.dump(row.asDict(), out)


def write_map_files(made: dict[str, DataFrame], folder: str) -> None:
    """lanes.gpkg, connectors.gpkg and polygons.gpkg of a generated map, each a layer named ``generated``, on the driver's file system."""
    os.makedirs(folder, exist_ok=True)
    polygons = made["polygons"].select(F.col("intersection_id").alias("element_id"), F.lit("intersection").alias("type"), "ring")
    files = {"lanes": (export.lanes_table(made["lanes"], made["links"]), "Polygon"), "connectors": (export.connectors_table(made["connectors"]), "LineString"), "polygons": (export.polygons_table(polygons), "Polygon")}
    for name, (rows, kind) in files.items():
        gpkg.write_layer(rows, os.path.join(folder, f"{name}.gpkg"), "generated", kind=kind)


def read_map_files(spark, folder: str) -> dict[str, DataFrame]:
    """The three tables of ``write_map_files``: boundaries and centrelines as arrays of points, neighbours as arrays of ids, polygons as rings."""
    read = lambda name: gpkg.read_layer(spark, os.path.join(folder, f"{name}.gpkg"), "generated")
    ids = lambda c: F.transform(F.filter(F.split(c, ", "), lambda v: v != ""), lambda v: v.cast("long")).alias(c)
    points = lambda *names: [export.coordinates(F.col(c)).alias(c) for c in names]
    first = F.col("geom")["rings"][0]
    lanes = read("lanes").select("element_id", "lane_id", "road_type", "from_object", "to_object", ids("predecessors"), ids("successors"), *points("boundary_left", "boundary_right", "centerline"), first.alias("ring"))
    connectors = read("connectors").select("connector_id", "source", "dest", "intersection_id", *points("left_boundary", "right_boundary"), "lane_type", "legal", *points("polygon"), first.alias("line"))
    return {"lanes": lanes, "connectors": connectors, "polygons": gpkg.polygons_only(read("polygons"), "geom").select("element_id", "type", "road_type", "ring")}
