"""GeoPackage layers as a Spark data source, and a writer for finished tables."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lanewright.sources import wkb

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "BLOB": "binary"}
_GEOMETRY = "struct<type:string,rings:array<array<struct<x:double,y:double>>>>"


def _layer(path: str, layer: str | None):
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        name, geometry = next((x for x in found if layer is None or x[0] == layer), (None, None))
        if name is None:
            raise ValueError(f"no layer {layer!r} in {path}")
        columns = [(c[1], (c[2] or "TEXT").upper().partition("(")[0]) for c in db.execute(f'PRAGMA table_info("{name}")')]
        low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
    return name, geometry, columns, low, high


class GpkgSource(DataSource):
    """Options: path, layer (the first by default), rows (rowids in a partition).

    Geometry becomes (type, rings): a polygon's rings, a line as one ring, a
    point as one ring of one point, and the parts of multi forms one after another.
    """

    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        _, geometry, columns, _, _ = _layer(self.options["path"], self.options.get("layer"))
        return ", ".join(f"`{c}` {_GEOMETRY if c == geometry else _TYPES.get(t, 'string')}" for c, t in columns)

    def reader(self, schema):
        return GpkgReader(self.options)


class GpkgReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layer, self.rows = options["path"], options.get("layer"), int(options.get("rows", 50_000))

    def partitions(self):
        _, _, _, low, high = _layer(self.path, self.layer)
        return [InputPartition((a, a + self.rows)) for a in range(low, high + 1, self.rows)] if low is not None else []

    def read(self, partition):
        name, geometry, columns, _, _ = _layer(self.path, self.layer)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT * FROM "{name}" WHERE rowid >= ? AND rowid < ?', partition.value):
                yield tuple(_rings(v) if c == geometry else (None if v is None else bool(v)) if t == "BOOLEAN" else v for (c, t), v in zip(columns, row))


def _rings(data):
    if data is None:
        return None
    kind, c = wkb.parse(data)
    pts = lambda ring: [{"x": p[0], "y": p[1]} for p in ring]
    rings = {"Point": lambda: [[c]], "LineString": lambda: [c], "Polygon": lambda: c, "MultiPoint": lambda: [c], "MultiLineString": lambda: c, "MultiPolygon": lambda: [r for p in c for r in p]}[kind]()
    return (kind, [pts(r) for r in rings])


def read_layer(spark, path: str, layer: str | None = None) -> DataFrame:
    spark.dataSource.register(GpkgSource)
    reader = spark.read.format("gpkg").option("path", path)
    return (reader.option("layer", layer) if layer else reader).load()


def polygons_only(df: DataFrame, geometry: str) -> DataFrame:
    """Rows with a single polygon; its outer ring as ``ring``."""
    return df.filter(F.col(geometry)["type"] == "Polygon").withColumn("ring", F.col(geometry)["rings"][0])


def write_layer(df: DataFrame, path: str, layer: str, ring: str = "geometry", kind: str = "Polygon", srid: int = 32631) -> None:
    """One layer of a file on the driver's file system, streamed partition by partition; arrays but the ring go as text."""
    names = [c for c in df.columns if c != ring]
    sql_type = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN"}
    columns = ", ".join(f'"{c}" {sql_type.get(dict(df.dtypes)[c], "TEXT")}' for c in names)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB{", " + columns if columns else ""})')
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (layer, kind.upper(), srid))
        marks = ", ".join("?" * (len(names) + 1))
        insert = f'INSERT INTO "{layer}" (geom{"".join(f", {chr(34)}{c}{chr(34)}" for c in names)}) VALUES ({marks})'
        for row in df.toLocalIterator():
            pts = [(p["x"], p["y"]) for p in row[ring]] if row[ring] is not None else None
            if pts and kind == "Polygon" and pts[0] != pts[-1]:
                pts.append(pts[0])
            shape = None if pts is None else wkb.write(kind, [pts] if kind == "Polygon" else pts[0] if kind == "Point" else pts, srid)
            db.execute(insert, (shape, *(str(row[c]) if isinstance(row[c], (list, dict)) else row[c] for c in names)))
