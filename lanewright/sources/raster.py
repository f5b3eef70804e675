"""Uncompressed TIFF rasters with their geotransform, through Spark's binary file reader."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}
SCHEMA = "path string, height int, width int, bands int, affine array<double>, resolution double, minx double, miny double, maxx double, maxy double, values array<double>"


def decode(data: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """(height, width, bands) values and the affine (a, b, c, d, e, f) of an uncompressed, striped, chunky TIFF."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(f"{end}I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(f"{end}H", data, at)[0]):
        tag, kind, n = struct.unpack_from(f"{end}HHI", data, at + 2 + 12 * k)
        if kind in _SIZES:
            code, size = _SIZES[kind]
            place = at + 10 + 12 * k
            place = place if n * size <= 4 else struct.unpack_from(f"{end}I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{end}{n}{code}", data, place)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("only uncompressed rasters are read")
    width, height, bands, bits, kind = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    raw = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    values = np.frombuffer(raw, np.dtype(f"{end}{'f' if kind == 3 else 'u'}{bits // 8}")).reshape(height, width, bands)
    sx, sy = tags.get(33550, (1.0, 1.0))[:2]
    tie = tags.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    return values, (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)


def encode(values: np.ndarray, affine: tuple[float, ...]) -> bytes:
    """A one-strip TIFF of unsigned bytes."""
    height, width, bands = values.shape
    entries = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (8,)), (259, 3, (1,)), (262, 3, (1,)), (273, 4, None), (277, 3, (bands,)), (278, 4, (height,)), (279, 4, (values.size,)), (33550, 12, (affine[0], -affine[4], 0.0)), (33922, 12, (0.0, 0.0, 0.0, affine[2], affine[5], 0.0))]
    extra_at = 8 + 2 + 12 * len(entries) + 4
    extra = b"".join(struct.pack(f"<{len(v)}d", *v) for _, t, v in entries if t == 12)
    out, used = struct.pack("<H", len(entries)), 0
    for tag, kind, v in entries:
        v = (extra_at + len(extra),) if v is None else v
        if kind == 12:
            out += struct.pack("<HHII", tag, kind, len(v), extra_at + used)
            used += 8 * len(v)
        else:
            out += struct.pack("<HHI", tag, kind, len(v)) + struct.pack("<" + _SIZES[kind][0], v[0]).ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, 8) + out + struct.pack("<I", 0) + extra + values.astype(np.uint8).tobytes()


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: size, geotransform, mean resolution, bounds and values in row order, bands last."""

    def rows(parts):
        for pdf in parts:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                v, a = decode(bytes(data))
                h, w, bands = v.shape
                out.append((name, h, w, bands, list(a), abs((a[0] - a[4]) / 2), a[2], a[5] + h * a[4], a[2] + w * a[0], a[5], v.reshape(-1).astype(float).tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)


def pixels(rasters: DataFrame, band: int = 0) -> DataFrame:
    """Long form (mask_id, row, col, value, is_set)."""
    p = rasters.select(F.col("path").alias("mask_id"), "width", "bands", F.posexplode("values").alias("i", "value")).filter((F.col("i") % F.col("bands")) == band)
    k = F.floor(F.col("i") / F.col("bands"))
    return p.select("mask_id", F.floor(k / F.col("width")).cast("int").alias("row"), (k % F.col("width")).cast("int").alias("col"), "value", (F.col("value") > 0).alias("is_set"))
