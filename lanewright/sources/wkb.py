"""Well-known binary and the GeoPackage header around it."""

from __future__ import annotations

import struct


def parse(data: bytes) -> tuple[str, list]:
    """(type, coordinates) of a point, line or polygon, or the multi form of one; a GeoPackage header is skipped."""
    if data[:2] == b"GP":
        envelope = (0, 32, 48, 48, 64)[(data[3] >> 1) & 7]
        data = data[8 + envelope :]
    return _one(data, 0)[0]


def _one(data: bytes, at: int):
    end = "<" if data[at] else ">"
    kind = struct.unpack_from(f"{end}I", data, at + 1)[0] % 1000
    at += 5

    def points(n, at):
        v = struct.unpack_from(f"{end}{2 * n}d", data, at)
        return list(zip(v[::2], v[1::2])), at + 16 * n

    count = lambda at: (struct.unpack_from(f"{end}I", data, at)[0], at + 4)
    if kind == 1:
        p, at = points(1, at)
        return ("Point", p[0]), at
    if kind == 2:
        n, at = count(at)
        p, at = points(n, at)
        return ("LineString", p), at
    if kind == 3:
        n, at = count(at)
        rings = []
        for _ in range(n):
            m, at = count(at)
            p, at = points(m, at)
            rings.append(p)
        return ("Polygon", rings), at
    if kind in (4, 5, 6):
        n, at = count(at)
        parts = []
        for _ in range(n):
            (_, c), at = _one(data, at)
            parts.append(c)
        return (("MultiPoint", "MultiLineString", "MultiPolygon")[kind - 4], parts), at
    raise ValueError(f"unknown geometry type {kind}")


def write(kind: str, coordinates, srid: int = 0) -> bytes:
    """GeoPackage binary of a point, line or polygon."""
    flat = lambda pts: struct.pack(f"<{2 * len(pts)}d", *(v for p in pts for v in p))
    head = b"GP" + bytes([0, 1]) + struct.pack("<i", srid)
    if kind == "Point":
        return head + b"\x01" + struct.pack("<I", 1) + flat([coordinates])
    if kind == "LineString":
        return head + b"\x01" + struct.pack("<II", 2, len(coordinates)) + flat(coordinates)
    if kind == "Polygon":
        return head + b"\x01" + struct.pack("<II", 3, len(coordinates)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in coordinates)
    raise ValueError(f"unknown geometry type {kind}")
