"""Geohash cells, distances, polygons and coordinate parsing."""

from __future__ import annotations

import math
import re

EARTH_KM = 6373.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Great-circle distance in km."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(a)))


def wrap_longitude(lon: float) -> float:
    return (lon + 180.0) % 360.0 - 180.0


def geohash(lat: float, lon: float, precision: int = 6) -> str | None:
    """The cell of a point; longitudes wrap, latitudes outside [-90, 90) have none."""
    if lat is None or lon is None or not -90 <= lat < 90 or not math.isfinite(lon):
        return None
    lon = wrap_longitude(lon)
    bits = 5 * min(precision, 12)
    nx, ny = (bits + 1) // 2, bits // 2
    x, y = int((lon + 180) / 360 * (1 << nx)), int((lat + 90) / 180 * (1 << ny))
    return _pack(x, y, nx, ny)


def _pack(x: int, y: int, nx: int, ny: int) -> str:
    value = 0
    for i in range(nx + ny):
        if i % 2 == 0:
            value = value << 1 | (x >> (nx - 1 - i // 2)) & 1
        else:
            value = value << 1 | (y >> (ny - 1 - i // 2)) & 1
    n = (nx + ny) // 5
    return "".join(_BASE32[value >> 5 * (n - 1 - k) & 31] for k in range(n))


def _unpack(cell: str) -> tuple[int, int, int, int]:
    bits = 5 * len(cell)
    nx, ny = (bits + 1) // 2, bits // 2
    value = 0
    for c in cell:
        value = value << 5 | _BASE32.index(c)
    x = y = 0
    for i in range(bits):
        bit = value >> (bits - 1 - i) & 1
        if i % 2 == 0:
            x = x << 1 | bit
        else:
            y = y << 1 | bit
    return x, y, nx, ny


def neighbours(cell: str) -> list[str]:
    """The up to eight cells around; none beyond the poles."""
    x, y, nx, ny = _unpack(cell)
    out = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dx or dy) and 0 <= y + dy < 1 << ny:
                out.append(_pack((x + dx) % (1 << nx), y + dy, nx, ny))
    return list(dict.fromkeys(c for c in out if c != cell))


def cells_around(lat: float, lon: float, precision: int = 6) -> list[str]:
    """A point's cell and its neighbours; none for the origin, which stands for no location."""
    if not lat and not lon:
        return []
    cell = geohash(lat, lon, precision)
    return [cell, *neighbours(cell)] if cell else []


def box(cell: str) -> tuple[float, float, float, float]:
    """(south, west, north, east) of a cell."""
    x, y, nx, ny = _unpack(cell)
    w, h = 360 / (1 << nx), 180 / (1 << ny)
    return y * h - 90, x * w - 180, (y + 1) * h - 90, (x + 1) * w - 180


def cover(ring: list[tuple[float, float]], precision: int) -> list[str]:
    """Cells of the bounding box of a ring of (lon, lat)."""
    west, east = min(p[0] for p in ring), max(p[0] for p in ring)
    south, north = min(p[1] for p in ring), max(p[1] for p in ring)
    x0, y0, nx, ny = _unpack(geohash(south, west, precision))
    x1, y1, *_ = _unpack(geohash(min(north, 89.999999), min(east, 179.999999), precision))
    return [_pack(x, y, nx, ny) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]


def contains(rings: list[list[tuple[float, float]]], lon: float, lat: float) -> bool:
    """Even-odd rule over all rings, so holes are outside."""
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


_NUMBER = r"([+-]?\d+(?:[.,]\d+)?)"
_DMS = re.compile(rf"^\s*{_NUMBER}\s*[°d:\s]\s*(?:(\d+(?:[.,]\d+)?)\s*['′m:\s]\s*)?(?:(\d+(?:[.,]\d+)?)\s*(?:\"|″|''|s)?\s*)?([NSEWOnsewo])?\s*$")
_DECIMAL = re.compile(rf"^\s*{_NUMBER}\s*°?\s*([NSEWOnsewo])?\s*$")


def parse_coordinate(text: str | None) -> float | None:
    """Degrees of a decimal or degrees-minutes-seconds coordinate; south and west are negative."""
    if text is None:
        return None
    m = _DECIMAL.match(text)
    parts, side = ([m[1]], m[2]) if m else (None, None)
    if parts is None:
        m = _DMS.match(text)
        if not m:
            return None
        parts, side = [m[1], m[2] or "0", m[3] or "0"], m[4]
    values = [float(v.replace(",", ".")) for v in parts]
    degrees = abs(values[0]) + sum(v / 60**k for k, v in enumerate(values[1:], 1))
    negative = parts[0].startswith("-") or (side or "").upper() in ("S", "W", "O")
    return -degrees if negative else degrees


def parse_point(lat: str | None, lon: str | None) -> tuple[float, float] | None:
    """A valid (latitude, longitude); longitude wraps."""
    y, x = parse_coordinate(lat), parse_coordinate(lon)
    if y is None or x is None or not -90 <= y <= 90:
        return None
    return y, wrap_longitude(x) if abs(x) > 180 else x
