"""Positions in the EXIF block of JPEG and TIFF files."""

from __future__ import annotations

import struct

# Tags and field sizes of the TIFF format.
GPS_IFD, LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT = 0x8825, 1, 2, 3, 4, 5, 6
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> bytes | None:
    if data[:2] in (b"II", b"MM"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(t: bytes, at: int, order: str) -> dict[int, list]:
    out: dict[int, list] = {}
    (n,) = struct.unpack_from(order + "H", t, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", t, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * count
        if not size:
            continue
        place = at + 2 + 12 * i + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "I", t, place)
        if kind == 2:
            out[tag] = [t[place : place + count].split(b"\0")[0].decode("ascii", "replace")]
        elif kind in (5, 10):
            parts = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, t, place)
            out[tag] = [a / b if b else float("nan") for a, b in zip(parts[::2], parts[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, t, place))
    return out


def gps_position(data: bytes) -> tuple[float, float, float | None] | None:
    """Latitude, longitude and altitude (or None) of an image file's bytes; None without a position."""
    t = _tiff(data)
    try:
        if t is None:
            return None
        order = "<" if t[:2] == b"II" else ">"
        main = _directory(t, struct.unpack_from(order + "I", t, 4)[0], order)
        if GPS_IFD not in main:
            return None
        gps = _directory(t, main[GPS_IFD][0], order)
        if LAT not in gps or LON not in gps:
            return None

        def degrees(tag: int, ref: int) -> float:
            d, m, s = (*gps[tag], 0.0, 0.0)[:3]
            value = d + m / 60 + s / 3600
            return -value if gps.get(ref, [""])[0] in ("S", "W") else value

        height = gps.get(ALT, [None])[0]
        if height is not None and gps.get(ALT_REF, [0])[0] == 1:
            height = -height
        return degrees(LAT, LAT_REF), degrees(LON, LON_REF), height
    except (struct.error, IndexError):
        return None
