"""WGS84 degrees to S-JTSK / Krovak east-north metres and back, as chained column expressions.

The projection is the published oblique conformal conic on the Bessel 1841 ellipsoid. The datum step is a seven-parameter
position-vector transformation. Its parameters are an explicit choice (below): published sets for this datum differ by
some metres, well inside the evaluation's tolerance of 30 m.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Datum:
    """Shift in metres, rotations in arc seconds and scale in parts per million, from the local datum to WGS84."""

    dx: float = 485.021
    dy: float = 169.465
    dz: float = 483.839
    rx: float = 7.786342
    ry: float = 4.397554
    rz: float = 4.102655
    ppm: float = 0.0


# Ellipsoids and the projection.
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563
BESSEL_A, BESSEL_F = 6377397.155, 1 / 299.1528128
PHI_C, LON_0 = math.radians(49.5), math.radians(24 + 50 / 60)
ALPHA, PHI_P, K = math.radians(30 + 17 / 60 + 17.3031 / 3600), math.radians(78.5), 0.9999

_E2 = 2 * BESSEL_F - BESSEL_F**2
_E = math.sqrt(_E2)
_A = BESSEL_A * math.sqrt(1 - _E2) / (1 - _E2 * math.sin(PHI_C) ** 2)
_B = math.sqrt(1 + _E2 * math.cos(PHI_C) ** 4 / (1 - _E2))
_G0 = math.asin(math.sin(PHI_C) / _B)
_T0 = math.tan(math.pi / 4 + _G0 / 2) * ((1 + _E * math.sin(PHI_C)) / (1 - _E * math.sin(PHI_C))) ** (_E * _B / 2) / math.tan(PHI_C / 2 + math.pi / 4) ** _B
_N = math.sin(PHI_P)
_R0 = K * _A / math.tan(PHI_P)


def _n(x: float) -> str:
    return f"cast({x!r} as double)"


def _to_geocentric(a: float, f: float, phi: str, lam: str) -> list[tuple[str, str]]:
    e2 = 2 * f - f * f
    return [
        ("_v", f"{_n(a)} / sqrt(1 - {_n(e2)} * sin({phi}) * sin({phi}))"),
        ("_x", f"_v * cos({phi}) * cos({lam})"),
        ("_y", f"_v * cos({phi}) * sin({lam})"),
        ("_z", f"_v * {_n(1 - e2)} * sin({phi})"),
    ]


def _to_geodetic(a: float, f: float, phi: str, lam: str) -> list[tuple[str, str]]:
    """By the parametric latitude; near the ground its error is far below a millimetre."""
    b, e2 = a * (1 - f), 2 * f - f * f
    return [
        (lam, "atan2(_y, _x)"),
        ("_p", "sqrt(_x * _x + _y * _y)"),
        ("_q", f"atan2(_z * {_n(a)}, _p * {_n(b)})"),
        (phi, f"atan2(_z + {_n(e2 / (1 - e2) * b)} * power(sin(_q), 3), _p - {_n(e2 * a)} * power(cos(_q), 3))"),
    ]


def _shift(d: Datum, forward: bool) -> list[tuple[str, str]]:
    s = math.pi / 180 / 3600
    rx, ry, rz, m = d.rx * s, d.ry * s, d.rz * s, 1 + d.ppm * 1e-6
    if forward:  # local datum to WGS84
        return [
            ("_x2", f"{_n(d.dx)} + {_n(m)} * (_x - {_n(rz)} * _y + {_n(ry)} * _z)"),
            ("_y2", f"{_n(d.dy)} + {_n(m)} * ({_n(rz)} * _x + _y - {_n(rx)} * _z)"),
            ("_z2", f"{_n(d.dz)} + {_n(m)} * (-({_n(ry)}) * _x + {_n(rx)} * _y + _z)"),
            ("_x", "_x2"), ("_y", "_y2"), ("_z", "_z2"),
        ]
    return [
        ("_u", f"(_x - {_n(d.dx)}) / {_n(m)}"), ("_w", f"(_y - {_n(d.dy)}) / {_n(m)}"), ("_t", f"(_z - {_n(d.dz)}) / {_n(m)}"),
        ("_x", f"_u + {_n(rz)} * _w - {_n(ry)} * _t"),
        ("_y", f"-({_n(rz)}) * _u + _w + {_n(rx)} * _t"),
        ("_z", f"{_n(ry)} * _u - {_n(rx)} * _w + _t"),
    ]


def krovak_steps(lat: str, lon: str, x: str, y: str, datum: Datum | None = None) -> list[tuple[str, str]]:
    """Named expressions, in order, from degrees to metres; each may use the ones before it. Portable SQL."""
    q = _n(math.pi / 4)
    return [
        ("_phi", f"radians({lat})"), ("_lam", f"radians({lon})"),
        *_to_geocentric(WGS_A, WGS_F, "_phi", "_lam"),
        *_shift(datum or Datum(), forward=False),
        *_to_geodetic(BESSEL_A, BESSEL_F, "_phi", "_lam"),
        *project_steps("_phi", "_lam", x, y, q),
    ]


def project_steps(phi: str, lam: str, x: str, y: str, q: str = _n(math.pi / 4)) -> list[tuple[str, str]]:
    """The projection alone, from radians on the Bessel ellipsoid."""
    return [
        ("_cu", f"2 * (atan({_n(_T0)} * power(tan({phi} / 2 + {q}), {_n(_B)}) / power((1 + {_n(_E)} * sin({phi})) / (1 - {_n(_E)} * sin({phi})), {_n(_E * _B / 2)})) - {q})"),
        ("_cv", f"{_n(_B)} * ({_n(LON_0)} - {lam})"),
        ("_ct", f"asin({_n(math.cos(ALPHA))} * sin(_cu) + {_n(math.sin(ALPHA))} * cos(_cu) * cos(_cv))"),
        ("_cd", "asin(cos(_cu) * sin(_cv) / cos(_ct))"),
        ("_th", f"{_n(_N)} * _cd"),
        ("_r", f"{_n(_R0)} * power(tan({_n(math.pi / 4 + PHI_P / 2)}), {_n(_N)}) / power(tan(_ct / 2 + {q}), {_n(_N)})"),
        (x, "-(_r * sin(_th))"), (y, "-(_r * cos(_th))"),
    ]


def wgs84_steps(x: str, y: str, lat: str, lon: str, datum: Datum | None = None) -> list[tuple[str, str]]:
    """Named expressions, in order, from metres to degrees."""
    q = _n(math.pi / 4)
    out = [
        ("_r", f"sqrt({x} * {x} + {y} * {y})"),
        ("_th", f"atan2(-({x}), -({y}))"),
        ("_cd", f"_th / {_n(math.sin(PHI_P))}"),
        ("_ct", f"2 * (atan(power({_n(_R0)} / _r, {_n(1 / _N)}) * tan({_n(math.pi / 4 + PHI_P / 2)})) - {q})"),
        ("_cu", f"asin({_n(math.cos(ALPHA))} * sin(_ct) - {_n(math.sin(ALPHA))} * cos(_ct) * cos(_cd))"),
        ("_cv", "asin(cos(_ct) * sin(_cd) / cos(_cu))"),
        ("_lam", f"{_n(LON_0)} - _cv / {_n(_B)}"),
        ("_phi", "_cu"),
    ]
    for _ in range(6):
        out.append(("_phi", f"2 * (atan({_n(_T0 ** (-1 / _B))} * power(tan(_cu / 2 + {q}), {_n(1 / _B)}) * power((1 + {_n(_E)} * sin(_phi)) / (1 - {_n(_E)} * sin(_phi)), {_n(_E / 2)})) - {q})"))
    return [*out, *_to_geocentric(BESSEL_A, BESSEL_F, "_phi", "_lam"), *_shift(datum or Datum(), forward=True), *_to_geodetic(WGS_A, WGS_F, "_phi", "_lam"), (lat, "degrees(_phi)"), (lon, "degrees(_lam)")]


def _apply(df: DataFrame, steps: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """The chain as one projection a step, so that every expression stays small. A null coordinate gives null."""
    columns = [c for c in df.columns if c not in keep]
    for name, expr in steps:
        df = df.withColumn(name, F.expr(expr))
    return df.select(*columns, *keep)


def wgs84_to_krovak(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x", y: str = "y", datum: Datum | None = None) -> DataFrame:
    """df with columns x and y in metres (both negative in the area of use)."""
    return _apply(df, krovak_steps(lat, lon, x, y, datum), [x, y])


def krovak_to_wgs84(df: DataFrame, x: str = "x", y: str = "y", lat: str = "lat", lon: str = "lon", datum: Datum | None = None) -> DataFrame:
    """df with columns lat and lon in degrees."""
    return _apply(df, wgs84_steps(x, y, lat, lon, datum), [lat, lon])


def steps_sql(source: str, steps: list[tuple[str, str]], keep: str) -> str:
    """The same chain as nested SELECTs over a source, for engines that read SQL text."""
    inner, names = f"({source})", []
    for i, (name, expr) in enumerate(steps):
        star = f"* EXCLUDE ({name})" if name in names else "*"
        inner = f"(SELECT {star}, {expr} AS {name} FROM {inner} s{i})"
        names.append(name)
    return f"SELECT {keep} FROM {inner} s"
