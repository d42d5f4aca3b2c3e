"""Geographic pages, tile windows and distances as column expressions.

Pages are square cells counted from the raster's upper left corner; rows grow southwards. A point belongs to the cell that
holds it half-open (its left and upper edges included). A page's box, in contrast, is closed on all sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_ID = r"^p(\d{4})_(\d{4})$"


@dataclass(frozen=True)
class Raster:
    """What the catalogue needs of a north-up raster: corner, ground size of a pixel, and size in pixels."""

    left: float
    top: float
    gsd: float
    width: int
    height: int

    def __post_init__(self) -> None:
        if self.gsd <= 0 or self.width <= 0 or self.height <= 0:
            raise ValueError("a raster needs a positive pixel size, width and height")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cell(x: str | Column, origin: float, size: float) -> Column:
    return F.floor((_c(x) - F.lit(float(origin))) / F.lit(float(size))).cast("int")


def page_col(x: str | Column, left: float, size: float) -> Column:
    return cell(x, left, size)


def page_row(y: str | Column, top: float, size: float) -> Column:
    return F.floor((F.lit(float(top)) - _c(y)) / F.lit(float(size))).cast("int")


def page_id(row: str | Column, col: str | Column) -> Column:
    return F.format_string("p%04d_%04d", _c(row), _c(col))


def parse_page_id(c: str | Column) -> tuple[Column, Column]:
    """Row and column, null where the text is no page id (five digits or a sign make none)."""

    def part(i: int) -> Column:
        text = F.regexp_extract(_c(c), PAGE_ID, i)
        return F.when(text != "", text.cast("int"))

    return part(1), part(2)


def page_box(row: str | Column, col: str | Column, left: float, top: float, size: float) -> dict[str, Column]:
    s = F.lit(float(size))
    minx, maxy = F.lit(float(left)) + _c(col) * s, F.lit(float(top)) - _c(row) * s
    return {"minx": minx, "miny": maxy - s, "maxx": minx + s, "maxy": maxy}


def distance(x1: str | Column, y1: str | Column, x2: str | Column, y2: str | Column) -> Column:
    return F.hypot(_c(x1) - _c(x2), _c(y1) - _c(y2))


def ground_window(x: str | Column, y: str | Column, side_m: float, raster: Raster) -> dict[str, Column]:
    """Pixel window of a square of side_m metres around a point: rounded half to even, at least one pixel wide."""
    half, g = side_m / 2.0, F.lit(float(raster.gsd))
    col0 = F.bround((_c(x) - F.lit(half) - F.lit(float(raster.left))) / g).cast("int")
    row0 = F.bround((F.lit(float(raster.top)) - _c(y) - F.lit(half)) / g).cast("int")
    col1 = F.bround((_c(x) + F.lit(half) - F.lit(float(raster.left))) / g).cast("int")
    row1 = F.bround((F.lit(float(raster.top)) - _c(y) + F.lit(half)) / g).cast("int")
    one = F.lit(1)
    return {"col_off": col0, "row_off": row0, "win_width": F.greatest(one, col1 - col0), "win_height": F.greatest(one, row1 - row0)}


def shrink_box(box: tuple[float, float, float, float], margin: float) -> tuple[float, float, float, float]:
    """(minx, miny, maxx, maxy) moved inwards on all sides; an error if nothing is left."""
    if len(box) != 4:
        raise ValueError("an area has four numbers")
    minx, miny, maxx, maxy = box
    out = minx + margin, miny + margin, maxx - margin, maxy - margin
    if out[0] >= out[2] or out[1] >= out[3]:
        raise ValueError("the margin leaves no area")
    return out


def dms_to_degrees(deg: str | Column, minute: str | Column, second: str | Column, ref: str | Column) -> Column:
    """Degrees of an angle in degrees, minutes and seconds; negative for references S and W."""
    value = _c(deg) + _c(minute) / F.lit(60.0) + _c(second) / F.lit(3600.0)
    return F.when(F.upper(_c(ref)).isin("S", "W"), -value).otherwise(value)


def altitude(value: str | Column, ref: str | Column) -> Column:
    """Metres above sea level; reference 1 means below."""
    return F.when(_c(ref) == 1, -_c(value)).otherwise(_c(value))
