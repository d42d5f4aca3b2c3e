"""Vector arithmetic over array columns, in double precision, as SQL text and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this, so that a zero vector stays zero.
EPS = 1e-12


def dot_sql(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, p) -> s + p)"


def norm_sql(v: str) -> str:
    return f"sqrt({dot_sql(v, v)})"


def normalize_sql(v: str) -> str:
    return f"transform({v}, e -> cast(e as double) / greatest({norm_sql(v)}, {EPS}D))"


def dot(a: str, b: str) -> Column:
    return F.expr(dot_sql(a, b))


def normalize(v: str) -> Column:
    """v over its length. The length is worked out once a vector: it is a field of a one-element array's only struct."""
    return F.expr(f"transform(array({norm_sql(v)}), n -> transform({v}, e -> cast(e as double) / greatest(n, {EPS}D)))[0]")


def rounded(v: str, digits: int = 6) -> Column:
    return F.transform(F.col(v), lambda e: F.round(e, digits))
