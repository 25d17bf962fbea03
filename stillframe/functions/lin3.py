"""3x3 algebra as column expressions.  A matrix is a list of nine columns, row by row;
the columns of a basis matrix are its axes a, b, c."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[Column]
Vector = list[Column]


def matrix(name: str) -> Matrix:
    """The entries of an array<double> column of length nine."""
    return [F.col(name)[i] for i in range(9)]


def columns(m: Matrix) -> list[Vector]:
    return [[m[j], m[3 + j], m[6 + j]] for j in range(3)]


def dot(u: Vector, v: Vector) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Vector, v: Vector) -> Vector:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def norm(u: Vector) -> Column:
    return F.sqrt(dot(u, u))


def det(m: Matrix) -> Column:
    return dot(m[0:3], cross(m[3:6], m[6:9]))


def inverse(m: Matrix) -> Matrix:
    """The inverse; null where the matrix is singular."""
    d = det(m)
    a, b, c = columns(m)
    rows = [cross(b, c), cross(c, a), cross(a, b)]
    return [F.try_divide(x, d) for row in rows for x in row]


def times(q: Vector, m: Matrix) -> Vector:
    """The row vector q times the matrix."""
    return [dot(q, axis) for axis in columns(m)]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def angle(u: Vector, v: Vector) -> Column:
    """Degrees between two vectors; null if one has no length."""
    return F.degrees(F.acos(clip(F.try_divide(dot(u, v), norm(u) * norm(v)), -1.0, 1.0)))
