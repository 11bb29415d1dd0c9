"""Column expressions: vectors, volumes, quality, lengths in a metric, barycentrics, tensors.

A point or vector is a tuple of three columns; a symmetric tensor a tuple of
six (xx, xy, xz, yy, yz, zz). Everything is built-in arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Ten = tuple[Column, Column, Column, Column, Column, Column]


def point(prefix: str, suffix: object = "") -> Vec:
    """The columns x, y, z of a corner, as ``attach_corners`` names them."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def scaled(a: Vec, k: Column) -> Vec:
    return tuple(p * k for p in a)


def six_volumes(p: Sequence[Vec]) -> Column:
    """Six times the signed volume of a tetra."""
    return dot(sub(p[1], p[0]), cross(sub(p[2], p[0]), sub(p[3], p[0])))


def volume(p: Sequence[Vec]) -> Column:
    return six_volumes(p) / 6.0


def squared_edges(p: Sequence[Vec]) -> Column:
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    out = None
    for i, j in pairs:
        e = sub(p[j], p[i])
        out = dot(e, e) if out is None else out + dot(e, e)
    return out


def quality(p: Sequence[Vec]) -> Column:
    """72 sqrt(3) V / (sum of squared edges)**1.5: one for a regular tetra, zero or less for an inverted one."""
    total = squared_edges(p)
    return F.when(total > 0, F.lit(72.0 * 3.0**0.5) * volume(p) / (total * F.sqrt(total))).otherwise(0.0)


def scalar_length(length: Column, h0: Column, h1: Column) -> Column:
    """Length of an edge in a size field that varies linearly between its ends; null unless sizes are positive."""
    ratio = h1 / h0
    same = F.abs(h1 - h0) < 1e-6 * h0
    return F.when((h0 > 0) & (h1 > 0), F.when(same, length / h0).otherwise(length * F.log(ratio) / (h1 - h0)))


def tensor_form(m: Ten, e: Vec) -> Column:
    """e^T M e."""
    xx, xy, xz, yy, yz, zz = m
    return xx * e[0] * e[0] + yy * e[1] * e[1] + zz * e[2] * e[2] + 2.0 * (xy * e[0] * e[1] + xz * e[0] * e[2] + yz * e[1] * e[2])


def tensor_length(e: Vec, m0: Ten, m1: Ten) -> Column:
    """Mean of the edge's lengths in the metrics of its ends."""
    return (F.sqrt(tensor_form(m0, e)) + F.sqrt(tensor_form(m1, e))) / 2.0


def tensor_inverse(m: Ten) -> Ten:
    """The inverse of a symmetric tensor; null if it is singular."""
    xx, xy, xz, yy, yz, zz = m
    cxx, cxy, cxz = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    det = xx * cxx + xy * cxy + xz * cxz
    cof = (cxx, cxy, cxz, xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy)
    return tuple(F.when(F.abs(det) > 1e-200, c / det) for c in cof)


def array_tensor(value: Column) -> Ten:
    return tuple(F.get(value, F.lit(i)) for i in range(6))


def barycentric(p: Sequence[Vec], q: Vec) -> list[Column]:
    """The four coordinates of q in a tetra; null if the tetra is flat. They sum to one."""
    whole = six_volumes(p)
    out = []
    for i in range(4):
        moved = list(p)
        moved[i] = q
        out.append(F.when(whole != 0, six_volumes(moved) / whole))
    return out


def triangle_normal(p: Sequence[Vec]) -> Vec:
    """Twice the area, along the normal."""
    return cross(sub(p[1], p[0]), sub(p[2], p[0]))


def barycentric2d(p: Sequence[Vec], q: Vec) -> tuple[list[Column], Column]:
    """The three coordinates of q's projection on a triangle, and q's signed distance from its plane."""
    n = triangle_normal(p)
    nn = dot(n, n)
    out = []
    for i in range(3):
        a, b = p[(i + 1) % 3], p[(i + 2) % 3]
        out.append(F.when(nn > 0, dot(cross(sub(a, q), sub(b, q)), n) / nn))
    return out, F.when(nn > 0, dot(sub(q, p[0]), n) / F.sqrt(nn))


def interface_weight(lengths: Sequence[Column], exponent: float = 28.0, most: float = 1e6) -> Column:
    """min(1 / exp(exponent * mean deviation of the face's three lengths), most); short and long edges weigh heavily."""
    total = None
    for x in lengths:
        d = F.when(x <= 1.0, x - 1.0).otherwise(1.0 / x - 1.0)
        total = d if total is None else total + d
    return F.least(1.0 / F.exp(F.lit(exponent) * total / 3.0), F.lit(most))


def sort3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return low, a + b + c - low - high, high
