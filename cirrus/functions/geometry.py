"""Geometry expressions over columns: boxes, rotations by 45 degrees, Morton codes and patch placement."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each view id the rotation plane, normal, tangent and bitangent axis, and projection mode.
VIEWS = [
    (0, 0, 2, 1, 0), (0, 1, 2, 0, 0), (0, 2, 0, 1, 0), (0, 0, 2, 1, 1), (0, 1, 2, 0, 1), (0, 2, 0, 1, 1),
    (1, 0, 2, 1, 0), (1, 2, 0, 1, 0), (1, 0, 2, 1, 1), (1, 2, 0, 1, 1), (2, 2, 0, 1, 0), (2, 1, 2, 0, 0),
    (2, 2, 0, 1, 1), (2, 1, 2, 0, 1), (3, 1, 2, 0, 0), (3, 0, 2, 1, 0), (3, 1, 2, 0, 1), (3, 0, 2, 1, 1),
]
#: Orientations in which a patch's sides keep their directions; all others swap them.
UPRIGHT = (0, 3, 5, 7)


def inside(p: list[Column], lo: list[int], hi: list[int]) -> Column:
    out = F.lit(True)
    for c, a, b in zip(p, lo, hi):
        out = out & c.between(a, b)
    return out


def boxes_meet(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Boxes as (low, high) for each axis, ends included."""
    out = F.lit(True)
    for (lo, hi), (lo2, hi2) in zip(a, b):
        out = out & (lo <= hi2) & (lo2 <= hi)
    return out


def rectangle_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Rectangles as x, y, width, height."""
    w = F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def morton(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    """Bits of z, y and x in turn from the lowest up."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate((z, y, x)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1)), 3 * i + k))
    return out


def patch_to_canvas(o: Column, u: Column, v: Column, u0: Column, v0: Column, size_u0: Column, size_v0: Column, block: int) -> tuple[Column, Column]:
    """Canvas position of a patch pixel for the nine orientations."""
    last_u, last_v = size_u0 * block - 1, size_v0 * block - 1
    across = {0: u, 1: v, 2: last_v - v, 3: last_u - u, 4: v, 5: last_u - u, 6: last_v - v, 7: u, 8: v}
    down = {0: v, 1: u, 2: u, 3: last_v - v, 4: last_u - u, 5: v, 6: last_u - u, 7: last_v - v, 8: u}
    pick = lambda cases: F.coalesce(*[F.when(o == k, c) for k, c in cases.items()])
    return pick(across) + u0 * block, pick(down) + v0 * block


def canvas_to_patch(o: Column, x: Column, y: Column, u0: Column, v0: Column, size_u0: Column, size_v0: Column, block: int) -> tuple[Column, Column]:
    """The way back from patch_to_canvas."""
    x, y, last_u, last_v = x - u0 * block, y - v0 * block, size_u0 * block - 1, size_v0 * block - 1
    u = {0: x, 1: y, 2: y, 3: last_u - x, 4: last_u - y, 5: last_u - x, 6: last_u - y, 7: x, 8: y}
    v = {0: y, 1: x, 2: last_v - x, 3: last_v - y, 4: x, 5: y, 6: last_v - x, 7: last_v - y, 8: x}
    pick = lambda cases: F.coalesce(*[F.when(o == k, c) for k, c in cases.items()])
    return pick(u), pick(v)


def normal_coordinate(mode: Column, depth: Column, d1: Column) -> Column:
    return F.when(mode == 0, depth + d1).otherwise(F.greatest(F.lit(0), d1 - depth))


def rotate45(axis: int, x: Column, y: Column, z: Column, top: int) -> tuple[Column, Column, Column]:
    """Points turned by 45 degrees about an axis (1: y, 2: x, 3: z) and moved to stay positive; top is the largest coordinate plus 1."""
    if axis == 1:
        return x + z, y, top - x + z
    if axis == 2:
        return x, y + z, top - y + z
    return (x + y, top - x + y, z) if axis == 3 else (x, y, z)


def unrotate45(axis: int, x: Column, y: Column, z: Column, top: int) -> tuple[Column, Column, Column]:
    half = lambda c: c / 2.0
    if axis == 1:
        return half(x - z + top), y.cast("double"), half(x + z - top)
    if axis == 2:
        return x.cast("double"), half(y - z + top), half(y + z - top)
    return (half(x - y + top), half(x + y - top), z.cast("double")) if axis == 3 else (x.cast("double"), y.cast("double"), z.cast("double"))


def rotation(angle: float, axis: tuple[float, float, float]) -> list[list[float]]:
    """The matrix that turns by angle (radians) about a unit axis: cos I + (1 - cos) a a' + sin [a]."""
    c, s = math.cos(angle), math.sin(angle)
    cross = [[0.0, -axis[2], axis[1]], [axis[2], 0.0, -axis[0]], [-axis[1], axis[0], 0.0]]
    return [[c * (i == j) + (1 - c) * axis[i] * axis[j] + s * cross[i][j] for j in range(3)] for i in range(3)]


def product(a: list[list], b: list[list]) -> list[list]:
    """The product of two 3 by 3 matrices of numbers or columns."""
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]
