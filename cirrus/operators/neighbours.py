"""Nearest-neighbour and radius joins between point tables (frame, pid, x, y, z), by grids of cells.

A ball of a given radius reaches one or two cells on each axis when cells are three radii wide, so a point of one side goes to few cells, a
point of the other side to its own, and balls meet points by an equi-join that spreads over frames and cells. Where pairs are ranked it is the
neighbours that go to few cells, so a point has all its pairs in one task and no pair is shuffled. The nearest-neighbour join takes points whose answer lies within the radius and doubles it for the others, so sparse regions cost further rounds of fewer
points and the result is exact.

Spark sizes a table by its packed files, before any copies, so joins here are hinted: neither copies nor points are collected and broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cirrus.plans.lineage import cut


#: What a point that isn't copied is found by, beside its pid.
CELL = ["frame", "kx", "ky", "kz"]


def _pairs(a: DataFrame, b: DataFrame, squared_radius: int, copied: str = "a", own: tuple[str, ...] = (), other: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a frame whose squared distance is at most squared_radius: CELL, pid, nn_pid, d2, and x, y and z of both (x2 for b's) with more columns of
    a (own) and b (other).

    copied: whose points go to all cells that a ball reaches. With "b" all pairs of a point are in its own cell, and what is ranked or summed by CELL and pid
    needs no other shuffle than that of points.
    """
    radius = math.isqrt(squared_radius)
    edge = max(2, 3 * radius)
    left = a.select("frame", "pid", "x", "y", "z", *own)
    right = b.select("frame", F.col("pid").alias("nn_pid"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "z", *other)])
    sides = []
    for rows, many, end in ((left, copied == "a", ""), (right, copied == "b", "2")):
        for c in "xyz":
            at = F.col(f"{c}{end}")
            rows = rows.withColumn(f"k{c}", F.explode(F.sequence(F.floor((at - radius) / edge), F.floor((at + radius) / edge))) if many else F.floor(at / edge))
        sides.append(rows)
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz"), F.lit(0)).cast("long")
    return sides[0].hint("merge").join(sides[1], CELL).where(d2 <= squared_radius).withColumn("d2", d2)


def within(a: DataFrame, b: DataFrame, squared_radius: int) -> DataFrame:
    """All pairs of a frame whose squared distance is at most squared_radius: frame, pid, nn_pid, d2. Coordinates are whole numbers."""
    return _pairs(a, b, squared_radius).select("frame", "pid", "nn_pid", "d2")


def listed(a: DataFrame, b: DataFrame, squared_radius: int, k: int, own: tuple[str, ...] = (), other: tuple[str, ...] = ()) -> DataFrame:
    """The rows of within_first() with CELL, the places of both points and more columns, as from _pairs(): pairs are ranked where they arise, and sums by CELL
    and pid are made there too."""
    return _ranked(_pairs(a, b, squared_radius, "b", own, other), k, False).where(F.col("rank") <= k)


def within_first(a: DataFrame, b: DataFrame, squared_radius: int, k: int) -> DataFrame:
    """within(), but of each point's pairs only the k nearest, with rank from 1; equal distances by smaller pid."""
    if k == 1:
        return _nearest_pair(_pairs(a, b, squared_radius)).select("frame", "pid", "nn_pid", "d2", "rank")
    return listed(a, b, squared_radius, k).select("frame", "pid", "nn_pid", "d2", "rank")


def _nearest_pair(pairs: DataFrame, *more: str) -> DataFrame:
    """Each point's nearest pair with more columns, by an aggregate, which combines before the shuffle."""
    least = pairs.groupBy("frame", "pid").agg(F.min(F.struct("d2", "nn_pid", *more)).alias("n"))
    return least.select("frame", "pid", "n.*", F.lit(1).cast("long").alias("rank"), F.lit(1).cast("long").alias("has"))


def _each(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by, "pid")


def _ranked(pairs: DataFrame, k: int, ties: bool, by: list[str] = CELL) -> DataFrame:
    rank = F.rank().over(_each(by).orderBy("d2")) if ties else F.row_number().over(_each(by).orderBy("d2", "nn_pid"))
    return pairs.withColumn("rank", rank.cast("long"))


def _best(a: DataFrame, b: DataFrame, squared_radius: int, k: int, ties: bool, copied: str, more: list[str]) -> DataFrame:
    """The k nearest of each point's pairs with more columns, rank, and has, how many these are."""
    if k == 1 and not ties:
        return _nearest_pair(_pairs(a, b, squared_radius), *more)
    by = CELL if copied == "b" else ["frame"]
    return _ranked(_pairs(a, b, squared_radius, copied), k, ties, by).where(F.col("rank") <= k).withColumn("has", F.count("*").over(_each(by)))


def nearest(a: DataFrame, b: DataFrame, k: int = 1, radius: int | None = None, ties: bool = False, places: bool = False) -> DataFrame:
    """The k nearest points of b for each point of a: frame, pid, rank (from 1), nn_pid, d2; equal distances by smaller pid. With places, x2, y2 and z2 too,
    where the point of b is, and all rows are in written tables, fit to be read several times.

    With ties, all points as near as the k-th come, and equal distances have equal ranks. Where a frame of b has fewer than k points, all of
    them come. The first round looks within the radius, by default one that holds k points of a closed surface even at its rim,
    so that few points are left for further rounds.
    """
    radius = radius or max(2, math.ceil(math.sqrt(2 * k / math.pi)))
    more = ["x2", "y2", "z2"] if places else []
    columns = ["frame", "pid", "rank", "nn_pid", "d2", *more]
    done, open_, reach = [], a.select("frame", "pid", "x", "y", "z"), None
    while True:
        if done and reach is None:  # how far a point of a frame can lie from one of b
            spread = b.groupBy("frame").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
            far = sum((F.pow(F.greatest(F.abs(F.col(c) - F.col(f"lo{c}")), F.abs(F.col(c) - F.col(f"hi{c}"))), 2) for c in "xyz"), F.lit(0.0))
            reach = open_.hint("merge").join(spread, "frame").agg(F.max(far)).first()[0] or 0
        # All points of a are open at first; later on they are few, and it is they who are copied.
        near = _best(open_, b, radius * radius, k, ties, "a" if done else "b", more).select(*columns, "has")
        if reach is not None and radius * radius >= reach:
            done.append(cut(near) if places else near)
            break
        near = cut(near)
        full = F.col("has") >= k
        done.append(near.where(full))
        open_ = cut(open_.join(near.where(full & (F.col("rank") == 1)).select("frame", "pid").hint("merge"), ["frame", "pid"], "left_anti"))
        if open_.isEmpty():
            break
        radius *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*columns)


def tied(a: DataFrame, b: DataFrame) -> DataFrame:
    """All points of b at the least distance from each point of a: frame, pid, nn_pid, d2. They lie within the same radius as the nearest one."""
    return nearest(a, b, ties=True).select("frame", "pid", "nn_pid", "d2")
