"""Operators on point tables (frame, pid, x, y, z, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["frame", "x", "y", "z"]


def first_of_each_place(points: DataFrame) -> DataFrame:
    """One point of each place, the one with the smallest pid. Sums combine before the shuffle, unlike a ranking."""
    rest = [c for c in points.columns if c not in PLACE]
    best = points.groupBy(*PLACE).agg(F.min_by(F.struct(*rest), "pid").alias("p"))
    return best.select(*PLACE, *[F.col("p")[c].alias(c) for c in rest])


def averaged_places(points: DataFrame) -> DataFrame:
    """One point of each place; colours are whole-number means, cut off."""
    return points.groupBy(*PLACE).agg(*[F.expr(f"sum({c}) div count(*)").alias(c) for c in ("r", "g", "b")], F.count("*").alias("n"))


def boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("frame").agg(*[f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))])


def centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("frame").agg(*[F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"], F.count("*").alias("n"))


def voxels(points: DataFrame, edge: int) -> DataFrame:
    """Cells of an edge that is a power of two, with centres at multiples of it: first pid, how many points, and their colour sum."""
    cell = lambda c: F.floor((F.col(c) + edge // 2) / edge).cast("int")
    return points.groupBy("frame", cell("x").alias("vx"), cell("y").alias("vy"), cell("z").alias("vz")).agg(F.min("pid").alias("first_pid"), F.count("*").alias("n"), F.sum("r").alias("sum_r"))


def canonical_order(points: DataFrame) -> DataFrame:
    """Points with their place in the order of x, y, z and then colour.

    Ranks are taken inside slabs of one x and shifted by the slabs before, so a frame's points never have to meet in one task.
    """
    slab = points.groupBy("frame", "x").count()
    before = slab.select("frame", "x", (F.sum("count").over(Window.partitionBy("frame").orderBy("x")) - F.col("count")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("frame", "x").orderBy("y", "z", "r", "g", "b", "pid"))
    return points.withColumn("nth", nth).join(before, ["frame", "x"]).select("frame", "pid", (F.col("before") + F.col("nth") - 1).alias("place"))


def axis_weights(points: DataFrame) -> DataFrame:
    """Occupied places in the three projections of a frame."""
    flat = lambda a, b: F.count_distinct(a, b)
    return points.groupBy("frame").agg(flat("y", "z").alias("yz"), flat("z", "x").alias("zx"), flat("x", "y").alias("xy"))


def missed(source: DataFrame, other: DataFrame) -> DataFrame:
    """Points of source at places where other has none."""
    return source.join(other.select(*PLACE).distinct(), PLACE, "left_anti")


def boxed(points: DataFrame, edge: int) -> DataFrame:
    """Non-empty boxes of a frame, numbered in order."""
    box = points.groupBy("frame", *[F.floor(F.col(c) / edge).cast("int").alias(f"box_{c}") for c in "xyz"]).agg(F.count("*").alias("n"))
    return box.withColumn("patch", F.dense_rank().over(Window.partitionBy("frame").orderBy("box_x", "box_y", "box_z")).cast("long") - 1)

