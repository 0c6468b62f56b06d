"""Operators on patches, patch pixels and atlas pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrus.functions import geometry


def placed(pixels: DataFrame, patches: DataFrame, block: int = 16) -> DataFrame:
    """Patch pixels at their places in the canvas, by their patch's orientation."""
    p = patches.select("frame", "patch", "orientation", "u0", "v0", "size_u0", "size_v0")
    x, y = geometry.patch_to_canvas(*[F.col(c) for c in ("orientation", "u", "v", "u0", "v0", "size_u0", "size_v0")], block)
    return pixels.join(p, ["frame", "patch"]).withColumn("x", x).withColumn("y", y)


def points_of(pixels: DataFrame, patches: DataFrame) -> DataFrame:
    """3D points of patch pixels: depth along the view's normal axis, u and v along the other two."""
    views = pixels.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(geometry.VIEWS)], "view_id int, turn int, normal int, tangent int, bitangent int, mode int")
    p = patches.select("frame", "patch", "view_id", "u1", "v1", "d1").withColumnRenamed("d1", "base")
    both = pixels.join(p, ["frame", "patch"]).join(F.broadcast(views), "view_id")  # 18 rows
    along = {"normal": geometry.normal_coordinate(F.col("mode"), F.col("d0"), F.col("base")), "tangent": F.col("u") + F.col("u1"), "bitangent": F.col("v") + F.col("v1")}
    axis = lambda k: F.coalesce(*[F.when(F.col(a) == k, c) for a, c in along.items()])
    return both.select("frame", "patch", "pid", *[axis(k).cast("long").alias(c) for k, c in enumerate("xyz")])


def depth_maps(pixels: DataFrame, mode: int = 0) -> DataFrame:
    """The nearer (mode 0) or farther depth of each patch pixel."""
    return pixels.groupBy("frame", "patch", "u", "v").agg((F.min if mode == 0 else F.max)("d0").alias("depth"))


def peak_filtered(pixels: DataFrame, block: int, most: int) -> DataFrame:
    """Pixels whose depth is near the least depth of their block; block minima are joined back, so no block is gathered."""
    cell = [F.floor(F.col(c) / block).cast("long").alias(f"b{c}") for c in "uv"]
    celled = pixels.select("*", *cell)
    peak = celled.groupBy("frame", "patch", "bu", "bv").agg(F.min("d0").alias("peak"))
    return celled.join(peak, ["frame", "patch", "bu", "bv"]).where(F.col("d0") - F.col("peak") <= most)


def horizons(pixels: DataFrame) -> DataFrame:
    """Top and bottom of a patch's silhouette for each u."""
    return pixels.groupBy("frame", "patch", "u").agg(F.min("v").alias("top"), F.max("v").alias("bottom"))


def by_size(patches: DataFrame) -> DataFrame:
    """Place of each patch in a frame by larger side, smaller side, index."""
    u, v = F.col("size_u"), F.col("size_v")
    order = Window.partitionBy("frame").orderBy(F.greatest(u, v).desc(), F.least(u, v).desc(), "patch")
    return patches.select("frame", "patch", (F.row_number().over(order).cast("long") - 1).alias("place"))


def stacked(patches: DataFrame, width: int, block: int = 16) -> DataFrame:
    """Rows of raw patches, one above the other: as many block rows as their points need, and where each starts."""
    rows = F.ceil(F.col("n") / F.lit(width * block)).cast("long")
    return patches.withColumn("rows", rows).withColumn("top", F.sum("rows").over(Window.partitionBy("frame").orderBy("patch")) - F.col("rows"))


def block_owner(pixels: DataFrame, block: int = 16) -> DataFrame:
    """The last patch that has an occupied pixel in each block, counted from 1."""
    cell = [F.floor(F.col(c) / block).cast("int").alias(f"block_{c}") for c in "xy"]
    return pixels.where("occ = 1").groupBy("frame", *cell).agg((F.max("patch") + 1).alias("owner"))


def overlapping(patches: DataFrame) -> DataFrame:
    """Pairs of patches of a frame whose rectangles meet, with their overlap over their union; patches of a frame are few."""
    a = patches.select("frame", F.col("patch").alias("a"), *[F.col(c).alias(f"{c}a") for c in ("u1", "v1", "size_u", "size_v")])
    b = patches.select("frame", F.col("patch").alias("b"), *[F.col(c).alias(f"{c}b") for c in ("u1", "v1", "size_u", "size_v")])
    side = lambda s: tuple(F.col(f"{c}{s}") for c in ("u1", "v1", "size_u", "size_v"))
    return a.join(b, "frame").where("a < b").withColumn("iou", geometry.rectangle_iou(side("a"), side("b")))


def initial_planes(normals: DataFrame, weights: list[float]) -> DataFrame:
    """For each row (frame, pid, nx, ny, nz) the direction of six along which its normal is longest; the first has no weight."""
    signed = [("nx", 1.0), ("ny", 1.0), ("nz", 1.0), ("nx", -1.0), ("ny", -1.0), ("nz", -1.0)]
    scores = F.array(*[F.col(c) * (s * (weights[i % 3] if i else 1.0)) for i, (c, s) in enumerate(signed)])
    return normals.select("frame", "pid", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("plane"))


def neighbours_of(boxes: DataFrame, margin: int = 1) -> DataFrame:
    """Pairs of patches of a frame whose boxes (lx to hz), made larger by margin, meet: frame, patch, other. Patches of a frame are few."""
    ends = [f"{e}{c}" for c in "xyz" for e in "lh"]
    other = boxes.select("frame", F.col("patch").alias("other"), *[F.col(c).alias(f"{c}2") for c in ends])
    side = lambda s, by: [(F.col(f"l{c}{s}") - by, F.col(f"h{c}{s}") + by) for c in "xyz"]
    return boxes.join(other, "frame").where((F.col("patch") != F.col("other")) & geometry.boxes_meet(side("", margin), side("2", 0))).select("frame", "patch", "other")
