"""The whole measure of distortion between two sequences: repeated places merged, normals carried over, both directions, and the worse of them.

The nearest points, all of a tie, are found once in each direction and serve for the normals, the planes and the colours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.functions.color import rgb_to_yuv_unit
from cirrus.operators.metrics import psnr
from cirrus.operators.neighbours import tied
from cirrus.operators.points import PLACE
from cirrus.plans.lineage import cut

N = ("nx", "ny", "nz")
#: Means and maxima of one direction, with the factor and the peak of their PSNR; place and plane take the peak of the coordinates.
MEASURES = {"mse": 3.0, "hausdorff": 3.0, "plane_mse": 3.0, "plane_hausdorff": 3.0, "mse_y": 1.0, "mse_u": 1.0, "mse_v": 1.0, "mse_r": 1.0}


def merged(points: DataFrame) -> DataFrame:
    """One point of each place, with the smallest pid and the whole-number means of r, g, b and reflectance (cut off)."""
    means = [F.expr(f"sum({c}) div count(*)").cast("int").alias(c) for c in ("r", "g", "b", "reflectance") if c in points.columns]
    return points.groupBy(*PLACE).agg(F.min("pid").alias("pid"), *means)


def copied_normals(points: DataFrame, normal_cloud: DataFrame) -> DataFrame:
    """frame, pid and the normal that normal_cloud has at a point's place (of several, the one with the largest pid); zeros where it has none."""
    last = normal_cloud.groupBy(*PLACE).agg(F.max_by(F.struct(*N), "pid").alias("n"))
    return points.select("frame", "pid", "x", "y", "z").join(last, PLACE, "left").select("frame", "pid", *[F.coalesce(f"n.{c}", F.lit(0.0)).alias(c) for c in N])


def scaled_normals(points: DataFrame, normals_of: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """frame, pid and a normal for each point, made from those of another cloud (frame, pid, nx, ny, nz).

    ahead: the points nearest to each of the other cloud's, ties included; a point takes the mean normal of those that have it there. A point that
    none has takes the mean normal of the other cloud's points nearest to it (back).
    """
    mean = [F.avg(c).alias(c) for c in N]
    given = ahead.join(normals_of, ["frame", "pid"]).groupBy("frame", F.col("nn_pid").alias("pid")).agg(*mean)
    bare = points.select("frame", "pid").join(given, ["frame", "pid"], "left_anti")
    filled = back.join(bare, ["frame", "pid"]).join(normals_of.withColumnRenamed("pid", "nn_pid"), ["frame", "nn_pid"]).groupBy("frame", "pid").agg(*mean)
    return given.unionByName(filled)


def one_way(a: DataFrame, b: DataFrame, near: DataFrame, normals_b: DataFrame | None = None, average: bool = True) -> DataFrame:
    """Per frame, from a to its nearest points in b (near: frame, pid, nn_pid, d2, ties included): n, mean and maximum of squared distances (mse,
    hausdorff), the same to the planes through them (plane_mse, plane_hausdorff, if b has normals), and mean squared differences of Y, U
    and V between 0 and 1 and of reflectance (mse_r, if both have it).

    A tie counts with the mean of its distances to planes, and its colour is the rounded mean of its colours, or, unless average, that of its
    smallest pid, as the reflectance is.
    """
    shine = "reflectance" in a.columns and "reflectance" in b.columns
    mine = [*"xyzrgb", *(["reflectance"] if shine else [])]
    left = a.select("frame", "pid", *mine)
    right = b.select("frame", F.col("pid").alias("nn_pid"), *[F.col(c).alias(f"{c}2") for c in mine])
    rows = near.join(right, ["frame", "nn_pid"]).join(left, ["frame", "pid"])
    parts = [F.first("d2").alias("d2"), *[F.first(c).alias(c) for c in ("r", "g", "b")]]
    first = F.min_by(F.struct(*[f"{c}2" for c in mine[3:]]), "nn_pid").alias("one")
    parts += [first, *[F.floor(F.avg(f"{c}2") + 0.5).alias(f"{c}2") for c in "rgb"], *([F.first("reflectance").alias("reflectance")] if shine else [])]
    if normals_b is not None:
        rows = rows.join(normals_b.select("frame", F.col("pid").alias("nn_pid"), *N), ["frame", "nn_pid"])
        along = sum(((F.col(c) - F.col(f"{c}2")) * F.col(n) for c, n in zip("xyz", N)), F.lit(0.0))
        parts.append(F.avg(along * along).alias("plane"))
    each = rows.groupBy("frame", "pid").agg(*parts)
    other = [F.col(f"{c}2") if average else F.col(f"one.{c}2") for c in "rgb"]
    differ = [p - q for p, q in zip(rgb_to_yuv_unit(*[F.col(c) for c in "rgb"]), rgb_to_yuv_unit(*other))]
    out = [F.count("*").alias("n"), F.avg("d2").alias("mse"), F.max("d2").cast("double").alias("hausdorff"), *[F.avg(d * d).alias(f"mse_{c}") for d, c in zip(differ, "yuv")]]
    if normals_b is not None:
        out += [F.avg("plane").alias("plane_mse"), F.max("plane").alias("plane_hausdorff")]
    if shine:
        step = (F.col("reflectance") - F.col("one.reflectance2")).cast("double")
        out.append(F.avg(step * step).alias("mse_r"))
    return each.groupBy("frame").agg(*out)


def _peak(name: str, peak: float) -> float:
    return 65535.0 if name == "mse_r" else 1.0 if name[:4] == "mse_" else peak


def _decibels(name: str) -> str:
    return f"psnr_{name}" if not name.startswith("mse_") else f"psnr_{name[4:]}"


def with_psnr(ways: DataFrame, peak: float = 1023.0) -> DataFrame:
    """One direction's measures to six digits, and their PSNR."""
    held = [m for m in MEASURES if m in ways.columns]
    return ways.select("frame", "way", "n", *[F.round(m, 6).alias(m) for m in held], *[F.round(psnr(F.col(m), _peak(m, peak), MEASURES[m]), 5).alias(_decibels(m)) for m in held])


def evaluated(source: DataFrame, other: DataFrame, normal_cloud: DataFrame | None = None, merge: bool = True, average: bool = True, peak: float = 1023.0) -> DataFrame:
    """For each frame that both sequences have, rows '1' (source to other), '2' (back) and 'F' (the worse of both): measures and their PSNR.

    merge: repeated places become one point first. normal_cloud: points with normals, those of the source; the other sequence gets them by
    scaled_normals(). Without it there are no distances to planes.
    """
    a, b = (cut(merged(p)) if merge else p for p in (source, other))
    ahead, back = cut(tied(a, b)), cut(tied(b, a))
    normals_a = normals_b = None
    if normal_cloud is not None:
        normals_a = cut(copied_normals(a, normal_cloud))
        normals_b = cut(scaled_normals(b, normals_a, ahead, back))
    both = cut(one_way(a, b, ahead, normals_b, average).withColumn("way", F.lit("1")).unionByName(one_way(b, a, back, normals_a, average).withColumn("way", F.lit("2"))))
    worse: list[Column] = [F.max(m).alias(m) for m in MEASURES if m in both.columns]
    final = both.groupBy("frame").agg(F.max("n").alias("n"), *worse).withColumn("way", F.lit("F"))
    return with_psnr(both.unionByName(final), peak)
