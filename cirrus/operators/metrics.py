"""Distortion between two point clouds, per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.functions.color import rgb_to_yuv_unit
from cirrus.operators.neighbours import nearest


def psnr(distance: Column, peak: float, factor: float = 1.0) -> Column:
    """Infinite where the distance is 0."""
    return F.when(distance == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(factor * peak * peak) / distance))


def one_way(a: DataFrame, b: DataFrame, peak: float = 1023.0) -> DataFrame:
    """For each frame: points, sum, mean and maximum of squared distances to the nearest point, and PSNR with the factor 3."""
    found = nearest(a, b).groupBy("frame").agg(F.count("*").alias("n"), F.sum("d2").alias("sse"), F.max("d2").alias("hausdorff"))
    mse = F.col("sse") / F.col("n")
    return found.select("frame", "n", "sse", "hausdorff", F.round(mse, 6).alias("mse"), F.round(psnr(mse, peak, 3.0), 6).alias("psnr"), F.round(psnr(F.col("hausdorff").cast("double"), peak, 3.0), 6).alias("hausdorff_psnr"))


def symmetric(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """The worse of both directions."""
    other = ba.select("frame", *[F.col(c).alias(f"{c}2") for c in ("mse", "hausdorff", "psnr", "hausdorff_psnr")])
    worse = lambda c: (F.greatest if c in ("mse", "hausdorff") else F.least)(F.col(c), F.col(f"{c}2")).alias(c)
    return ab.join(other, "frame").select("frame", *[worse(c) for c in ("mse", "hausdorff", "psnr", "hausdorff_psnr")])


def colour(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean squared differences of Y, U and V (between 0 and 1) at nearest points, per frame."""
    rgb = lambda d, s: d.select("frame", F.col("pid").alias("pid" if s == "a" else "nn_pid"), *[v.alias(f"{n}{s}") for n, v in zip("yuv", rgb_to_yuv_unit(F.col("r"), F.col("g"), F.col("b")))])
    both = nearest(a, b).join(rgb(a, "a"), ["frame", "pid"]).join(rgb(b, "b"), ["frame", "nn_pid"])
    return both.groupBy("frame").agg(*[F.round(F.avg((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b"))), 6).alias(f"mse_{c}") for c in "yuv"])


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """One direction's means and maxima per frame, in place and in Y, U and V, from one search for nearest points."""
    yuv = lambda d, key, s: d.select("frame", F.col("pid").alias(key), *[v.alias(f"{n}{s}") for n, v in zip("yuv", rgb_to_yuv_unit(F.col("r"), F.col("g"), F.col("b")))])
    both = nearest(a, b).join(yuv(a, "pid", "1"), ["frame", "pid"]).join(yuv(b, "nn_pid", "2"), ["frame", "nn_pid"])
    squares = [F.avg((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2"))).alias(f"mse_{c}") for c in "yuv"]
    return both.groupBy("frame").agg(F.count("*").alias("n"), F.avg("d2").alias("mse"), F.max("d2").alias("hausdorff"), *squares)


def two_way(a: DataFrame, b: DataFrame) -> DataFrame:
    """matched() of both directions as rows 'ab' and 'ba'."""
    return matched(a, b).withColumn("way", F.lit("ab")).unionByName(matched(b, a).withColumn("way", F.lit("ba")))


def report(ways: DataFrame, peak: float = 1023.0) -> DataFrame:
    """Per frame the worse of both directions of two_way(), and their PSNR: in place with the factor 3, in colour with a peak of 1."""
    worse = ways.groupBy("frame").agg(*[F.max(c).alias(c) for c in ("mse", "hausdorff", "mse_y", "mse_u", "mse_v")])
    place = [F.round(psnr(F.col(c).cast("double"), peak, 3.0), 5).alias(n) for c, n in (("mse", "psnr"), ("hausdorff", "hausdorff_psnr"))]
    return worse.select("frame", F.round("mse", 6).alias("mse"), "hausdorff", *place, *[F.round(psnr(F.col(f"mse_{c}"), 1.0), 5).alias(f"psnr_{c}") for c in "yuv"])
