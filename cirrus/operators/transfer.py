"""Moving colours from one cloud to another, and refining planes by votes of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.neighbours import nearest
from cirrus.operators.patches import initial_planes
from cirrus.plans.lineage import cut


def two_way(target: DataFrame, source: DataFrame) -> DataFrame:
    """frame, pid and colour of each target point: the rounded mean of the source points that have it nearest, else of its own nearest one."""
    rgb = lambda d, key: d.select("frame", F.col("pid").alias(key), *"rgb")
    forward = nearest(target, source).join(rgb(source, "nn_pid"), ["frame", "nn_pid"]).select("frame", "pid", *"rgb")
    seen = nearest(source, target).join(rgb(source, "pid"), ["frame", "pid"]).groupBy("frame", F.col("nn_pid").alias("pid"))
    backward = seen.agg(*[F.round(F.avg(c)).cast("int").alias(f"{c}2") for c in "rgb"])
    return forward.join(backward, ["frame", "pid"], "left").select("frame", "pid", *[F.coalesce(f"{c}2", c).alias(c) for c in "rgb"])


def mixed(target: DataFrame, source: DataFrame, steps: int = 10) -> DataFrame:
    """As two_way(), but a frame's colours are forward and backward ones in the mixture (steps of 1/steps) with the least squared error to both.

    The error of every mixture comes from one aggregate over points, so the search reads the joins once.
    """
    rgb = lambda d, key: d.select("frame", F.col("pid").alias(key), "r")
    forward = nearest(target, source).join(rgb(source, "nn_pid"), ["frame", "nn_pid"]).select("frame", "pid", F.col("r").alias("f"))
    backward = nearest(source, target).join(rgb(source, "pid"), ["frame", "pid"]).groupBy("frame", F.col("nn_pid").alias("pid")).agg(F.avg("r").alias("b"))
    both = cut(forward.join(backward, ["frame", "pid"], "left").withColumn("b", F.coalesce("b", F.col("f").cast("double"))))
    at = F.col("w") * F.col("f") + (1 - F.col("w")) * F.col("b")
    tried = both.withColumn("w", F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])))
    error = tried.groupBy("frame", "w").agg(F.sum((at - F.col("f")) * (at - F.col("f")) + (at - F.col("b")) * (at - F.col("b"))).alias("e"))
    best = error.groupBy("frame").agg(F.min_by("w", F.struct(F.round("e", 6), "w")).alias("w"))
    return both.join(best, "frame").select("frame", "pid", F.round(at).cast("int").alias("r"))


def refined_planes(points: DataFrame, normals: DataFrame, k: int, rounds: int, strength: float, weights: list[float], near: DataFrame | None = None) -> DataFrame:
    """frame, pid and plane after rounds of votes: a plane scores the normal along it plus strength / k for each neighbour (near, if they are known) that has it.

    A point whose scores are all negative keeps its plane. All points change at once in a round; a round's planes are written as a table.
    """
    signed: list[tuple[str, float]] = [(c, s) for s in (1.0, -1.0) for c in ("nx", "ny", "nz")]
    near = (cut(nearest(points, points, k)) if near is None else near).select("frame", "pid", "nn_pid")
    planes = cut(initial_planes(normals, weights))
    for _ in range(rounds):
        votes = near.join(planes.withColumnRenamed("pid", "nn_pid"), ["frame", "nn_pid"]).groupBy("frame", "pid").agg(*[F.count_if(F.col("plane") == j).alias(f"v{j}") for j in range(6)])
        score: list[Column] = [F.col(c) * s + F.col(f"v{j}") * (strength / k) for j, (c, s) in enumerate(signed)]
        best = F.array(*score)
        new = F.when(F.array_max(best) > 0, (F.array_position(best, F.array_max(best)) - 1).cast("int")).otherwise(F.col("plane"))
        planes = cut(votes.join(normals, ["frame", "pid"]).join(planes, ["frame", "pid"]).select("frame", "pid", new.alias("plane")))
    return planes
