"""Surface normals by principal components of neighbours, and distances along them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.operators.neighbours import CELL, listed, nearest
from cirrus.plans.lineage import cut

_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def normals(points: DataFrame, k: int = 16, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), near: DataFrame | None = None) -> DataFrame:
    """frame, pid and the direction in which the k nearest points (near, if known with their places) spread least, turned towards the viewpoint.

    Sums of coordinates and their products combine before the shuffle; only the 3 by 3 eigenproblems run in numpy, for whole batches.
    """
    near = nearest(points, points, k, places=True) if near is None else near
    sums = [F.avg(F.col(f"{a}2").cast("double") * F.col(f"{b}2")).alias(a + b) for a, b in _PAIRS]
    moments = near.groupBy("frame", "pid").agg(*[F.avg(f"{c}2").alias(f"m{c}") for c in "xyz"], *sums)
    rows = moments.join(points.select("frame", "pid", "x", "y", "z"), ["frame", "pid"]).select("frame", "pid", "x", "y", "z", "mx", "my", "mz", *[a + b for a, b in _PAIRS])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: np.asarray(batch.column(c)).astype(float)  # noqa: B023, E731
            cov = np.empty((batch.num_rows, 3, 3))
            for a, b in _PAIRS:
                i, j = "xyz".index(a), "xyz".index(b)
                cov[:, i, j] = cov[:, j, i] = get(a + b) - get(f"m{a}") * get(f"m{b}")
            normal = np.linalg.eigh(cov)[1][:, :, 0]
            towards = np.array(viewpoint) - np.stack([get(c) for c in "xyz"], 1)
            normal = np.where((normal * towards).sum(axis=1, keepdims=True) < 0, -normal, normal)
            yield pa.RecordBatch.from_arrays([batch.column("frame"), batch.column("pid"), *(pa.array(normal[:, i]) for i in range(3))], names=["frame", "pid", "nx", "ny", "nz"])

    return rows.mapInArrow(solve, "frame int, pid long, nx double, ny double, nz double")


def point_to_plane(a: DataFrame, b: DataFrame, normals_b: DataFrame) -> DataFrame:
    """Per frame the mean squared distance from a to the plane at the nearest point of b, and the largest."""
    near = nearest(a, b).join(a.select("frame", "pid", "x", "y", "z"), ["frame", "pid"])
    other = b.select("frame", F.col("pid").alias("nn_pid"), *[F.col(c).alias(f"{c}2") for c in "xyz"]).join(normals_b.withColumnRenamed("pid", "nn_pid"), ["frame", "nn_pid"])
    along = sum(((F.col(c) - F.col(f"{c}2")) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    both = near.join(other, ["frame", "nn_pid"]).withColumn("d", along * along)
    return both.groupBy("frame").agg(F.round(F.avg("d"), 6).alias("mse"), F.round(F.max("d"), 6).alias("hausdorff"))


def smoothed(points: DataFrame, normals_of: DataFrame, squared_radius: int, k: int, weight: float, rounds: int = 1) -> DataFrame:
    """Normals mixed with the direction of their neighbours' sum: up to k - 1 others within the radius, each turned to the point's side.

    All points change at once in a round, so the order of points doesn't matter; normals go with the points, and sums are made where pairs arise. A vector of length 0 stays as it is.
    """
    n = ("nx", "ny", "nz")
    unit = lambda v: [F.when(length > 0, c / length).otherwise(c) for length in [F.sqrt(sum((x * x for x in v), F.lit(0.0)))] for c in v]
    out = normals_of.select("frame", "pid", *n)
    for _ in range(rounds):
        rows = points.select("frame", "pid", *"xyz").join(out, ["frame", "pid"], "left")
        others = listed(rows, rows, squared_radius, k, n, n).where("pid <> nn_pid")
        side = F.when(sum((F.col(c) * F.col(f"{c}2") for c in n), F.lit(0.0)) < 0, -1).otherwise(1)
        sums = others.groupBy(*CELL, "pid").agg(*[F.sum(side * F.col(f"{c}2")).alias(f"s{c}") for c in n]).select("frame", "pid", *[f"s{c}" for c in n])
        both = out.join(sums, ["frame", "pid"], "left")
        mean = unit([F.coalesce(f"s{c}", F.lit(0.0)) for c in n])
        new = unit([(1 - weight) * F.col(c) + weight * m for c, m in zip(n, mean)])
        out = both.select("frame", "pid", *[v.alias(c) for c, v in zip(n, new)])
        out = cut(out) if rounds > 1 else out
    return out
