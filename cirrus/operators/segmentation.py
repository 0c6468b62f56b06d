"""Connected components of adjacent points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.operators import contraction
from cirrus.operators.neighbours import within


def components(points: DataFrame, squared_radius: int) -> DataFrame:
    """frame, pid and the least pid that steps within the radius lead to."""
    found = contraction.components(contraction.undirected(within(points, points, squared_radius)))
    return points.select("frame", "pid").join(found, ["frame", "pid"], "left").select("frame", "pid", F.coalesce("root", "pid").alias("label"))
