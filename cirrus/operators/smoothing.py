"""Smoothing of reconstructed points over grids of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.neighbours import CELL, listed, within_first


def cell_means(points: DataFrame, edge: int) -> DataFrame:
    """For each cell: points, sums of positions, and whether several patches meet in it."""
    cells = [F.floor(F.col(c) / edge).cast("int").alias(f"k{c}") for c in "xyz"]
    sums = [F.sum(c).alias(f"s{c}") for c in "xyz"]
    return points.groupBy("frame", *cells).agg(F.count("*").alias("n"), *sums, (F.max("patch") > F.min("patch")).alias("mixed"))


def _eight(points: DataFrame, edge: int) -> DataFrame:
    """Each point with the eight cells around it (kx, ky, kz), the weight of each (w, of all (2 * edge) ** 3), and the first one (lx, ly, lz).

    On an axis, a point lies between the centres of two cells; twice its distance from the one's centre, plus one, is the other's weight.
    """
    low = lambda c: (F.floor(F.col(c) / edge) - (F.col(c) % edge < edge // 2).cast("int")).cast("int")
    rows = points.select("*", *[low(c).alias(f"l{c}") for c in "xyz"])
    for c in "xyz":
        rows = rows.withColumn(f"o{c}", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(f"k{c}", F.col(f"l{c}") + F.col(f"o{c}"))
    along = lambda c: (F.col(c) - F.col(f"l{c}") * edge - edge // 2) * 2 + 1
    part = lambda c: F.when(F.col(f"o{c}") == 0, 2 * edge - along(c)).otherwise(along(c))
    return rows.withColumn("w", (part("x") * part("y") * part("z")).cast("long"))


def weighted_centroids(points: DataFrame, edge: int, counted: DataFrame | None = None) -> DataFrame:
    """For points around which patches meet in a cell: the mean place (cx, cy, cz) of the eight cells around, weighted by nearness, and n, the points
    that it stands for, as a whole number. An empty cell counts with the point's own place, and with no points. Cells hold the points counted, by default the same ones."""
    means = cell_means(points if counted is None else counted, edge).select("frame", "kx", "ky", "kz", "n", "mixed", *[(F.col(f"s{c}") / F.col("n")).alias(f"m{c}") for c in "xyz"])
    both = _eight(points.select("frame", "pid", "x", "y", "z"), edge).join(means, ["frame", "kx", "ky", "kz"], "left")
    whole = (2 * edge) ** 3
    moved = [(F.sum(F.col("w") * F.coalesce(f"m{c}", c)) / whole).alias(f"c{c}") for c in "xyz"]
    stands = F.floor(F.sum(F.col("w") * F.coalesce("n", F.lit(0))) / whole).alias("n")
    out = both.groupBy("frame", "pid").agg(F.coalesce(F.bool_or("mixed"), F.lit(False)).alias("mixed"), stands, *moved)
    return out.where("mixed").select("frame", "pid", "n", "cx", "cy", "cz")


def grid_centroids(points: DataFrame, edge: int) -> DataFrame:
    """weighted_centroids() to four digits."""
    return weighted_centroids(points, edge).select("frame", "pid", "n", *[F.round(f"c{c}", 4).alias(f"c{c}") for c in "xyz"])


def _within(points: DataFrame, edge: int, size: int | None) -> DataFrame:
    """points with within: whether a point is half a cell or more from the ends of its space, whole cells up to size or up to the frame's last place."""
    margin = max(edge // 2, 1)
    if size is None:
        ends = points.groupBy("frame").agg((F.ceil(F.greatest(*[F.max(c) for c in "xyz"]) / edge) * edge).alias("end"))
        placed = points.join(ends, "frame")
    else:
        placed = points.withColumn("end", F.lit(edge * (size // edge)))
    inside: Column = F.lit(True)
    for c in "xyz":
        inside = inside & (F.col(c) >= margin) & (F.col(c) + margin < F.col("end"))
    return placed.withColumn("within", inside).drop("end")


def grid_smoothed(points: DataFrame, edge: int, threshold: int, size: int | None = None) -> DataFrame:
    """All points (with patch and boundary: whether a point lies at a patch's edge); a boundary point whose centroid is far moves to it (rounded) and gets type 3.

    Far: n times the squared distance plus 0.5 is at least twice the larger of threshold and n, with n the points the centroid stands for. Points
    within half a cell of the ends of a space of size places (by default, whole cells up to the frame's last place) stay and are in no cell, and points that are no boundary points stay.
    """
    placed = _within(points, edge, size)
    inner = placed.where("within")
    centroids = weighted_centroids(inner.where("boundary"), edge, inner)
    both = placed.select("frame", "pid", "x", "y", "z").join(centroids, ["frame", "pid"], "left")
    d2 = sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0))
    far = F.coalesce((F.col("n") > 0) & (F.round(d2 * F.col("n"), 6) + 0.5 >= 2 * F.greatest(F.lit(threshold), F.col("n"))), F.lit(False))
    return both.select("frame", "pid", *[F.when(far, F.floor(F.round(f"c{c}", 6) + 0.5).cast("int")).otherwise(F.col(c)).alias(c) for c in "xyz"], F.when(far, 3).otherwise(0).alias("type"))


def radius_smoothed(points: DataFrame, k: int, squared_radius: int, squared_reach: int, threshold: int) -> DataFrame:
    """All points (with patch and boundary); one with a point of another patch within reach moves to the mean of its k nearest points within the radius, itself
    among them, if that is far: type 2 where such a boundary point stays or moves, with moved.

    Far: n times the squared distance, half a unit added and cut off to parts of n, is at least threshold. Places are whole non-negative numbers; means are rounded.
    """
    met = listed(points, points, squared_radius, k, ("patch", "boundary"), ("patch",))
    foreign = F.bool_or((F.col("d2") <= squared_reach) & ~F.col("patch2").eqNullSafe(F.col("patch"))).alias("foreign")
    own = ["pid", "x", "y", "z", "patch", "boundary"]
    both = met.groupBy(*CELL, *own).agg(F.count("*").alias("n"), *[F.sum(f"{c}2").alias(f"s{c}") for c in "xyz"], foreign).select("frame", *own, "n", "sx", "sy", "sz", "foreign")
    gap = sum(((F.col(f"s{c}") - F.col("n") * F.col(c)) * (F.col(f"s{c}") - F.col("n") * F.col(c)) for c in "xyz"), F.lit(0))
    both = both.withColumn("moved", F.col("foreign") & (gap + F.expr("n div 2") >= F.col("n") * threshold))
    place = [F.when(F.col("moved"), F.expr(f"CAST((s{c} + n div 2) div n AS INT)")).otherwise(F.col(c)).alias(c) for c in "xyz"]
    return both.select("frame", "pid", *place, F.when(F.col("foreign") & F.col("boundary"), 2).otherwise(F.col("boundary").cast("int")).alias("type"), "moved")


def smoothed_frames(points: DataFrame, way: str | None = "grid", edge: int = 8, threshold: int = 64, k: int = 64, squared_radius: int = 64, squared_reach: int = 64) -> DataFrame:
    """Points (frame, pid, x, y, z, patch, boundary) after smoothing by a grid, by balls ("radius"), or as they are (None): frame, pid, place, type and moved."""
    if way == "grid":
        out = grid_smoothed(points, edge, threshold).join(points.select("frame", "pid", "boundary"), ["frame", "pid"])
        return out.select("frame", "pid", "x", "y", "z", F.when(F.col("type") == 3, 3).otherwise(F.col("boundary").cast("int")).alias("type"), (F.col("type") == 3).alias("moved"))
    if way == "radius":
        return radius_smoothed(points, k, squared_radius, squared_reach, threshold)
    if way is not None:
        raise ValueError(f"no such smoothing: {way}")
    return points.select("frame", "pid", "x", "y", "z", F.col("boundary").cast("int").alias("type"), F.lit(False).alias("moved"))


def presmoothed(points: DataFrame, k: int = 64, squared_radius: int = 64, threshold: int = 10, most_entropy: float = 4.5) -> DataFrame:
    """All points (frame, pid, place, r, g, b, boundary); a boundary point takes the mean colour (rounded) of its k nearest points within the radius, itself among them,
    where that differs by threshold or more in all and the entropy of the neighbours' luma (whole numbers, cut off) is below most_entropy bits.

    Means are those of the colours before any change. Only boundary points are joined with neighbours; counts by luma come before sums by point.
    """
    near = within_first(points.where("boundary"), points, squared_radius, k)
    met = near.join(points.select("frame", F.col("pid").alias("nn_pid"), *"rgb"), ["frame", "nn_pid"])
    luma = F.expr("(CAST(2126 AS BIGINT) * r + 7152 * g + 722 * b) div 10000").alias("luma")
    counts = met.groupBy("frame", "pid", luma).agg(F.count("*").alias("c"), *[F.sum(c).alias(f"s{c}") for c in "rgb"])
    n = F.sum("c")
    entropy = F.round(F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n, 9)
    stats = counts.groupBy("frame", "pid").agg(n.alias("n"), entropy.alias("entropy"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "rgb"])
    mean = {c: F.expr(f"CAST((s{c} + n div 2) div n AS INT)") for c in "rgb"}
    both = points.select("frame", "pid", *"rgb").join(stats, ["frame", "pid"], "left")
    differ = sum((F.abs(mean[c] - F.col(c)) for c in "rgb"), F.lit(0))
    taken = F.coalesce((differ >= threshold) & (F.col("entropy") < most_entropy), F.lit(False))
    return both.withColumn("taken", taken).select("frame", "pid", *[F.when(F.col("taken"), mean[c]).otherwise(F.col(c)).alias(c) for c in "rgb"], "taken")


def colour_cells(points: DataFrame, edge: int) -> DataFrame:
    """For each cell: points, mean colour (c0 is luma), how far mean and median luma differ, and whether several patches meet in it."""
    at = [F.floor(F.col(c) / edge).cast("int").alias(f"k{c}") for c in "xyz"]
    means = [F.avg(c).alias(f"m{c}") for c in ("c0", "c1", "c2")]
    return points.groupBy("frame", *at).agg(F.count("*").alias("n"), *means, F.abs(F.avg("c0") - F.median("c0")).alias("uneven"), (F.max("patch") > F.min("patch")).alias("mixed"))


def colour_smoothed(points: DataFrame, edge: int, uneven: float, differ: float, threshold: float) -> DataFrame:
    """All points (frame, pid, place, patch, c0 to c2) with their colours; where patches meet around a point, a colour may give way to a mean.

    The mean is that of the eight cells around, weighted by nearness. A cell that is empty, whose mean and median luma differ by more than
    uneven, or whose luma is further than differ from that of the first cell, counts with the point's own colour; where the first
    cell is uneven, the point keeps its colour. The mean is taken where its luma differs by threshold or more (in units of 25.6).
    """
    channels = ("c0", "c1", "c2")
    half = edge // 2
    low = lambda c: (F.floor(F.col(c) / edge) - (F.col(c) % edge < half).cast("int")).cast("int")
    own = points.select("frame", "pid", "x", "y", "z", *channels, *[low(c).alias(f"l{c}") for c in "xyz"])
    stats = colour_cells(points, edge)
    first = stats.select("frame", *[F.col(f"k{c}").alias(f"l{c}") for c in "xyz"], F.col("mc0").alias("y0"), ((F.col("n") > 1) & (F.col("uneven") > uneven)).alias("rough"))
    rows = own.join(first, ["frame", "lx", "ly", "lz"], "left").withColumn("y0", F.coalesce("y0", "c0"))
    for c in "xyz":
        rows = rows.withColumn(f"o{c}", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(f"k{c}", F.col(f"l{c}") + F.col(f"o{c}"))
    met = rows.join(stats.withColumnRenamed("mixed", "meets"), ["frame", "kx", "ky", "kz"], "left")
    along = lambda c: (F.col(c) - F.col(f"l{c}") * edge - half) * 2 + 1
    part = lambda c: F.when(F.col(f"o{c}") == 0, 2 * edge - along(c)).otherwise(along(c))
    weight = part("x") * part("y") * part("z")
    at_first = F.col("ox") + F.col("oy") + F.col("oz") == 0
    trusted = F.col("n").isNotNull() & (at_first | ((F.abs(F.col("y0") - F.col("mc0")) <= differ) & ((F.col("n") == 1) | (F.col("uneven") <= uneven))))
    sums = [F.sum(weight * F.when(trusted, F.col(f"m{c}")).otherwise(F.col(c))).alias(f"t{c}") for c in channels]
    keep = [F.first(c).alias(c) for c in channels]
    out = met.groupBy("frame", "pid").agg(*keep, *sums, F.coalesce(F.bool_or("meets"), F.lit(False)).alias("meets"), F.coalesce(F.bool_or("rough"), F.lit(False)).alias("rough"))
    new = [F.floor(F.round(F.col(f"t{c}") / (2 * edge) ** 3, 6) + 0.5).cast("int") for c in channels]
    moved = F.col("meets") & ~F.col("rough") & (F.abs(new[0] - F.col("c0")) * 10.0 / 256.0 >= threshold)
    return out.select("frame", "pid", *[F.when(moved, n).otherwise(F.col(c)).alias(c) for n, c in zip(new, channels)], moved.alias("moved"))
