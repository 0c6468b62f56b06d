"""Normals turned to agree with each other: by a viewpoint, along a spanning tree of like normals, or from what the faces of a cube see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators import contraction, normals
from cirrus.operators.neighbours import nearest
from cirrus.plans.lineage import cut

N = ("nx", "ny", "nz")
#: Stands for all points whose side is known beforehand; below every pid.
KNOWN = -(1 << 63) + 1


def _towards(viewpoint: tuple[float, float, float]) -> Column:
    """How far a normal points to the viewpoint."""
    return sum((F.col(n) * (F.lit(float(v)) - F.col(c)) for n, c, v in zip(N, "xyz", viewpoint)), F.lit(0.0))


def _near(points: DataFrame, k: int, squared_radius: int | None) -> DataFrame:
    near = nearest(points, points, k)
    return cut((near if squared_radius is None else near.where(F.col("d2") <= squared_radius)).where("pid <> nn_pid").select("frame", "pid", "nn_pid"))


def alike(near: DataFrame, normals_of: DataFrame) -> DataFrame:
    """Edges between neighbours: weight, how parallel their normals are, and sign, whether they point to one side (0 counts as that)."""
    end = lambda key, s: normals_of.select("frame", F.col("pid").alias(key), *[F.col(n).alias(n + s) for n in N])
    both = contraction.undirected(near).join(end("u", "1"), ["frame", "u"]).join(end("v", "2"), ["frame", "v"])
    dot = F.col("nx1") * F.col("nx2") + F.col("ny1") * F.col("ny2") + F.col("nz1") * F.col("nz2")
    return both.select("frame", "u", "v", F.abs(dot).alias("weight"), F.when(dot < 0, -1).otherwise(1).alias("sign"))


def seen_sides(points: DataFrame, normals_of: DataFrame) -> DataFrame:
    """frame, pid and side (1 or -1, to multiply the normal with) of the points that one of six faces around the cloud sees first.

    A face looks along an axis and sees, in each column, the outermost point (of equal ones the smallest pid), whose normal has to point to
    it. Faces come in the order of axes, low end before high end; the last one that the normal isn't at right angles to decides.
    """
    faces = []
    for j, c in enumerate("xyz"):
        others = [o for o in "xyz" if o != c]
        ends = points.groupBy("frame", *others).agg(F.min(F.struct(c, "pid")).alias("low"), F.min(F.struct(-F.col(c), "pid")).alias("high"))
        both = F.explode(F.array(*[F.struct(F.lit(2 * j + h).alias("face"), F.col(f"{end}.pid").alias("pid")) for h, end in enumerate(("low", "high"))]))
        faces.append(ends.select("frame", both.alias("f")).select("frame", "f.pid", "f.face"))
    seen = faces[0].unionByName(faces[1]).unionByName(faces[2]).join(normals_of, ["frame", "pid"])
    along = F.element_at(F.array(*N), (F.floor(F.col("face") / 2) + 1).cast("int"))
    side = F.signum(along) * F.when(F.col("face") % 2 == 1, 1).otherwise(-1)
    return seen.groupBy("frame", "pid").agg(F.coalesce(F.max_by(side, F.when(side != 0, F.col("face"))), F.lit(1)).cast("int").alias("side"))


def _agreed(sides: DataFrame, near: DataFrame, normals_of: DataFrame) -> DataFrame:
    """Sides turned where a point's normal is against the sum of its neighbours' (those with a side), all points at once."""
    turned = normals_of.join(sides, ["frame", "pid"]).select("frame", "pid", "side", *[(F.col(n) * F.col("side")).alias(n) for n in N])
    sums = near.join(turned.select("frame", F.col("pid").alias("nn_pid"), *N), ["frame", "nn_pid"]).groupBy("frame", "pid").agg(*[F.sum(n).alias(f"s{n}") for n in N])
    against = F.coalesce(sum((F.col(n) * F.col(f"s{n}") for n in N), F.lit(0.0)) < 0, F.lit(False))
    return turned.join(sums, ["frame", "pid"], "left").select("frame", "pid", F.when(against, -F.col("side")).otherwise(F.col("side")).alias("side"))


def oriented(points: DataFrame, normals_of: DataFrame, strategy: str = "tree", k: int = 16, squared_radius: int | None = None, viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), near: DataFrame | None = None) -> DataFrame:
    """frame, pid and normal (nx, ny, nz) of each point, its direction kept or reversed.

    'viewpoint': towards the viewpoint. 'tree': neighbours (k nearest, within the radius if one is given; near, if they are known) are joined by the spanning forest of
    the most parallel normals, and along it normals point to one side; the point with the least pid of each tree faces the viewpoint, and
    a frame of which more than half then looks away is reversed as a whole. 'cube': the outermost points as six faces see them, made to agree with
    each other, are given; the forest carries their sides to all others, and trees without one start at their least pid.
    """
    rows = points.select("frame", "pid", *"xyz").join(normals_of.select("frame", "pid", *N), ["frame", "pid"])
    if strategy == "viewpoint":
        away = _towards(viewpoint) < 0
        return rows.select("frame", "pid", *[F.when(away, -F.col(n)).otherwise(F.col(n)).alias(n) for n in N])
    near = _near(points, k, squared_radius) if near is None else near.where("pid <> nn_pid").select("frame", "pid", "nn_pid")
    edges = alike(near, normals_of)
    sides = None
    if strategy == "cube":
        sides = cut(_agreed(seen_sides(points, normals_of), near, normals_of))
        for end in "uv":
            met = edges.join(sides.select("frame", F.col("pid").alias(end), "side"), ["frame", end], "left")
            edges = met.withColumns({end: F.when(F.col("side").isNull(), F.col(end)).otherwise(F.lit(KNOWN)), "sign": F.col("sign") * F.coalesce("side", F.lit(1))}).drop("side")
        edges = edges.where("u <> v").select("frame", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight", "sign")
        edges = edges.groupBy("frame", "u", "v").agg(F.max_by(F.struct("weight", "sign"), F.struct("weight", "sign")).alias("e")).select("frame", "u", "v", "e.*")
    elif strategy != "tree":
        raise ValueError(f"no such strategy: {strategy}")
    forest = contraction.spanning_forest(edges)
    placed = rows.join(forest, ["frame", "pid"], "left").withColumns({"root": F.coalesce("root", "pid"), "sign": F.coalesce("sign", F.lit(1))})
    if sides is not None:
        given = forest.where(F.col("pid") == KNOWN).select("frame", "root", F.col("sign").alias("known"))
        placed = placed.join(given, ["frame", "root"], "left").join(sides, ["frame", "pid"], "left")
    first = placed.groupBy("frame", "root").agg(F.min_by(F.col("sign") * _towards(viewpoint), "pid").alias("facing"))
    start = F.when(F.col("facing") < 0, -1).otherwise(1)
    turn = F.col("sign") * (start if sides is None else F.coalesce("known", start))
    turned = placed.join(first, ["frame", "root"]).withColumn("turn", turn if sides is None else F.coalesce("side", turn))
    out = turned.select("frame", "pid", *"xyz", *[(F.col(n) * F.col("turn")).alias(n) for n in N])
    if sides is not None:
        return out.select("frame", "pid", *N)
    out = cut(out)
    half = out.groupBy("frame").agg((F.count_if(_towards(viewpoint) < 0) > F.floor((F.count("*") + 1) / 2)).alias("reverse"))
    return out.join(half, "frame").select("frame", "pid", *[F.when(F.col("reverse"), -F.col(n)).otherwise(F.col(n)).alias(n) for n in N])


def pipeline(points: DataFrame, k: int = 16, smoothing_rounds: int = 0, smoothing: tuple[int, int, float] = (3, 16, 0.5), strategy: str = "tree", viewpoint: tuple[float, float, float] = (0.0, 0.0, 0.0), near: DataFrame | None = None) -> DataFrame:
    """Normals estimated from k neighbours (near, if they are known with their places), smoothed (squared radius, neighbours, weight) in rounds, and oriented."""
    near = nearest(points, points, k, places=True) if near is None else near
    found = cut(normals.normals(points, k, viewpoint, near))
    if smoothing_rounds:
        found = cut(normals.smoothed(points, found, *smoothing, smoothing_rounds))
    return oriented(points, found, strategy, k, None, viewpoint, near)
