"""Planes of points counted by voxel (frame, vx, vy, vz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.operators.neighbours import within
from cirrus.plans.lineage import cut

PLANES = 6
VOXEL = ["frame", "vx", "vy", "vz"]


def at(edge: int) -> list[Column]:
    return [F.floor(F.col(c) / edge).cast("int").alias(f"v{c}") for c in "xyz"]


def scores(points: DataFrame, edge: int) -> DataFrame:
    """For each voxel the number of its points on each plane (s0 to s5), as one aggregate over points (frame, x, y, z, plane)."""
    return points.groupBy("frame", *at(edge)).agg(*[F.count_if(F.col("plane") == j).alias(f"s{j}") for j in range(PLANES)])


def dominant(points: DataFrame, edge: int) -> DataFrame:
    """The plane that most points of a voxel have; of planes with as many, the least."""
    counts = points.groupBy("frame", *at(edge), "plane").agg(F.count("*").alias("n"))
    return counts.groupBy(VOXEL).agg(F.max_by("plane", F.struct("n", -F.col("plane"))).alias("plane"), F.max("n").alias("n"))


def edges(points: DataFrame, edge: int) -> DataFrame:
    """scores() with the edge class of each voxel: 'single' (one point), 'direct' (several planes), 'indirect' (one plane, but a voxel that
    touches it is direct or single and has another plane as its dominant one), else 'none'.

    A voxel sends its class to the 26 around it, so voxels meet by equality.
    """
    ranked = [F.struct(F.col(f"s{j}").alias("n"), F.lit(-j).alias("at")) for j in range(PLANES)]
    found = scores(points, edge).withColumn("plane", -F.greatest(*ranked)["at"])
    total, planes = (sum((f(F.col(f"s{j}")) for j in range(PLANES)), F.lit(0)) for f in (lambda c: c, lambda c: (c > 0).cast("int")))
    found = found.withColumn("own", F.when(total == 1, "single").when(planes > 1, "direct"))
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((a, b, c), "abc")]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)])
    sent = found.where(F.col("own").isNotNull()).select("frame", "vx", "vy", "vz", F.col("plane").alias("other"), F.explode(steps).alias("d"))
    near = sent.select("frame", *[(F.col(f"v{c}") + F.col(f"d.{n}")).alias(f"v{c}") for c, n in zip("xyz", "abc")], "other").groupBy(VOXEL).agg(F.collect_set("other").alias("others"))
    touched = F.exists(F.coalesce("others", F.array().cast("array<int>")), lambda p: p != F.col("plane"))
    return found.join(near, VOXEL, "left").select(*VOXEL, *[f"s{j}" for j in range(PLANES)], "plane", F.coalesce("own", F.when(touched, "indirect"), F.lit("none")).alias("edge"))


def _argmax(scores: list[Column]) -> Column:
    """The first of the greatest."""
    return (F.array_position(F.array(*scores), F.greatest(*scores)) - 1).cast("int")


def refined(points: DataFrame, normals: DataFrame, edge: int = 2, reach: int = 4, neighbours: int = 16, strength: float = 3.0, rounds: int = 4) -> tuple[DataFrame, list[int]]:
    """frame, pid and plane after rounds of votes between voxels, and how many voxels each round recomputed.

    A voxel holds the points around a multiple of edge. It hears the voxels within the squared distance reach (in voxels), nearest first, until they hold so
    many points; a point then takes the plane of which its normal plus strength, shared among those points, scores most. Only voxels at an edge between planes are
    recomputed: those with one point ('single') or several planes ('multi'), and those of one plane that a neighbour at an edge hears outvoted ('indirect').
    Voxels are taken in order of their least pid, so one that is outvoted by an earlier voxel joins in the same round, by a later one in the next.
    Within a round these calls spread by steps over newly called voxels only; scores change between rounds. points: frame, pid, x, y, z, plane.
    """
    n = ("nx", "ny", "nz")
    s = [f"s{j}" for j in range(PLANES)]
    cells = [F.floor((F.col(c) + edge // 2) / edge).cast("int").alias(f"v{c}") for c in "xyz"]
    placed = points.select("frame", "pid", "plane", *cells)
    counts = lambda plane: [F.count_if(plane == j).alias(f"s{j}") for j in range(PLANES)]
    planes = sum(((F.col(c) > 0).cast("int") for c in s), F.lit(0))
    several = F.when(planes == 1, "none").otherwise("multi")
    found = placed.groupBy(VOXEL).agg(F.min("pid").alias("id"), F.count("*").alias("total"), *counts(F.col("plane")))
    state = cut(found.withColumns({"edge": F.when(F.col("total") == 1, "single").otherwise(several), "plane": _argmax([F.col(c) for c in s])}))
    held = cut(placed.join(state.select(*VOXEL, "id"), VOXEL).join(normals, ["frame", "pid"]).select("frame", "id", "pid", *n))

    grid = state.select("frame", F.col("id").alias("pid"), *[F.col(f"v{c}").alias(c) for c in "xyz"])
    sized = within(grid, grid, reach).join(state.select("frame", F.col("id").alias("nn_pid"), "total", *[F.col(f"v{c}").alias(f"o{c}") for c in "xyz"]), ["frame", "nn_pid"]).join(state.select("frame", F.col("id").alias("pid"), *[f"v{c}" for c in "xyz"]), ["frame", "pid"])
    order = Window.partitionBy("frame", "pid").orderBy("d2", "nn_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heard = sized.withColumn("so_far", F.sum("total").over(order)).where(F.col("so_far") - F.col("total") < neighbours)
    span = 1 if edge >= 4 else 2
    close = F.greatest(*[F.abs(F.col(f"o{c}") - F.col(f"v{c}")) for c in "xyz"]) <= span
    heard = cut(heard.select("frame", F.col("pid").alias("id"), F.col("nn_pid").alias("other"), close.alias("close"), "total"))
    weight = cut(heard.groupBy("frame", "id").agg((F.lit(float(strength)) / F.sum("total")).alias("weight")))

    changes, sizes = [points.select("frame", "pid", "plane", F.lit(0).alias("round"))], []
    for r in range(1, rounds + 1):
        called, late, fresh = None, [], state.where("edge <> 'none'").select("frame", "id")
        while True:
            votes = heard.join(fresh, ["frame", "id"]).join(state.select("frame", F.col("id").alias("other"), *s), ["frame", "other"])
            smooth = cut(votes.groupBy("frame", "id").agg(*[F.sum(c).alias(c) for c in s]).withColumn("best", _argmax([F.col(c) for c in s])))
            called = smooth if called is None else called.unionByName(smooth)
            calm = state.where("edge = 'none'").select("frame", F.col("id").alias("other"), "plane")
            outvoted = heard.where("close").join(smooth.select("frame", "id", "best"), ["frame", "id"]).join(calm, ["frame", "other"]).where("plane <> best")
            new = outvoted.groupBy("frame", F.col("other").alias("id")).agg(F.bool_or(F.col("id") < F.col("other")).alias("now"))
            new = cut(new.join(called.select("frame", "id"), ["frame", "id"], "left_anti"))
            late.append(new.select("frame", "id"))
            fresh = new.where("now").select("frame", "id")
            if fresh.isEmpty():
                break
        marked = late[0]
        for m in late[1:]:
            marked = marked.unionByName(m)
        marked = marked.distinct()
        heard_by = called.join(state.select("frame", "id", "edge", "plane"), ["frame", "id"])
        own = F.element_at(F.array(*s), F.col("plane") + 1)
        work = cut(heard_by.where((F.col("edge") == "multi") | ~((planes == 1) & (own > 0))).join(weight, ["frame", "id"]).select("frame", "id", "weight", *s))
        sizes.append(work.count())
        axes = [F.col(c) * sign for sign in (1.0, -1.0) for c in n]
        score = [a + F.col("weight") * F.col(c) for a, c in zip(axes, s)]
        moved = cut(held.join(work, ["frame", "id"]).select("frame", "id", "pid", _argmax(score).alias("plane")))
        changes.append(moved.select("frame", "pid", "plane", F.lit(r).alias("round")))
        new = moved.groupBy("frame", "id").agg(*counts(F.col("plane"))).withColumns({"new_edge": several, "new_plane": _argmax([F.col(c) for c in s])})
        new = new.select("frame", "id", "new_edge", "new_plane", *[F.col(c).alias(f"new_{c}") for c in s])
        both = state.join(new, ["frame", "id"], "left").join(marked.withColumn("marked", F.lit(True)), ["frame", "id"], "left")
        called_now = F.when(F.col("edge") == "single", "single").otherwise(F.coalesce("new_edge", F.when(F.col("marked"), "indirect"), "edge"))
        state = cut(both.select(*VOXEL, "id", "total", *[F.coalesce(f"new_{c}", c).alias(c) for c in s], called_now.alias("edge"), F.coalesce("new_plane", "plane").alias("plane")))
    out = changes[0]
    for c in changes[1:]:
        out = out.unionByName(c)
    return out.groupBy("frame", "pid").agg(F.max_by("plane", "round").alias("plane")), sizes
