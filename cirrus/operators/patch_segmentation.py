"""A cloud cut into patches: components of neighbours on one plane, projected, and what is far from the projection cut again.

Rounds work on open points only, the ones that no patch has come near. Within a round, components come from contraction of the edges
between open points of one plane, and depth maps, peaks and surface layers are aggregates by patch and pixel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.functions import color, geometry
from cirrus.operators import contraction, orientation, patches, transfer
from cirrus.operators.neighbours import nearest, within
from cirrus.plans.lineage import cut

PIXEL = ["frame", "round", "start", "u", "v"]
PATCH = ["frame", "round", "start"]


@dataclass(frozen=True)
class Limits:
    """Neighbours of a point, points of a patch, squared distances, and what a patch's projection may hold."""

    neighbours: int = 16
    least_points: int = 16
    detection: int = 9  # a patch needs a point farther than this from what is projected
    selection: int = 1  # points farther than this stay open
    thickness: int = 4
    block: int = 16
    peak: int = 32
    deepest: int = 255
    level: int = 64
    colour: int = 128
    expand: bool = False


@dataclass(frozen=True)
class Segmentation:
    """members: frame, patch, pid. pixels: frame, patch, u, v, d0, d1. patches: frame, patch, plane, round, start, n. raw: frame, pid."""

    members: DataFrame
    pixels: DataFrame
    patches: DataFrame
    raw: DataFrame
    rounds: list[int]


def _axis(role: int) -> Column:
    """A point's coordinate along its plane's normal (1), tangent (2) or bitangent (3) axis."""
    out = F.lit(None).cast("int")
    for j in range(6):
        out = F.when(F.col("plane") == j, F.col("xyz"[geometry.VIEWS[j][role]])).otherwise(out)
    return out


def _direction() -> Column:
    """1 where a patch keeps its least depths, -1 where it keeps its greatest."""
    return F.when(F.col("plane") < 3, 1).otherwise(-1)


def projected(members: DataFrame, limits: Limits) -> DataFrame:
    """Pixels of patches (frame, round, start, plane, u, v, d0, d1, with u and v as coordinates in space) from members (pid, x, y, z, r, g, b as well).

    Depth 0 is the depth nearest to the projection plane; a pixel goes whose depth is far from its block's nearest, or too deep for the patch. Depth 1 is
    the farthest one within the thickness of a point whose colour is like that of depth 0 (of equal places, the smallest pid's).
    """
    flat = members.select(*PATCH, "plane", "pid", _axis(2).alias("u"), _axis(3).alias("v"), (_axis(1) * _direction()).alias("depth"), *"rgb")
    whole = flat.groupBy(PATCH).agg(F.min("u").alias("u1"), F.min("v").alias("v1"), F.min("depth").alias("least"))
    lowest = F.floor(F.col("least") / limits.level) * limits.level  # of -depth this rounds depth up
    lowest = F.when(F.col("plane") < 3, lowest).otherwise(F.least(lowest, F.lit(0)))
    nearest_ = flat.groupBy(*PIXEL, "plane").agg(F.min_by(F.struct("depth", *"rgb"), F.struct("depth", "pid")).alias("top"))
    celled = nearest_.join(whole, PATCH).select(*PIXEL, "plane", "top", lowest.alias("lowest"), F.floor((F.col("u") - F.col("u1")) / limits.block).alias("bu"), F.floor((F.col("v") - F.col("v1")) / limits.block).alias("bv"))
    peaks = celled.groupBy(*PATCH, "bu", "bv").agg(F.min("top.depth").alias("peak"))
    kept = celled.join(peaks, [*PATCH, "bu", "bv"]).where((F.col("top.depth") - F.col("peak") <= limits.peak) & (F.col("top.depth") + limits.thickness <= F.col("lowest") + limits.deepest))
    rows = flat.join(kept.select(*PIXEL, "top"), PIXEL)
    layer = (F.col("depth") - F.col("top.depth") <= limits.thickness) & color.similar([F.col(c) for c in "rgb"], [F.col(f"top.{c}") for c in "rgb"], limits.colour)
    found = rows.groupBy(*PIXEL, "plane").agg(F.min("top.depth").alias("d0"), F.max(F.when(layer, F.col("depth"))).alias("d1"))
    return found.select(*PIXEL, "plane", (F.col("d0") * _direction()).alias("d0"), (F.coalesce("d1", "d0") * _direction()).alias("d1"))


def resampled(pixels: DataFrame) -> DataFrame:
    """The points that pixels stand for, those of both depths: frame, x, y, z."""
    both = pixels.select("frame", "plane", "u", "v", F.explode(F.array_distinct(F.array("d0", "d1"))).alias("d"))
    at = lambda k: F.coalesce(*[F.when(F.col("plane") == j, F.col("duv"[geometry.VIEWS[j][1:4].index(k)])) for j in range(6)])
    return both.select("frame", *[at(k).alias(c) for k, c in enumerate("xyz")]).distinct()


def expanded(members: DataFrame, near: DataFrame, planes: DataFrame, flagged: DataFrame) -> DataFrame:
    """Points that patches take in beside their own (frame, round, start, pid, plane of the patch): neighbours of their members at a squared distance of
    2 at most, on another plane that isn't the opposite one, whom no larger patch (of equal ones, the smaller start) and no earlier round has."""
    sizes = members.groupBy(PATCH).agg(F.count("*").alias("n"))
    turn = members.join(sizes, PATCH).select(*PATCH, "pid", "plane", F.struct((-F.col("n")).alias("n"), "start").alias("turn"))
    reach = near.where("d2 <= 2 AND pid <> nn_pid").select("frame", "pid", "nn_pid").join(turn, ["frame", "pid"]).select(*PATCH, "plane", "turn", F.col("nn_pid").alias("pid"))
    met = reach.join(planes.withColumnRenamed("plane", "own"), ["frame", "pid"]).where("own <> plane AND abs(own - plane) <> 3").join(flagged, ["frame", "pid"], "left_anti")
    taken = turn.select("frame", "pid", F.col("turn").alias("its"))
    free = met.join(taken, ["frame", "pid"], "left").where(F.col("its").isNull() | (F.col("its") > F.col("turn")))
    return free.groupBy("frame", "pid").agg(F.min_by(F.struct("round", "start", "plane"), "turn").alias("to")).select("frame", "to.round", "to.start", "pid", "to.plane")


def segment(points: DataFrame, planes: DataFrame, limits: Limits = Limits(), near: DataFrame | None = None) -> Segmentation:  # noqa: B008
    """Patches of points (frame, pid, x, y, z, r, g, b) with planes (frame, pid, plane 0 to 5); near: their nearest neighbours, if they are known.

    Neighbours are taken both ways: two points are adjacent if one is among the nearest of the other. A component of open points on one plane becomes a
    patch if it has enough points, one of them far from all that is projected so far; its start is the least pid of those, and patches of a frame are
    numbered by round and start. A point is open while it lies farther than the selection distance from all points projected. Rounds end when no
    component is left; raw are the points that then are open. Points at equal places are points of their own.
    """
    rows = cut(points.select("frame", "pid", *"xyzrgb").join(planes, ["frame", "pid"]))
    near = (cut(nearest(points, points, limits.neighbours)) if near is None else near).select("frame", "pid", "nn_pid", "d2")
    end = lambda c: rows.select("frame", F.col("pid").alias(c), F.col("plane").alias(f"{c}_plane"))
    edges = cut(contraction.undirected(near).join(end("u"), ["frame", "u"]).join(end("v"), ["frame", "v"]).where("u_plane = v_plane").select("frame", "u", "v"))
    open_ = rows.select("frame", "pid", F.lit(None).cast("long").alias("d2"))
    reach = max(limits.detection, limits.selection)
    members, pixels, counts = [], [], []
    flagged = rows.select("frame", "pid").where("false")
    while True:
        mine = edges if not members else edges.join(open_.select("frame", F.col("pid").alias("u")), ["frame", "u"], "left_semi").join(open_.select("frame", F.col("pid").alias("v")), ["frame", "v"], "left_semi")
        rooted = open_.join(contraction.components(mine), ["frame", "pid"], "left").withColumn("root", F.coalesce("root", "pid"))
        far = F.col("d2").isNull() | (F.col("d2") > limits.detection)
        found = rooted.groupBy("frame", "root").agg(F.count("*").alias("n"), F.min(F.when(far, F.col("pid"))).alias("start")).where((F.col("n") >= limits.least_points) & F.col("start").isNotNull())
        new = cut(rooted.join(found.drop("n"), ["frame", "root"]).join(rows, ["frame", "pid"]).select("frame", F.lit(len(members)).alias("round"), "start", "pid", "plane", *"xyzrgb"))
        if new.isEmpty():
            break
        if limits.expand:
            more = expanded(new.select(*PATCH, "pid", "plane"), near, rows.select("frame", "pid", "plane"), flagged)
            new = cut(new.unionByName(more.join(rows.drop("plane"), ["frame", "pid"])))
            flagged = flagged.unionByName(new.select("frame", "pid"))
        shown = cut(projected(new, limits))
        members.append(new)
        pixels.append(shown)
        made = resampled(shown).withColumn("pid", F.monotonically_increasing_id())
        seen = within(rows.join(open_.select("frame", "pid"), ["frame", "pid"], "left_semi"), made, reach).groupBy("frame", "pid").agg(F.min("d2").alias("now"))
        nearer = open_.join(seen, ["frame", "pid"], "left").select("frame", "pid", F.least("d2", "now").alias("d2"))
        open_ = cut(nearer.where(F.col("d2").isNull() | (F.col("d2") > limits.selection)))
        counts.append(open_.count())
        if not counts[-1]:
            break
    all_members = new.where("false") if not members else members[0]
    for m in members[1:]:
        all_members = all_members.unionByName(m)
    all_pixels = projected(all_members, limits) if not pixels else pixels[0]
    for p in pixels[1:]:
        all_pixels = all_pixels.unionByName(p)
    own = all_members.groupBy(PATCH).agg(F.min("plane").alias("plane"), F.count("*").alias("n"))
    numbered = cut(own.withColumn("patch", F.row_number().over(Window.partitionBy("frame").orderBy("round", "start")) - 1))
    named = lambda df, *more: df.join(numbered.select(*PATCH, "patch"), PATCH).select("frame", "patch", *more)
    return Segmentation(named(all_members, "pid"), named(all_pixels, "u", "v", "d0", "d1"), numbered.select("frame", "patch", "plane", "round", "start", "n"), open_.select("frame", "pid"), counts)


def pipeline(points: DataFrame, limits: Limits = Limits(), k: int = 16, rounds: int = 4, strength: float = 3.0, weights: tuple[float, ...] = (1.0, 1.0, 1.0)) -> Segmentation:  # noqa: B008
    """From points to patches: normals oriented along the spanning tree, the plane of each, planes refined by votes of neighbours, segments.
    Neighbours are looked for once."""
    near = nearest(points, points, k, places=True)
    found = cut(orientation.pipeline(points, k, near=near))
    planes = cut(transfer.refined_planes(points, found, k, rounds, strength, list(weights), near) if rounds else patches.initial_planes(found, list(weights)))
    return segment(points, planes, limits, near if limits.neighbours == k else None)
