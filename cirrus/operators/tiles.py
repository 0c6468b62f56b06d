"""Tiles of a frame, and patches followed through groups of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrus.functions import geometry
from cirrus.operators.patches import block_owner


def of_segments(patches: DataFrame, least: int, block: int = 16) -> DataFrame:
    """frame, patch, place, side, own and tile: the three largest patches are in tile 0, of the others those below least across in 1, the rest in 2.

    Larger is what has the longer side, then the longer shorter side, then the smaller index; side is the longer one in whole blocks. Where one of
    the tiles 1 and 2 is empty and the other isn't, it borrows the other's last patch; own is the tile before that. Patches of a frame are few.
    """
    long, short = F.greatest("size_u", "size_v"), F.least("size_u", "size_v")
    order = Window.partitionBy("frame").orderBy(long.desc(), short.desc(), "patch")
    side = (F.ceil(long / block) * block).cast("int")
    rows = patches.select("frame", "patch", side.alias("side"), F.row_number().over(order).alias("place"))
    rows = rows.withColumn("own", F.when(F.col("place") <= 3, 0).when(F.col("side") < least, 1).otherwise(2))
    frame = Window.partitionBy("frame")
    small, large = (F.count_if(F.col("own") == t).over(frame) for t in (1, 2))
    last = F.col("place") == F.max("place").over(frame)
    lends = last & (F.col("own") > 0) & ((small == 0) | (large == 0))
    return rows.select("frame", "patch", "place", "side", "own", F.when(lends, 3 - F.col("own")).otherwise(F.col("own")).alias("tile"))


def layout(tiled: DataFrame, raw: DataFrame, width: int, least: int, raw_width: int) -> DataFrame:
    """frame, tile, left_, top, width, height: tile 0 at the origin, 1 right of it, 2 below it, raw points (frame, n) in 3 below all of them.

    Tiles 0 and 2 are width across, 1 is least; a tile is as high as its longest patch, or has no height. A borrowed patch counts where it was.
    """
    high = tiled.groupBy("frame").agg(*[F.coalesce(F.max(F.when(F.col("own") == t, F.col("side"))), F.lit(0)).alias(f"h{t}") for t in range(3)])
    both = high.join(raw, "frame", "left").withColumn("h3", F.ceil(F.coalesce("n", F.lit(0)) / raw_width).cast("int"))
    zero, below = F.lit(0), F.greatest(F.col("h0") + F.col("h2"), F.col("h1"))
    corner = [(zero, zero, width), (F.lit(width), zero, least), (zero, F.col("h0"), width), (zero, below, raw_width)]
    at = [F.struct(F.lit(t).alias("tile"), left.alias("left_"), top.alias("top"), F.lit(w).alias("width"), F.col(f"h{t}").alias("height")) for t, (left, top, w) in enumerate(corner)]
    return both.select("frame", F.inline(F.array(*at)))


def atlas_block_owner(pixels: DataFrame, tiled: DataFrame, placed: DataFrame, block: int = 16) -> DataFrame:
    """The last patch with an occupied pixel in each block of the whole frame: pixels move with their patch's tile, in whole blocks."""
    moved = tiled.select("frame", "patch", "tile").join(placed.select("frame", "tile", "left_", "top"), ["frame", "tile"])
    there = pixels.join(moved, ["frame", "patch"])
    shift = lambda c: F.floor(F.col(c) / block).cast("int") * block
    return block_owner(there.withColumn("x", F.col("x") + shift("left_")).withColumn("y", F.col("y") + shift("top")), block)


def tracks(patches: DataFrame, group: int) -> DataFrame:
    """The tracks of each group of frames: one for each patch of its first frame, by that patch's index."""
    first = patches.groupBy(F.floor(F.col("frame") / group).cast("int").alias("gof")).agg(F.min("frame").alias("frame"))
    return patches.join(first, "frame").select("gof", F.col("patch").alias("track"), F.col("frame").alias("first_frame"))


def padded_blocks(blocks: DataFrame, patches: DataFrame, group: int) -> DataFrame:
    """Occupancy of each patch in blocks (frame, patch, bu, bv: the occupied ones; patches with sizes in blocks), padded with empty blocks to
    the size of its track's union. A patch without a track keeps its own size."""
    gof = F.floor(F.col("frame") / group).cast("int")
    known = tracks(patches, group).select("gof", F.col("track").alias("patch"), F.lit(True).alias("global"))
    marked = patches.select("frame", "patch", "size_u", "size_v", gof.alias("gof")).join(known, ["gof", "patch"], "left")
    union = marked.where("global").groupBy("gof", "patch").agg(F.max("size_u").alias("wu"), F.max("size_v").alias("wv"))
    sized = marked.join(union, ["gof", "patch"], "left").select("frame", "patch", F.coalesce("wu", "size_u").alias("wu"), F.coalesce("wv", "size_v").alias("wv"))
    grid = sized.withColumn("bu", F.explode(F.sequence(F.lit(0), F.col("wu") - 1))).withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("wv") - 1)))
    full = blocks.select("frame", "patch", "bu", "bv", F.lit(1).alias("occ")).distinct()
    return grid.join(full, ["frame", "patch", "bu", "bv"], "left").select("frame", "patch", "bu", "bv", F.coalesce("occ", F.lit(0)).alias("occ"))


def roi_chunks(points: DataFrame, rois: list[tuple[list[int], list[int]]], cuts: tuple[int, int, int]) -> DataFrame:
    """frame, pid and chunk: which part of which region a point is in; a point of several regions is in several chunks, one of none in none.

    A region (low and high corner, ends included) shrinks to the box of a frame's points in it. Its longest side (of equal ones the first axis) is cut into
    cuts[0] ranges, the next one into cuts[1], the shortest into cuts[2]; ranges are of equal length up to rounding and don't overlap. Chunks are numbered by
    region, then by their range on x, y and z.
    """
    inside = [F.when(geometry.inside([F.col(c) for c in "xyz"], low, high), F.lit(i)) for i, (low, high) in enumerate(rois)]
    rows = points.select("frame", "pid", *"xyz", F.explode(F.array_compact(F.array(*inside))).alias("roi"))
    tight = rows.groupBy("frame", "roi").agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[(F.max(c) - F.min(c) + 1).alias(f"n{c}") for c in "xyz"])
    for k, c in enumerate("xyz"):
        before = sum(((F.col(f"n{o}") >= F.col(f"n{c}") if j < k else F.col(f"n{o}") > F.col(f"n{c}")).cast("int") for j, o in enumerate("xyz") if o != c), F.lit(0))
        tight = tight.withColumn(f"cuts_{c}", F.element_at(F.array(*[F.lit(n) for n in cuts]), before + 1))
    found = rows.join(tight, ["frame", "roi"])
    for c in "xyz":
        found = found.withColumn(f"at_{c}", F.explode(F.sequence(F.lit(0), F.col(f"cuts_{c}") - 1)))
        edge = lambda i, c=c: F.round(i * F.col(f"n{c}") / F.col(f"cuts_{c}")) + F.col(f"l{c}")
        found = found.where((F.col(c) >= edge(F.col(f"at_{c}"))) & (F.col(c) < edge(F.col(f"at_{c}") + 1)))
    chunk = F.col("roi") * (cuts[0] * cuts[1] * cuts[2]) + (F.col("at_x") * F.col("cuts_y") + F.col("at_y")) * F.col("cuts_z") + F.col("at_z")
    return found.select("frame", "pid", chunk.cast("int").alias("chunk"))
