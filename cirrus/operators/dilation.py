"""Unoccupied pixels filled from occupied ones: by depths near the cloud, inside a block by waves, empty blocks from the block on their left or above.

A block is a bounded dense array that one task fills by itself; which block an empty one copies is a window over the blocks of a row.
Places, blocks and patches grow with the input, so joins on them are hinted: their packed files look small enough to be broadcast, their rows are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.functions import geometry
from cirrus.operators.neighbours import nearest
from cirrus.operators.patches import block_owner, points_of
from cirrus.plans.lineage import cut


def filled(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A block (height, width, channels), some of it known, filled in waves: a pixel next to the last wave takes the mean of its neighbours there,
    a half rounded up."""
    values, known, wave = values.copy(), known.copy(), known.copy()
    while not known.all():
        total, count = np.zeros_like(values), np.zeros(known.shape, np.int64)
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            to = [slice(None)] * 2
            of = [slice(None)] * 2
            to[axis], of[axis] = (slice(1, None), slice(None, -1)) if step > 0 else (slice(None, -1), slice(1, None))
            total[tuple(to)] += np.where(wave[tuple(of)][..., None], values[tuple(of)], 0)
            count[tuple(to)] += wave[tuple(of)]
        wave = ~known & (count > 0)
        c = count[wave][:, None]
        values[wave] = (total[wave] + c // 2) // c
        known |= wave
    return values


def dilated(pixels: DataFrame, channels: list[str], block: int = 16) -> DataFrame:
    """All pixels of the frames' canvases (frame, x, y, channels; whole numbers) from pixels with occ (1: occupied), each place once at most.

    A canvas is as large as its last pixels make it, in whole blocks. In a block with occupied pixels, the others are filled by waves. An empty block takes, in
    each row, the pixel on its left; one at the left end takes, in each column, the pixel above it; one in the corner is 0.
    """
    n = len(channels)
    whole = lambda c: (F.floor(F.max(c) / block) + 1).cast("int")
    sizes = pixels.groupBy("frame").agg(whole("x").alias("wide"), whole("y").alias("high"))
    cell = [F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "xy"]
    place = ((F.col("y") % block) * block + F.col("x") % block).cast("int").alias("at")
    held = pixels.where("occ = 1").select("frame", *cell, place, *[F.col(c).cast("int").alias(c) for c in channels])
    gathered = held.groupBy("frame", "bx", "by").agg(F.collect_list("at").alias("at"), *[F.collect_list(c).alias(c) for c in channels])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = batch.column("at").to_pylist(), [batch.column(c).to_pylist() for c in channels]
            out: list[list[np.ndarray]] = [[] for _ in channels]
            for i, places in enumerate(at):
                values, known = np.zeros((block * block, n), np.int64), np.zeros(block * block, bool)
                known[places] = True
                values[places] = np.stack([values_of[i] for values_of in lists], 1)
                done = filled(values.reshape(block, block, n), known.reshape(block, block)).reshape(-1, n)
                for k in range(n):
                    out[k].append(done[:, k].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("frame", "bx", "by")), *[pa.array(o, pa.list_(pa.int32())) for o in out]], names=["frame", "bx", "by", *channels])

    blocks = gathered.mapInArrow(fill, "frame int, bx int, by int, " + ", ".join(f"`{c}` array<int>" for c in channels))
    grid = sizes.select("frame", "wide", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("by")).select("frame", "by", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("bx"))
    rows = grid.join(blocks.hint("merge"), ["frame", "bx", "by"], "left")
    left = Window.partitionBy("frame", "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = lambda c: F.when(F.col(c).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda y: F.element_at(F.col(c), y * block + block)))
    # The blocks at the left end alone, and the last row of the lowest one with pixels so far.
    first = rows.where("bx = 0").select("frame", "by", *[F.slice(c, block * (block - 1) + 1, block).alias(f"base_{c}") for c in channels])
    down = Window.partitionBy("frame").orderBy("by").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = first.select("frame", "by", *[F.last(f"base_{c}", ignorenulls=True).over(down).alias(f"base_{c}") for c in channels])
    beside = rows.withColumns({f"edge_{c}": F.last(edge(c), ignorenulls=True).over(left) for c in channels}).join(base.hint("merge"), ["frame", "by"])

    def pixel(c: str, k: Column) -> Column:
        above = F.when(F.col("bx") == 0, F.element_at(f"base_{c}", k % block + 1)).otherwise(F.element_at(f"base_{c}", block))
        copied = F.coalesce(F.element_at(f"edge_{c}", F.floor(k / block).cast("int") + 1), above, F.lit(0))
        return F.coalesce(F.element_at(c, k + 1), copied).cast("int")

    each = beside.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block * block - 1))))
    at = lambda b, inner: (F.col(b) * block + inner).cast("int")
    return each.select("frame", at("bx", F.col("k") % block).alias("x"), at("by", F.floor(F.col("k") / block)).alias("y"), *[pixel(c, F.col("k")).alias(c) for c in channels])


def depth_padded(pixels: DataFrame, patches: DataFrame, cloud: DataFrame, precision: int = 4, block: int = 16, most: int = 255, reach: int = 8) -> DataFrame:
    """Depths (frame, x, y, d0) for the unoccupied places of cells of precision that have an occupied pixel (frame, x, y, patch, d0, occ), from the cloud (frame, pid, x, y, z).

    A place starts from the mean depth of its cell, cut off, in space as its block's patch has it. It takes the depth less than reach away (and no further than the mean is from 0 and
    from most) whose point is nearest to the cloud; of equals the mean, then the one less far from it, then the larger. Places whose mean is in the cloud are asked about
    once, and the others again with all depths. A frame without a cloud takes means. Sides of a canvas are below 2 ** 20, reach is at most 16.
    """
    patches = patches.hint("merge")
    held = pixels.where("occ = 1").select("frame", "x", "y", "d0")
    cell = [F.floor(F.col(c) / precision).cast("int").alias(f"c{c}") for c in "xy"]
    means = held.groupBy("frame", *cell).agg(F.expr("CAST(sum(d0) div count(*) AS INT)").alias("mean"))
    inner = F.explode(F.sequence(F.lit(0), F.lit(precision - 1)))
    places = means.withColumn("i", inner).withColumn("j", inner).select("frame", (F.col("cx") * precision + F.col("i")).alias("x"), (F.col("cy") * precision + F.col("j")).alias("y"), "mean")
    owners = block_owner(pixels, block).select("frame", "block_x", "block_y", (F.col("owner") - 1).alias("patch"))
    empty = places.join(held.select("frame", "x", "y").hint("merge"), ["frame", "x", "y"], "left_anti").withColumns({f"block_{c}": F.floor(F.col(c) / block).cast("int") for c in "xy"})
    u, v = geometry.canvas_to_patch(*[F.col(c) for c in ("orientation", "x", "y", "u0", "v0", "size_u0", "size_v0")], block)
    shapes = patches.select("frame", "patch", "orientation", "u0", "v0", "size_u0", "size_v0")
    asked = empty.join(owners.hint("merge"), ["frame", "block_x", "block_y"]).join(shapes, ["frame", "patch"]).select("frame", "patch", "x", "y", "mean", u.alias("u"), v.alias("v"))
    place = ((F.shiftleft(F.col("y").cast("long"), 20) + F.col("x")) * 32).alias("place")
    asked = cut(asked.withColumn("place", place)).hint("merge")

    def distances(candidates: DataFrame) -> DataFrame:
        return nearest(points_of(candidates.select("frame", "patch", (F.col("place") + F.col("turn")).alias("pid"), "u", "v", "d0"), patches), cloud).select("frame", "pid", "d2")

    first = cut(distances(asked.select("*", F.lit(0).alias("turn"), F.col("mean").alias("d0"))))
    off = asked.join(first.where("d2 > 0").select("frame", F.col("pid").alias("place")), ["frame", "place"], "left_semi")
    span = F.least(F.lit(reach), F.col("mean"))
    span = F.when(F.col("mean") + span > most, most - F.col("mean")).otherwise(span)
    around = off.withColumn("span", span).where("span > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("span") - 1)))
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    further = around.withColumn("side", sides).select("frame", "patch", "place", "u", "v", (F.col("mean") + F.col("k") * F.col("side")).alias("d0"), F.when(F.col("side") > 0, 2 * F.col("k") - 1).otherwise(2 * F.col("k")).alias("turn"))
    turn = F.col("pid") % 32
    met = first.unionByName(distances(further)).select("frame", (F.col("pid") - turn).alias("place"), F.struct("d2", turn.alias("turn")).alias("best"))
    best = met.groupBy("frame", "place").agg(F.min("best").alias("best"))
    step = F.expr("CAST(CASE WHEN best.turn % 2 = 1 THEN (best.turn + 1) div 2 ELSE -(best.turn div 2) END AS INT)")
    return asked.join(best, ["frame", "place"], "left").select("frame", "x", "y", (F.col("mean") + F.coalesce(step, F.lit(0))).alias("d0"))


def padded(pixels: DataFrame, patches: DataFrame, cloud: DataFrame, precision: int = 4, block: int = 16, most: int = 255) -> DataFrame:
    """All depths (frame, x, y, d0) of the frames' canvases: depth_padded() first, then dilated()."""
    near = depth_padded(pixels, patches, cloud, precision, block, most).withColumn("occ", F.lit(1))
    return dilated(pixels.select("frame", "x", "y", F.col("d0").cast("int").alias("d0"), "occ").unionByName(near), ["d0"], block)
