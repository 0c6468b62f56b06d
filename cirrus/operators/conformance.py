"""Comparing logs and checking level limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the six levels. Per second: projected, EOM, raw points; per frame: projected, EOM, raw points.
LEVELS = [
    (30000000, 1500000, 1500000, 1000000, 50000, 50000), (60000000, 3000000, 3000000, 2000000, 100000, 100000),
    (120000000, 6000000, 6000000, 4000000, 200000, 200000), (240000000, 12000000, 12000000, 8000000, 400000, 400000),
    (480000000, 24000000, 24000000, 16000000, 800000, 800000), (960000000, 48000000, 48000000, 32000000, 1600000, 1600000),
]


def at_levels(rows: DataFrame) -> DataFrame:
    """Each row once for each level, with the level's limits beside it."""
    names = ("proj_s", "eom_s", "raw_s", "proj", "eom", "raw")
    limits = F.array(*[F.struct(F.lit(i).alias("level"), *[F.lit(x).cast("long").alias(n) for n, x in zip(names, v)]) for i, v in enumerate(LEVELS)])
    return rows.select("*", F.explode(limits).alias("limits")).select(*rows.columns, "limits.*")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each key of each row of two logs (file, row_idx, k, v): MATCH, DIFF or MISSING."""
    both = a.join(b.withColumnRenamed("v", "w"), ["file", "row_idx", "k"], "full_outer")
    status = F.when(F.col("v").isNull() | F.col("w").isNull(), "MISSING").when(F.col("v") == F.col("w"), "MATCH").otherwise("DIFF")
    return both.select("file", "row_idx", "k", status.alias("status"))


def over_frame_limits(log: DataFrame) -> DataFrame:
    """For each level, frames over its limits per frame."""
    over = lambda c, m: F.count_if(F.col(c) > F.col(m)).alias(f"{m}_over")
    return at_levels(log).groupBy("level").agg(over("num_proj", "proj"), over("num_eom", "eom"), over("num_raw", "raw"))


def numbered(log: DataFrame, slab: int = 4096) -> DataFrame:
    """log with nth, the place of each row in the order of frame_id, from 0: places inside slabs of frame numbers, after what the slabs before hold."""
    placed = log.withColumn("slab", F.floor(F.col("frame_id") / slab).cast("long"))
    slabs = placed.groupBy("slab").count()
    before = slabs.select("slab", (F.sum("count").over(Window.orderBy("slab")) - F.col("count")).alias("before"))
    inside = placed.withColumn("inside", F.row_number().over(Window.partitionBy("slab").orderBy("frame_id")))
    return inside.join(before, "slab").withColumn("nth", F.col("before") + F.col("inside") - 1).drop("slab", "before", "inside")


def sliding_sums(log: DataFrame, fps: int = 30, column: str = "num_proj") -> DataFrame:
    """Sum of a column over each frame and the fps - 1 recorded before it, for frames that have so many before them.

    Frames are counted first, since numbers may be missing; runs of fps frames are dealt to tasks, each with the run before it, and summed there.
    """
    run = F.floor(F.col("nth") / fps).cast("long")
    dealt = numbered(log.select("frame_id", F.col(column).alias("n"))).select("frame_id", "nth", "n", run.alias("own"), F.explode(F.array(run, run + 1)).alias("run"))
    window = Window.partitionBy("run").orderBy("nth").rowsBetween(1 - fps, 0)
    summed = dealt.select("*", F.sum("n").over(window).alias("total"), F.count("*").over(window).alias("many"))
    return summed.where((F.col("own") == F.col("run")) & (F.col("many") == fps)).select("frame_id", "total")


def order_counts(lsbs: DataFrame, bits: int) -> DataFrame:
    """Full order counts of rows (grp, idx, lsb): the low bits wrap when they fall by half their range or more."""
    half, w = 1 << (bits - 1), Window.partitionBy("grp").orderBy("idx")
    before = F.lag("lsb", 1).over(w)
    step = F.when(before - F.col("lsb") >= half, 1 << bits).when(F.col("lsb") - before > half, -(1 << bits)).otherwise(0)
    stepped = lsbs.withColumn("step", F.when(before.isNull(), 0).otherwise(step))
    return stepped.select("grp", "idx", (F.sum("step").over(w) + F.col("lsb")).alias("count"))
