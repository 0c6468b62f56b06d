"""Colours moved from a source cloud to a target cloud by neighbours in both directions.

Forward, a target point looks at its nearest source points; backward, it looks at the source points that have it among their nearest. Both
lists are rows (frame, pid of the target, other, d2, colour), trimmed while they stream by in order of distance, and become sums: the search
for the best colour near the backward mean needs the number, the sum and the squares of a list only, so no list is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.operators.neighbours import nearest
from cirrus.plans.lineage import cut

RGB = ("r", "g", "b")
AT = ["frame", "pid"]


@dataclass(frozen=True)
class Way:
    """How one direction is averaged. Bounds that are None don't hold."""

    neighbours: int = 1
    weighted: bool = True
    offset: float = 4.0
    most_d2: float | None = None  # of a neighbour's place
    most_colour_d2: float | None = None  # between any two colours of a list
    outlier: float | None = None  # distance of a colour from the mean beyond which it is left out
    identical_alone: bool = False  # a neighbour at the same place counts alone


def _rows(near: DataFrame, source: DataFrame, target_key: str, source_key: str) -> DataFrame:
    colours = source.select("frame", F.col("pid").alias("other"), *RGB)
    return near.select("frame", F.col(target_key).alias("pid"), F.col(source_key).alias("other"), "d2", "rank").join(colours, ["frame", "other"])


def within_spread(rows: DataFrame, most: float) -> DataFrame:
    """Of each target's rows, by distance, those before the first one whose colour is too far from one before it; the nearest stays in any case.

    This is what is left when the farthest row is dropped until all colours lie near each other. A list goes by row after row; what is
    remembered of it are the different colours kept, which lie within a small ball.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, closed = None, [], False
        for batch in batches:
            frames, pids = batch.column("frame").to_pylist(), batch.column("pid").to_pylist()
            colours = list(zip(*(batch.column(c).to_pylist() for c in RGB)))
            take = np.zeros(batch.num_rows, bool)
            for i, (f, p, c) in enumerate(zip(frames, pids, colours)):
                if (f, p) != key:
                    key, kept, closed = (f, p), [], False
                if closed:
                    continue
                if any((c[0] - o[0]) ** 2 + (c[1] - o[1]) ** 2 + (c[2] - o[2]) ** 2 > most for o in kept):
                    closed = True
                    continue
                take[i] = True
                if c not in kept:
                    kept.append(c)
            yield batch.filter(pa.array(take))

    return rows.repartition("frame", "pid").sortWithinPartitions("frame", "pid", "d2", "other").mapInArrow(run, rows.schema)


def _listed(rows: DataFrame, way: Way, one_stays: bool) -> DataFrame:
    if way.most_d2 is not None:
        near = F.col("d2") <= way.most_d2
        rows = rows.where(near | (F.col("rank") == 1) if one_stays else near)
    if way.identical_alone:
        first = rows.groupBy(AT).agg(F.min(F.struct("d2", "other")).alias("first"))
        rows = rows.join(first, AT).where((F.col("first.d2") > 0) | (F.col("first.other") == F.col("other"))).drop("first")
    return rows if way.most_colour_d2 is None else within_spread(rows, way.most_colour_d2)


def _mean(rows: DataFrame, way: Way, distance: Column) -> DataFrame:
    """For each target: n, mean colour (mr, mg, mb), sums (sr, sg, sb) and the sum of squares q of its list."""
    weight = 1 / (distance + way.offset) if way.weighted else F.lit(1.0)
    mean = lambda keep: [(F.sum(F.when(keep, F.col(c) * weight)) / F.sum(F.when(keep, weight))).alias(f"m{c}") for c in RGB]
    square = sum((F.col(c).cast("long") * F.col(c) for c in RGB), F.lit(0))
    found = rows.groupBy(AT).agg(F.count("*").alias("n"), *mean(F.lit(True)), *[F.sum(c).alias(f"s{c}") for c in RGB], F.sum(square).alias("q"))
    if way.outlier is None:
        return found
    away = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in RGB), F.lit(0.0))
    held = rows.join(found.select(*AT, "mr", "mg", "mb"), AT).withColumn("near", F.round(away, 6) <= way.outlier * way.outlier).drop("mr", "mg", "mb")
    again = held.groupBy(AT).agg(F.count_if("near").alias("nears"), *mean(F.col("near"))).select(*AT, "nears", *[F.col(f"m{c}").alias(f"again_{c}") for c in RGB])
    some = (F.col("nears") > 0) & (F.col("nears") < F.col("n"))
    return found.join(again, AT).select(*AT, "n", *[F.when(some, F.col(f"again_{c}")).otherwise(F.col(f"m{c}")).alias(f"m{c}") for c in RGB], "sr", "sg", "sb", "q")


def _whole(c: Column, peak: int) -> Column:
    return F.least(F.greatest(F.floor(F.round(c, 6) + 0.5), F.lit(0)), F.lit(peak)).cast("int")


def _settled(forward: DataFrame, backward: DataFrame, counts: DataFrame, reach: int, peak: int) -> DataFrame:
    """The colour within reach of the backward mean whose larger error is least: against the forward colour, over the target's points, or against
    the backward list, over the source's points. Of equal ones the first, in order of r, g, b. Without a backward list the forward colour."""
    both = forward.select(*AT, *[_whole(F.col(f"m{c}"), peak).alias(f"c{c}") for c in RGB]).join(backward.select(*AT, "n", "sr", "sg", "sb", "q", *[_whole(F.col(f"m{c}"), peak).alias(f"b{c}") for c in RGB]), AT, "left").join(counts, "frame")
    side = 2 * reach + 1

    def tried(i: Column) -> Column:
        steps = [F.floor(i / (side * side)), F.floor(i / side) % side, i % side]
        at = [F.least(F.greatest(F.col(f"b{c}") + s - reach, F.lit(0)), F.lit(peak)).cast("long") for c, s in zip(RGB, steps)]
        one = sum(((a - F.col(f"c{c}")) * (a - F.col(f"c{c}")) for c, a in zip(RGB, at)), F.lit(0)) * (1.0 / F.col("n_target"))
        two = (sum((F.col("n") * a * a - 2 * a * F.col(f"s{c}") for c, a in zip(RGB, at)), F.lit(0)) + F.col("q")) * (1.0 / F.col("n_source"))
        return F.struct(F.greatest(one, two).alias("e"), i.alias("i"), *[a.alias(c) for c, a in zip(RGB, at)])

    best = both.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(0), F.lit(side**3 - 1)), tried)))
    return best.select(*AT, *[F.when(F.col("n").isNull(), F.col(f"c{c}")).otherwise(F.col(f"best.{c}")).cast("int").alias(c) for c in RGB])


def _counts(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.groupBy("frame").agg(F.count("*").alias("n_target")).join(source.groupBy("frame").agg(F.count("*").alias("n_source")), "frame")


def transferred(target: DataFrame, source: DataFrame, forward: Way, backward: Way, reach: int = 0, peak: int = 255, lossless: bool = False) -> DataFrame:
    """frame, pid and colour of each target point whose frame has source points. Lossless: the forward colour as it is."""
    ahead = _mean(_listed(_rows(nearest(target, source, forward.neighbours), source, "pid", "nn_pid"), forward, True), forward, F.col("d2"))
    if lossless:
        return ahead.select(*AT, *[_whole(F.col(f"m{c}"), peak).alias(c) for c in RGB])
    behind = _mean(_listed(_rows(nearest(source, target, backward.neighbours), source, "nn_pid", "pid"), backward, False), backward, F.sqrt("d2"))
    return _settled(ahead, behind, _counts(target, source), reach, peak)


def boundary_transferred(target: DataFrame, source: DataFrame, forward: Way, backward: Way, reach: int = 0, peak: int = 65535, gate: int = 40) -> DataFrame:
    """As transferred(), but only for target points of type 3 (between patches); all others keep their colour.

    Backward, only source points that a boundary point found forward look back, once for each that found them, and only at target points whose
    colour is within gate of theirs on every channel.
    """
    edge = target.where("type = 3")
    near = cut(nearest(edge, source, forward.neighbours))
    ahead = _mean(_listed(_rows(near, source, "pid", "nn_pid"), forward, True), forward, F.col("d2"))
    found = near.groupBy("frame", F.col("nn_pid").alias("pid")).agg(F.count("*").alias("times"))
    asked = source.join(found, AT)
    back = _rows(nearest(asked, target, backward.neighbours), source, "nn_pid", "pid").join(asked.select("frame", F.col("pid").alias("other"), "times"), ["frame", "other"])
    own = edge.select(*AT, *[F.col(c).alias(f"own_{c}") for c in RGB])
    alike = back.join(own, AT).where(" AND ".join(f"abs({c} - own_{c}) < {gate}" for c in RGB))
    rows = alike.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*AT, "other", "d2", "rank", *RGB)
    settled = _settled(ahead, _mean(_listed(rows, backward, False), backward, F.sqrt("d2")), _counts(target, source), reach, peak)
    return target.select(*AT, *RGB).join(settled.select(*AT, *[F.col(c).alias(f"new_{c}") for c in RGB]), AT, "left").select(*AT, *[F.coalesce(f"new_{c}", c).cast("int").alias(c) for c in RGB])
