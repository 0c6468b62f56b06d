"""Operators on sparse pixel tables (frame, x, y, values); a missing pixel is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.plans.lineage import cut


def cells(pixels: DataFrame, size: int) -> list:
    return [F.floor(F.col(c) / size).cast("int").alias(c) for c in "xy"]


def chroma_halved(pixels: DataFrame) -> DataFrame:
    """Chroma of 2 by 2 pixels: their sum plus 2, divided by 4 and cut off. A block's missing pixels count as 0."""
    return pixels.groupBy("frame", *cells(pixels, 2)).agg(*[F.expr(f"(sum({c}) + 2) div 4").alias(c) for c in ("c1", "c2")])


def upsampled(pixels: DataFrame, rate: int) -> DataFrame:
    """Each pixel as rate by rate pixels."""
    steps = F.sequence(F.lit(0), F.lit(rate - 1))
    out = pixels
    for c in "xy":
        out = out.withColumn(f"s{c}", F.explode(steps)).withColumn(c, F.col(c) * rate + F.col(f"s{c}")).drop(f"s{c}")
    return out


def shifted(pixels: DataFrame, steps: list[tuple[int, int]], *columns: str) -> DataFrame:
    """Each pixel's columns at the places that see it at these steps: one row for each, before sums over places."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    return pixels.select("frame", "x", "y", *columns, F.explode(moves).alias("m")).select("frame", (F.col("x") - F.col("m.a")).alias("x"), (F.col("y") - F.col("m.b")).alias("y"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), *columns)


def filtered(pixels: DataFrame, kernel: dict[tuple[int, int], int], shift: int) -> DataFrame:
    """Weighted sums over neighbours, shifted right, at occupied places."""
    weight = F.coalesce(*[F.when((F.col("a") == a) & (F.col("b") == b), F.lit(w)) for (a, b), w in kernel.items()])
    seen = shifted(pixels, list(kernel), "occ").groupBy("frame", "x", "y").agg(F.sum(F.col("occ") * weight).alias("s"))
    return pixels.join(seen, ["frame", "x", "y"]).select("frame", "x", "y", F.shiftright(F.col("s").cast("long"), shift).alias("value"))


def boundary(pixels: DataFrame, reach: int = 1) -> DataFrame:
    """Occupied pixels and whether one of the places around is empty."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a, b) != (0, 0)]
    full = pixels.where("occ = 1").select("frame", "x", "y")
    seen = shifted(full, steps).groupBy("frame", "x", "y").agg(F.count("*").alias("n"))
    return full.join(seen, ["frame", "x", "y"], "left").select("frame", "x", "y", (F.coalesce("n", F.lit(0)) < len(steps)).alias("border"))


def refined_occupancy(pixels: DataFrame, small: int = 4, large: int = 16, least: int = 4) -> DataFrame:
    """Occupied pixels without those alone in a small cell, and without large blocks that have fewer than least of the rest."""
    full = pixels.where("occ = 1").select("frame", "x", "y")
    keyed = full.select("*", *[F.floor(F.col(c) / s).cast("long").alias(f"{c}{s}") for c in "xy" for s in (small, large)])
    alone = keyed.groupBy("frame", f"x{small}", f"y{small}").count().where("count = 1").drop("count")
    kept = keyed.join(alone, ["frame", f"x{small}", f"y{small}"], "left_anti")
    thin = kept.groupBy("frame", f"x{large}", f"y{large}").count().where(F.col("count") < least).drop("count")
    return kept.join(thin, ["frame", f"x{large}", f"y{large}"], "left_anti").select("frame", "x", "y")


def block_occupancy(pixels: DataFrame, size: int) -> DataFrame:
    return pixels.groupBy("frame", *cells(pixels, size)).agg(F.max("occ").alias("occ"))


def thresholded(pixels: DataFrame, size: int, threshold: int) -> DataFrame:
    """Full-resolution pixels with the decision of their block: whether its occupied pixels are more than threshold."""
    full = pixels.select("*", F.floor(F.col("x") / size).cast("long").alias("bx"), F.floor(F.col("y") / size).cast("long").alias("by"))
    voted = full.groupBy("frame", "bx", "by").agg((F.sum("occ") > threshold).alias("on"))
    return full.join(voted, ["frame", "bx", "by"]).select("frame", "x", "y", "on")


def mip(pixels: DataFrame) -> DataFrame:
    """Means of the occupied pixels of 2 by 2 places."""
    return pixels.where("occ = 1").groupBy("frame", *cells(pixels, 2)).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("c0", "c1", "c2")], F.count("*").alias("weight"))


def residual(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Difference to a reference at the same places, kept within 128 and moved up by 128."""
    both = a.select("frame", "x", "y", F.col(column).alias("v")).join(b.select("frame", "x", "y", F.col(column).alias("w")), ["frame", "x", "y"])
    return both.select("frame", "x", "y", (F.greatest(F.least(F.col("v") - F.col("w"), F.lit(127)), F.lit(-128)) + 128).alias("residual"))


def entropy(values: DataFrame, column: str) -> DataFrame:
    """Entropy of a column's values for each frame, in bits."""
    counts = values.groupBy("frame", column).count()
    total = counts.groupBy("frame").agg(F.sum("count").alias("total"))
    p = F.col("count") / F.col("total")
    return counts.join(total, "frame").groupBy("frame").agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


CHANNELS = ("c0", "c1", "c2")


def pulled(pixels: DataFrame) -> DataFrame:
    """The layer of half size: whole means (cut off) of the occupied pixels of 2 by 2 places, which are occupied themselves."""
    return pixels.where("occ = 1").groupBy("frame", *cells(pixels, 2)).agg(*[F.expr(f"CAST(sum({c}) div count(*) AS INT)").alias(c) for c in CHANNELS], F.lit(1).alias("occ"))


def filled(pixels: DataFrame, coarse: DataFrame, size: DataFrame) -> DataFrame:
    """All places of a frame's canvas (size: frame, w, h); an empty one is the mean of the four places of the full layer coarse that lie nearest,
    weighted 144, 48, 48 and 16, cut off. Places outside the layer have no weight."""
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = pixels.where("occ = 1").select("frame", "x", "y", *CHANNELS)
    empty = size.withColumn("x", span("w")).withColumn("y", span("h")).join(full.select("frame", "x", "y"), ["frame", "x", "y"], "left_anti")
    side = lambda c: F.floor(F.col(c) / 2) + F.when(F.col(c) % 2 == 0, -1).otherwise(1)
    own = lambda c: F.floor(F.col(c) / 2)
    four = [F.struct(a("x").cast("int").alias("cx"), b("y").cast("int").alias("cy"), F.lit(w).alias("weight")) for a, b, w in ((own, own, 144), (side, own, 48), (own, side, 48), (side, side, 16))]
    asked = empty.select("frame", "x", "y", F.inline(F.array(*four)))
    met = asked.join(coarse.select("frame", F.col("x").alias("cx"), F.col("y").alias("cy"), *CHANNELS), ["frame", "cx", "cy"])
    means = met.groupBy("frame", "x", "y").agg(*[F.expr(f"CAST(sum({c} * weight) div sum(weight) AS INT)").alias(c) for c in CHANNELS])
    return full.unionByName(means)


def push_pull(pixels: DataFrame) -> DataFrame:
    """Every place of a frame's canvas filled from the pyramid of its occupied pixels, without smoothing. Frames without one have no rows.

    The pyramid has as many layers as halvings of the widest canvas; the layers are written once each, since filling reads them again.
    """
    bounds = pixels.groupBy("frame").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.max("occ").alias("any")).where("any = 1").drop("any")
    widest = bounds.agg(F.max(F.greatest("w", "h"))).first()[0]
    if widest is None:
        return pixels.select("frame", "x", "y", *CHANNELS).limit(0)
    depth = (int(widest) - 1).bit_length()
    layers, sizes = [pixels], [bounds]
    for _ in range(depth):
        layers.append(cut(pulled(layers[-1])))
        sizes.append(sizes[-1].select("frame", *[F.floor((F.col(c) + 1) / 2).cast("int").alias(c) for c in "wh"]))
    out = layers[-1].select("frame", "x", "y", *CHANNELS)
    for layer, size in zip(layers[-2::-1], sizes[-2::-1]):
        out = cut(filled(layer, out, size))
    return out


def decoded_occupancy(video: DataFrame, size: DataFrame, precision: int, threshold: int | None = 0) -> DataFrame:
    """Occupancy of full size from a video (frame, x, y, value) of a precision-th of it: whether the value is above threshold, or the value
    itself where threshold is None. Places outside a frame's size (frame, w, h) are cut off."""
    value = F.col("value") if threshold is None else (F.col("value") > threshold).cast("int")
    return upsampled(video, precision).join(size, "frame").where("x < w AND y < h").select("frame", "x", "y", value.alias("occ"))
