"""Chroma planes halved and doubled by FIR filters: lines of a plane as arrays, one pass along them, one transposition, one pass across.

A line is as long as a frame is wide or high, so the arrays are bounded; frames and lines are dealt out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.functions import color


class Down(NamedTuple):
    """Taps along and across, and the power of two that they add up to."""

    horizontal: tuple[float, ...]
    vertical: tuple[float, ...]
    shift: int


class Up(NamedTuple):
    """Taps along and across for even places, then for odd ones; they add up to 256."""

    horizontal0: tuple[float, ...]
    vertical0: tuple[float, ...]
    horizontal1: tuple[float, ...]
    vertical1: tuple[float, ...]


#: Taps of the filters by name.
DOWN = {
    "F0": Down((64, 384, 64), (256, 256), 9),
    "F1": Down((128, 256, 128), (256, 256), 9),
    "TM5": Down((21, 0, -52, 0, 159, 256, 159, 0, -52, 0, 21), (5, 11, -21, -37, 70, 228, 228, 70, -37, -21, 11, 5), 9),
    "FV": Down((8, 0, -64, 128, 368, 128, -64, 0, 8), (8, 0, -24, 48, 224, 224, 48, -24, 0, 8), 9),
    "WCS": Down((2, -3, -9, 6, 39, 58, 39, 6, -9, -3, 2), (1, 0, -7, -5, 22, 53, 53, 22, -5, -7, 0, 1), 7),
}
#: Taps of the filters by name.
UP = {
    "F0": Up((0, 256), (-8, 64, 216, -16), (-16, 144, 144, -16), (-16, 216, 64, -8)),
    "FV": Up((0, 256), (0, -16, 56, 240, -32, 8), (-16, 144, 144, -16), (8, -32, 240, 56, -16, 0)),
    "GS": Up((0, 256), (-6, 58, 222, -18), (-16, 144, 144, -16), (-18, 222, 58, -6)),
    "LS3": Up((0, 256), (2, -18, 70, 228, -34, 8), (6, -34, 156, 156, -34, 6), (8, -34, 228, 70, -18, 2)),
    "LS4": Up((0, 256), (-1, 8, -23, 72, 229, -39, 14, -4), (-3, 15, -43, 159, 159, -43, 15, -3), (-4, 14, -39, 229, 72, -23, 8, -1)),
    "TM": Up((0, 256), (3, -16, 67, 227, -32, 7), (21, -52, 159, 159, -52, 21), (7, -32, 227, 67, -16, 3)),
}


def lines(pixels: DataFrame, channels: list[str], at: str, fill: float = 0.0) -> DataFrame:
    """Pixels (frame, x, y, channels) as dense lines: frame, at (y for rows, x for columns) and an array for each channel. Missing pixels have fill.

    A frame is as wide and high as its last pixels make it, rounded up to even.
    """
    along = "y" if at == "x" else "x"
    even = lambda c: (F.floor(F.max(c) / 2) * 2 + 2).cast("int")
    sizes = pixels.groupBy("frame").agg(even(at).alias("many"), even(along).alias("length"))
    empty = sizes.select("frame", "length", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias(at))
    held = pixels.groupBy("frame", at).agg(F.map_from_entries(F.collect_list(F.struct(F.col(along).cast("int"), F.struct(*channels)))).alias("held"))
    whole = empty.join(held, ["frame", at], "left")
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.coalesce(F.element_at("held", i)[c].cast("double"), F.lit(fill)))
    return whole.select("frame", at, *[dense(c).alias(c) for c in channels])


def _filtered(line: Column, taps: tuple[float, ...], shift: int, at: Column, back: int) -> Column:
    """The weighted sum of the places from at - back on; places beyond an end are that end."""
    last = F.size(line) - 1
    parts = [F.element_at(line, (F.least(F.greatest(at + (t - back), F.lit(0)), last) + 1).cast("int")) * float(w) for t, w in enumerate(taps) if w]
    return sum(parts[1:], parts[0]) / float(1 << shift)


def _turned(df: DataFrame, at: str, to: str, channels: list[str]) -> DataFrame:
    """Rows as columns or columns as rows."""
    cells = df.select("frame", at, F.posexplode(F.arrays_zip(*channels)).alias(to, "cell"))
    sorted_ = F.array_sort(F.collect_list(F.struct(at, "cell")))
    return cells.groupBy("frame", to).agg(sorted_.alias("s")).select("frame", to, *[F.col(f"s.cell.{c}").alias(c) for c in channels])


def _pixels(df: DataFrame, at: str, along: str, channels: list[str]) -> DataFrame:
    return df.select("frame", at, F.posexplode(F.arrays_zip(*channels)).alias(along, "cell")).select("frame", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(f"cell.{c}").alias(c) for c in channels])


def halved(pixels: DataFrame, channels: list[str], taps: Down = DOWN["F0"]) -> DataFrame:
    """Planes of half the width and height: frame, x, y and the channels as doubles."""
    half = lambda c, w: F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda j: _filtered(F.col(c), w, taps.shift, 2 * j, (len(w) - 1) >> 1)).alias(c)
    rows = lines(pixels, channels, "y").select("frame", "y", *[half(c, taps.horizontal) for c in channels])
    return _pixels(_turned(rows, "y", "x", channels).select("frame", "x", *[half(c, taps.vertical) for c in channels]), "x", "y", channels)


def doubled(pixels: DataFrame, channels: list[str], taps: Up = UP["F0"]) -> DataFrame:
    """Planes of twice the width and height: frame, x, y and the channels as doubles."""

    def twice(c: str, even: tuple[float, ...], odd: tuple[float, ...]) -> Column:
        one = lambda w, at: _filtered(F.col(c), w, 8, at, (len(w) + 1) >> 1)
        each = lambda m: F.when(m % 2 == 0, one(even, F.shiftright(m, 1))).otherwise(one(odd, F.shiftright(m, 1) + 1))
        return F.transform(F.sequence(F.lit(0), F.size(c) * 2 - 1), each).alias(c)

    columns = lines(pixels, channels, "x").select("frame", "x", *[twice(c, taps.vertical0, taps.vertical1) for c in channels])
    return _pixels(_turned(columns, "x", "y", channels).select("frame", "y", *[twice(c, taps.horizontal0, taps.horizontal1) for c in channels]), "y", "x", channels)


def _clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rgb_to_yuv420(pixels: DataFrame, taps: Down = DOWN["F0"]) -> tuple[DataFrame, DataFrame]:
    """Luma (frame, x, y, luma) and halved chroma (frame, x, y, u, v) with 8 bits of pixels with r, g, b. Missing pixels are black."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    y = _clamped(0.2126 * r + 0.7152 * g + 0.0722 * b, 0.0, 1.0)
    u = _clamped(-0.114572 * r - 0.385428 * g + 0.5 * b, -0.5, 0.5)
    v = _clamped(0.5 * r - 0.454153 * g - 0.045847 * b, -0.5, 0.5)
    small = halved(pixels.select("frame", "x", "y", u.alias("u"), v.alias("v")), ["u", "v"], taps)
    whole = lambda c, chroma: color.unit_to_whole(F.round(c, 9), 8, chroma)
    return pixels.select("frame", "x", "y", whole(y, False).alias("luma")), small.select("frame", "x", "y", whole(F.col("u"), True).alias("u"), whole(F.col("v"), True).alias("v"))


def _chroma_units(chroma: DataFrame, taps: Up) -> DataFrame:
    unit = lambda c: _clamped((F.col(c) - 128) / 255.0, -0.5, 0.5).alias(c)
    return doubled(chroma.select("frame", "x", "y", unit("u"), unit("v")), ["u", "v"], taps)


def yuv420_to_yuv444(luma: DataFrame, chroma: DataFrame, taps: Up = UP["F0"]) -> DataFrame:
    """frame, x, y, luma, u, v with 16 bits."""
    both = luma.join(_chroma_units(chroma, taps), ["frame", "x", "y"])
    whole = lambda c, middle: color.unit_to_whole(F.round(c, 9), 16, middle)
    return both.select("frame", "x", "y", whole(F.col("luma") / 255.0, False).alias("luma"), whole(F.col("u"), True).alias("u"), whole(F.col("v"), True).alias("v"))


def yuv420_to_rgb(luma: DataFrame, chroma: DataFrame, taps: Up = UP["F0"]) -> DataFrame:
    """frame, x, y, r, g, b with 8 bits."""
    both = luma.join(_chroma_units(chroma, taps), ["frame", "x", "y"]).withColumn("l", F.col("luma") / 255.0)
    unit = {"r": F.col("l") + 1.5748 * F.col("v"), "g": F.col("l") - 0.18733 * F.col("u") - 0.46813 * F.col("v"), "b": F.col("l") + 1.85563 * F.col("u")}
    return both.select("frame", "x", "y", *[F.floor(F.round(255.0 * _clamped(c, 0.0, 1.0), 6) + 0.5).cast("int").alias(n) for n, c in unit.items()])
