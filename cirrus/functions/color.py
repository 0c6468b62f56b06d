"""Colour expressions over columns (BT.709). Whole numbers are 0 to 255 unless a bit depth is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Rounded half away from zero."""
    whole = lambda x: F.round(x).cast("int")
    return whole(luma(r, g, b)), whole(-0.114572 * r - 0.385428 * g + 0.5 * b + 128.0), whole(0.5 * r - 0.454153 * g - 0.045847 * b + 128.0)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    u, v = u - 128.0, v - 128.0
    whole = lambda x: clip(F.round(x), 0.0, 255.0).cast("int")
    return whole(y + 1.5748 * v), whole(y - 0.18733 * u - 0.46813 * v), whole(y + 1.85563 * u)


def rgb_to_yuv_unit(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Between 0 and 1, as the distortion metrics use it."""
    return luma(r, g, b) / 255.0, (-0.1146 * r - 0.3854 * g + 0.5 * b) / 255.0 + 0.5, (0.5 * r - 0.4542 * g - 0.0458 * b) / 255.0 + 0.5


def unit_to_whole(x: Column, bits: int, chroma: bool) -> Column:
    """A unit YUV value as a whole number of 8, 10 or 16 bits; chroma lies around the middle."""
    scale = {8: 255.0, 10: 1023.0, 16: 65535.0}[bits]
    offset = {8: 128.0, 10: 512.0, 16: 32768.0}[bits] if chroma else 0.0
    return clip(F.round(scale * x + offset), 0.0, scale).cast("int")


def whole_to_unit(x: Column, bits: int, chroma: bool) -> Column:
    """The way back. Sixteen bits are read on the scale of ten, unlike how they are written; that asymmetry is part of the format."""
    scale = {8: 255.0, 10: 1023.0, 16: 1023.0}[bits]
    offset = {8: 128.0, 10: 512.0, 16: 512.0}[bits] if chroma else 0.0
    return (x - offset) / scale


def similar(a: list[Column], b: list[Column], threshold: int) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & (F.abs(x - y) < threshold)
    return out


def squared(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0))


def change_depth(x: Column, bits: int, to: int, align_top: bool) -> Column:
    """Shifts towards the top bits, or clips where the target has fewer."""
    if align_top:
        return F.shiftleft(x, to - bits) if to > bits else F.shiftright(x, bits - to)
    return F.least(x, F.lit((1 << to) - 1)) if to < bits else x
