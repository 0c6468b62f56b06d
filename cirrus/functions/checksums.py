"""Checksums of byte strings and of frames."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _crc_table() -> list[int]:
    """CCITT, polynomial 0x1021, for each first byte."""
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


def crc16(column: Column) -> Column:
    """CRC-16-CCITT of binary from 0xFFFF, with two zero bytes after it; null stays null.

    Shifting zero bytes in at the end is the same as beginning with 0x1D0F and looking bytes up in a table.
    """

    @F.pandas_udf("int")
    def run(data: pd.Series) -> pd.Series:
        table, has = np.array(_crc_table(), np.uint16), data.notna().to_numpy()
        texts = [b for b in data if b is not None]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-length, kind="stable")  # at each place, the texts that still go on come first
        raw, start = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(length) - length)[order]
        crc, on = np.full(len(texts), 0x1D0F, np.uint16), np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        for k, n in enumerate(on.tolist()):
            crc[:n] = crc[:n] << np.uint16(8) ^ table[crc[:n] >> np.uint16(8) ^ raw[start[:n] + k]]
        found = np.zeros(len(texts), np.int64)
        found[order] = crc
        out = pd.Series(pd.array([None] * len(data), "Int32"), index=data.index)
        out[has] = found
        return out

    return run(column.cast("binary"))


def frame_md5(points: DataFrame, canonical: bool = False) -> DataFrame:
    """MD5 of each frame: all positions as 16-bit numbers, then all colours as bytes; in pid order, or in the order of place and colour."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = ["x", "y", "z", "r", "g", "b"] if canonical else ["pid"]
        table = table.sort_by([(c, "ascending") for c in order])
        column = lambda c, k: np.asarray(table.column(c)).astype(k)
        data = np.stack([column(c, "<i2") for c in "xyz"], 1).tobytes() + np.stack([column(c, "u1") for c in "rgb"], 1).tobytes()
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "md5": [hashlib.md5(data).hexdigest()]})

    return points.select("frame", "pid", *"xyzrgb").groupBy("frame").applyInArrow(run, "frame int, md5 string")
