"""Placing patches on a canvas of blocks. The order of placing defines the result, so a frame is one task; frames are dealt out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def first_fit(sizes: list[tuple[int, int]], width: int, height: int) -> tuple[list[tuple[int, int, bool]], int]:
    """Place (u0, v0) of each patch (blocks across and down) and whether its sides are switched, and the canvas height.

    Patches come in order; rows are scanned before columns; both ways round are tried at a place, the upright one first; if none fits the
    canvas doubles.
    """
    width = max([width, *(u + 1 for u, _ in sizes)])
    taken, out = np.zeros((height, width), bool), []
    for u, v in sizes:
        found = None
        while found is None:
            for v0 in range(taken.shape[0]):
                for u0 in range(width):
                    for across, down, switched in ((u, v, False), (v, u, True)):
                        spot = taken[v0 : v0 + down, u0 : u0 + across]
                        if spot.shape == (down, across) and not spot.any():
                            found = (u0, v0, switched)
                            spot[:] = True
                            break
                    if found:
                        break
                if found:
                    break
            else:
                taken = np.vstack([taken, np.zeros_like(taken)])
        out.append(found)
    return out, taken.shape[0]


def flexible(patches: DataFrame, width: int = 4, height: int = 4) -> DataFrame:
    """frame, patch, u0, v0, switched and canvas height; patches (frame, patch, size_u0, size_v0) by larger side, smaller side, index."""

    def place(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("size_u0", "size_v0", "patch"))), key=lambda r: (-max(r[:2]), -min(r[:2]), r[2]))
        spots, tall = first_fit([r[:2] for r in rows], width, height)
        u0, v0, switched = zip(*spots)
        n = len(rows)
        return pa.table({"frame": pa.array([key[0].as_py()] * n, pa.int32()), "patch": pa.array([r[2] for r in rows], pa.int32()), "u0": pa.array(u0, pa.int32()), "v0": pa.array(v0, pa.int32()), "switched": list(switched), "canvas_height": pa.array([tall] * n, pa.int32())})

    return patches.groupBy("frame").applyInArrow(place, "frame int, patch int, u0 int, v0 int, switched boolean, canvas_height int")


def matched(before: DataFrame, now: DataFrame, least: float = 0.2) -> DataFrame:
    """Greedy matching of a frame's patches with the ones of the frame before: frame, patch, and the patch it follows, or null.

    Patches of the earlier frame choose in order; each takes the free patch of its own view with the largest overlap over union, if that
    is large enough. before has its frame numbers raised by one.
    """
    import pandas as pd

    def match(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, int] = {}
        for o in old.sort_values("patch").itertuples():
            top, at = least, -1
            for n in new.sort_values("patch").itertuples():
                if n.view_id != o.view_id or n.patch in best:
                    continue
                w = max(0, min(o.u1 + o.size_u, n.u1 + n.size_u) - max(o.u1, n.u1))
                h = max(0, min(o.v1 + o.size_v, n.v1 + n.size_v) - max(o.v1, n.v1))
                iou = w * h / (o.size_u * o.size_v + n.size_u * n.size_v - w * h)
                if iou > top:
                    top, at = iou, n.patch
            if at >= 0:
                best[at] = o.patch
        rows = [(int(n.frame), int(n.patch), best.get(n.patch)) for n in new.itertuples()]
        return pd.DataFrame(rows, columns=["frame", "patch", "follows"]).astype({"follows": "Int32"})

    return before.groupBy("frame").cogroup(now.groupBy("frame")).applyInPandas(match, "frame int, patch int, follows int")
