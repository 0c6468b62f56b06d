"""Tracks of patches over frames: a patch of a group's first frame, followed from frame to frame until one has no patch like it.

The batch form folds each group of frames in one bounded task. The stream keeps, for each group, its open tracks and the rows of frames that may
still grow; a frame is taken up, in order, once the watermark has passed it, a track is told when it closes, and the state of a group goes with
its last frame. Rows of frames behind the watermark are dropped by the engine, and nothing else is.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of event time from one frame to the next, and the least overlap of a patch with the one before.
FRAME_SECONDS, LEAST_OVERLAP = 1, 0.2
PATCH = ["patch", "view_id", "u1", "v1", "size_u", "size_v"]
CLOSED = "gof int, track int, first_frame long, last_frame long, patches array<int>"


def overlap(a: list[int], b: list[int]) -> float:
    """Common area of two patches over their union."""
    width = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    height = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    return width * height / (a[4] * a[5] + b[4] * b[5] - width * height)


def extended(open_: list[dict[str, Any]], frame: int, patches: list[list[int]]) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """Open tracks, in order, each take the patch of the frame (by number) that overlaps most with their last one and has its view, if none before
    took it and the overlap is above the least; the others close. Returns open and closed tracks."""
    taken, still, closed = set(), [], []
    for track in open_:
        best, most = None, LEAST_OVERLAP
        for p in patches:
            if p[1] == track["last"][1] and p[0] not in taken and (o := overlap(track["last"], p)) > most:
                best, most = p, o
        if best is None:
            closed.append(track)
            continue
        taken.add(best[0])
        still.append(track | {"last": best, "end": frame, "patches": [*track["patches"], best[0]]})
    return still, closed


class Walk:
    """What is known of a group: open tracks, the last frame taken up, and rows that wait, by frame."""

    def __init__(self, text: str | None = None):
        self.at, self.open, waiting = json.loads(text) if text else (None, [], [])
        self.waiting: dict[int, list[list[int]]] = {f: rows for f, rows in waiting}

    def text(self) -> str:
        return json.dumps([self.at, self.open, sorted(self.waiting.items())])

    def add(self, rows: Iterable[tuple[int, list[int]]]) -> None:
        for frame, patch in rows:
            self.waiting.setdefault(frame, []).append(patch)

    def up_to(self, frame: int) -> list[dict[str, Any]]:
        """Takes up the waiting frames before the given one; returns the tracks that closed."""
        closed = []
        for f in sorted(f for f in self.waiting if f < frame):
            patches = sorted(self.waiting.pop(f))
            if self.at is None:
                self.open = [{"track": p[0], "start": f, "end": f, "last": p, "patches": [p[0]]} for p in patches]
            elif f != self.at + 1:  # a frame without patches lies between
                closed += self.open
                self.open = []
            else:
                self.open, ended = extended(self.open, f, patches)
                closed += ended
            self.at = f
        return closed


def _told(gof: int, closed: list[dict[str, Any]]) -> pd.DataFrame:
    rows = [(gof, t["track"], t["start"], t["end"], t["patches"]) for t in closed]
    return pd.DataFrame(rows, columns=["gof", "track", "first_frame", "last_frame", "patches"])


def _rows(pdf: pd.DataFrame) -> Iterator[tuple[int, list[int]]]:
    for row in pdf[["frame", *PATCH]].itertuples(index=False):
        frame, *patch = map(int, row)
        yield frame, patch


def tracks(patches: DataFrame, group: int = 32) -> DataFrame:
    """All tracks of patches (frame, patch, view_id, u1, v1, size_u, size_v): gof, track (its first patch), first_frame, last_frame, patches.

    Tracks begin in a group's first frame that has patches. A group holds so many frames at most; groups are dealt out.
    """

    def fold(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        walk = Walk()
        walk.add(_rows(pdf))
        return _told(int(key[0]), walk.up_to(1 << 62) + walk.open)

    rows = patches.select(F.floor(F.col("frame") / group).cast("int").alias("gof"), "frame", *PATCH)
    return rows.groupBy("gof").applyInPandas(fold, CLOSED)


def timed(patches: DataFrame) -> DataFrame:
    """Patches with the time at which their frame ends."""
    return patches.withColumn("time", F.timestamp_seconds((F.col("frame") + 1) * FRAME_SECONDS))


def streamed_tracks(patches: DataFrame, group: int = 32, late_frames: int = 8) -> DataFrame:
    """tracks() over a stream of patches, whose frames may arrive out of order by late_frames; rows are told once, as their track closes.

    For use with the output mode 'update' or 'append'.
    """
    period = FRAME_SECONDS * 1000

    def follow(key: tuple[int], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gof = int(key[0])
        last = (gof + 1) * group - 1
        walk = Walk(state.get[0] if state.exists else None)
        for pdf in pdfs:
            walk.add(_rows(pdf))
        passed = state.getCurrentWatermarkMs()
        safe = passed // period  # frames before this one can't grow any more: rows at the watermark are dropped
        closed = walk.up_to(safe)
        if safe > last:
            closed += walk.open
            state.remove()
        else:
            state.update((walk.text(),))
            state.setTimeoutTimestamp(max((min([last, *walk.waiting]) + 1) * period - 1, passed + 1))
        if closed:
            yield _told(gof, closed)

    rows = timed(patches).withWatermark("time", f"{late_frames * FRAME_SECONDS} seconds").select(F.floor(F.col("frame") / group).cast("int").alias("gof"), "frame", *PATCH, "time")
    return rows.groupBy("gof").applyInPandasWithState(follow, CLOSED, "walk string", "append", GroupStateTimeout.EventTimeTimeout)
