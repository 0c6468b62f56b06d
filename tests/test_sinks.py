"""Files that are published by the job's commit: whole sequences, failed jobs, tasks that ran twice."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrus.sources import ply, rawvideo
from cirrus.sources.staged import Parts, Stage

POINT = "frame int, pid long, x int, y int, z int, r int, g int, b int"


def points(spark, frames=5):
    rng = random.Random(2)
    return [(f, i, *(rng.randrange(50) for _ in "xyz"), *(rng.randrange(256) for _ in "rgb")) for f in range(frames) for i in range(4)]


def test_sequence_of_frames(spark, tmp_path):
    """Two groups of frames, the second numbered on from the first."""
    rows = points(spark)
    df, pattern = spark.createDataFrame(rows, POINT), f"file://{tmp_path}/cloud_%04d.ply"
    after = ply.write(df, pattern, "ascii", 10)
    assert after == 15 and ply.write(df, pattern, "binary", after) == 20 and ply.write(df.where("false"), pattern, "binary", 20) == 20
    assert sorted(os.listdir(tmp_path)) == [f"cloud_{i:04d}.ply" for i in range(10, 20)]
    back = ply.read(spark, pattern, start=10).select(F.expr("(frame - 10) % 5 AS frame"), *"xyzrgb")
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[0], *r[2:]) for r in rows * 2)


def test_ascii_floats_come_back():
    values = {c: np.array([0.1, 1 / 3, 123456.789, -2.5e-7], np.float32) for c in "xyz"}
    lines = ply.text_of(values, True).decode().split("end_header\n")[1].splitlines()
    assert [np.float32(v) for v in lines[1].split()] == [np.float32(1 / 3)] * 3 and len(lines) == 4


@pytest.mark.parametrize("kind", ["ply", "rawvideo"])
def test_failed_job_leaves_nothing(spark, tmp_path, kind):
    """One frame fails after others have been written; nothing is published, and nothing stays behind."""
    target = f"{tmp_path}/out"
    os.makedirs(target)
    with pytest.raises(Exception, match="(?i)boom|isn't whole"):
        if kind == "ply":
            df = spark.createDataFrame(points(spark), POINT).withColumn("x", F.when(F.col("frame") == 3, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("x")))
            ply.write(df, f"file://{target}")
        else:
            lines = [(f, c, y, [1] * (4 if c == 0 else 2)) for f in range(5) for c, h in ((0, 4), (1, 2), (2, 2)) for y in range(h) if (f, c, y) != (3, 1, 1)]
            rawvideo.write(spark.createDataFrame(lines, "frame int, channel int, y int, row array<int>"), f"file://{target}", 1, width=4, height=4)
    assert os.listdir(target) == []


def test_tasks_that_run_twice(tmp_path):
    """Of two attempts, only the one whose message comes is published; two tasks with rows of one frame are an error."""
    writer = ply.PlyWriter(f"file://{tmp_path}/a", False, 0)
    batch = pa.RecordBatch.from_pydict({"frame": pa.array([1, 1, 2], pa.int32()), **{c: pa.array([1, 2, 3], pa.int32()) for c in "xyzrgb"}})
    writer.write(iter([batch]))
    again = writer.write(iter([batch]))
    writer.commit([again, None])
    assert sorted(os.listdir(f"{tmp_path}/a")) == ["cloud_00000001.ply", "cloud_00000002.ply"]
    other = ply.PlyWriter(f"file://{tmp_path}/b", False, 0)
    with pytest.raises(ValueError, match="several tasks"):
        other.commit([other.write(iter([batch])), other.write(iter([batch]))])
    assert os.listdir(f"{tmp_path}/b") == []
    stage = Stage(f"file://{tmp_path}/c")
    stage.put(Parts(), "x", b"1")
    stage.drop()
    stage.drop()
    assert os.listdir(f"{tmp_path}/c") == []


@pytest.mark.parametrize(("form", "nbyte", "per_file"), [("yuv420", 1, 4), ("yuv444", 2, 3), ("rgb444", 1, 1)])
def test_raw_video_round_trip(spark, tmp_path, form, nbyte, per_file):
    """A raw file read, written as a folder and read again; the folder's files end to end are the file."""
    rng = random.Random(per_file)
    size = nbyte * sum(w * h for w, h in rawvideo.planes(6, 4, form))
    data = bytes(rng.randrange(256) for _ in range(10 * size))
    (tmp_path / "v.raw").write_bytes(data)
    options = {"width": 6, "height": 4, "form": form, "nbyte": nbyte}
    video = rawvideo.read(spark, f"file://{tmp_path}/v.raw", frames_per_task=3, **options)
    rawvideo.write(video, f"file://{tmp_path}/out", per_file, **options)
    files = sorted(os.listdir(tmp_path / "out"))
    assert files == [f"frames_{f:08d}.raw" for f in range(0, 10, per_file)]
    assert b"".join((tmp_path / "out" / f).read_bytes() for f in files) == data
    again = rawvideo.read(spark, f"file://{tmp_path}/out", **options)
    assert sorted(map(str, again.collect())) == sorted(map(str, video.collect()))
