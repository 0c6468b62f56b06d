"""Raw planar video as a Spark data source: partitions are ranges of whole frames, found from the file's size alone.

Options: width, height, format (yuv420, yuv444, rgb444) and nbyte (1 or 2, little endian). Columns: frame, channel, y, row (the samples
of one line), so a line is what a task holds at once, not a frame. A folder of files is read as one video, in order of names.

Written, a video is a folder of files of whole frames, each named by its first frame, which put end to end are the raw file; with frames_per_file
1, each image is a file of its own. Files appear when the job commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cirrus.sources.staged import Parts, Stage


def planes(width: int, height: int, form: str) -> list[tuple[int, int]]:
    half = (-(-width // 2), -(-height // 2))
    return [(width, height), half, half] if form == "yuv420" else [(width, height)] * 3


class Frames(InputPartition):
    """Frames first to last - 1 of a file whose first frame has the number at."""

    def __init__(self, path: str, at: int, first: int, last: int):
        self.path, self.at, self.first, self.last = path, at, first, last


class RawVideo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return "frame int, channel int, y int, row array<int>"

    def reader(self, schema) -> RawVideoReader:
        return RawVideoReader(self.options["path"], int(self.options["width"]), int(self.options["height"]), self.options.get("form", "yuv420"), int(self.options.get("nbyte", 1)), int(self.options.get("frames_per_task", 8)))

    def writer(self, schema, overwrite: bool) -> RawVideoWriter:
        return RawVideoWriter(self.options["path"], int(self.options["width"]), int(self.options["height"]), self.options.get("form", "yuv420"), int(self.options.get("nbyte", 1)), int(self.options.get("frames_per_file", 8)))


class RawVideoReader(DataSourceReader):
    def __init__(self, path: str, width: int, height: int, form: str, nbyte: int, per_task: int):
        self.path, self.sizes, self.nbyte, self.per_task = path, planes(width, height, form), nbyte, per_task
        self.frame_bytes = nbyte * sum(w * h for w, h in self.sizes)

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.path)
        info, found, at = system.get_file_info(path), [], 0
        inside = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
        for file in sorted((f for f in inside if f.is_file and f.base_name[0] != "."), key=lambda f: f.path):
            n = file.size // self.frame_bytes  # a part of a frame at the end is left out
            found += [Frames(file.path, at, a, min(n, a + self.per_task)) for a in range(0, n, self.per_task)]
            at += n
        return found or [Frames("", 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as file:
            file.seek(partition.first * self.frame_bytes)
            for frame in range(partition.first, partition.last):
                for channel, (w, h) in enumerate(self.sizes):
                    samples = np.frombuffer(file.read(self.nbyte * w * h), f"<u{self.nbyte}").astype(np.int32)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w * h + 1, w), pa.int32()), pa.array(samples))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(h, v), pa.int32()) for v in (partition.at + frame, channel)] + [pa.array(np.arange(h), pa.int32()), rows], names=["frame", "channel", "y", "row"])


class RawVideoWriter(DataSourceArrowWriter):
    """Lines come in order of frame, channel and y, all of a frame in one task (see write()). A frame that isn't whole fails the job."""

    def __init__(self, path: str, width: int, height: int, form: str, nbyte: int, per_file: int):
        self.stage, self.sizes, self.nbyte, self.per_file = Stage(path), planes(width, height, form), nbyte, per_file
        self.frame_bytes = nbyte * sum(w * h for w, h in self.sizes)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        parts, held, first, top = Parts(), [], None, (1 << 8 * self.nbyte) - 1
        wanted = [(c, y, w) for c, (w, h) in enumerate(self.sizes) for y in range(h)]
        place, frame = 0, None

        def close() -> None:
            if held:
                self.stage.put(parts, f"frames_{first:08d}.raw", b"".join(held))

        for batch in batches:
            lines = zip(batch.column("frame").to_pylist(), batch.column("channel").to_pylist(), batch.column("y").to_pylist(), batch.column("row"))
            for f, channel, y, row in lines:
                samples = row.values.to_numpy()
                if place == 0:
                    if first is None or f // self.per_file != first // self.per_file:
                        close()
                        held, first = [], f
                    frame = f
                if f != frame or (channel, y, len(samples)) != wanted[place]:
                    raise ValueError(f"frame {frame} isn't whole, or its lines aren't in order")
                held.append(np.clip(samples, 0, top).astype(f"<u{self.nbyte}").tobytes())
                place = (place + 1) % len(wanted)
        if place:
            raise ValueError(f"frame {frame} isn't whole")
        close()
        return parts

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.publish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.drop()


def write(video: DataFrame, path: str, frames_per_file: int = 8, **options: object) -> None:
    """Lines (frame, channel, y, row) as raw files; options as for reading. Samples beyond what nbyte bytes hold are clipped."""
    video.sparkSession.dataSource.register(RawVideo)
    dealt = video.select("frame", "channel", "y", "row").repartition(F.floor(F.col("frame") / frames_per_file)).sortWithinPartitions("frame", "channel", "y")
    dealt.write.format("rawvideo").mode("append").options(path=path, frames_per_file=frames_per_file, **options).save()


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(RawVideo)
    return spark.read.format("rawvideo").options(**options).load(path)


def pixels(video: DataFrame) -> DataFrame:
    """One row for each sample: frame, channel, x, y, value."""
    return video.select("frame", "channel", "y", F.posexplode("row").alias("x", "value"))


def frame_bytes(video: DataFrame, nbyte: int = 1) -> DataFrame:
    """Each frame's planes in order as binary (a frame is a few megabytes), the form in which a raw file holds them."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("channel", "ascending"), ("y", "ascending")])
        data = np.asarray(table.column("row").combine_chunks().flatten()).astype(f"<u{nbyte}").tobytes()
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    return video.groupBy("frame").applyInArrow(pack, "frame int, data binary")
