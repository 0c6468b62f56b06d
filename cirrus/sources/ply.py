"""PLY point-cloud files as a Spark data source, to read and to write; one file holds one frame.

spark.read.format("ply").load("folder/cloud_%04d.ply") with options start and end reads a sequence up to its first missing file, or
a folder as a whole. Header: ascii or binary, little or big endian; scalar properties of a vertex; other elements are skipped. Values are decoded by their
declared types. Writing puts each frame of a task's rows into a file of its own, so rows are first dealt by frame; files are published when the job commits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cirrus.sources.staged import Parts, Stage

#: The scalar types of PLY and their aliases.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: Property names and the columns they fill.
COLUMNS = {"x": "x", "y": "y", "z": "z", "red": "r", "green": "g", "blue": "b", "nx": "nx", "ny": "ny", "nz": "nz", "reflectance": "reflectance", "refc": "reflectance"}
SCHEMA = "frame int, pid long, x int, y int, z int, r int, g int, b int, nx double, ny double, nz double, reflectance int"
KINDS = {"frame": pa.int32(), "pid": pa.int64(), **{c: pa.int32() for c in ("x", "y", "z", "r", "g", "b")}, **{c: pa.float64() for c in ("nx", "ny", "nz")}, "reflectance": pa.int32()}


def parse(data: bytes) -> dict[str, np.ndarray]:
    """Columns of a file's vertices; positions are cut off towards zero."""
    head, _, body = data.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines() if x.strip() and not x.startswith("comment")]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form = next(x[1] for x in lines if x[0] == "format")
    at = next(i for i, x in enumerate(lines) if x[:2] == ["element", "vertex"])
    n, names, kinds = int(lines[at][2]), [], []
    for x in lines[at + 1 :]:
        if x[0] == "element":
            break
        if x[0] == "property" and len(x) == 3:
            names.append(x[2])
            kinds.append(TYPES[x[1]])
    if form == "ascii":
        table = np.array([r.split()[: len(names)] for r in body.decode("ascii").splitlines()[:n]], dtype=np.float64).reshape(n, len(names))
        values = {c: table[:, i] for i, c in enumerate(names)}
    else:
        order = ">" if "big" in form else "<"
        rows = np.frombuffer(body, np.dtype([(c, order + k) for c, k in zip(names, kinds)]), n)
        values = {c: rows[c] for c in names}
    return {COLUMNS[c]: np.trunc(v) if COLUMNS[c] in "xyz" else v for c, v in values.items() if c in COLUMNS}


def text_of(columns: dict[str, np.ndarray], ascii_form: bool) -> bytes:
    """A file of positions as floats and colours as bytes, if there are any."""
    n = len(columns["x"])
    with_colour = all(c in columns for c in "rgb")
    head = ["ply", f"format {'ascii' if ascii_form else 'binary_little_endian'} 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"]]
    if with_colour:
        head += [f"property uchar {c}" for c in ("red", "green", "blue")]
    out = ("\n".join([*head, "end_header"]) + "\n").encode()
    used = [*"xyz", *("rgb" if with_colour else "")]
    if ascii_form:
        # Nine significant digits bring any float back.
        return out + "".join(" ".join(f"{float(v):.9g}" for v in row) + "\n" for row in zip(*(columns[c] for c in used))).encode()
    rows = np.zeros(n, np.dtype([(c, "<f4" if c in "xyz" else "u1") for c in used]))
    for c in used:
        rows[c] = columns[c]
    return out + rows.tobytes()


class FrameFile(InputPartition):
    def __init__(self, path: str, frame: int):
        self.path, self.frame = path, frame


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], self.options.get("form", "binary") == "ascii", int(self.options.get("first", 0)))


class PlyReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.options = path, options

    def partitions(self) -> list[InputPartition]:
        if "%" in self.path:
            found = []
            for frame in range(int(self.options.get("start", 0)), int(self.options.get("end", 1 << 31))):
                system, path = fs.FileSystem.from_uri(self.path.replace("%", "%25") if "://" in self.path else self.path)
                path = path % frame
                if system.get_file_info(path).type == fs.FileType.NotFound:
                    break  # a missing file ends the sequence
                found.append(FrameFile(path, frame))
            return found or [FrameFile("", 0)]
        system, top = fs.FileSystem.from_uri(self.path)
        files = [f.path for f in system.get_file_info(fs.FileSelector(top)) if f.base_name.endswith(".ply") and f.base_name[0] != "."]
        return [FrameFile(p, int((re.findall(r"(\d+)\.ply$", p) or ["0"])[0])) for p in sorted(files)] or [FrameFile("", 0)]

    def read(self, partition: FrameFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path.split("%")[0])
        with system.open_input_file(partition.path) as file:
            columns = parse(file.read())
        n = len(columns["x"])
        columns |= {"frame": np.full(n, partition.frame), "pid": np.arange(n)}
        whole = pa.RecordBatch.from_arrays([pa.array(columns[c]).cast(k, safe=False) if c in columns else pa.nulls(n, k) for c, k in KINDS.items()], names=list(KINDS))
        for a in range(0, n, 100_000):
            yield whole.slice(a, 100_000)


class PlyWriter(DataSourceArrowWriter):
    """Rows of a frame come together (see write()). Files appear under their names when all tasks are through, or not at all."""

    def __init__(self, path: str, ascii_form: bool, first: int):
        folder, _, name = path.rpartition("/") if "%" in path else (path, "", "cloud_%08d.ply")
        self.stage, self.name, self.ascii_form, self.first = Stage(folder), name, ascii_form, first

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        parts, frame, held = Parts(), None, []

        def close() -> None:
            if held:
                table = pa.Table.from_batches(held)
                columns = {c: np.asarray(table.column(c)) for c in table.column_names if table.column(c).null_count == 0}
                self.stage.put(parts, self.name % (self.first + frame), text_of(columns, self.ascii_form))

        for batch in batches:
            frames = np.asarray(batch.column("frame"))
            cut = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)]
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    if frames[a] != frame:
                        close()
                        frame, held = int(frames[a]), []
                    held.append(batch.slice(a, b - a))
        close()
        return parts

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.publish(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.drop()


def write(points: DataFrame, path: str, form: str = "binary", first: int = 0) -> int:
    """One file for each frame (a frame is what one task holds), points in pid order; returns the number that follows the last frame's.

    path is a folder, or a pattern like folder/cloud_%04d.ply; a frame's file has the number first + frame. Of a job that fails, no file appears.
    """
    points.sparkSession.dataSource.register(PlySource)
    dealt = points.repartition("frame").sortWithinPartitions("frame", "pid").select("frame", "x", "y", "z", "r", "g", "b")
    dealt.write.format("ply").mode("append").option("path", path).option("form", form).option("first", first).save()
    last = points.agg({"frame": "max"}).first()[0]
    return first if last is None else first + last + 1


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").options(**options).load(path)
