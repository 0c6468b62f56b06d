"""Media columns: payloads kept as images in archives, and a Spark data source that reads them by byte ranges.

Texts become grey images of 8-bit samples, 64 to a row (PNG, written here with zlib: lossless, and equal texts give equal files),
and go as stored members into ZIP archives of bounded size in the shared folder. The source "archive_media" plans partitions over
byte ranges of the archives in a folder from their sizes alone; a task reads the directory at the end of its archive, takes the
members whose headers start in its range, and fetches each by offset. A member that can't be read, or whose checksum is wrong, is
fetched again on its own, from a newly opened file. Payloads leave as Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cirrus.llm.common import scratch, slices, utf8

WIDTH = 64
#: Bytes of an archive, of a partition of the source and of an Arrow batch, about.
ARCHIVE_BYTES, PARTITION_BYTES, BATCH_BYTES = 32 << 20, 16 << 20, 4 << 20
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(text: bytes, level: int = 6) -> bytes:
    """A grey PNG of the padded text; the length before padding is in its text field."""
    rows = np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # filter 0 before each row
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"tEXt", b"Bytes\0%d" % len(text)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[int, bytes]:
    """The length before padding, and the samples."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, parts, n_bytes, shape = 8, [], -1, (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", data)
        elif kind == b"tEXt":
            n_bytes = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    return n_bytes, samples[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, the mean step between neighbours, and their spread over 16 levels."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    levels = ",".join(map(str, counts.reshape(16, 16).sum(axis=1)))
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f};levels={levels}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Stores each document (doc_id, text) as a member named by its doc_id; returns the members and their bytes.

    folder is a URI that driver and executors share. An archive appears under its name when it is whole; a task that runs again
    replaces its archives by equal ones. Null texts are stored as empty; a member is named id= and its doc_id, or none; names may repeat.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        task, n, members, size = TaskContext.get(), 0, 0, 0
        system.create_dir(top, recursive=True)
        held = io.BytesIO()
        archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)

        def finish() -> None:
            nonlocal held, archive, n
            archive.close()
            name = f"part-{task.partitionId():06d}-{n:05d}.zip"
            with system.open_output_stream(f"{top}/.{name}.{task.taskAttemptId()}") as out:
                out.write(held.getbuffer())
            system.move(f"{top}/.{name}.{task.taskAttemptId()}", f"{top}/{name}")
            held, n = io.BytesIO(), n + 1
            archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)

        for batch in slices(batches, "text", BATCH_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                media = encode(text)
                name = zipfile.ZipInfo("none" if doc_id is None else f"id={doc_id}", (1980, 1, 1, 0, 0, 0))
                with archive.open(name, "w") as member:
                    member.write(media)
                members, size = members + 1, size + len(media)
                if held.tell() >= archive_bytes:
                    finish()
        if archive.infolist():
            finish()
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], pa.int64()), "bytes": pa.array([size], pa.int64())})

    row = docs.select("doc_id", "text").mapInArrow(store, "members long, bytes long").groupBy().sum("members", "bytes").first()
    return row[0] or 0, row[1] or 0


class ByteRange(InputPartition):
    def __init__(self, archive: str, size: int, first: int, last: int):
        self.archive, self.size, self.first, self.last = archive, size, first, last


class ArchiveMedia(DataSource):
    """spark.read.format("archive_media").load(folder); options: partition_bytes, attempts. Columns: archive, member, at, media."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "archive string, member string, at long, media binary"

    def reader(self, schema) -> ArchiveMediaReader:
        return ArchiveMediaReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)), int(self.options.get("attempts", 3)))


class ArchiveMediaReader(DataSourceReader):
    def __init__(self, folder: str, partition_bytes: int, attempts: int):
        self.folder, self.partition_bytes, self.attempts = folder, partition_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        system, top = opened(self.folder)
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        ranges = [ByteRange(f.path, f.size, a, a + self.partition_bytes) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".zip") and f.base_name[0] != "." for a in range(0, f.size, self.partition_bytes)]
        return ranges or [ByteRange("", 0, 0, 0)]

    def fetch(self, system: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset; each attempt opens the file anew, and none touches other members."""
        for left in range(self.attempts - 1, -1, -1):
            try:
                with system.open_input_file(path) as file:
                    file.seek(info.header_offset)
                    head = file.read(30)
                    name, extra = struct.unpack_from("<HH", head, 26)
                    file.seek(info.header_offset + 30 + name + extra)
                    media = file.read(info.file_size)
                if head[:4] != b"PK\3\4" or len(media) != info.file_size or zlib.crc32(media) != info.CRC:
                    raise OSError(f"{path}: the member at {info.header_offset} is damaged")
                return media
            except (OSError, struct.error):  # a short read may end inside the header
                if not left:
                    raise
        raise ValueError("attempts has to be positive")

    def directory(self, system: fs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        """The members of an archive, from its end; tried as often as a member is."""
        for left in range(self.attempts - 1, -1, -1):
            try:
                with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    return archive.infolist()
            except (OSError, struct.error, zipfile.BadZipFile):
                if not left:
                    raise
        raise ValueError("attempts has to be positive")

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "at", "media"]
        if not partition.size:
            return
        system, _ = opened(self.folder)
        members = [m for m in self.directory(system, partition.archive) if partition.first <= m.header_offset < partition.last]
        rows, size, short = [], 0, os.path.basename(partition.archive)
        for m in members:
            media = self.fetch(system, partition.archive, m)
            rows.append((short, m.filename, m.header_offset, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def read_archives(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").options(**options).load(folder)


def describe(media: DataFrame) -> DataFrame:
    """What is in each stored payload, from the bytes read back: one row for each member, with its doc_id as text (null where it was null).

    Equal payloads have equal values; an empty text is one row of zero bytes. No members, no rows; a damaged one fails the job.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, m in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist()):
                n_bytes, samples = decode(m)
                rows.append((member[3:] if member.startswith("id=") else None, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), features(samples)))
            kinds = [pa.string()] + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return media.mapInArrow(look, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores all documents in archives of the shared folder and describes what is read back; doc_id has the type it had.

    Rows that repeat, and rows without an id, are members like others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    write_archives(docs, folder)
    found = describe(read_archives(spark, folder))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
