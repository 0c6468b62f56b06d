"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cirrus-")
    return _own[app]


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cirrus/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and lost executors cost nothing before it."""
    path = scratch(df.sparkSession, label)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of DataFrames that are gone. It does so when the driver's JVM collects garbage, which without need comes late."""
    gc.collect()
    spark._jvm.System.gc()


def distilled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """durable(make(), label); the tables that make() wrote on the way are deleted after that, and the shuffle files."""
    _open.append([])
    try:
        out = make()
    finally:
        spent = _open.pop()
    kept, spark = durable(out, label), out.sparkSession
    del out
    for path in spent:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    swept(spark)
    return kept


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB at most for the session, if it sets no size: an executor has them in the JVM and in Python, coming and going, for each core."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def with_rid(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns and rid, a number for each row. It tells rows apart where doc_id is null or repeated.

    rid is a function of the row's place in the files, so docs has to be read from files (write a computed table first). A
    task that runs again gives the same numbers. Spark cuts files by the cores it has when it plans, unless told how many parts there are to
    be; since executors come and go between the steps of an operator, that number is fixed here for the session, if it isn't set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.select(*columns, F.monotonically_increasing_id().alias("rid"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each row as one column, doc, so that no other column's name can clash with its own; and rid."""
    return with_rid(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Each text as UTF-8 bytes; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of a struct column as "doc.text": a row that travels whole needn't carry its text twice."""
    top, *fields = name.split(".")
    found = batch.column(top)
    for f in fields:
        found = pc.struct_field(found, f)
    return found


def hand_back() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], name: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most so many bytes together (or one longer text); name: of the texts, or of a column of their sizes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts = column(batch, name)
        lengths = np.asarray(pc.fill_null(texts if pa.types.is_integer(texts.type) else pc.binary_length(texts), 0)).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    hand_back()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (shift, xor and multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


#: Bits that a sieve has for each key, that a key sets, and that a piece of it has (all of one key's bits are in one piece); its largest size.
SIEVE_BITS, SIEVE_PROBES, SIEVE_PIECE, SIEVE_MOST_BITS = 16, 3, 1 << 16, 1 << 29


def sieve_places(keys: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece of each key, and the bits of it that the key sets."""
    h = mix64(keys.view(np.uint64))
    piece = (h & np.uint64(n_pieces - 1)).astype(np.int64)
    h = mix64(h)
    return piece, np.stack([(h >> np.uint64(16 * k)) & np.uint64(SIEVE_PIECE - 1) for k in range(SIEVE_PROBES)], 1).astype(np.int64)


def sieve(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter (one row for each piece) of the only column of keys, numbers of 64 bits; 64 MB at most, which is fit to be broadcast.

    It spares shuffling rows that a join is going to drop, and decides nothing itself. None if the keys are too many for it: then the join has all the work.
    """
    n = keys.count()
    if 4 * n > SIEVE_MOST_BITS:
        return None
    n_pieces = min(SIEVE_MOST_BITS, 1 << max(1, SIEVE_BITS * n).bit_length()) // SIEVE_PIECE or 1
    name = keys.columns[0]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, _ = sieve_places(np.asarray(batch.column(0)), n_pieces)
            yield pa.RecordBatch.from_arrays([pa.array(piece), batch.column(0)], names=["piece", name])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = -1, np.zeros(SIEVE_PIECE, bool)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])
        for batch in batches:
            if not batch.num_rows:
                continue
            piece, places = sieve_places(np.asarray(batch.column(name)), n_pieces)
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for a, b in zip(cuts, cuts[1:]):
                if piece[a] != at:
                    if at >= 0:
                        yield out()
                    at, bits = int(piece[a]), np.zeros(SIEVE_PIECE, bool)
                bits[places[a:b].ravel()] = True
        if at >= 0:
            yield out()

    pieces = keys.mapInArrow(number, f"piece long, {name} long").repartition("piece").sortWithinPartitions("piece").mapInArrow(build, "piece long, bits binary")
    found = np.zeros((n_pieces, SIEVE_PIECE // 8), np.uint8)
    for row in pieces.toLocalIterator():
        found[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return found


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a sieve lets each key through: all that it was built from, and one in some hundred of the others."""
    piece, places = sieve_places(keys, len(bits))
    return ((bits[piece[:, None], places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def sifted(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key a sieve of keys lets through."""
    bits = sieve(keys)
    if bits is None:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(sent.value, np.asarray(batch.column(key)))))

    return rows.mapInArrow(run, rows.schema)


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among keys (a column of that name, not null). Only rows that a sieve of keys lets through are shuffled."""
    bits = sieve(keys)
    if bits is None:
        return rows.join(keys, key, "left_anti")
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(passes(sent.value, np.asarray(batch.column(key))) == wanted))

        return rows.mapInArrow(run, rows.schema)

    return part(False).unionByName(part(True).join(keys, key, "left_anti"))
