"""Packing by powers of two: each document is split into pieces of binary lengths, and equal lengths go into one bucket.

A document of L tokens gives a piece of the longest length as often as that fits and then one piece for each bit of the rest, longest
first. Every piece is a sequence of its own, so none crosses documents and none is padded; a trainer takes batches of equal lengths from the
buckets. Where a piece ends follows from its document alone, so nothing is shuffled and no source or group of copies is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import slices, small_batches
from cirrus.llm.packing import tokenizer_path, tokens

#: A sequence's number: its bucket, the task that made it, and its place among the task's sequences of that bucket.
BUCKET_SHIFT, TASK_SHIFT = 56, 32


def binary_lengths(length: int, longest: int) -> list[int]:
    """The lengths of the pieces of so many tokens, longest first; longest is a power of two."""
    rest = length % longest
    return [longest] * (length // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def sequences(docs: DataFrame, tokenizer: str | None = None, longest: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece, that is for each sequence: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of the length), sequence_id, offset (0) and, if asked for, ids.

    A null or empty text has the end id alone: one sequence of one token. Rows that repeat, and rows whose doc_id is null, are documents like others; an
    empty table gives an empty result; other columns are left out. Numbers are the same when a task runs again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "sequence_id", "offset"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bucket int, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task = tokens(path), TaskContext.get().partitionId() << TASK_SHIFT
        made = [0] * longest.bit_length()
        for batch in slices(batches, "text", 6 << 20):
            rows, out = [], []
            for i, ids in enumerate(find.ids(batch.column("text"))):
                ids += end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    part, bucket = ids[4 * at : 4 * (at + length)], length.bit_length() - 1
                    rows.append((i, at, length, zlib.crc32(part), n, bucket, bucket << BUCKET_SHIFT | task | made[bucket]))
                    made[bucket] += 1
                    at += length
                    if with_ids:
                        out.append(np.frombuffer(part, "<i4"))
            row, *columns = map(np.array, zip(*rows))
            got = [pa.array(c, pa.int32() if name == "bucket" else pa.int64()) for name, c in zip(names[1:], columns)] + [pa.array(np.zeros(len(row), np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *got] + [pa.array(out, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)
        find.forget()

    return docs.select("doc_id", "text").mapInArrow(split, schema + ", ids array<int>" * with_ids)


def batched(found: DataFrame, batch_tokens: int) -> DataFrame:
    """sequences() with batch_id: batch_tokens tokens of equal lengths to a batch, whatever the length (a power of two, not below the longest).

    The last batch of a bucket in a task may be smaller; nothing is shuffled. Short sequences share batches by the thousand, so a batch is whole
    when a task has batch_tokens tokens of its bucket: let tasks be large, or coalesce the documents first.
    """
    per_batch = F.lit(batch_tokens.bit_length() - 1) - F.col("bucket")
    if batch_tokens & (batch_tokens - 1):
        raise ValueError("tokens to a batch must be a power of two")
    within = (1 << TASK_SHIFT) - 1
    number = F.call_function("shiftright", F.col("sequence_id").bitwiseAND(F.lit(within)), per_batch.cast("int"))
    return found.withColumn("batch_id", F.col("sequence_id") - F.col("sequence_id").bitwiseAND(F.lit(within)) + number)


def write_buckets(found: DataFrame, path: str) -> None:
    """sequences(with_ids=True) as Parquet with a folder for each bucket: a trainer reads the lengths that its curriculum asks for."""
    found.write.partitionBy("bucket").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """All documents in sequences of at most 2048 tokens. Nulls, empty and repeated rows as in sequences()."""
    return sequences(docs)
