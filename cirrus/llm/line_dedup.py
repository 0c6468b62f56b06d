"""Dropping lines that other documents have too, by two Bloom filters and an exact confirmation of the suspects.

The tasks set a bit pattern for each line key of each document in a once-seen filter, and in a twice-seen filter if the pattern was
there before. Filters merge piece by piece (once: or; twice: or, and what both once-filters have), in a tree. With the twice-seen
filter at hand, a second pass sends on only the keys that it holds, as 128-bit hashes; these are grouped exactly. A filter has a
fixed largest size: where lines outgrow it, more of them are suspects, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import column, durable, slices, utf8, whole_rows, with_rid

#: Code points that a key needs to count.
LEAST = 10
#: Bits of a filter: so many for each document, between these bounds (128 MB at most, which is what is broadcast).
BITS_PER_DOCUMENT, LEAST_BITS, MOST_BITS = 512, 1 << 20, 1 << 30
#: Bits that a line sets, and bits of a piece in which filters are merged.
PROBES, PIECE_BITS = 4, 1 << 20
#: Filters that one task of the merging tree takes together.
FAN_IN = 64
#: A null doc_id counts as one that is larger than all others.
NO_ID = (1 << 63) - 1


def key_of(line: bytes) -> bytes:
    """White space of ASCII off both ends, A-Z in lower case; bytes.strip and bytes.lower mean exactly these."""
    return line.strip().lower()


def hashes(text: bytes) -> list[bytes | None]:
    """For each line the 128-bit hash of its key; None where the key is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = key_of(line)
        short = len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def distinct(text: bytes) -> set[bytes]:
    found = set(hashes(text))
    found.discard(None)
    return found


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: one row of h holds its two halves."""
    step = h[:, 1] | np.uint64(1)
    return (h[:, :1] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def put(once: np.ndarray, twice: np.ndarray, h: np.ndarray) -> None:
    """Adds keys of different documents (a key once a document) to filters that are arrays of bytes."""
    if not len(h):
        return
    bits = 8 * len(once)
    _, first, count = np.unique(h.view("V16").ravel(), return_index=True, return_counts=True)
    at = probes(h[first], bits)
    byte, mask = (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
    again = (count > 1) | ((once[byte] & mask) == mask).all(axis=1)
    np.bitwise_or.at(twice, byte[again].ravel(), mask[again].ravel())
    np.bitwise_or.at(once, byte.ravel(), mask.ravel())


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = probes(h, 8 * len(bitmap))
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def packed(piece: np.ndarray) -> bytes:
    """A piece of a filter as it travels: a task sets few bits of a filter that is as large as the table asks for, so nearly all of it is zeros."""
    return pa.compress(piece.tobytes(), codec="lz4", asbytes=True)


def unpacked(piece: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(piece, decompressed_size=size, codec="lz4", asbytes=True), np.uint8)


def twice_seen(docs: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter of all line keys, as bytes."""
    spark, size = docs.sparkSession, min(bits, PIECE_BITS) // 8
    schema = "piece int, part int, once binary, twice binary"

    def rows(part: int, found: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        for piece, once, twice in found:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=["piece", "part", "once", "twice"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in slices(batches, "text", 4 << 20):
            keys = [b"".join(distinct(t)) for t in utf8(batch.column("text"))]
            put(once, twice, np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2))
        pieces = once.reshape(-1, size), twice.reshape(-1, size)
        some = np.flatnonzero(pieces[0].any(axis=1)).tolist()
        yield from rows(TaskContext.get().partitionId(), ((k, packed(pieces[0][k]), packed(pieces[1][k])) for k in some))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece and part; a task holds one piece at a time."""
        at, once, twice = None, None, None
        for batch in batches:
            for piece, part, o, t in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = unpacked(o, size), unpacked(t, size)
                if (piece, part) == at:
                    twice = twice | t | (once & o)
                    once = once | o
                    continue
                if at:
                    yield from rows(at[1], [(at[0], packed(once), packed(twice))])
                at, once, twice = (piece, part), o, t
        if at:
            yield from rows(at[1], [(at[0], packed(once), packed(twice))])

    found = docs.select("text").mapInArrow(build, schema)
    width = max(1, docs.rdd.getNumPartitions())
    while True:
        width = -(-width // FAN_IN)
        grouped = found.withColumn("part", (F.col("part") / FAN_IN).cast("int"))
        n = max(1, min(width * (bits // 8 // size), 8 * spark.sparkContext.defaultParallelism))
        found = grouped.repartition(n, "piece", "part").sortWithinPartitions("piece", "part").mapInArrow(merge, schema)
        if width <= 1:
            break
    bitmap = np.zeros((bits // 8 // size, size), np.uint8)
    for row in found.select("piece", "twice").toLocalIterator():
        bitmap[row["piece"]] = unpacked(row["twice"], size)
    return bitmap.ravel()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs (any columns, with doc_id and text; read from files) as column doc, with text, n_lines and n_dropped.

    A key that at least two doc_ids have loses all its lines but those of the smallest doc_id. Rows with one doc_id count as one
    document, and so do all rows whose doc_id is null (they rank last). A null or empty text is one empty line; a null text stays null
    in doc and is empty in text. Keys of fewer than ten code points stay.
    """
    spark, identified = docs.sparkSession, with_rid(docs, "doc_id", "text")  # first, since it fixes how files are split
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (docs.count() * BITS_PER_DOCUMENT).bit_length()))
    sent = spark.sparkContext.broadcast(twice_seen(docs, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            keys = [b"".join(distinct(t)) for t in utf8(batch.column("text"))]
            h = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            row = np.repeat(np.arange(len(keys)), [len(k) // 16 for k in keys])
            some = np.flatnonzero(holds(sent.value, h)) if len(h) else np.zeros(0, np.int64)
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([pa.array(h[some, 0].view(np.int64)), pa.array(h[some, 1].view(np.int64)), batch.column("id").take(at), batch.column("rid").take(at)], names=["a", "b", "id", "rid"])

    keyed = identified.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "rid")
    suspected = durable(keyed.mapInArrow(suspects, "a long, b long, id long, rid long"), "suspects")
    first = suspected.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    repeated = durable(first, "repeated-lines")
    gone = suspected.join(repeated, ["a", "b"]).where("id > first").groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    joined = whole_rows(docs).join(gone, "rid", "left").select("doc", F.lit(None).cast("string").alias("text"), F.lit(0).alias("n_lines"), F.lit(0).alias("n_dropped"), "gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "doc.text", 4 << 20):
            texts, n_lines, n_dropped = utf8(column(batch, "doc.text")), [], []
            new: list[bytes | None] = [None] * len(texts)
            for i, gone in enumerate(batch.column("gone").to_pylist()):
                lines = texts[i].split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    out = {np.array([g["a"], g["b"]], np.int64).tobytes() for g in gone}
                    kept = [x for x, h in zip(lines, hashes(texts[i])) if h not in out]
                    new[i] = b"\n".join(kept)
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_dropped.append(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(new, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())], names=["doc", "text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(rewrite, joined.drop("gone").schema)
    return out.select("doc", F.coalesce("text", "doc.text", F.lit("")).alias("text"), "n_lines", "n_dropped")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the columns they have, less the lines that drop_repeats() drops; n_chars (if there is such a column) follows the text."""
    out, changed = drop_repeats(docs), F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """For each document doc_id, n_lines, n_dropped and kept_sha256."""
    return drop_repeats(docs.select("doc_id", "text")).select(F.col("doc.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d) u),
keys AS (SELECT k, min(doc_id) AS first_id FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id > keys.first_id, false) AS gone FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
