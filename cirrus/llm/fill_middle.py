"""Fill-in-the-middle: documents turned into prefix, suffix and middle, cut at places counted in code points.

A text is cut into chunks where a rolling hash of its last bytes says so, so equal passages give equal chunks wherever they
lie. What is needed of a chunk (how many code points start in it, whether a mark lies in it, its first and last bytes) is computed once
for each content that a worker meets: a cache is looked up by a hash and trusted only if the content is the same. Adding
up the counts of a text's chunks tells in which chunk a code point lies; only that chunk is searched. Nothing is shuffled, and each
row is on its own, so a hot source or a large group of copies costs nothing but its bytes, and copies hit the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import mix64, slices, small_batches, utf8

#: The rolling hash sees so many bytes; a chunk ends where its first CHUNK_BITS bits are 0, but has LEAST bytes at least and MOST at most (the last one of a text may be shorter).
WINDOW, CHUNK_BITS, LEAST, MOST = 32, 12, 64, 1 << 16
#: Bytes hashed at a time, and bytes of chunks that a worker remembers before it drops those that it hasn't met since it last had so many.
BLOCK, REMEMBERED = 1 << 20, 16 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the WINDOW bytes up to it: the sum of their gears, each shifted by its distance, built by doubling."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of a text end. The last end is the text's; an empty text has none."""
    n, found = len(data), []
    for a in range(0, n if n > LEAST else 0, BLOCK):
        low = max(0, a - WINDOW + 1)
        hits = np.flatnonzero(rolling(np.frombuffer(data, np.uint8, min(n, a + BLOCK) - low, low)) >> np.uint32(32 - CHUNK_BITS) == 0) + low + 1
        found.append(hits[hits > max(a, WINDOW - 1)])
    raw = np.concatenate(found) if found else np.zeros(0, np.int64)
    # A hit close to the hit before it doesn't count, whether or not that one did: so what follows a repeated passage's first bytes is cut alike everywhere.
    ends, at = [], 0
    for e in [*raw[np.diff(raw, prepend=0) >= LEAST].tolist(), n]:
        ends += range(at + MOST, e, MOST)
        if e > at:
            ends.append(e)
        at = e
    return ends


class Summary(NamedTuple):
    """Of a chunk: code points that start in it, whether a mark lies within it, and the bytes at its ends that a mark across an edge would have."""

    points: int
    marked: bool
    head: bytes
    tail: bytes


def leads(chunk: bytes) -> np.ndarray:
    """Where code points start: at bytes that don't continue one."""
    return (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80


class Chunks:
    """Summaries of chunks by their content."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.older: dict[int, tuple[bytes, Summary]] = {}
        self.size = self.hits = 0

    def summary(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        entry = self.known.get(key)
        if entry is None and (entry := self.older.get(key)) is not None:
            self.keep(key, entry)
        if entry is not None and entry[0] == chunk:
            self.hits += 1
            return entry[1]
        made = Summary(int(np.count_nonzero(leads(chunk))), any(m in chunk for m in _MARKS), chunk[:2], chunk[-2:])
        if entry is None:
            self.keep(key, (chunk, made))
        return made

    def keep(self, key: int, entry: tuple[bytes, Summary]) -> None:
        if self.size > REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        self.known[key] = entry
        self.size += len(entry[0])


class Counted:
    """A text as its chunks' summaries combined."""

    def __init__(self, data: bytes, cache: Chunks):
        self.data, self.ends = data, chunk_ends(data)
        parts = [cache.summary(data[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.before = np.concatenate([[0], np.cumsum([p.points for p in parts], dtype=np.int64)])
        self.marked, tail = any(p.marked for p in parts), b""
        for p in parts:
            self.marked = self.marked or any(m in tail + p.head for m in _MARKS)
            tail = (tail + p.tail)[-2:]

    @property
    def points(self) -> int:
        return int(self.before[-1])

    def byte_of(self, point: int) -> int:
        """The byte at which a code point starts; the text's end for the number of its code points."""
        if point >= self.points:
            return len(self.data)
        k = int(np.searchsorted(self.before, point, "right")) - 1
        start = self.ends[k - 1] if k else 0
        return start + int(np.flatnonzero(leads(self.data[start : self.ends[k]]))[point - int(self.before[k])])


class Plan(NamedTuple):
    form: str
    first: int
    second: int


def planned(key: str, points: int, marked: bool, salt: int, plain_percent: int, spm_percent: int) -> Plan:
    """Form and cuts of a document, from the sha256 of salt and key alone."""
    digest = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not points or marked or h3 % 100 >= 100 - plain_percent:
        return Plan("plain", 0, 0)
    first, second = sorted((h1 % (points + 1), h2 % (points + 1)))
    return Plan("spm" if h4 % 100 < spm_percent else "psm", first, second)


def transform(docs: DataFrame, salt: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Each document as a training text: doc_id, n (code points), form, prefix_chars, middle_chars and output.

    A null text counts as empty. Empty texts, and texts that hold one of the marks already, stay as they are (form plain, no lengths), and so do
    plain_percent of the others, picked by doc_id; of the rest, spm_percent put the suffix first. A null doc_id counts as the empty word. Rows that
    repeat give equal rows; an empty table an empty one; other columns are left out. A row takes memory for its text and output only.
    """
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks()
        for batch in slices(batches, "text", 4 << 20):
            keys = [k or "" for k in batch.column("doc_id").cast(pa.string()).to_pylist()]
            n, form, prefix, middle, out = [], [], [], [], []
            for key, data in zip(keys, utf8(batch.column("text"))):
                text = Counted(data, cache)
                plan = planned(key, text.points, text.marked, salt, plain_percent, spm_percent)
                plain = plan.form == "plain"
                n.append(text.points)
                form.append(plan.form)
                prefix.append(None if plain else plan.first)
                middle.append(None if plain else plan.second - plan.first)
                if plain:
                    out.append(data)
                    continue
                a, b = text.byte_of(plan.first), text.byte_of(plan.second)
                p, s = _MARKS[0] + data[:a], _MARKS[1] + data[b:]
                out.append(b"".join([s, p] if plan.form == "spm" else [p, s]) + _MARKS[2] + data[a:b])
            lengths = [pa.array(c, pa.int64()) for c in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), *lengths, pa.array(out, pa.binary())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def original(form: Column, output: Column) -> Column:
    """The text that an output was made of. A text that holds a mark has the form plain, so the first of each mark is the one that was put in."""
    at = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, at(a) + 3, at(b) - at(a) - 3)
    middle = F.substring(output, at(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))


def digest(docs: DataFrame) -> DataFrame:
    """transform() with sha256 of the output and of the text rebuilt from it. Nulls, empty and repeated rows as there."""
    restored = original(F.col("form"), F.col("output"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


def _oracle() -> str:
    h = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
e AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h(2)} % 100 >= 90 THEN 'plain' WHEN {h(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  CAST(least({h(0)} % (n + 1), {h(1)} % (n + 1)) AS BIGINT) AS a, CAST(greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) AS BIGINT) AS b FROM d),
f AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<S>' || substring(t, b + 1) AS s, '<M>' || substring(t, a + 1, b - a) AS m FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


ORACLE_SQL = _oracle()
