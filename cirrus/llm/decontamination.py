"""Finding and removing benchmark passages, by an FM-index for each training shard.

A window is ten consecutive words of a benchmark item (all of them where it has fewer). A shard is a few megabytes of documents in a
task. Only runs of words that all occur in the benchmark can hold a window, so those runs, as word numbers with separators between,
are the text that a shard's FM-index covers: nothing that can match is left out. All windows are looked up together by backward
search through the ranks of a wavelet matrix; positions come from sampled suffixes; overlapping hits merge into spans of words.
Documents are never shuffled. The benchmark goes to the tasks in blocks of bounded size, each block in a further pass over the
rows, so it may be of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import column, slices, utf8

WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that one FM-index covers.
SHARD_BYTES = 4 << 20
#: A suffix position is kept for every so many.
SAMPLED = 4

#: ASCII letters in lower case and digits stay, other ASCII becomes a space; bytes from 0x80 up belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edge[::2], edge[1::2]


class WaveletMatrix:
    """Ranks over a sequence of small numbers: how often does c occur before place i?"""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.before, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.before.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - self.before[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for k in range(self.bits):
            one, ones = ((c >> (self.bits - 1 - k)) & 1).astype(bool), self.before[k]
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, self.zeros[k] + lo1, lo - lo1), np.where(one, self.zeros[k] + hi1, hi - hi1)
        return hi - lo

    def value_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each place, and how often it occurs before that place."""
        value, lo, at = np.zeros_like(i), np.zeros_like(i), i.copy()
        for k in range(self.bits):
            ones = self.before[k]
            bit = ones[at + 1] - ones[at]
            lo1, at1 = ones[lo], ones[at]
            lo, at = np.where(bit == 1, self.zeros[k] + lo1, lo - lo1), np.where(bit == 1, self.zeros[k] + at1, at - at1)
            value = 2 * value + bit
        return value, at - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling the length that is sorted; a suffix that is a prefix of another comes first."""
    rank, k = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        second = np.zeros_like(rank)
        second[:-k] = rank[k:]
        key = rank * (len(seq) + 2) + second
        order = np.argsort(key, kind="stable")
        got = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(got[1:] != got[:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        k *= 2
        if new[-1] == len(seq) or k >= len(seq):
            return order


class FmIndex:
    """Over numbers from 0 up; the last one has to be a 0 that is smaller than all before it."""

    def __init__(self, seq: np.ndarray):
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n, self.tree = len(seq), WaveletMatrix(bwt, max(1, int(seq.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))]).astype(np.int64)
        kept = sa % SAMPLED == 0
        self.kept, self.kept_before, self.sample = kept, np.concatenate([[0], np.cumsum(kept)]), sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) of the suffix array that start with each phrase (all of one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = len(self.first) - 1
        for c in phrases.T[::-1]:
            known = c < top
            c = np.where(known, c, 0)
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
            hi = np.where(known, np.maximum(lo, hi), lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text, by steps back to a sampled suffix."""
        at, steps, out = rows.copy(), np.zeros_like(rows), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[at[open_]]
            hit = open_[done]
            out[hit] = self.sample[self.kept_before[at[hit]]] + steps[hit]
            open_ = open_[~done]
            c, r = self.tree.value_and_rank(at[open_])
            at[open_] = self.first[c] + r
            steps[open_] += 1
        return out


class Windows:
    """Of a block of benchmark items: the numbers of its words, the windows by length, and the items of each window."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                held[tuple(ids[a : a + window])].add(name)
        by_length = defaultdict(list)
        for w in held:
            by_length[len(w)].append(w)
        self.phrases = {n: (np.array(ws, np.int64), [held[w] for w in ws]) for n, ws in by_length.items()}
        self.shortest = min(by_length, default=0)

    def find(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """For each text the number of words, the spans of words that windows cover, and the items that have a window there."""
        counts, runs, owner, start, total = [], [], [], [], 0
        get = self.number.get
        for d, text in enumerate(texts):
            ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
            counts.append(len(ids))
            if not self.shortest or not len(ids):
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a >= self.shortest:
                    runs += [ids[a:b], np.zeros(1, np.int64)]
                    owner.append(d)
                    start.append((total, a))
                    total += b - a + 1
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        names: list[set[str]] = [set() for _ in texts]
        if not runs:
            return counts, spans, names
        seq = np.concatenate([*runs, [0]])
        seq[:-1] += 1  # separators become 1; the last one is smaller than all
        index = FmIndex(seq)
        at, offset = np.array(start, np.int64).T
        owner = np.array(owner)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, (phrases, items) in self.phrases.items():
            lo, hi = index.search(phrases + 1)
            many = hi - lo
            which = np.repeat(np.arange(len(lo)), many)
            if not len(which):
                continue
            rows = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(which))
            place = index.locate(rows)
            run = np.searchsorted(at, place, "right") - 1
            doc, first = owner[run], place - at[run] + offset[run]
            found.append((doc, first, first + n))
            pair = np.unique(doc * len(items) + which)
            for d, w in zip((pair // len(items)).tolist(), (pair % len(items)).tolist()):
                names[d] |= items[w]
        if found:
            doc, first, last = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((first, doc))
            doc, first, last = doc[order], first[order], last[order]
            reach = np.maximum.accumulate(doc * (1 << 40) + last)  # ends grow within a document and never reach into the next
            new = np.concatenate([[True], doc[1:] * (1 << 40) + first[1:] > reach[:-1]])
            cut = np.flatnonzero(new)
            ends = reach[np.concatenate([cut[1:], [len(doc)]]) - 1] & ((1 << 40) - 1)
            for d, a, b in zip(doc[cut].tolist(), first[cut].tolist(), ends.tolist()):
                spans[d].append((a, b))
        return counts, spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[Windows]:
    """The benchmark in blocks; the driver holds one partition's rows and one block at a time."""
    held: list[tuple[str, bytes]] = []
    size, some = 0, False
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        held.append((row["item"], row["text"].encode()))
        size += len(held[-1][1])
        if size >= most_bytes:
            yield Windows(held)
            held, size, some = [], 0, True
    if held or not some:
        yield Windows(held)


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (any columns, with text) as column doc, with n_words, spans (pairs of word numbers, sorted and apart) and items.

    Null and empty texts have no words. Rows that repeat are marked alike. Items whose text is null have no windows; an item
    without an id is called "null".
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.lit(0).alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "doc.text", SHARD_BYTES):
                counts, spans, names = sent.value.find(utf8(column(batch, "doc.text")))
                spans = [merged([*map(tuple, old), *new]) if old else new for old, new in zip(batch.column("spans").to_pylist(), spans)]
                names = [sorted({*old, *new}) for old, new in zip(batch.column("items").to_pylist(), names)]
                got = {"n_words": pa.array(counts, pa.int32()), "spans": pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32()))), "items": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([got.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the columns they have, less the benchmark passages in their texts (a hit span goes from its first word to its last).

    Where a document loses text, n_chars (if there is such a column) follows. A null text stays null.
    """
    marked = mark(docs, benchmark)
    rows = marked.select("doc", "spans", F.lit(None).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, texts = column(batch, "doc.text"), [None] * batch.num_rows
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    raw = old[i].as_py().encode()
                    first, last = word_offsets(raw)
                    edge = [0] + [x for a, b in spans for x in (int(first[a]), int(last[b - 1]))] + [len(raw)]
                    texts[i] = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])).decode("utf-8", "replace")
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = rows.mapInArrow(cut, rows.schema)
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    return mark(docs.select("doc_id", "text"), benchmark).select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
