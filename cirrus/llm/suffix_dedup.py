"""Removing repeated byte strings, by anchors that repeats share and common-prefix interval trees over the suffixes at anchors.

Each string of LENGTH bytes holds one anchor: the least of its grams of GRAM bytes under a hash (the first, where equal). Equal
strings have their anchor at the same place, so they meet under the anchor's gram. An anchor's context is all bytes of the strings
that chose it. Anchors whose gram is nowhere else go first, by counts that combine before the shuffle. Contexts that occur twice as
a whole are repeats throughout. The other contexts of a gram, one of each kind, form an enhanced suffix array: the suffixes at their
anchors in order, with the lengths that neighbours share. A stack scan gives the intervals of its common-prefix tree; in each, the
bytes before the anchors are sorted backwards, and where they differ, the repeat ends: a group that shares l bytes ahead and m
behind, and not more, is a maximal repeat with all its occurrences. A gram with very many different contexts
(more than MOST) is dealt by its strings instead: each string of each context is counted by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import durable, mix64, slices, utf8, with_rid

LENGTH, GRAM = 200, 32
#: Different contexts of one gram that one suffix array takes.
MOST = 4000
#: Bytes of text whose grams a task hashes at once.
SLICE_BYTES = 1 << 20

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]).astype(np.uint64))


class Hashes:
    """Polynomial hashes of any substring, from sums over prefixes (modulo 2**64, so an odd base has an inverse)."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data))[:-1])])
        self.back = powers(inverse, len(data))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, by running minima inside blocks from both ends."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text, place, first and last string start, gram hash and context hash of each anchor; places count from the text's start."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, none = np.cumsum(n) - n, np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    one, bits = Hashes(data, _ONE), int(len(data)).bit_length()
    at = np.arange(len(data) - GRAM + 1)
    gram = one.of(at, at + GRAM)
    order = (gram >> np.uint64(bits)) << np.uint64(bits) | at.astype(np.uint64)
    least = (sliding_min(order, LENGTH - GRAM + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    many = np.maximum(0, n - LENGTH + 1)
    text = np.repeat(np.arange(len(texts)), many)
    start = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    place = least[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(place) else none
    last = np.concatenate([new[1:], [len(place)]]) - 1 if len(place) else none
    text, place, first, last = text[new], place[new], start[new], start[last]
    context = Hashes(data, _TWO).of(first, last + LENGTH)
    off = begin[text]
    return text, place - off, first - off, last - off, gram[place], context


#: Where an anchor lies, in one number: first start, place less first, last less first.
def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 20 | (place - first) << 10 | (last - first)


def unpacked(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = loc >> 20
    return first + (loc >> 10 & 1023), first, first + (loc & 1023)


def common(a: bytes, b: bytes) -> int:
    """Bytes that both start with."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def intervals(order: list[int], shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(l, i, j) for each interval of the common-prefix tree: order[i:j] share l bytes, and no more rows around them do.

    shared[k] is what order[k - 1] and order[k] share; the scan keeps open intervals on a stack.
    """
    stack: list[tuple[int, int]] = []
    for k in range(1, len(order) + 1):
        depth, left = shared[k] if k < len(order) else 0, k - 1
        while stack and stack[-1][0] > depth:
            found, left = stack.pop()
            yield found, left, k
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(m, l, rows): the strings of m bytes before and l after the anchor that rows share, m + l >= least, and that can't grow for all.

    before holds the bytes in front of each anchor, the nearest first. A row that ends where another goes on counts as different.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    shared = [0] + [common(after[i], after[j]) for i, j in zip(order, order[1:])]
    for ahead, i, j in intervals(order, shared):
        rows = sorted(order[i:j], key=before.__getitem__)
        behind = [0] + [common(before[x], before[y]) for x, y in zip(rows, rows[1:])]
        if ahead >= least:
            yield 0, ahead, rows
        for back, a, b in intervals(rows, behind):
            if back + ahead >= least:
                yield back, ahead, rows[a:b]


def repeat_spans(contexts: list[tuple[int, bytes]]) -> list[tuple[int, int] | None]:
    """For each context (place of the anchor in it, its bytes) of one gram what repeats cover: a span, or None.

    All strings of a context hold its anchor, so what repeats cover is in one piece."""
    spans: list[tuple[int, int] | None] = [None] * len(contexts)
    if len(contexts) == 2:  # the commonest case needs no tree
        (p, x), (q, y) = contexts
        back, ahead = common(x[:p][::-1], y[:q][::-1]), common(x[p:], y[q:])
        return [(p - back, p + ahead), (q - back, q + ahead)] if back + ahead >= LENGTH else spans
    before, after = [x[:p][::-1] for p, x in contexts], [x[p:] for p, x in contexts]
    for back, ahead, rows in maximal_repeats(before, after):
        for r in rows:
            p, old = contexts[r][0], spans[r]
            new = (p - back, p + ahead)
            spans[r] = new if old is None else (min(old[0], new[0]), max(old[1], new[1]))
    return spans


def all_anchors(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            text, place, first, last, gram, context = anchors(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column("rid").take(pa.array(text)), pa.array(packed(place, first, last))], names=["g", "c", "rid", "loc"])

    return keyed.mapInArrow(run, "g long, c long, rid long, loc long")


def covered(contexts: DataFrame) -> DataFrame:
    """rid, a, b: what repeats cover in contexts (g, rid, loc, alone, bytes) that are alone of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []

        def close() -> list[tuple[int, int, int]]:
            spans = repeat_spans([(p - a, x) for _, p, a, _, x in held]) if len(held) > 1 else []
            return [(rid, a + s[0], a + s[1]) for (rid, _, a, alone, _), s in zip(held, spans) if alone and s]

        def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], names=["rid", "a", "b"])

        for batch in batches:
            rows = []
            place, first, _ = unpacked(np.asarray(batch.column("loc")))
            for g, rid, p, a, alone, x in zip(batch.column("g").to_pylist(), batch.column("rid").to_pylist(), place.tolist(), first.tolist(), batch.column("alone").to_pylist(), batch.column("bytes").to_pylist()):
                if g != gram:
                    rows += close()
                    gram, held = g, []
                held.append((rid, p, a, alone, x))
            if rows:
                yield out(rows)
        if rows := close():
            yield out(rows)

    return contexts.repartition("g").sortWithinPartitions("g").select("g", "rid", "loc", "alone", "bytes").mapInArrow(run, "rid long, a int, b int")


def counted(contexts: DataFrame) -> DataFrame:
    """As covered(), for grams with very many contexts: by counts of all their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            rids, starts, hashes = [], [], []
            _, first, last = unpacked(np.asarray(batch.column("loc")))
            for rid, a, b, x in zip(batch.column("rid").to_pylist(), first.tolist(), last.tolist(), batch.column("bytes").to_pylist()):
                for s in range(b - a + 1):
                    rids.append(rid)
                    starts.append(a + s)
                    hashes.append(xxhash.xxh3_128_digest(x[s : s + LENGTH]))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(rids, pa.int64()), pa.array(starts, pa.int32())], names=["h", "i", "rid", "a"])

    strings = durable(contexts.mapInArrow(run, "h long, i long, rid long, a int"), "strings")
    again = durable(strings.groupBy("h", "i").agg(F.count("*").alias("many")).where("many > 1").drop("many"), "again")
    return strings.join(again, ["h", "i"]).select("rid", "a", (F.col("a") + LENGTH).cast("int").alias("b"))


def with_bytes(reps: DataFrame, keyed: DataFrame) -> DataFrame:
    """reps (g, rid, loc, alone) with the bytes of their contexts."""
    grouped = reps.groupBy("rid").agg(F.collect_list(F.struct("g", "loc", "alone")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            of = batch.column("of")
            flat, edge = of.flatten(), np.asarray(of.offsets) - of.offsets[0].as_py()
            _, first, last = unpacked(np.asarray(flat.field("loc")))
            row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            texts = utf8(batch.column("text"))
            cut = [texts[r][a : b + LENGTH] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("g"), batch.column("rid").take(pa.array(row)), flat.field("loc"), flat.field("alone"), pa.array(cut, pa.binary())], names=["g", "rid", "loc", "alone", "bytes"])

    return keyed.join(grouped, "rid").select("rid", "text", "of").mapInArrow(run, "g long, rid long, loc long, alone boolean, bytes binary")


def spans_of(keyed: DataFrame) -> DataFrame:
    """rid, a, b: byte spans of keyed (rid, text) that repeated strings cover; spans may overlap."""
    found = all_anchors(keyed)
    shared = durable(found.groupBy("g").agg(F.count("*").alias("many"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("many > 1").select("g", (F.col("lo") != F.col("hi")).alias("mixed")), "shared")
    met = durable(found.join(shared, "g"), "met")
    kinds = durable(met.where("mixed").groupBy("g", "c").agg(F.count("*").alias("many"), F.min("rid").alias("rid"), F.min_by("loc", "rid").alias("loc")), "kinds")
    crowded = durable(kinds.groupBy("g").count().where(F.col("count") > MOST).select("g"), "crowded")
    reps = kinds.select("g", "rid", "loc", (F.col("many") == 1).alias("alone"))
    contexts = durable(with_bytes(reps, keyed), "contexts")
    first, width = F.shiftright("loc", 20), F.col("loc").bitwiseAND(F.lit(1023))
    whole = lambda rows: rows.select("rid", first.cast("int").alias("a"), (first + width + LENGTH).cast("int").alias("b"))
    twice = durable(kinds.where("many > 1").select("g", "c"), "twice")
    parts = [whole(met.where("not mixed")), whole(met.where("mixed").join(twice, ["g", "c"], "left_semi")), covered(contexts.join(crowded, "g", "left_anti"))]
    if not crowded.isEmpty():
        parts.append(counted(contexts.join(crowded, "g", "left_semi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return durable(out, "spans")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs; spans that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:], [len(ends)]]) - 1]


def removed(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text; read from files) doc_id, n_bytes, n_removed, n_spans, kept (its other bytes) and kept_sha256.

    A null text is empty. Rows that repeat are texts like others, so texts of LENGTH bytes or more that occur twice lose everything.
    kept is binary, since a cut may fall inside a character. An empty table gives an empty result.
    """
    keyed = with_rid(docs, "text").select("rid", "text")
    spans = spans_of(keyed).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rows = with_rid(docs, "doc_id", "text").join(spans, "rid", "left").select(F.struct("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for text, found in zip(utf8(batch.column("text")), batch.column("spans")):
                size, lost, n, kept = len(text), 0, 0, text
                if found.is_valid and len(found):
                    a, b = merged(np.asarray(found.values.field("a")), np.asarray(found.values.field("b")))
                    edge = [0, *np.stack([a, b], 1).ravel().tolist(), size]
                    kept, n = b"".join(text[x:y] for x, y in zip(edge[::2], edge[1::2])), len(a)
                    lost = size - len(kept)
                out.append((size, lost, n, kept, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["row", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row struct<doc_id: {id_type}>, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def digest(docs: DataFrame) -> DataFrame:
    return removed(docs).drop("kept")
