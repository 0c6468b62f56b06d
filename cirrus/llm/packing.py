"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie, cut into pieces only where they are longer than a sequence, and the pieces (their lengths,
not their tokens) are dealt evenly over bins of work by a round robin. Inside one of these, best-fit decreasing places each piece into
the open sequence with the least room that still holds it; a segment tree over the amounts of room finds that sequence in
log2(capacity) steps. Pieces that fill a sequence need no search. Each bin of work leaves at most a handful of
sequences part-filled, so the loss against one global run is below one sequence for tens of thousands of pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import hand_back, slices, small_batches, utf8

#: Pieces that one task packs: their lengths take a few megabytes. With ids, 4096 for a piece at most, they are up to 64 MB.
PIECES_PER_TASK, PIECES_WITH_IDS_PER_TASK = 50_000, 4_000
#: Words whose tokens a Python worker remembers before it drops those that it hasn't met since it last had so many.
WORDS_REMEMBERED = 200_000
#: Bytes of texts that are cut into words at a time (or one longer text).
SLICE = 1 << 20

#: Letters that the tokenizer's normaliser leaves as they are whatever stands beside them, and words of nothing else (UTF-8).
PLAIN_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN_WORD = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")
#: What a word's end is cut off of, behind a letter: none of these begins a pattern of the tokenizer that goes on with letters, or a special token.
MARKS = b",.;:!?#$%&*)"

_loaded: dict[str, WordTokens] = {}


class WordTokens:
    """Token ids of texts by way of the tokens of their words.

    The tokenizer never joins across ASCII white space (its pattern drops white space, its normaliser works within it), nor across a
    letter and the MARKS behind it, and it lowers case; so the ids of a text are those of its words in order. Words
    repeat: each is looked up once for a batch, and encoded once for a task. A PLAIN_WORD is one word to the pattern and
    passes the normaliser unchanged, so the tokenizer's model is asked at once; that takes a third of the time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.letters = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in PLAIN_LETTERS})

    def forget(self) -> None:
        """Words are remembered for a task: a worker lives on, and other tasks need its memory."""
        self.known, self.older = {}, {}
        hand_back()

    def encode(self, words: list[bytes]) -> None:
        """Plain words go to the model. Others without a comma go to the tokenizer as one text with commas between, at whose token the ids are cut; the rest go one by one."""
        plain, rest, ask = [], [], self.tokenizer.model.tokenize
        for w in words:
            (plain if PLAIN_WORD.fullmatch(w) else rest).append(w)
        flat, ends = array("I"), [0]
        for w in plain:
            flat.extend([t.id for t in ask(w.decode() if w.isascii() else w.decode().translate(self.letters))])
            ends.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        self.known.update(zip(plain, [raw[i:j] for i, j in zip(ends, ends[1:])]))
        joined = [w for w in rest if b"," not in w and b"<" not in w]
        other = [w for w in rest if b"," in w or b"<" in w]
        comma = self.tokenizer.encode(",", add_special_tokens=False).ids
        for a in range(0, len(joined), 4000):
            part = joined[a : a + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" , ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            cut = 4 * np.flatnonzero(ids == comma[0])
            if len(cut) != len(part) - 1:  # a character that the tokenizer takes for a comma
                other += part
                continue
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)])]))
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit numbers."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > WORDS_REMEMBERED:
            self.known, self.older, new = {}, self.known, set(words)
        met = new.intersection(self.older)
        self.known.update(zip(met, map(self.older.__getitem__, met)))
        new -= met
        ends = [(w, c, w[len(c) :]) for w in new if w and w[-1] in MARKS and (c := w.rstrip(MARKS)) and (97 <= c[-1] <= 122 or (c[-1] >= 128 and c.decode("utf-8", "replace")[-1].lower().isalpha()))]
        needed = new.difference([w for w, _, _ in ends]).union([c for _, c, _ in ends], [tail for _, _, tail in ends])
        self.encode(list(needed.difference(self.known)))
        self.known.update([(w, self.known[c] + self.known[tail]) for w, c, tail in ends])
        return list(map(self.known.__getitem__, words))

    def ids(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids, as for words; null as empty."""
        texts = pc.fill_null(texts, "")
        size = int(pc.sum(pc.binary_length(texts)).as_py() or 0)
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if size else np.zeros(0, np.uint8)
        # Lowering A-Z beforehand could change what a combining mark (lead bytes 0xCC and 0xCD) composes with, or make a special token.
        if not ((raw == 0xCC) | (raw == 0xCD)).any() and not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), "\n")  # no word has white space
        found = self.of_words(utf8(one)[0].split(b"\n"))
        n, at = np.fromiter(map(len, found), np.int32, len(found)) // 4, np.asarray(coded.indices)
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n, dtype=np.int32) - n
        many = n[at]
        ends = np.cumsum(many, dtype=np.int32)
        take = np.repeat(first[at] - ends + many, many)
        take += np.arange(len(take), dtype=np.int32)
        ids = flat[take]
        edge = np.concatenate([[0], ends])[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text has the end id alone. Rows that repeat, and rows whose doc_id is null, are documents like others.
    """
    small_batches(docs.sparkSession)
    columns = "doc_id {}, piece int, start long, length long, ids_crc32 long".format(docs.schema["doc_id"].dataType.simpleString())
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = tokens(tokenizer)
        for batch in slices(batches, "text", SLICE):
            rows, out = [], []
            for i, ids in enumerate(find.ids(batch.column("text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        out.append(np.frombuffer(part, "<i4"))
            at, k, start, length, crc = map(np.array, zip(*rows))
            got = [batch.column("doc_id").take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(got + [pa.array(out, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        find.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, columns + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best-fit decreasing; equal lengths keep their order."""
    size = 1 << int(capacity).bit_length()
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    some = [0] * (2 * size)  # segment tree over room: how many open bins lie below a node
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        node, room = size + n, -1
        if some[node]:
            room = n
        else:
            while node > 1:  # up until a right neighbour has an open bin, then down to its leftmost
                if not node & 1 and some[node + 1]:
                    node += 1
                    while node < size:
                        node = 2 * node if some[2 * node] else 2 * node + 1
                    room = node - size
                    break
                node >>= 1
        if room < 0:
            b, room, used = used, capacity, used + 1
        else:
            b = open_at[room].pop()
            node = size + room
            while node:
                some[node] -= 1
                node >>= 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            open_at[left].append(b)
            node = size + left
            while node:
                some[node] += 1
                node >>= 1
    return bins, offsets


def place(parts: DataFrame, capacity: int, n_tasks: int) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset. A sequence's number tells the task and the bin in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        bins, offsets = best_fit(np.asarray(table.column("length")), capacity)
        table = table.append_column("sequence_id", pa.array(bins + (TaskContext.get().partitionId() << 32), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.to_batches(max_chunksize=20_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.repartition(n_tasks).mapInArrow(pack, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text; other columns are left out) and returns a row for each piece.

    An empty table gives an empty result. With with_ids the token ids come along; sequences() lays them out.
    """
    # A token has a byte at least, so a text has no more pieces than this.
    most = docs.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / capacity))).first()[0] or 0
    n_tasks = max(1, -(-most // (PIECES_WITH_IDS_PER_TASK if with_ids else PIECES_PER_TASK)))
    return place(pieces(docs, tokenizer or tokenizer_path(), capacity, end_id, with_ids), capacity, n_tasks)


def sequences(packed: DataFrame) -> DataFrame:
    """Of pack(with_ids=True), the sequences themselves: sequence_id, ids. A sequence holds at most capacity pieces."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
