"""Toxicity by bags of subwords: embeddings of words and their character n-grams, averaged into a linear softmax.

A window of words is the mean of the embeddings of all their subwords; a document scores as its most toxic window, so that a short
insult in a long text counts. Embeddings and softmax are trained together in numpy, on a bounded sample of labelled documents (whole
texts), first on whole documents, then on each document's leading window. A misspelling shares most of its n-grams with the word it
hides. Scoring needs one number for each subword (its embedding along the difference of the two softmax rows), so tasks get a
vector of fixed length and score all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import column, mix64, slices, small_batches, utf8
from cirrus.llm.decontamination import WORD_BYTES

#: Labelled documents of each class that training takes at most (those with the smallest hashes), and their largest size.
SAMPLE_PER_CLASS, SAMPLE_TEXT_BYTES = 1500, 1 << 15
BUCKETS, WIDTH, GRAMS = 1 << 18, 4, (3, 4, 5)
#: Words of a window, and from one window's start to the next.
WINDOW, STEP = 48, 24
#: Subwords that a bag has at least; the missing ones are zero vectors, so a few words can't weigh more than a window of them.
PADDED = 200
#: Occurrences by which log-odds are shrunk.
SHRINK = 4.0
EPOCHS_WHOLE, EPOCHS_WINDOW, RATE = 10, 60, 0.5
#: Bytes of texts that a task scores at a time (or one longer text); it takes some 100 times as much for a moment where words are short.
SLICE = 1 << 19


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' subwords, word after word, and how many each word has. A word's own bucket is among them."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(words)), n)
    ends = np.repeat(first + n, n)
    place = np.arange(len(raw))
    power = np.uint64(0x100000001B3)
    got, of = [], []
    h = np.zeros(len(raw), np.uint64)
    for k in range(max(GRAMS)):
        h[: len(raw) - k] = h[: len(raw) - k] * power + raw[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            inside = place + k < ends
            got.append(mix64(h[inside] ^ np.uint64(k + 1)))
            of.append(owner[inside])
    powers = np.cumprod(np.full(int(n.max(initial=0)) + 1, power, np.uint64))
    own = np.add.reduceat(raw * powers[place - first[owner]], first) if len(words) else np.zeros(0, np.uint64)
    got.append(mix64(own))
    of.append(np.arange(len(words)))
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return (np.concatenate(got)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of_all, minlength=len(words))


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Different words of a batch of texts, the place among them of each text's words in order, where texts begin and end, and for each word
    where the same word stood before in its text (-1: nowhere)."""
    raw = utf8(texts)
    words = pc.ascii_split_whitespace(pa.array([t.translate(WORD_BYTES).strip() for t in raw], pa.binary()).cast(pa.large_string()))
    flat = words.flatten()
    coded = flat.dictionary_encode()
    edge = np.asarray(words.offsets).astype(np.int64)
    at, doc = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(edge))
    key = doc * (len(coded.dictionary) + 1) + at
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before = np.full(len(at), -1)
    before[order[again + 1]] = order[again]
    return utf8(coded.dictionary), at, edge - edge[0], before


def windows(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end of each window; each document with words has one at least, and its end is in one."""
    n = np.diff(edge)
    many = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    first = edge[:-1][doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
    return doc, first, np.minimum(first + WINDOW, edge[1:][doc])


def members(lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bag and place of the words from lo to hi. A word counts once a bag, so that endless repeats of one word can't fill it."""
    length = hi - lo
    row = np.repeat(np.arange(len(lo)), length)
    place = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
    new = before[place] < lo[row]
    return row[new], place[new]


@dataclass
class Model:
    """A number for each subword bucket, and the log-odds of a bag before its words are seen; prior: of an empty text."""

    along: np.ndarray
    bias: float
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        words, at, edge, before = split(texts)
        odds = np.full(len(texts), self.prior)
        if words and len(at):
            ids, n = subwords(words)
            total = np.add.reduceat(self.along[ids], np.cumsum(n) - n)
            doc, a, b = windows(edge)
            row, place = members(a, b, before)
            sums, counts = (np.bincount(row, x[at[place]], len(a)) for x in (total, n))
            z = sums / np.maximum(PADDED, counts) + self.bias
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            odds[doc[start]] = np.maximum.reduceat(z, start)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(texts: list[str], toxic: np.ndarray, seed: int = 1) -> Model:
    """Joint training by Adagrad. Without examples of both classes, the model is the share of toxic ones."""
    share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    words, at, edge, before = split(pa.array(texts, pa.string()))
    if len(set(toxic.tolist())) < 2 or not words:
        return Model(np.zeros(BUCKETS), prior, prior)
    ids, n = subwords(words)
    used, ids = np.unique(ids, return_inverse=True)
    first = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.1, (len(used), WIDTH)), rng.normal(0, 0.5, (2, WIDTH)), np.zeros(2)
    seen = [np.full(x.shape, 1e-8) for x in (emb, soft, bias)]
    # To begin with, the first dimension of a subword is how much oftener than others it stands in toxic documents (log-odds, shrunk).
    once = before < 0
    is_toxic = toxic[np.repeat(np.arange(len(texts)), np.diff(edge))][once]
    seen_in = [np.bincount(ids, np.repeat(np.bincount(at[once], is_toxic == k, len(words)), n), len(used)) for k in (0, 1)]
    part = seen_in[1].sum() / max(1.0, seen_in[0].sum() + seen_in[1].sum())
    emb[:, 0] = np.log((seen_in[1] + SHRINK * part) / (seen_in[0] + SHRINK * (1 - part))) - np.log(part / (1 - part))
    soft[:, 0] = -1, 1
    doc, a, b = windows(edge)
    of_window = members(a, b, before)
    window_size = np.maximum(PADDED, np.bincount(of_window[0], n[at[of_window[1]]], len(a)))
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    has = doc[start]
    y = toxic[has].astype(float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for epoch in range(EPOCHS_WHOLE + EPOCHS_WINDOW):
        if epoch < EPOCHS_WHOLE:
            lo, hi = edge[:-1][has], edge[1:][has]
        else:
            by_word = np.add.reduceat((emb @ (soft[1] - soft[0]))[ids], first)
            z = np.bincount(of_window[0], by_word[at[of_window[1]]], len(a)) / window_size
            top = np.maximum.reduceat(z, start)
            best = np.flatnonzero(z == np.repeat(top, np.diff(np.append(start, len(doc)))))
            best = best[np.unique(doc[best], return_index=True)[1]]
            lo, hi = a[best], b[best]
        row, place = members(lo, hi, before)
        word = at[place]
        size = np.maximum(PADDED, np.bincount(row, n[word], len(lo)))
        bag = np.stack([np.bincount(row, np.add.reduceat(emb[:, k][ids], first)[word], len(lo)) / size for k in range(WIDTH)], 1)
        logits = bag @ soft.T + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - np.stack([1 - y, y], 1)) * weight[:, None]
        # The gradient of a subword: of each bag that holds it, its count there over the bag's size times the bag's own gradient.
        back = g @ soft / size[:, None]
        by_word = np.stack([np.bincount(word, back[row, k], len(words)) for k in range(WIDTH)], 1)
        grads = np.stack([np.bincount(ids, np.repeat(by_word[:, k], n), len(used)) for k in range(WIDTH)], 1), g.T @ bag, g.sum(axis=0)
        for x, s, d in zip((emb, soft, bias), seen, grads):
            s += d * d
            x -= RATE * d / np.sqrt(s)
    along = np.zeros(BUCKETS)
    along[used] = emb @ (soft[1] - soft[0])
    return Model(along, float(bias[1] - bias[0]), prior)


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels may not be learnt from; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labels outside the held-out fifth. Labels that are null are left out; a document with several is toxic if one is, and of
    several texts with one id the least is learnt from. Without labels of both classes, all scores are the share of toxic ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE_PER_CLASS rows at most
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns, with text) as column doc, with score: how likely the label 1 is. Null and empty texts get the sample's share."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.lit(0.0).alias("score"))

    return rows.mapInArrow(lambda batches: scored(batches, sent.value), rows.schema)


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """doc and score of batches with doc, SLICE bytes of texts at a time."""
    for batch in slices(batches, "doc.text", SLICE):
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(model.score(column(batch, "doc.text")))], names=["doc", "score"])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each document doc_id, held_out, score and predicted. Rows that repeat are scored alike; a null id is held out; an empty table gives an empty result."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
