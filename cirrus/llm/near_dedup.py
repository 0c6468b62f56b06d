"""Near duplicates by SetSketch registers, banded, estimated jointly and confirmed on whole shingle sets.

A document's set has its distinct five-word shingles. Register i of its sketch is the exponentially spaced, truncated
minimum of the set under hash i: floor(1 - log_b(a x)) for the least exponential variate x, kept between 0 and a largest value. The registers of a union
are the larger ones of both, so sketches merge; two registers agree about as often as the sets overlap. Four registers make a band:
sets that overlap by three quarters share one of the 48 bands but for one pair in 80 million.

Equal sets are one class, and only its representative goes on. In each band, representatives with the same registers are linked to
the first of them, not to each other, and each keeps the leader with which it shares most bands. These links are confirmed on the
full sets, and linked classes get one label. What is left are bands where different labels meet: there, all rows outside the band's
main label are held against the rows of other labels, so no link is lost. Shingles that no other row there has count for no link,
and no row has what it lacks of its band's centre (the row with the fewest such shingles, which all others meet first); sizes, counts
and bit masks of these rule out most of these pairs in the join itself, exactly. The likelihood of the registers drops pairs
far below the threshold, and the others are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.llm.common import distilled, durable, mix64, sifted, slices, utf8, whole_rows, with_rid, without

WORDS, BANDS, ROWS = 5, 48, 4
REGISTERS = BANDS * ROWS
#: Base and scale of the registers, and the largest value they take.
BASE, SCALE, TOP = 1.001, 1e-3, 65_535
#: A pair is linked if PERCENT[0] * intersection >= PERCENT[1] * union; pairs with a likelier overlap below LIKELY are not looked at.
PERCENT, LIKELY = (100, 75), 0.5
#: Bytes of text that are cut into shingles at a time: each of their letters takes some fifty bytes meanwhile, in each Python worker of an executor.
SLICE = 1 << 18

_rng = np.random.default_rng(7)
_multiply = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_add = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; one shingle for one to four words, none without words."""
    raw = b"\n".join(texts).lower()
    data = np.frombuffer(raw, np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    first, last = edge[::2], edge[1::2]
    n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(n_bytes + 1) - n_bytes - 1
    bound = np.searchsorted(first, np.append(begin, len(raw)))
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    length = last - first
    powers = np.cumprod(np.full(int(length.max()) + 1, _POWER))
    letters = data[inside].astype(np.uint64)
    start = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(start, length)
    word = mix64(np.add.reduceat((letters + np.uint64(1)) * powers[place], start))
    h = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        h = h * _POWER + word[k : k + len(h)]
    h = mix64(h)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 1]))
        elif b > a:
            few = b - a
            for w in word[a:b].tolist():
                few = (few * int(_POWER) + w) % (1 << 64)
            out.append(mix64(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of one set; of no set at all, zeros."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 512):
        x = h[a : a + 512, None] * _multiply
        x += _add
        np.minimum(least, x.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(SCALE * variate) / np.log(BASE)), 0, TOP).astype(np.uint16)


def overlap(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets with n and m shingles, of whose registers so many are larger and smaller."""
    u, v = n / (n + m), m / (n + m)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    grid = np.linspace(0, 1, 101)[:, None] * np.minimum(u / v, v / u)
    up, down = p(u - v * grid), p(v - u * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    score = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)
    return np.take_along_axis(grid, score.argmax(axis=0)[None], 0)[0]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return PERCENT[0] * both >= PERCENT[1] * (len(x) + len(y) - both) and both > 0


def sketches(keyed: DataFrame) -> DataFrame:
    """rid, n, digest (of the whole set) and registers of each row of keyed (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(utf8(batch.column("text")))
            got = [batch.column("rid"), batch.column("id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(got, names=["rid", "id", "n", "digest", "registers"])

    return keyed.mapInArrow(run, "rid long, id long, n int, digest binary, registers binary")


def bands(sketched: DataFrame) -> DataFrame:
    """band (a hash of its number and registers) and rid, for each band of each row."""
    number = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                packed = regs[:, :, 0] | regs[:, :, 1] << np.uint64(16) | regs[:, :, 2] << np.uint64(32) | regs[:, :, 3] << np.uint64(48)
                key = mix64(packed + mix64(number + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("rid")), BANDS))], names=["band", "rid"])

    return sketched.select("rid", "registers").mapInArrow(run, "band long, rid long")


def likely(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Those of pairs (x, y) whose sizes allow a link and whose registers make one thinkable."""
    side = lambda c: sketched.select(F.col("rid").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where("100 * least(nx, ny) >= 75 * greatest(nx, ny)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rx, ry = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("rx", "ry"))
                n, m = (np.asarray(batch.column(c)).astype(float) for c in ("nx", "ny"))
                # The set with more shingles has more registers ahead.
                keep = overlap((rx > ry).sum(axis=1), (rx < ry).sum(axis=1), n, m) >= LIKELY
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep))

    return both.select("x", "y", "nx", "ny", "rx", "ry").mapInArrow(run, "x long, y long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (x, y) whose full shingle sets overlap enough; texts: rid, text."""
    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ty", SLICE):
            tx, ty = utf8(batch.column("tx")), utf8(batch.column("ty"))
            different = list(dict.fromkeys(tx + ty))
            sets = dict(zip(different, shingle_sets(different)))
            keep = [linked(sets[x], sets[y]) for x, y in zip(tx, ty)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """rid and label (the least rid reachable) of each row that links (x, y) name: labels spread along links, and labels of labels follow."""
    both = durable(links.select("x", "y").union(links.select("y", "x")), "links")
    labels = durable(both.groupBy(F.col("x").alias("rid")).agg(F.least(F.min("y"), F.col("rid")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("rid", "y"), "y").groupBy(F.col("x").alias("rid")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "rid", "left").select("rid", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jumped = spread.join(labels.select(F.col("rid").alias("label"), F.col("label").alias("further")), "label", "left").select("rid", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = durable(jumped, "labels")
        labels = step.select("rid", "label")
        if step.where("label <> old").isEmpty():
            return labels


def link_labels(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """rid and label of representatives that are linked with another; reps: rid, n, registers; texts: rid, text."""
    banded = bands(reps)
    shared = durable(banded.groupBy("band").agg(F.min("rid").alias("leader"), F.count("*").alias("many")).where("many > 1").drop("many"), "bands")
    met = durable(sifted(banded, "band", shared.select("band")).join(shared, "band"), "met")
    ids = durable(met.select("rid").distinct(), "rids")
    some = durable(sifted(texts, "rid", ids).join(ids, "rid", "left_semi"), "texts")
    best = met.where("rid <> leader").groupBy("rid", "leader").agg(F.count("*").alias("many")).groupBy("rid").agg(F.max(F.col("many") * F.lit(1 << 50) - F.col("leader")).alias("top"))
    star = met.where("rid <> leader").groupBy("rid", "leader").agg(F.count("*").alias("many")).join(best, "rid").where(F.col("many") * F.lit(1 << 50) - F.col("leader") == F.col("top")).select(F.col("leader").alias("x"), F.col("rid").alias("y"))
    sure = durable(confirmed(star, some), "sure")
    open_ = mixed_bands(met, components(sure))
    alone = shared_less(some.join(open_.select("rid").distinct(), "rid", "left_semi"))
    profile = durable(reps.select("rid", "n").join(alone, "rid", "left").select("rid", "n", F.coalesce("u", F.lit(0)).alias("u")), "profile")
    told = open_.join(profile, "rid")
    centre = durable(told.groupBy("band").agg(F.min(F.struct("u", "rid", "n")).alias("c")).select("band", F.col("c.rid").alias("x"), F.col("c.n").alias("nx")), "centres")
    views = durable(against(open_.join(centre, "band").select("x", F.col("rid").alias("y")).distinct(), some), "views")
    more = durable(sure.union(views.where("linked AND x <> y").select("x", "y")), "more")
    seen = views.drop("linked").withColumnRenamed("y", "rid")
    open_ = durable(mixed_bands(met, components(more)).join(profile, "rid").join(centre, "band").join(seen, ["x", "rid"]), "open")
    main = durable(open_.groupBy("band", "label").agg(F.count("*").alias("many")).groupBy("band").agg(F.max_by("label", F.struct("many", "label")).alias("main")), "main")
    rest = durable(open_.join(main, "band").where("label <> main").select("band", *[F.col(c).alias(f"{c}2") for c in ("rid", "label", "n", "u", "extra", *MASKS)]), "rest")
    pairs = open_.join(rest, "band").where((F.col("label") != F.col("label2")) & possible())
    late = confirmed(likely(pairs.select(F.least("rid", "rid2").alias("x"), F.greatest("rid", "rid2").alias("y")).distinct(), reps), some)
    return components(more.union(late))


def mixed_bands(met: DataFrame, labels: DataFrame) -> DataFrame:
    """band, rid and label of the rows of met in bands where labels differ; a row without a label has its rid."""
    placed = durable(met.join(labels, "rid", "left").select("band", "rid", F.coalesce("label", "rid").alias("label")), "placed")
    mixed = durable(placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band"), "mixed")
    return durable(placed.join(mixed, "band", "left_semi"), "mixed-rows")


def shared_less(texts: DataFrame) -> DataFrame:
    """rid and u: how many of a text's shingles no other of texts (rid, text) has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(utf8(batch.column("text")))
            rid = batch.column("rid").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), rid], names=["h", "rid"])

    once = texts.select("rid", "text").mapInArrow(run, "h long, rid long").groupBy("h").agg(F.count("*").alias("many"), F.min("rid").alias("rid")).where("many = 1")
    return once.groupBy("rid").agg(F.count("*").alias("u"))


#: Columns that mark, by hashed bits, which shingles of a band's centre a row lacks.
MASKS = ("m0", "m1", "m2", "m3")


def against(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For pairs (x, y) whether they are linked, how many shingles y has that x lacks (extra), and bits for those of x that y lacks."""
    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ty", SLICE):
            tx, ty = utf8(batch.column("tx")), utf8(batch.column("ty"))
            different = list(dict.fromkeys(tx + ty))
            sets = dict(zip(different, shingle_sets(different)))
            masks, extra = np.zeros((len(tx), len(MASKS)), np.uint64), []
            for i, (x, y) in enumerate(zip(tx, ty)):
                lost = np.setdiff1d(sets[x], sets[y], assume_unique=True)
                extra.append(len(sets[y]) - len(sets[x]) + len(lost))
                np.bitwise_or.at(masks[i], (lost >> np.uint64(6)).astype(np.int64) % len(MASKS), np.uint64(1) << (lost & np.uint64(63)))
            hit = pa.array([linked(sets[x], sets[y]) for x, y in zip(tx, ty)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), hit, pa.array(extra, pa.int32()), *(pa.array(m.view(np.int64)) for m in np.ascontiguousarray(masks.T))], names=["x", "y", "linked", "extra", *MASKS])

    return both.mapInArrow(run, "x long, y long, linked boolean, extra int, " + ", ".join(f"{m} long" for m in MASKS))


def possible() -> Column:
    """Whether two rows of a band can overlap enough for a link.

    n, n2: their shingles; u, u2: those that no other row has; extra: those that the band's centre (of nx shingles) lacks; the masks
    have at most one bit for each shingle of the centre that a row lacks. What both have is in the centre, and then neither lacks it, or is
    extra and not alone in both.
    """
    lost = sum((F.bit_count(F.col(m).bitwiseOR(F.col(f"{m}2"))) for m in MASKS), F.lit(0))
    through = F.col("nx") - lost + F.least(F.col("extra") - F.col("u"), F.col("extra2") - F.col("u2"))
    both = F.least(F.col("n") - F.col("u"), F.col("n2") - F.col("u2"), through)
    return PERCENT[0] * both >= PERCENT[1] * (F.col("n") + F.col("n2") - both)


NO_ID = (1 << 63) - 1


def grouped(docs: DataFrame) -> DataFrame:
    """rid, id (a null doc_id: NO_ID), n, label and component of each row of docs (doc_id, text; read from files).

    Rows with one label hang together by links; component is the smallest id among them. Rows without words have labels of their own.
    """
    return distilled(lambda: regrouped(docs), "groups")


def regrouped(docs: DataFrame) -> DataFrame:
    keyed = with_rid(docs, "doc_id", "text").select("rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    sketched = durable(sketches(keyed), "sketches")
    some = sketched.where("n > 0")
    classes = durable(some.groupBy("digest").agg(F.min("rid").alias("rep"), F.min("id").alias("least")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "registers")
    labels = distilled(lambda: link_labels(durable(reps, "reps"), keyed.select("rid", "text")), "link-labels")
    named = durable(classes.join(labels.withColumnRenamed("rid", "rep"), "rep", "left").select("digest", "least", F.coalesce("label", "rep").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of_class = durable(named.join(least, "label").select("digest", "label", "component"), "components")
    alone = F.col("n") == 0
    found = sketched.drop("registers").join(of_class, "digest", "left")
    return found.select("rid", "id", "n", F.when(alone, -1 - F.col("rid")).otherwise(F.col("label")).alias("label"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    """For each row of docs doc_id, n_shingles, component_id and kept.

    component_id is the smallest doc_id that links lead to; a null doc_id ranks last, so it is null only where no linked row has an
    id. kept: doc_id is component_id (both may be null). Rows without words are linked with nothing. Rows that repeat have
    equal sets, so they are linked. An empty table gives an empty result.
    """
    id_, component = (F.when(F.col(c) != NO_ID, F.col(c)) for c in ("id", "component"))
    return grouped(docs).select(id_.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), id_.eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (null last; of rows with one doc_id, the first)."""
    rows = grouped(docs)
    best = rows.groupBy("label").agg(F.min_by("rid", F.struct("id", "rid")).alias("best"))
    gone = durable(rows.join(best, "label").where("rid <> best").select("rid"), "gone")
    return without(whole_rows(docs), "rid", gone).select("doc.*")
