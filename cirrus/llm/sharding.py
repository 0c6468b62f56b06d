"""Shards of nearly equal bytes by a k-d tree over the metadata of rows.

A node of the tree splits at the weighted quantile of the dimension in which its rows lie widest apart, so that both sides get the
bytes of the leaves they will hold; for an even number of leaves that is the weighted median. Quantiles are found on the cluster:
sums of bytes by ten bits of a key at a time, then again inside the one bin that the quantile falls into. A key is the dimension's
value followed by a hash of the text and one of the row, so rows that are alike in the dimension, or even in the text, still
split, and equal texts stay neighbours. The driver sees at most 1024 sums for each open node, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.common import durable, with_rid

#: Bits of a dimension's value and of the key behind it, and bits that one pass looks at.
VALUE_BITS, TIE_BITS, PASS_BITS = 20, 60, 10
#: A split is exact enough when the bin it falls into has this share of a leaf's bytes.
EXACT = 1e-4
#: Rows that one task numbers.
ROWS_PER_TASK = 100_000


@dataclass
class Node:
    """Leaves first to last of the tree, and how the node is split: rows with (value, tie) up to the bound go left."""

    first: int
    last: int
    dim: int = 0
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self, dims: list[Column], tie: Column, leaves: list[Node]) -> Column:
        """The place in leaves of the leaf that a row falls into; leaves is filled in passing."""
        if self.left is None or self.right is None:
            leaves.append(self)
            return F.lit(len(leaves) - 1)
        d, v = dims[self.dim], F.lit(self.value)
        down = (d < v) | ((d == v) & (tie <= F.lit(self.tie)))
        return F.when(down, self.left.column(dims, tie, leaves)).otherwise(self.right.column(dims, tie, leaves))


def metadata(docs: DataFrame) -> list[Column]:
    """The dimensions of documents: language, source, length and id. A null is the smallest value of a dimension."""
    named = lambda c: F.crc32(F.col(c).cast("string")) if c in docs.columns else F.lit(0)
    return [named("lang"), named("source"), F.log2(F.octet_length("text") + F.lit(1)), F.col("doc_id").cast("double")]


def points(docs: DataFrame, dims: list[Column]) -> DataFrame:
    """doc_id, rid, size, text_crc32, tie and the dimensions d0, d1, ... as numbers of VALUE_BITS bits, kept as a table."""
    names = [f"d{i}" for i in range(len(dims))]
    rows = with_rid(docs.select("doc_id", F.col("text").alias("text"), *[F.coalesce(d.cast("double"), F.lit(float("-inf"))).alias(n) for d, n in zip(dims, names)]), "doc_id", "text", *names)
    finite = lambda n: F.when(F.col(n) > F.lit(float("-inf")), F.col(n))
    spread = rows.agg(*[f(finite(n)).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()

    def scaled(n: str) -> Column:
        lo, hi = spread[f"lo{n}"], spread[f"hi{n}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        top = (1 << VALUE_BITS) - 2
        return F.when(F.col(n) < lo, F.lit(0)).otherwise(1 + F.floor((F.col(n) - lo) / (hi - lo) * top)).cast("long")

    crc, half = F.crc32(F.coalesce("text", F.lit(""))), 1 << TIE_BITS // 2
    tie = (crc % half) * half + F.pmod(F.xxhash64("doc_id", "rid"), F.lit(half))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    return durable(rows.select("doc_id", "rid", size.alias("size"), crc.alias("text_crc32"), tie.alias("tie"), *[scaled(n).alias(n) for n in names]), "points")


def grow(rows: DataFrame, n_dims: int, n_shards: int) -> Node:
    """The tree with n_shards leaves."""
    dims, tie, root = [F.col(f"d{i}") for i in range(n_dims)], F.col("tie"), Node(0, n_shards)
    while True:
        leaves: list[Node] = []
        node = root.column(dims, tie, leaves)
        if all(x.last - x.first == 1 for x in leaves):
            return root
        placed = rows.withColumn("node", node)
        spans = [F.max(d) - F.min(d) for d in dims]
        facts = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("total"), *[s.alias(f"s{i}") for i, s in enumerate(spans)]).collect()}
        todo = {}
        for i, x in enumerate(leaves):
            if x.last - x.first > 1:
                half = x.first + (x.last - x.first) // 2
                x.left, x.right = Node(x.first, half), Node(half, x.last)
                if i in facts:
                    x.dim = max(range(n_dims), key=lambda j, i=i: facts[i][f"s{j}"])
                    todo[i] = (x, facts[i]["total"] * (half - x.first) / (x.last - x.first), facts[i]["total"] / (x.last - x.first))
        quantiles(placed, todo, dims, tie)


def pick(values: dict[int, object], other: Column) -> Column:
    """The value for each node, by a map of constants."""
    if not values:
        return other
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("node"))


def quantiles(placed: DataFrame, todo: dict[int, tuple[Node, float, float]], dims: list[Column], tie: Column) -> None:
    """Sets the bounds of nodes; todo: node, bytes wanted on its left, bytes of a leaf."""
    whole, prefix, shift = VALUE_BITS + TIE_BITS, dict.fromkeys(todo, 0), VALUE_BITS + TIE_BITS
    open_, left = set(todo), dict.fromkeys(todo, 0)
    while open_ and shift:
        shift -= PASS_BITS
        value = F.element_at(F.array(*dims), pick({i: todo[i][0].dim + 1 for i in open_}, F.lit(1)))
        in_value = shift >= TIE_BITS
        above = F.shiftright(value, shift - TIE_BITS) if in_value else F.shiftright(tie, shift)
        rows = placed.where(F.col("node").isin(list(open_)))
        if shift + PASS_BITS < whole:  # only rows inside the bin found so far
            if in_value:
                rows = rows.where(F.shiftright(value, shift + PASS_BITS - TIE_BITS) == pick({i: prefix[i] for i in open_}, F.lit(0)))
            else:
                rows = rows.where(value == pick({i: prefix[i] >> (TIE_BITS - shift - PASS_BITS) for i in open_}, F.lit(0)))
                if shift + PASS_BITS < TIE_BITS:
                    rows = rows.where(F.shiftright(tie, shift + PASS_BITS) == pick({i: prefix[i] & ((1 << (TIE_BITS - shift - PASS_BITS)) - 1) for i in open_}, F.lit(0)))
        bins: dict[int, dict[int, int]] = {i: {} for i in open_}
        for r in rows.groupBy("node", above.bitwiseAND(F.lit((1 << PASS_BITS) - 1)).alias("bin")).agg(F.sum("size").alias("size")).collect():
            bins[r["node"]][r["bin"]] = r["size"]
        for i in list(open_):
            _, want, leaf = todo[i]
            at, b = left[i], -1
            for b in sorted(bins[i]):
                if at + bins[i][b] >= want or b == max(bins[i]):
                    break
                at += bins[i][b]
            bin_bytes = bins[i].get(b, 0)
            if bin_bytes <= EXACT * leaf or not shift:
                if want - at < bin_bytes / 2:
                    b -= 1  # the nearer end of the bin; b may be -1, just before the prefix
                bound = (((prefix[i] << PASS_BITS) + b + 1) << shift) - 1
                todo[i][0].value, todo[i][0].tie = bound >> TIE_BITS, bound & ((1 << TIE_BITS) - 1)
                open_.discard(i)
            else:
                prefix[i], left[i] = (prefix[i] << PASS_BITS) + b, at


def shard(docs: DataFrame, n_shards: int = 40, dims: list[Column] | None = None) -> DataFrame:
    """Puts documents (doc_id, text; read from files) into shards whose bytes are nearly equal, and numbers each shard's rows from 0.

    A row's size is its text's UTF-8 bytes (null: none) plus 16, so rows without text spread too. Rows that repeat, and rows whose
    doc_id is null, are rows like others. An empty table gives an empty result.
    """
    dims = dims or metadata(docs)
    rows = points(docs, dims)
    leaves: list[Node] = []
    tree = grow(rows, len(dims), n_shards)
    place = tree.column([F.col(f"d{i}") for i in range(len(dims))], F.col("tie"), leaves)
    first = F.element_at(F.array(*[F.lit(x.first) for x in leaves]), place + 1)
    placed = rows.select("doc_id", "rid", "size", "text_crc32", "tie", first.alias("shard"))
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    most = min(ROWS_PER_TASK, max(1, sum(counts.values()) // (4 * n_shards)))
    chunks = F.element_at(F.array(*[F.lit(-(-counts.get(i, 0) // most) or 1) for i in range(n_shards)]), F.col("shard") + 1)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int"))
    before = placed.groupBy("shard", "chunk").count().select("shard", "chunk", (F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count")).alias("before"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("tie", "rid")))
    return numbered.join(before, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
