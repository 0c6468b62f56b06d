"""A Merkle manifest of a dataset, with checkpoints: of each tree only every few levels are stored.

A tree is built over the rows of each group (a source), and one more over the roots of all groups. What is stored are blocks: the nodes of one aligned
subtree's lowest level (ARITY ** step of them at most), for the leaves and for every step-th level above. Going up, a block is hashed to
its one node. For proofs, blocks are taken from the top down: each regenerates the nodes between, emits the siblings of each of its nodes
with the path that it got from above, and drops the rest. So a step holds one block and one path, whatever the group's size, and all the
paths above a block are written once for the block, not for each leaf.

Places of rows in their group come from slabs of rows sorted by range, numbered inside a slab and shifted by what the slabs before hold: a
group with a third of all rows spans many slabs and is never in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.common import distilled, durable, with_rid

#: Children of a node; levels from one stored level to the next; rows that a task numbers.
ARITY, STEP, SLAB_ROWS = 3, 4, 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: of each field its length in bytes, a colon and its value; a null field as a dash."""
    text = [f.cast("string") for f in fields]
    coded = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a string column g that isn't null) with pos, the place in its group from 0 by order (nulls first), and n, the rows of its group."""
    n_slabs = max(1, -(-rows.count() // SLAB_ROWS))
    keys = ["g", *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", slab int, at long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.array(batch.column("g").to_pylist(), object)
            starts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(g)))
            at = np.arange(len(g)) - np.repeat(starts, sizes)
            if g[0] == last:
                at[: sizes[0]] += seen
            last, seen = g[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), slab), pa.int32()), pa.array(at, pa.int64())], names=[*batch.schema.names, "slab", "at"])

    slabs = durable(rows.repartitionByRange(n_slabs, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema), "slabs")
    held = slabs.groupBy("g", "slab").agg(F.count("*").alias("held"))
    whole = Window.partitionBy("g")
    before = held.withColumns({"before": F.sum("held").over(whole.orderBy("slab").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held"), "n": F.sum("held").over(whole)}).drop("held")
    return slabs.join(before, ["g", "slab"]).withColumn("pos", F.col("before") + F.col("at")).drop("slab", "at", "before")


def blocks(nodes: DataFrame, step: int, *more: str) -> DataFrame:
    """Nodes (g, pos, n, node and more columns) as blocks: g, block, n and the array nodes by place, ARITY ** step of them at most."""
    items = F.array_sort(F.collect_list(F.struct("pos", "node", *more)))
    return nodes.groupBy("g", F.floor(F.col("pos") / ARITY**step).alias("block")).agg(F.first("n").alias("n"), items.alias("nodes"))


def levels(nodes: list[str], n: int, step: int) -> list[list[str]]:
    """All levels of a block, its own first: step more, or fewer where the group (n nodes on this level) is down to one node."""
    found = [nodes]
    while n > 1 and len(found) <= step:
        below = found[-1]
        found.append([digest_of(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return found


def lifted(stored: DataFrame, step: int) -> DataFrame:
    """The node over each block: g, pos, n (nodes of the group on that level), node. A group of one node keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = [levels(nodes, k, step)[-1][0] for nodes, k in zip(batch.column("nodes").to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array([-(-k // ARITY**step) for k in n], pa.int64()), pa.array(tops, pa.string())], names=["g", "pos", "n", "node"])

    return stored.select("g", "block", "n", F.col("nodes.node").alias("nodes")).mapInArrow(run, "g string, pos long, n long, node string")


class Trees(NamedTuple):
    """Trees of all groups: stored levels from the leaves up, and for each group its root and the stored level that the root lies over."""

    stored: list[DataFrame]
    roots: DataFrame
    step: int


def grown(rows: DataFrame, order: list[str], step: int, *more: str) -> Trees:
    """Trees over rows (g, node and more columns, which stay beside the leaves), their leaves in order within g."""
    stored, roots = [distilled(lambda: blocks(placed(rows, order), step, *more), "leaves")], []
    most = stored[0].agg(F.max("n")).first()[0] or 0
    while True:
        up = durable(lifted(stored[-1], step), "nodes")
        roots.append(up.where("n = 1").select("g", "node", F.lit(len(stored) - 1).alias("level")))
        most = -(-most // ARITY**step)
        if most <= 1:
            break
        stored.append(durable(blocks(up.where("n > 1"), step), "level"))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return Trees(stored, found, step)


def unfolded(stored: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """Each node of the blocks with its path to the root: g, pos, item (the block's entry), path, subroot.

    above: g, block, path, subroot. A path has two entries for each level: the joined digests of the siblings on the left, and those on the right.
    """
    item = stored.schema["nodes"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block at a time: paths of its nodes are some hundred kilobytes at most
                row = batch.slice(i, 1)
                items = row.column("nodes").flatten()
                own = pa.compute.struct_field(items, "node").to_pylist()
                found, upper = levels(own, row.column("n")[0].as_py(), step), row.column("path")[0].as_py()
                paths = []
                for k in range(len(own)):
                    path, at = [], k
                    for level in found[:-1]:
                        first = at - at % ARITY
                        path += ["".join(level[first:at]), "".join(level[at + 1 : first + ARITY])]
                        at //= ARITY
                    paths.append(path + upper)
                many = pa.array(np.zeros(len(own), np.int64))
                take = lambda c: row.column(c).take(many)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([take("g"), pa.compute.struct_field(items, "pos"), items, pa.array(paths, pa.list_(pa.string())), take("subroot")], names=["g", "pos", "item", "path", "subroot"])

    met = stored.join(above, ["g", "block"]).select("g", "n", "nodes", "path", "subroot")
    return met.mapInArrow(run, f"g string, pos long, item {item}, path array<string>, subroot string")


def descended(trees: Trees, above: DataFrame) -> DataFrame:
    """unfolded() for the leaves of all groups. above: g, path (from the group's root on) and subroot."""
    tops = trees.roots.select("g", "level").join(above, "g").withColumn("block", F.lit(0).cast("long"))
    paths = None
    for level in range(len(trees.stored) - 1, -1, -1):
        here = tops.where(F.col("level") == level).select("g", "block", "path", "subroot")
        if paths is not None:
            here = here.unionByName(paths.select("g", F.col("pos").alias("block"), "path", "subroot"))
        paths = unfolded(trees.stored[level], here, trees.step)
        if level:
            paths = durable(paths.drop("item"), "paths")
    return paths


class Manifest(NamedTuple):
    """The trees of all sources, and the tree over their roots."""

    trees: Trees
    over: Trees


def build(rows: DataFrame, group: str, order: list[str], *more: str, step: int = STEP) -> Manifest:
    """The manifest of rows (group, node, the columns of order and more), every step-th level stored. Groups are ordered by UTF-8 bytes, null first; rows in a group by order, nulls first."""
    g = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    trees = grown(rows.withColumn("g", g), order, step, *more)
    subroots = trees.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    return Manifest(trees, grown(subroots, ["name"], step, "name"))


def root(manifest: Manifest) -> str | None:
    """The digest of the whole dataset; None of an empty one."""
    found = manifest.over.roots.select("node").first()
    return found and found["node"]


def proofs(manifest: Manifest) -> DataFrame:
    """For every row: g, pos, item (pos, node and what build() was told to keep), path and subroot. path runs through the subroot to the root."""
    top = manifest.over.roots.select("g", F.expr("CAST(array() AS array<string>)").alias("path"), F.col("node").alias("subroot"))
    upper = descended(manifest.over, top).select(F.col("item.name").alias("g"), "path", F.col("item.node").alias("subroot"))
    return descended(manifest.trees, durable(upper, "sources"))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    step = lambda h, i: F.sha2(F.concat(F.element_at(path, (2 * i + 1).cast("int")), h, F.element_at(path, (2 * i + 2).cast("int"))).cast("binary"), 256)
    return F.when(F.size(path) == 0, node).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(path) / 2).cast("int") - 1)), node, step))


def digest(docs: DataFrame) -> DataFrame:
    """All documents with leaf, subroot, root, the digest of their proof, and what the proof says of a row that was tampered with.

    Null fields have digests of their own, empty texts are values like others. Rows of a source with equal doc_id (or none: they come first) lie
    in the order of their leaves; equal rows are leaves of their own. A row without doc_id isn't tampered with. An empty table gives an empty
    result. Other columns are left out. docs has to be read from files.
    """
    key = F.col("doc_id").cast("string")
    changed = F.when(F.crc32(key.cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    rows = with_rid(docs, *FIELDS).select("doc_id", "source", "rid", leaf(fields).alias("node"), leaf([*fields[:-1], changed]).alias("tampered"))
    manifest = build(rows, "source", ["doc_id", "node", "rid"], "doc_id", "tampered")
    whole = F.lit(root(manifest)).cast("string")
    found = proofs(manifest).select("item.doc_id", F.col("item.node").alias("leaf"), "subroot", whole.alias("root"), F.sha2(F.array_join("path", "").cast("binary"), 256).alias("proof_sha256"), folded(F.col("item.tampered"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_CODED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
_TEXT = "CASE WHEN {t} IS NULL THEN '-' ELSE strlen({t}) || ':' || {t} END"
_UP = "SELECT {g}level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {t} WHERE n > 1 GROUP BY {g}level, i // 3"
_SIDES = "array_to_string(r.hs[1:f.i % 3], '')", "array_to_string(r.hs[f.i % 3 + 2:], '')"
_CLIMB = f"sha256({_SIDES[0]} || f.h || {_SIDES[1]}), f.proof || {_SIDES[0]} || {_SIDES[1]}"
#: Trees, runs of siblings and paths as recursive queries; crc32 from its own table of 256 entries, which a rule gives.
ORACLE_SQL = f"""
WITH RECURSIVE bits(i, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, tab),
leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256({_CODED} || {_TEXT.format(t="text")}) AS leaf, sha256({_CODED} || {_TEXT.format(t="CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered FROM crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, level, i, h, n) AS (SELECT g, 0, i, leaf, n FROM ranked UNION ALL {_UP.format(g="g, ", t="tree")}),
roots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, i, h, n) AS (SELECT 0, i, h, n FROM roots UNION ALL {_UP.format(g="", t="top")}),
runs AS (SELECT g, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY g, level, i // 3),
topruns AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY level, i // 3),
f(doc_id, leaf, g, level, i, n, h, proof) AS (SELECT doc_id, leaf, g, 0, i, n, tampered, '' FROM ranked
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.level + 1, f.i // 3, (f.n + 2) // 3, {_CLIMB} FROM f JOIN runs r ON r.g = f.g AND r.level = f.level AND r.run = f.i // 3),
w(doc_id, leaf, subroot, level, i, n, h, proof) AS (SELECT f.doc_id, f.leaf, roots.h, 0, roots.i, roots.n, f.h, f.proof FROM f JOIN roots ON roots.g = f.g WHERE f.n = 1
  UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.i // 3, (f.n + 2) // 3, {_CLIMB} FROM w f JOIN topruns r ON r.level = f.level AND r.run = f.i // 3)
SELECT w.doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = top.h AS verified FROM w, top WHERE w.n = 1 AND top.n = 1"""
