"""Connected components, and spanning forests of the best edges with a sign carried along them.

Frames of up to HELD edges are dealt out, and a task contracts each as arrays. Larger frames are shrunk in rounds by all tasks. In a round each vertex hooks onto one neighbour, the trees that arise are flattened by pointer doubling, and what is left are edges
between different trees, one for each pair. Vertices at least halve (in components, local minima stay), edges go with them, and each
round's map is written once. Rounds work on all large frames at once; no task holds such a frame or a component of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cirrus.plans.lineage import cut

#: Edges of a frame that one task takes at most (some 60 MB with all that is made from them).
HELD = 1 << 18
#: Steps of pointer doubling between two looks at whether a round's trees are flat.
DOUBLINGS = 3


def undirected(pairs: DataFrame) -> DataFrame:
    """Pairs (frame, pid, nn_pid) as edges u < v, each once."""
    ends = [F.least("pid", "nn_pid").alias("u"), F.greatest("pid", "nn_pid").alias("v")]
    return pairs.where("pid <> nn_pid").select("frame", *ends).distinct()


def _flat(parents: DataFrame) -> DataFrame:
    """Each vertex (a) with its tree's root and the product of the signs on the way."""
    while True:
        start = parents
        for _ in range(DOUBLINGS):
            up = parents.select("frame", F.col("a").alias("parent"), F.col("parent").alias("far"), F.col("sign").alias("far_sign"))
            parents = parents.join(up, ["frame", "parent"]).select("frame", "a", F.col("far").alias("parent"), (F.col("sign") * F.col("far_sign")).alias("sign"))
        parents = cut(parents)
        moved = parents.join(start.select("frame", "a", F.col("parent").alias("old")), ["frame", "a"]).where("parent <> old")
        if moved.isEmpty():
            return parents


def _contracted(edges: DataFrame, hooked: Column | None, best: Column) -> DataFrame:
    """frame, pid, root and sign for each vertex of edges (frame, u, v, sign and what best needs).

    best orders the edges at a vertex (as seen from a to b); hooked, if given, tells whether the vertex takes its best edge, else every vertex
    does, and of two that take the same edge the smaller one is the root.
    """
    maps, more = [], [c for c in edges.columns if c not in ("frame", "u", "v", "sign")]
    edges = cut(edges)
    while not edges.isEmpty():
        both = edges.withColumns({"a": F.col("u"), "b": F.col("v")}).unionByName(edges.withColumns({"a": F.col("v"), "b": F.col("u")}))
        hooks = both.groupBy("frame", "a").agg(F.max_by(F.struct("b", "sign"), best).alias("to")).select("frame", "a", "to.b", "to.sign")
        if hooked is None:
            hooks = cut(hooks)
            back = hooks.select("frame", F.col("a").alias("b"), F.col("b").alias("again"))
            met = hooks.join(back, ["frame", "b"])
            stays = (F.col("again") == F.col("a")) & (F.col("a") < F.col("b"))
        else:
            met, stays = hooks, ~hooked
        parents = cut(met.select("frame", "a", F.when(stays, F.col("a")).otherwise(F.col("b")).alias("parent"), F.when(stays, 1).otherwise(F.col("sign")).alias("sign")))
        flat = _flat(parents)
        maps.append(flat)
        end = lambda c: flat.select("frame", F.col("a").alias(c), F.col("parent").alias(f"{c}2"), F.col("sign").alias(f"{c}_sign"))  # noqa: B023, E731
        joined = edges.join(end("u"), ["frame", "u"]).join(end("v"), ["frame", "v"]).where("u2 <> v2")
        renamed = joined.select("frame", F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"), (F.col("sign") * F.col("u_sign") * F.col("v_sign")).alias("sign"), *more)
        kept = F.struct("sign", *more)
        edges = cut(renamed.groupBy("frame", "u", "v").agg((F.max_by(kept, best) if more else F.first(kept)).alias("e")).select("frame", "u", "v", "e.*"))
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], edges.select("frame", F.col("u").alias("pid"), F.col("u").alias("root"), F.col("sign")).schema)
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        above = whole.select("frame", F.col("a").alias("parent"), F.col("parent").alias("top"), F.col("sign").alias("top_sign"))
        met = earlier.join(above, ["frame", "parent"], "left")
        whole = met.select("frame", "a", F.coalesce("top", "parent").alias("parent"), (F.col("sign") * F.coalesce("top_sign", F.lit(1))).alias("sign"))
    return cut(whole.select("frame", F.col("a").alias("pid"), F.col("parent").alias("root"), "sign"))


def grown(u: np.ndarray, v: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices of edges in order, for each the number of its tree's root, and the product of the signs on the way, in the forest of the edges that come first.

    As in the rounds below: each tree takes its first edge to another one, of two that take the same the smaller is the root, and pointers are doubled.
    """
    vertex, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, me = ends[: len(u)], ends[len(u) :], np.arange(len(vertex))
    root, turn = me, np.ones(len(vertex), np.int64)
    while len(a):
        first = np.full(len(vertex), -1)
        first[np.stack([a, b], 1).ravel()[::-1]] = np.repeat(np.arange(len(a)), 2)[::-1]  # the last one written is the first edge
        some = np.flatnonzero(first >= 0)
        up, way = me.copy(), np.ones(len(vertex), np.int64)
        up[some], way[some] = a[first[some]] + b[first[some]] - some, sign[first[some]]
        top = (up[up] == me) & (me < up)
        up[top], way[top] = me[top], 1
        while (up[up] != up).any():
            way, up = way * way[up], up[up]
        turn, root = turn * way[root], up[root]
        a, b, sign = up[a], up[b], sign * way[a] * way[b]
        apart = a != b
        a, b, sign = a[apart], b[apart], sign[apart]
    return vertex, root, turn


def _dealt(edges: DataFrame, tree: Callable[[pa.Table], tuple[np.ndarray, ...]], rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frame, pid, root and sign for each vertex of edges: of small frames by tree, of the others by rounds."""
    edges = cut(edges)
    sizes = edges.groupBy("frame").count()
    most = sizes.agg(F.max("count")).first()[0]
    if most is None:
        return rounds(edges)
    kinds = [edges.schema[c].dataType.simpleString() for c in ("frame", "u", "u", "sign")]

    def run(rows: pa.Table) -> pa.Table:
        got = tree(rows)
        return pa.table([pa.repeat(rows.column("frame")[0], len(got[0])), *map(pa.array, got)], names=["frame", "pid", "root", "sign"])

    small = edges if most <= HELD else edges.join(sizes.where(F.col("count") > HELD).hint("merge"), "frame", "left_anti")
    found = cut(small.groupBy("frame").applyInArrow(run, ", ".join(f"{c} {kind}" for c, kind in zip(("frame", "pid", "root", "sign"), kinds))))
    return found if most <= HELD else found.unionByName(rounds(edges.join(sizes.where(F.col("count") > HELD).hint("merge"), "frame", "left_semi")))


def components(edges: DataFrame) -> DataFrame:
    """frame, pid and root, the least vertex of its component, for each vertex of edges (frame, u, v)."""

    def tree(rows: pa.Table) -> tuple[np.ndarray, ...]:
        u, v, sign = (rows.column(c).to_numpy() for c in ("u", "v", "sign"))
        vertex, root, turn = grown(u, v, sign)
        least = np.empty(len(vertex), np.int64)
        least[root[::-1]] = np.arange(len(vertex))[::-1]
        return vertex, vertex[least[root]], turn.astype(sign.dtype)

    rounds = lambda e: _contracted(e, F.col("b") < F.col("a"), -F.col("b"))
    return _dealt(edges.select("frame", "u", "v", F.lit(1).alias("sign")), tree, rounds).select("frame", "pid", "root")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """frame, pid, root and sign: the product of the signs on the path to the root in the forest of the greatest weights.

    edges: frame, u < v, weight, sign (1 or -1). Of equal weights the edge with the smaller ends goes first, so the forest is the
    only one there is. Roots are arbitrary vertices of their trees.
    """

    def tree(rows: pa.Table) -> tuple[np.ndarray, ...]:
        u, v, sign = (rows.column(c).to_numpy() for c in ("u", "v", "sign"))
        weight = rows.column("weight").cast(pa.float64()).fill_null(-np.inf).to_numpy()
        order = np.lexsort((v, u, -weight, ~np.isnan(weight)))  # to Spark, NaN is the greatest
        vertex, root, turn = grown(u[order], v[order], sign[order])
        return vertex, vertex[root], turn.astype(sign.dtype)

    given = lambda e: e.select("frame", "u", "v", "sign", "weight", (-F.col("u")).alias("first"), (-F.col("v")).alias("second"))
    return _dealt(edges.select("frame", "u", "v", "sign", "weight"), tree, lambda e: _contracted(given(e), None, F.struct("weight", "first", "second")))
