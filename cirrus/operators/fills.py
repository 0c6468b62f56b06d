"""Unoccupied pixels filled from a pyramid: smoothed push-pull, and the harmonic function between the occupied pixels.

A layer is dealt in square tiles with a margin, dense arrays of bounded size, so a frame of any size is spread over tasks. n rounds of a stencil
need one exchange only, of a margin n wide. The harmonic fill solves each tile against its margin and passes strips to the eight tiles around, until
no strip changes; a coarser layer gives the first guess. A canvas that fits in a tile takes a single task without any exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirrus.operators.images import CHANNELS, pulled
from cirrus.plans.lineage import cut

#: Widest canvas side at which a pyramid ends.
LAST = 4
KEYS = ("frame", "ty", "tx", "w", "h")
PIXELS = "frame int, x int, y int, " + ", ".join(f"{c} int" for c in CHANNELS)
#: A tile's own values (fixed: which cells of the tile with its margin are given) and strips of it on the way to the tiles around.
PIECES = "frame int, ty int, tx int, w int, h int, y0 int, x0 int, high int, wide int, own boolean, change double, v array<double>, fixed array<boolean>"


def halvings(w: int, h: int) -> int:
    """Layers below a canvas, one at least, until a side is at most LAST."""
    n = 0
    while not n or (w > LAST and h > LAST):
        w, h, n = (w + 1) // 2, (h + 1) // 2, n + 1
    return n


# ---- dense arrays ---------------------------------------------------------------------------------------------------


def region(t: int, side: int, tile: int, margin: int) -> tuple[int, int]:
    """From where to where the t-th tile of a side reaches with its margin, on the canvas."""
    return max(0, t * tile - margin), min(side, (t + 1) * tile + margin)


def refilled(known: np.ndarray, values: np.ndarray, coarse: np.ndarray, at: tuple[int, int], coarse_at: tuple[int, int], coarse_size: tuple[int, int]) -> np.ndarray:
    """values with each unknown cell as the mean of the four nearest cells of the coarser layer, weighted 144, 48, 48 and 16, cut off."""
    total, weight = np.zeros(values.shape, np.int64), np.zeros(known.shape, np.int64)
    picks = []
    for n, start, low, size in zip(known.shape, at, coarse_at, coarse_size):
        own = (start + np.arange(n)) // 2
        side = own + np.where((start + np.arange(n)) % 2, 1, -1)
        there = (side >= 0) & (side < size)
        picks.append(((own - low, np.full(n, 12)), (np.where(there, side, own) - low, np.where(there, 4, 0))))
    for rows, a in picks[0]:
        for columns, b in picks[1]:
            w = a[:, None] * b[None, :]
            total += coarse[rows][:, columns] * w[..., None]
            weight += w
    return np.where(known[..., None], values, total // weight[..., None])


def smoothed(known: np.ndarray, values: np.ndarray, rounds: int) -> np.ndarray:
    """Unknown cells as the mean of the eight around, a half rounded up, all at once; places beyond the ends are those at the ends."""
    ends = [(np.maximum(np.arange(n) - 1, 0), np.arange(n), np.minimum(np.arange(n) + 1, n - 1)) for n in known.shape]
    for _ in range(rounds):
        across = [values[:, c] for c in ends[1]]
        total = sum(a[r] for a in across for r in ends[0]) - values
        values = np.where(known[..., None], values, (total + 4) >> 3)
    return values


def halved(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = known.shape
    k = np.pad(known, ((0, h % 2), (0, w % 2))).reshape((h + 1) // 2, 2, (w + 1) // 2, 2).sum((1, 3))
    v = np.pad(np.where(known[..., None], values, 0), ((0, h % 2), (0, w % 2), (0, 0))).reshape((h + 1) // 2, 2, (w + 1) // 2, 2, -1).sum((1, 3))
    return k > 0, v // np.maximum(k, 1)[..., None]


def whole_pyramid(known: np.ndarray, values: np.ndarray, first: int, most: int) -> np.ndarray:
    """A canvas in one array, filled from all layers below it."""
    layers = [(known, np.where(known[..., None], values, 0))]
    for _ in range(halvings(known.shape[1], known.shape[0])):
        layers.append(halved(*layers[-1]))
    out = layers.pop()[1]
    for n, (k, v) in enumerate(reversed(layers)):
        out = smoothed(k, refilled(k, v, out, (0, 0), (0, 0), out.shape[:2]), min(first + n, most))
    return out


def relaxed(fixed: np.ndarray, values: np.ndarray, bound: float) -> np.ndarray:
    """Cells that aren't fixed as the mean of those beside them: red-black over-relaxation until no step is above bound."""
    if fixed.all():
        return values
    around = np.pad(np.ones(fixed.shape), 1)
    count = (around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:])[..., None]
    x = np.pad(values, ((1, 1), (1, 1), (0, 0)))
    inner = x[1:-1, 1:-1]
    odd = np.add.outer(np.arange(fixed.shape[0]), np.arange(fixed.shape[1])) % 2
    step = 2 / (1 + math.sin(math.pi / (max(fixed.shape) + 1)))
    turns = [((odd == c) & ~fixed)[..., None] * step for c in (0, 1)]
    while True:
        largest = 0.0
        for turn in turns:
            move = ((x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]) / count - inner) * turn
            inner += move
            largest = max(largest, float(np.abs(move).max()))
        if largest <= bound:
            return inner.copy()


# ---- layers ---------------------------------------------------------------------------------------------------------


def bounds(pixels: DataFrame) -> DataFrame:
    """frame, w and h of the canvases with an occupied pixel."""
    return pixels.groupBy("frame").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"), F.max("occ").alias("any")).where("any = 1").drop("any")


def shrunk(sizes: DataFrame, layer: int) -> DataFrame:
    return sizes.withColumns({c: F.ceil(F.col(c) / (1 << layer)).cast("int") for c in "wh"})


def dealt(rows: DataFrame, sizes: DataFrame, kind: int, tile: int, margin: int, scale: int = 1, reach: tuple[int, int] = (0, 0)) -> DataFrame:
    """rows (frame, x, y, channels) once for each tile of the layer (sizes) that they lie in or beside."""

    def tiles(c: str, side: str) -> F.Column:
        low = F.floor((F.col(c) * scale - reach[0] - margin) / tile)
        high = F.floor((F.col(c) * scale + reach[1] + margin) / tile)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.floor((F.col(side) - 1) / tile)).cast("int")))

    placed = rows.select("frame", "x", "y", *CHANNELS).join(sizes, "frame")
    return placed.withColumn("tx", tiles("x", "w")).withColumn("ty", tiles("y", "h")).select(*KEYS, F.lit(kind).alias("kind"), "x", "y", *CHANNELS)


def grid(sizes: DataFrame, tile: int) -> DataFrame:
    """One row for each tile, so that tiles without any pixel are there too."""
    count = lambda side: F.explode(F.sequence(F.lit(0), F.floor((F.col(side) - 1) / tile).cast("int")))
    at = sizes.withColumn("tx", count("w")).withColumn("ty", count("h"))
    return at.select(*KEYS, F.lit(2).alias("kind"), *[F.lit(0).alias(c) for c in ("x", "y", *CHANNELS)])


def arrays(rows: pa.Table, kind: int, at: tuple[int, int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which cells of an array have a row of this kind, and their values; 0 elsewhere."""
    of = np.flatnonzero(rows.column("kind").to_numpy() == kind)
    y, x = (rows.column(c).to_numpy()[of] - a for c, a in zip("yx", at))
    inside = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1])
    known, values = np.zeros(shape, bool), np.zeros((*shape, len(CHANNELS)), np.int64)
    known[y[inside], x[inside]] = True
    for k, c in enumerate(CHANNELS):
        values[y[inside], x[inside], k] = rows.column(c).to_numpy()[of][inside]
    return known, values


def by_tile(rows: DataFrame, run: Callable[..., pa.Table], schema: str) -> DataFrame:
    return rows.groupBy(*KEYS).applyInArrow(run, schema)


def layers_of(pixels: DataFrame, sizes: DataFrame, depth: int) -> list[DataFrame]:
    out = [pixels.where("occ = 1").select("frame", "x", "y", *CHANNELS, "occ").join(sizes.select("frame"), "frame", "left_semi")]
    for _ in range(depth):
        out.append(cut(pulled(out[-1])))
    return out


def down_to(side: F.Column, most: int) -> F.Column:
    """How many halvings take a side to most, by the length of a binary number."""
    n = (F.ceil(side / most) - 1).cast("long")
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def fitting(tile: int) -> F.Column:
    """The first layer that fits in a tile."""
    return down_to(F.greatest("w", "h"), tile)


def coarse_span(low: int, high: int, side: int) -> tuple[int, int]:
    return max(0, low // 2 - 1), min((side + 1) // 2, (high - 1) // 2 + 2)


def smoothed_push_pull(pixels: DataFrame, first: int = 4, most: int = 16, tile: int = 64) -> DataFrame:
    """All places of the frames' canvases (frame, x, y, channels) from pixels (with occ; 1: occupied), each place once at most, whole non-negative values.

    Layers are halved until a side is at most 4; empty places of the last one count as 0. Each layer above is filled from the one below and its
    filled places are smoothed, first times in the lowest, once more in each further one, most times at most. Frames without an occupied pixel have no rows.
    """
    low = F.greatest(F.least(down_to(F.col("w"), LAST), down_to(F.col("h"), LAST)), F.lit(1))
    sizes = cut(bounds(pixels).withColumn("start", F.least(fitting(tile), low - 1)))
    top = sizes.agg(F.max("start")).first()[0]
    if top is None:
        return pixels.select("frame", "x", "y", *[F.col(c).cast("int").alias(c) for c in CHANNELS]).limit(0)
    layers = layers_of(pixels, sizes, top + 1)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        frame, ty, tx, w, h = (k.as_py() for k in key)
        if max(w, h) <= tile:
            y, x = 0, 0
            inner = whole_pyramid(*arrays(rows, 0, (0, 0), (h, w)), first, most)
        else:
            (ya, yb), (xa, xb) = region(ty, h, tile, most), region(tx, w, tile, most)
            (ca, cb), (da, db) = coarse_span(ya, yb, h), coarse_span(xa, xb, w)
            known, values = arrays(rows, 0, (ya, xa), (yb - ya, xb - xa))
            coarse = arrays(rows, 1, (ca, da), (cb - ca, db - da))[1]
            done = smoothed(known, refilled(known, values, coarse, (ya, xa), (ca, da), ((h + 1) // 2, (w + 1) // 2)), min(first + halvings(w, h) - 1, most))
            y, x = ty * tile, tx * tile
            inner = done[y - ya : y - ya + tile, x - xa : x - xa + tile]
        at = np.indices(inner.shape[:2])
        columns = [np.full(inner.shape[:2], frame), at[1] + x, at[0] + y, *(inner[..., k] for k in range(len(CHANNELS)))]
        return pa.table([pa.array(c.ravel().astype(np.int32)) for c in columns], names=["frame", "x", "y", *CHANNELS])

    out = None
    for i in range(top, -1, -1):
        here = shrunk(sizes.where(F.col("start") >= i), i)
        rows = dealt(layers[i], here.select("frame", "w", "h"), 0, tile, most).unionByName(grid(here, tile))
        # Canvases that end here without fitting in a tile: the last layer as it is.
        ends = here.where((F.col("start") == i) & (F.greatest("w", "h") > tile)).select("frame", "w", "h")
        rows = rows.unionByName(dealt(layers[i + 1], ends, 1, tile, most, 2, (2, 3)))
        if out is not None:
            rows = rows.unionByName(dealt(out, here.where(F.col("start") > i).select("frame", "w", "h"), 1, tile, most, 2, (2, 3)))
        out = by_tile(rows, run, PIXELS)
        out = cut(out) if i else out
    return out


# ---- harmonic fill --------------------------------------------------------------------------------------------------


def pieces(key: tuple[int, ...], tile: int, margin: int, at: tuple[int, int], values: np.ndarray, fixed: np.ndarray, change: float) -> pa.Table:
    """A tile's own values, and what the tiles around see of it in their margins; values and fixed begin at `at`."""
    frame, ty, tx, w, h = key
    mine = (ty * tile, min(h, ty * tile + tile)), (tx * tile, min(w, tx * tile + tile))
    out = []
    for y in range(max(0, ty - 1), min(-(-h // tile), ty + 2)):
        for x in range(max(0, tx - 1), min(-(-w // tile), tx + 2)):
            own = (y, x) == (ty, tx)
            (ya, yb), (xa, xb) = ((max(m[0], r[0]), min(m[1], r[1])) for m, r in zip(mine, (region(y, h, tile, margin), region(x, w, tile, margin))))
            if ya >= yb or xa >= xb:
                continue
            part = values[ya - at[0] : yb - at[0], xa - at[1] : xb - at[1]]
            out.append((frame, y, x, w, h, ya, xa, yb - ya, xb - xa, own, change, part.ravel(), fixed.ravel() if own else None))
    types = [pa.int32()] * 9 + [pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.bool_())]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def solved(fixed: np.ndarray, values: np.ndarray, spans: tuple, sides: tuple[int, int], bound: float) -> np.ndarray:
    """A tile with its margin: given cells and the outermost cells of the margin stay, unless those lie at the canvas's end."""
    held = fixed.copy()
    for axis, ((a, b), side) in enumerate(zip(spans, sides)):
        edge = np.moveaxis(held, axis, 0)
        if a > 0:
            edge[0] = True
        if b < side:
            edge[-1] = True
    return relaxed(held, values, bound)


def harmonic_fill(pixels: DataFrame, bound: float = 1e-3, tile: int = 64, margin: int = 16) -> DataFrame:
    """All places of the frames' canvases (frame, x, y, channels as doubles) from pixels (with occ; 1: occupied), each place once at most.

    Occupied pixels keep their values, any other is the mean of the (two to four) pixels beside it. Rounds end for a frame when no tile moves by more than
    bound. Frames without an occupied pixel have no rows.
    """
    sizes = cut(bounds(pixels).withColumn("start", fitting(tile)))
    top = sizes.agg(F.max("start")).first()[0]
    if top is None:
        return pixels.select("frame", "x", "y", *[F.col(c).cast("double").alias(c) for c in CHANNELS]).limit(0)
    layers = layers_of(pixels, sizes, top)
    fine = bound / 100

    def begun(key: tuple, rows: pa.Table) -> pa.Table:
        frame, ty, tx, w, h = key = tuple(k.as_py() for k in key)
        (ya, yb), (xa, xb) = spans = region(ty, h, tile, margin), region(tx, w, tile, margin)
        known, values = arrays(rows, 0, (ya, xa), (yb - ya, xb - xa))
        if max(w, h) <= tile:
            guess = np.broadcast_to(values[known].mean(0), values.shape)
        else:
            (ca, cb), (da, db) = coarse_span(ya, yb, h), coarse_span(xa, xb, w)
            coarse = arrays(rows, 1, (ca, da), (cb - ca, db - da))[1]
            guess = coarse[np.arange(ya, yb) // 2 - ca][:, np.arange(xa, xb) // 2 - da]
        start = np.where(known[..., None], values, guess).astype(float)
        return pieces(key, tile, margin, (ya, xa), solved(known, start, spans, (h, w), fine), known, 0.0 if max(w, h) <= tile else math.inf)

    def again(key: tuple, rows: pa.Table) -> pa.Table:
        frame, ty, tx, w, h = key = tuple(k.as_py() for k in key)
        (ya, yb), (xa, xb) = spans = region(ty, h, tile, margin), region(tx, w, tile, margin)
        values, moved = np.zeros((yb - ya, xb - xa, len(CHANNELS))), 0.0
        for r in range(rows.num_rows):
            y, x, high, wide, own, change = (rows.column(c)[r].as_py() for c in ("y0", "x0", "high", "wide", "own", "change"))
            values[y - ya : y - ya + high, x - xa : x - xa + wide] = rows.column("v")[r].values.to_numpy().reshape(high, wide, -1)
            if own:
                fixed = rows.column("fixed")[r].values.to_numpy(zero_copy_only=False).reshape(yb - ya, xb - xa)
            else:
                moved = max(moved, change)
        if moved <= bound:
            return pieces(key, tile, margin, (ya, xa), values, fixed, 0.0)
        done = solved(fixed, values, spans, (h, w), fine)
        mine = slice(ty * tile - ya, ty * tile - ya + tile), slice(tx * tile - xa, tx * tile - xa + tile)
        return pieces(key, tile, margin, (ya, xa), done, fixed, float(np.abs(done - values)[mine].max()))

    out = None
    for i in range(top, -1, -1):
        here = shrunk(sizes.where(F.col("start") >= i), i)
        rows = dealt(layers[i], here.select("frame", "w", "h"), 0, tile, margin).unionByName(grid(here, tile))
        if out is not None:
            whole = out.select("frame", "x", "y", *[F.round(c).cast("int").alias(c) for c in CHANNELS])
            rows = rows.unionByName(dealt(whole, here.where(F.col("start") > i).select("frame", "w", "h"), 1, tile, margin, 2, (2, 3)))
        state, settled = cut(by_tile(rows, begun, PIECES)), []
        while True:
            still = cut(state.groupBy("frame").agg(F.max("change").alias("most")).where(F.col("most") > bound).select("frame"))
            settled.append(state.where("own").join(still, "frame", "left_anti"))
            if still.isEmpty():
                break
            state = cut(by_tile(state.join(still, "frame", "left_semi"), again, PIECES))
        tiles = settled[0]
        for s in settled[1:]:
            tiles = tiles.unionByName(s)
        n = len(CHANNELS)
        cells = tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("high") * F.col("wide") - 1)))
        out = cells.select("frame", (F.col("x0") + F.col("k") % F.col("wide")).cast("int").alias("x"), (F.col("y0") + F.floor(F.col("k") / F.col("wide"))).cast("int").alias("y"), *[F.element_at("v", F.col("k") * n + j + 1).alias(c) for j, c in enumerate(CHANNELS)])
        out = cut(out) if i else out
    return out
