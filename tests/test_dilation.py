"""Filling of unoccupied pixels against a walk in raster order."""

import random

import pytest

from cirrus.operators import dilation, neighbours


def plain(pixels, wide, high, block):
    """pixels: occupied values by place; a canvas of wide by high blocks."""
    image = {}
    for by in range(high):
        for bx in range(wide):
            inside = [(bx * block + u, by * block + v) for v in range(block) for u in range(block)]
            wave = {p: pixels[p] for p in inside if p in pixels}
            if wave:
                known = dict(wave)
                while len(known) < len(inside):
                    reached = {}
                    for (x, y), value in wave.items():
                        for p in ((x, y - 1), (x - 1, y), (x + 1, y), (x, y + 1)):
                            if p in inside and p not in known:
                                reached.setdefault(p, []).append(value)
                    wave = {p: tuple((sum(c) + len(vs) // 2) // len(vs) for c in zip(*vs)) for p, vs in reached.items()}
                    known |= wave
                image |= known
            else:
                for x, y in inside:
                    image[x, y] = image[x - 1, y] if bx else image[x, y - 1] if by else (0, 0)
    return image


@pytest.mark.parametrize(("seed", "block", "share"), [(1, 4, 0.04), (2, 4, 0.5), (3, 8, 0.01), (4, 2, 0.03)])
def test_dilation(spark, seed, block, share):
    """Empty corners, empty rows and columns of blocks, blocks with one pixel; unoccupied pixels don't count but make the canvas larger."""
    rng, rows, expected = random.Random(seed), [], {}
    for frame, (wide, high) in enumerate(((5, 4), (3, 6), (1, 1))):
        pixels = {(x, y): (rng.randrange(256), rng.randrange(1000)) for x in range(wide * block) for y in range(high * block) if rng.random() < share}
        rows += [(frame, x, y, *v, 1) for (x, y), v in pixels.items()]
        if (wide * block - 1, high * block - 1) not in pixels:
            rows.append((frame, wide * block - 1, high * block - 1, 7, 7, 0))
        expected |= {(frame, *p): v for p, v in plain(pixels, wide, high, block).items()}
    got = dilation.dilated(spark.createDataFrame(rows, "frame int, x int, y int, c int, d int, occ int"), ["c", "d"], block).collect()
    assert {(r.frame, r.x, r.y): (r.c, r.d) for r in got} == expected and len(got) == len(expected)


def test_dilation_of_nothing(spark):
    none = spark.createDataFrame([], "frame int, x int, y int, c int, occ int")
    assert dilation.dilated(none, ["c"]).count() == 0


def test_depths_near_the_cloud(spark):
    """Seen along z from below: a place in the cloud of its mean, one nearer to a higher point, one between two (the larger), one beyond reach, a frame without a cloud, a depth of 0."""
    pixels = [(f, x, 0, 0, d, 1) for f, x, d in ((0, 0, 20), (0, 4, 20), (0, 8, 20), (0, 12, 21), (0, 12 + 1, 20), (1, 0, 9), (0, 16, 0))]
    pixels += [(0, 17, 0, 1, 0, 1), (0, 40, 20, 0, 3, 0)]
    cloud = [(0, 1, 1, 1, 20), (0, 2, 5, 1, 24), (0, 3, 9, 1, 23), (0, 4, 9, 1, 17), (0, 5, 13, 1, 60), (0, 6, 200, 200, 200)]
    df = spark.createDataFrame(pixels, "frame int, x int, y int, patch int, d0 int, occ int")
    canvas = spark.createDataFrame([(f, p, 0, 0, 0, 3, 1, 0, 0, 0, v) for f, p, v in ((0, 0, 0), (0, 1, 0), (1, 0, 0))], "frame int, patch int, orientation int, u0 int, v0 int, size_u0 int, size_v0 int, u1 int, v1 int, d1 int, view_id int")
    points = spark.createDataFrame([(f, i, *upright(x, y, z)) for f, i, x, y, z in cloud], "frame int, pid long, x long, y long, z long")
    got = {(r.frame, r.x, r.y): r.d0 for r in dilation.depth_padded(df, canvas, points).collect()}
    assert len(got) == 6 * 16 - 8 and got[0, 1, 1] == 20 and got[0, 5, 1] == 24 and got[0, 9, 1] == 23
    assert got[0, 13, 1] in range(13, 28) and got[1, 1, 1] == 9 and got[0, 18, 1] == 0
    assert dilation.padded(df, canvas, points).where("frame = 0").count() == 48 * 32
    none = df.limit(0)
    assert dilation.depth_padded(none, canvas, points).count() == 0 and dilation.padded(none, canvas.limit(0), points.limit(0)).count() == 0


def upright(u, v, depth):
    """A point of view 0, as space has it."""
    from cirrus.functions.geometry import VIEWS

    _, normal, tangent, bitangent, _ = VIEWS[0]
    out = [0, 0, 0]
    out[normal], out[tangent], out[bitangent] = depth, u, v
    return out


def test_nothing_that_grows_is_broadcast(spark):
    """Small tables, which Spark would rather broadcast: places, their copies in cells, blocks and patches are shuffled."""
    pixels = spark.createDataFrame([(0, 0, 0, 0, 20, 1), (0, 20, 0, 0, 24, 1)], "frame int, x int, y int, patch int, d0 int, occ int")
    canvas = spark.createDataFrame([(0, 0, 0, 0, 0, 2, 1, 0, 0, 0, 0)], "frame int, patch int, orientation int, u0 int, v0 int, size_u0 int, size_v0 int, u1 int, v1 int, d1 int, view_id int")
    points = spark.createDataFrame([(0, 1, 1, 1, 21), (0, 2, 9, 9, 9)], "frame int, pid long, x long, y long, z long")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (dilation.depth_padded(pixels, canvas, points), dilation.padded(pixels, canvas, points), neighbours.within(points, points, 9))]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
