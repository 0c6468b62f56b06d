"""Weighted colour transfer and smoothing over cells against plain versions."""

import math
import random

import pytest

from cirrus.operators import colour_transfer, smoothing
from cirrus.operators.colour_transfer import Way

POINT = "frame int, pid long, x int, y int, z int, r int, g int, b int"


def rows_of(seed, n, size=9, start=0):
    rng = random.Random(seed)
    return [(f, start + 1000 * f + i, *(rng.randrange(size) for _ in "xyz"), *(rng.choice([10, 40, 60, 200]) + rng.randrange(9) for _ in "rgb")) for f in range(2) for i in range(n)]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def ranked(a, b, k):
    """For each point of a the k nearest of b in its frame."""
    return {p[1]: sorted((squared(p[2:5], q[2:5]), q[1]) for q in b if q[0] == p[0])[:k] for p in a}


def trimmed(found, colours, way, one_stays):
    """A list (d2, other) by distance, cut as a way says."""
    found = [e for i, e in enumerate(found) if way.most_d2 is None or e[0] <= way.most_d2 or (one_stays and i == 0)]
    if way.identical_alone and found and found[0][0] == 0:
        found = found[:1]
    while way.most_colour_d2 is not None and len(found) > 1 and max(squared(colours[p], colours[q]) for _, p in found for _, q in found) > way.most_colour_d2:
        found = found[:-1]
    return found


def mean_of(found, colours, way, root):
    weigh = lambda d: 1 / ((math.sqrt(d) if root else d) + way.offset) if way.weighted else 1.0
    mean = lambda es: [sum(weigh(d) * colours[q][k] for d, q in es) / sum(weigh(d) for d, _ in es) for k in range(3)]
    first = mean(found)
    if way.outlier is not None:
        near = [e for e in found if round(squared(colours[e[1]], first), 6) <= way.outlier**2]
        if 0 < len(near) < len(found):
            return mean(near)
    return first


def settled(one, behind, colours, way, n_target, n_source, reach, peak):
    whole = lambda c: [min(max(math.floor(round(v, 6) + 0.5), 0), peak) for v in c]
    one = whole(one)
    if not behind:
        return tuple(one)
    start, best = whole(mean_of(behind, colours, way, True)), None
    steps = range(-reach, reach + 1)
    for c in ([min(max(v + s, 0), peak) for v, s in zip(start, (a, b, d))] for a in steps for b in steps for d in steps):
        e = max(squared(c, one) * (1 / n_target), sum(squared(c, colours[q]) for _, q in behind) * (1 / n_source))
        if best is None or e < best[0]:
            best = (e, tuple(c))
    return best[1]


def plain(target, source, forward, backward, reach, peak):
    colours, ahead, lists = {q[1]: q[5:8] for q in source}, ranked(target, source, forward.neighbours), {}
    for q, near in ranked(source, target, backward.neighbours).items():
        for d, t in near:
            lists.setdefault(t, []).append((d, q))
    out = {}
    for t in target:
        sizes = [sum(p[0] == t[0] for p in cloud) for cloud in (target, source)]
        one = mean_of(trimmed(ahead[t[1]], colours, forward, True), colours, forward, False)
        out[t[1]] = settled(one, trimmed(sorted(lists.get(t[1], [])), colours, backward, False), colours, backward, *sizes, reach, peak)
    return out


WAYS = [
    (Way(4, True, 4.0), Way(2, True, 4.0), 1),
    (Way(5, True, 1.0, 6, 4000.0, 40.0, True), Way(3, True, 2.0, 9, 2500.0, 30.0), 0),
    (Way(3, False, 4.0, None, 900.0), Way(2, False, 4.0, 12, 900.0, None, True), 1),
]


@pytest.mark.parametrize("ways", WAYS)
def test_weighted_transfer(spark, ways):
    """Repeated places, targets that no source point looks back at, lists cut by distance, by colour and by outliers."""
    source, target = rows_of(1, 45), rows_of(2, 40, 10, 50_000) + [(0, 99_000, 8, 8, 8, 0, 0, 0), (0, 99_001, 8, 8, 8, 0, 0, 0)]
    source += [(0, 900 + i, 8, 8, 8, 20 * i, 5, 5) for i in range(5)]
    got = colour_transfer.transferred(spark.createDataFrame(target, POINT), spark.createDataFrame(source, POINT), ways[0], ways[1], ways[2]).collect()
    assert {r.pid: (r.r, r.g, r.b) for r in got} == plain(target, source, ways[0], ways[1], ways[2], 255) and len(got) == len(target)


def test_transfer_at_the_boundary(spark):
    source, target = rows_of(3, 30, 7), rows_of(4, 30, 7, 50_000)
    forward, backward, gate = Way(3), Way(2), 60
    kinds = {t[1]: 3 if t[1] % 3 == 0 else 1 for t in target}
    edge, colours, own = [t for t in target if kinds[t[1]] == 3], {q[1]: q[5:8] for q in source}, {t[1]: t[5:8] for t in target}
    ahead, lists = ranked(edge, source, 3), {}
    asked = [q for near in ahead.values() for _, q in near]
    back = ranked(source, target, 2)
    for q in asked:
        for d, t in back[q]:
            if kinds[t] == 3 and all(abs(a - b) < gate for a, b in zip(colours[q], own[t])):
                lists.setdefault(t, []).append((d, q))
    expected = dict(own)
    for t in edge:
        sizes = [sum(p[0] == t[0] for p in cloud) for cloud in (target, source)]
        expected[t[1]] = settled(mean_of(ahead[t[1]], colours, forward, False), sorted(lists.get(t[1], [])), colours, backward, *sizes, 1, 65535)
    typed = spark.createDataFrame([(*t, kinds[t[1]]) for t in target], POINT + ", type int")
    got = colour_transfer.boundary_transferred(typed, spark.createDataFrame(source, POINT), forward, backward, 1, 65535, gate).collect()
    assert {r.pid: (r.r, r.g, r.b) for r in got} == expected


def test_transfer_of_nothing(spark):
    none, some = spark.createDataFrame([], POINT), spark.createDataFrame(rows_of(5, 3), POINT)
    assert colour_transfer.transferred(none, some, Way(), Way()).count() == 0 and colour_transfer.transferred(some, none, Way(), Way()).count() == 0


def test_points_smoothed_over_cells(spark):
    """A move by hand: one cell of four points of two patches, seven empty cells that count with the point's own place."""
    points = [(0, 0, 9, 9, 9, 0), (0, 1, 10, 9, 9, 1), (0, 2, 11, 9, 9, 1), (0, 3, 11, 11, 11, 1), (0, 4, 1, 9, 9, 0)]
    df = spark.createDataFrame([(*p, True) for p in points], "frame int, pid long, x int, y int, z int, patch int, boundary boolean")
    got = {r.pid: (r.n, r.cx, r.cy, r.cz) for r in smoothing.grid_centroids(df, 8).collect()}
    # Cells of 8 places: point 0 lies between cells 0 and 1 on each axis, 2 w + 1 = 11 of 16 towards cell 1, whose mean is (10.25, 9.5, 9.5).
    one = 11 * 11 * 11 / 16**3
    low = 5 * 11 * 11 / 16**3  # the cell on the low side of x has point 4 alone
    assert got[0] == (math.floor(4 * one + low), *(round(v, 4) for v in (9 + 1.25 * one - 8 * low, 9 + 0.5 * one, 9 + 0.5 * one)))
    moved = {r.pid: (r.x, r.y, r.z, r.type) for r in smoothing.grid_smoothed(df, 8, 0, 1024).collect()}
    n, *at = got[0]
    far = n * squared(at, (9, 9, 9)) + 0.5 >= 2 * n
    assert moved[0] == ((*(math.floor(v + 0.5) for v in at), 3) if far else (9, 9, 9, 0))
    assert moved[4] == (1, 9, 9, 0)  # within half a cell of the space's end
    still = smoothing.grid_smoothed(df.withColumn("boundary", df.pid < 0), 8, 0, 1024).collect()
    assert {(r.x, r.y, r.z, r.type) for r in still} == {(*p[2:5], 0) for p in points}


PLACED = "frame int, pid long, x int, y int, z int, patch int, boundary boolean, r int, g int, b int"


def test_smoothing_by_way(spark):
    """A spike at a seam moves both ways; a point at the end of the grid, one of a single patch and a lone one stay; the way None changes nothing."""
    flat = [(0, x * 10 + y, x, y, 20, int(x > 14), 13 <= x <= 16, 100, 100, 100) for x in range(9, 22) for y in range(9, 19)]
    spiked = [(*p[:4], 23, *p[5:7], 250, 0, 0) if (p[2], p[3]) == (14, 13) else p for p in flat]
    rows = [*spiked, (0, 9001, 0, 0, 0, 1, True, 1, 2, 3), (0, 9002, 39, 39, 39, 1, True, 1, 2, 3), (1, 1, 30, 30, 30, 0, True, 9, 9, 9)]
    df = spark.createDataFrame(rows, PLACED)
    spike = 14 * 10 + 13
    for way, kind in (("grid", 3), ("radius", 2)):
        got = {(r.frame, r.pid): r for r in smoothing.smoothed_frames(df, way, 8, 1, 40, 64, 16).collect()}
        assert len(got) == len(rows) and got[0, spike].moved and got[0, spike].type == kind and got[0, spike].z < 23
        for key in ((0, 9001), (0, 9002), (1, 1)):
            assert not got[key].moved and got[key].type == 1
        assert all(not got[0, r[1]].moved for r in rows if r[0] == 0 and r[2] == 9)
    plain = {(r.frame, r.pid): (r.x, r.y, r.z, r.type, r.moved) for r in smoothing.smoothed_frames(df, None).collect()}
    assert plain == {(r[0], r[1]): (*r[2:5], int(r[6]), False) for r in rows}
    with pytest.raises(ValueError):
        smoothing.smoothed_frames(df, "other")


def test_presmoothing_of_colours(spark):
    """An odd colour among equal ones gives way; among colours that all differ it stays, and so does one that is no boundary point."""
    place = [(x, y) for x in range(5) for y in range(5)]
    even = [(0, i, x, y, 3, 0, True, *((250, 0, 0) if (x, y) == (2, 2) else (100, 100, 100))) for i, (x, y) in enumerate(place)]
    rough = [(1, i, x, y, 3, 0, True, 10 * i, 10 * i, 10 * i) for i, (x, y) in enumerate(place)]
    inner = [(2, *r[1:6], False, *r[7:]) for r in even]
    got = {(r.frame, r.pid): r for r in smoothing.presmoothed(spark.createDataFrame(even + rough + inner, PLACED), 25, 32, 20, 4.5).collect()}
    assert [k for k, r in got.items() if r.taken] == [(0, 12)] and len(got) == 75
    assert (got[0, 12].r, got[0, 12].g, got[0, 12].b) == (106, 96, 96) and (got[1, 0].r, got[2, 12].r) == (0, 250)


def test_smoothing_of_nothing(spark):
    none = spark.createDataFrame([], PLACED)
    assert all(smoothing.smoothed_frames(none, way).count() == 0 for way in ("grid", "radius", None)) and smoothing.presmoothed(none).count() == 0
