"""The whole measure of distortion against a plain version, with ties, repeated places and frames of one side only."""

import math
import random

import pytest

from cirrus.operators import quality

POINT = "frame int, pid long, x int, y int, z int, r int, g int, b int, reflectance int"


def rows_of(seed, n, start=0, frames=(0, 1)):
    rng = random.Random(seed)
    return [(f, start + 1000 * f + i, *(rng.randrange(5) for _ in "xyz"), *(rng.randrange(256) for _ in "rgb"), rng.randrange(900)) for f in frames for i in range(n)]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def merged(rows):
    places = {}
    for r in rows:
        places.setdefault((r[0], *r[2:5]), []).append(r)
    return [(f, min(r[1] for r in g), *xyz, *(sum(c) // len(g) for c in list(zip(*g))[5:])) for (f, *xyz), g in places.items()]


def tied(a, b):
    out = {}
    for p in a:
        d = {q[1]: squared(p[2:5], q[2:5]) for q in b if q[0] == p[0]}
        if d:
            out[p[1]] = (min(d.values()), sorted(q for q, v in d.items() if v == min(d.values())))
    return out


def mean(vs):
    return tuple(sum(c) / len(vs) for c in zip(*vs))


def yuv(c):
    r, g, b = c
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, (-0.1146 * r - 0.3854 * g + 0.5 * b) / 255, (0.5 * r - 0.4542 * g - 0.0458 * b) / 255


def measured(a, b, near, normals, average, frame):
    one, points = {p[1]: p for p in a}, {q[1]: q for q in b}
    mine = [p for p in a if p[0] == frame and p[1] in near]
    place, plane, colour, shine = [], [], [], []
    for p in mine:
        d, ties = near[p[1]]
        place.append(d)
        plane.append(sum(sum((u - v) * n for u, v, n in zip(one[p[1]][2:5], points[q][2:5], normals[q])) ** 2 for q in ties) / len(ties))
        other = [math.floor(c + 0.5) for c in mean([points[q][5:8] for q in ties])] if average else points[ties[0]][5:8]
        colour.append([(u - v) ** 2 for u, v in zip(yuv(p[5:8]), yuv(other))])
        shine.append((p[8] - points[ties[0]][8]) ** 2)
    avg = lambda v: sum(v) / len(v)
    return {"n": len(mine), "mse": avg(place), "hausdorff": max(place), "plane_mse": avg(plane), "plane_hausdorff": max(plane), **{f"mse_{c}": avg([v[k] for v in colour]) for k, c in enumerate("yuv")}, "mse_r": avg(shine)}


@pytest.mark.parametrize(("merge", "average"), [(True, True), (False, False)])
def test_quality(spark, merge, average):
    rng = random.Random(6)
    source, other = rows_of(1, 40, frames=(0, 1, 5)), rows_of(2, 35, 50_000)
    given = {r[1]: tuple(rng.uniform(-1, 1) for _ in "xyz") for r in source if r[1] % 7}
    cloud = [(*r[:5], *given[r[1]]) for r in source if r[1] in given]
    df = lambda rows: spark.createDataFrame(rows, POINT)
    normal_cloud = spark.createDataFrame(cloud, "frame int, pid long, x int, y int, z int, nx double, ny double, nz double")
    got = {(r.frame, r.way): r.asDict() for r in quality.evaluated(df(source), df(other), normal_cloud, merge, average).collect()}
    a, b = (merged(source), merged(other)) if merge else (source, other)
    at = {}
    for r in sorted(cloud, key=lambda r: r[1]):
        at[r[0], r[2:5]] = r[5:8]
    na = {p[1]: at.get((p[0], tuple(p[2:5])), (0.0, 0.0, 0.0)) for p in a}
    ahead, back = tied(a, b), tied(b, a)
    held = {}
    for p, (_, ties) in ahead.items():
        for q in ties:
            held.setdefault(q, []).append(na[p])
    nb = {q[1]: mean(held[q[1]]) if q[1] in held else mean([na[p] for p in back[q[1]][1]]) for q in b}
    assert set(got) == {(f, w) for f in (0, 1) for w in "12F"}
    for f in (0, 1):
        ways = {"1": measured(a, b, ahead, nb, average, f), "2": measured(b, a, back, na, average, f)}
        ways["F"] = {k: max(ways["1"][k], ways["2"][k]) for k in ways["1"]}
        for way, want in ways.items():
            assert {k: got[f, way][k] for k in want} == pytest.approx(want, abs=1e-6)
            assert got[f, way]["psnr_mse"] == pytest.approx(10 * math.log10(3 * 1023**2 / want["mse"]), abs=1e-4)
            assert got[f, way]["psnr_r"] == pytest.approx(10 * math.log10(65535**2 / want["mse_r"]), abs=1e-4)


def test_equal_sequences_and_nothing(spark):
    """No distance anywhere: all PSNR are infinite. Without normals there are no planes."""
    df = spark.createDataFrame(rows_of(3, 12), POINT)
    rows = quality.evaluated(df, df).collect()
    assert {r.psnr_mse for r in rows} == {math.inf} and "plane_mse" not in rows[0]
    assert quality.evaluated(df.where("false"), df).count() == 0
