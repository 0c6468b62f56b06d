"""Push-pull with smoothing against loops over pixels; the harmonic fill against a dense solver."""

import random

import numpy as np
import pytest

from cirrus.operators import fills

CANVASES = ((37, 29), (6, 5), (3, 2), (50, 3), (1, 1), (16, 8))


def plain_push_pull(w, h, pixels):
    """pixels: occupied values by place; loops over single pixels."""
    layers = [(w, h, pixels)]
    while len(layers) == 1 or min(layers[-1][:2]) > 4:
        a, b, known = layers[-1]
        cells = {}
        for (x, y), v in known.items():
            cells.setdefault((x // 2, y // 2), []).append(v)
        layers.append(((a + 1) // 2, (b + 1) // 2, {p: tuple(sum(c) // len(vs) for c in zip(*vs)) for p, vs in cells.items()}))
    a, b, known = layers.pop()
    image = {(x, y): known.get((x, y), (0, 0, 0)) for x in range(a) for y in range(b)}
    rounds = 4
    while layers:
        a, b, known = layers.pop()
        full = {}
        for x in range(a):
            for y in range(b):
                total, weight = [0, 0, 0], 0
                for i, p in ((12, x // 2), (4, x // 2 + (1 if x % 2 else -1))):
                    for j, q in ((12, y // 2), (4, y // 2 + (1 if y % 2 else -1))):
                        if (p, q) in image:
                            weight += i * j
                            total = [t + i * j * c for t, c in zip(total, image[p, q])]
                full[x, y] = known.get((x, y)) or tuple(t // weight for t in total)
        for _ in range(rounds):
            at = lambda x, y: full[min(max(x, 0), a - 1), min(max(y, 0), b - 1)]  # noqa: E731, B023
            full = {(x, y): known.get((x, y)) or tuple((sum(c) + 4) >> 3 for c in zip(*[at(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])) for x, y in full}
        image, rounds = full, min(rounds + 1, 16)
    return image


def dense(w, h, pixels):
    """The linear system of all unknown pixels, solved at once."""
    at = {(x, y): i for i, (x, y) in enumerate((x, y) for x in range(w) for y in range(h))}
    a, b = np.zeros((w * h, w * h)), np.zeros((w * h, 3))
    for (x, y), i in at.items():
        if (x, y) in pixels:
            a[i, i], b[i] = 1, pixels[x, y]
            continue
        for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if p in at:
                a[i, i] += 1
                a[i, at[p]] -= 1
    solution = np.linalg.solve(a, b)
    return {p: solution[i] for p, i in at.items()}


def canvases(seed, share):
    """Frames of several sizes; the last corner always has a row, most often an unoccupied one. The last frame has no occupied pixel."""
    rng, rows, known = random.Random(seed), [], {}
    for frame, (w, h) in enumerate(CANVASES):
        pixels = {(x, y): tuple(rng.randrange(1, 256) for _ in range(3)) for x in range(w) for y in range(h) if rng.random() < share}
        if frame == 0:  # one corner holds everything, so tiles far away are empty
            pixels = {p: v for p, v in pixels.items() if p[0] < 9 and p[1] < 9}
        pixels = pixels or {(0, 0): (9, 8, 7)}
        known[frame] = pixels
        rows += [(frame, x, y, *v, 1) for (x, y), v in pixels.items()]
        if (w - 1, h - 1) not in pixels:
            rows.append((frame, w - 1, h - 1, 200, 200, 200, 0))
    return rows + [(99, 3, 3, 5, 5, 5, 0)], known


SCHEMA = "frame int, x int, y int, c0 int, c1 int, c2 int, occ int"


@pytest.mark.parametrize(("seed", "share", "tile"), [(1, 0.1, 8), (2, 0.5, 64)])
def test_smoothed_push_pull(spark, seed, share, tile):
    rows, known = canvases(seed, share)
    got = fills.smoothed_push_pull(spark.createDataFrame(rows, SCHEMA), tile=tile).collect()
    expected = {(f, *p): v for f, pixels in known.items() for p, v in plain_push_pull(*CANVASES[f], pixels).items()}
    assert {(r.frame, r.x, r.y): (r.c0, r.c1, r.c2) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize(("seed", "share", "tile", "margin"), [(3, 0.1, 16, 8), (4, 0.3, 64, 16)])
def test_harmonic_fill(spark, seed, share, tile, margin):
    rows, known = canvases(seed, share)
    got = fills.harmonic_fill(spark.createDataFrame(rows, SCHEMA), 1e-3, tile, margin).collect()
    expected = {(f, *p): v for f, pixels in known.items() for p, v in dense(*CANVASES[f], pixels).items()}
    found = {(r.frame, r.x, r.y): (r.c0, r.c1, r.c2) for r in got}
    assert found.keys() == expected.keys() and len(got) == len(expected)
    assert max(np.abs(np.array(found[p]) - v).max() for p, v in expected.items()) < 0.02
    assert all(found[f, *p] == v for f, pixels in known.items() for p, v in pixels.items())


def test_fills_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fills.smoothed_push_pull(none).count() == 0 and fills.harmonic_fill(none).count() == 0
