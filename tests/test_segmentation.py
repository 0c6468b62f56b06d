"""Contraction of graphs, orientation of normals, patch segmentation and grid refinement against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.operators import contraction, orientation, patch_segmentation, voxels

POINT = "frame int, pid long, x int, y int, z int, r int, g int, b int"


def cloud(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) if len(r) == 5 else r for r in rows], POINT)


def graph(seed, n=60, m=90, frames=2):
    rng = random.Random(seed)
    return sorted({(f, *sorted(rng.sample(range(n), 2))) for f in range(frames) for _ in range(m)})


def kruskal(edges):
    """Forest of the greatest weights (ties: smaller ends first) as adjacency with signs."""
    parent, tree = {}, {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for f, u, v, w, s in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        a, b = find((f, u)), find((f, v))
        if a != b:
            parent[a] = b
            tree.setdefault((f, u), []).append(((f, v), s))
            tree.setdefault((f, v), []).append(((f, u), s))
    return tree


def walked(tree, start, sign=1):
    signs, stack = {start: sign}, [start]
    while stack:
        a = stack.pop()
        for b, s in tree.get(a, []):
            if b not in signs:
                signs[b] = signs[a] * s
                stack.append(b)
    return signs


@pytest.mark.parametrize("m", [5, 200])
def test_components_of_edges(spark, m):
    edges = graph(m, m=m)
    expected, tree = {}, {}
    for f, u, v in edges:
        tree.setdefault((f, u), []).append(((f, v), 1))
        tree.setdefault((f, v), []).append(((f, u), 1))
    for a in sorted(tree):
        if a not in expected:
            expected |= dict.fromkeys(walked(tree, a), a[1])
    got = contraction.components(spark.createDataFrame(edges, "frame int, u long, v long")).collect()
    assert {(r.frame, r.pid): r.root for r in got} == expected and len(got) == len(expected)


def test_components_of_a_long_path(spark):
    order = list(range(100))
    random.Random(2).shuffle(order)
    edges = [(0, min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    assert {r.root for r in contraction.components(spark.createDataFrame(edges, "frame int, u long, v long")).collect()} == {0}


@pytest.mark.parametrize("levels", [3, 1000])
def test_spanning_forest(spark, levels):
    """Few levels: many equal weights, which the ends decide."""
    rng = random.Random(levels)
    edges = [(*e, rng.randrange(levels) / 7, rng.choice([1, -1])) for e in graph(3, m=120)]
    tree = kruskal(edges)
    got = {(r.frame, r.pid): (r.root, r.sign) for r in contraction.spanning_forest(spark.createDataFrame(edges, "frame int, u long, v long, weight double, sign int")).collect()}
    assert got.keys() == tree.keys()
    for (f, pid), (root, sign) in got.items():
        assert walked(tree, (f, root))[f, pid] == sign


def test_contraction_of_nothing(spark):
    none = spark.createDataFrame([], "frame int, u long, v long, weight double, sign int")
    assert contraction.components(none).count() == 0 and contraction.spanning_forest(none).count() == 0


# ---- orientation ----------------------------------------------------------------------------------------------------

NORMAL = "frame int, pid long, nx double, ny double, nz double"


def neighbours_of(points, k, radius=None):
    near = set()
    for f, p, *xyz in points:
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(xyz, q[2:5])), q[1]) for q in points if q[0] == f)[:k]
        near |= {(f, p, q) for d, q in ranked if q != p and (radius is None or d <= radius)}
    return near


def bent(seed=1, n=14):
    """A bent sheet and its true normals, which point up, and the same with random flips."""
    rng, points, true = random.Random(seed), [], []
    for i in range(n):
        for j in range(n):
            points.append((0, i * n + j, i, j, round((i * i + j * j) / 16)))
            v = np.array([-i / 8, -j / 8, 1.0])
            true.append(v / np.linalg.norm(v))
    flipped = [v * rng.choice([1, -1]) for v in true]
    return points, true, flipped


def frame_of(spark, points, normals):
    return cloud(spark, points), spark.createDataFrame([(p[0], p[1], *map(float, v)) for p, v in zip(points, normals)], NORMAL)


def plain_oriented(points, normals, k, radius, viewpoint):
    place = {(p[0], p[1]): np.array(p[2:5], float) for p in points}
    n = {(p[0], p[1]): np.array(v, float) for p, v in zip(points, normals)}
    edges = []
    for f, u, v in {(f, *sorted((a, b))) for f, a, b in neighbours_of(points, k, radius)}:
        (a, b, c), (d, e, g) = n[f, u], n[f, v]
        dot = a * d + b * e + c * g
        edges.append((f, u, v, abs(dot), -1 if dot < 0 else 1))
    tree, out = kruskal(edges), {}
    for key in sorted(n):
        if key not in out:
            out |= walked(tree, key, 1 if n[key] @ (np.array(viewpoint) - place[key]) >= 0 else -1)
    for f in {p[0] for p in points}:
        keys = [key for key in n if key[0] == f]
        if sum(out[key] * n[key] @ (np.array(viewpoint) - place[key]) < 0 for key in keys) > (len(keys) + 1) // 2:
            out |= {key: -out[key] for key in keys}
    return {key: tuple(np.round(out[key] * n[key], 9) + 0.0) for key in n}


def found(df):
    return {(r.frame, r.pid): tuple(np.round([r.nx, r.ny, r.nz], 9) + 0.0) for r in df.collect()}


def test_tree_makes_a_bent_surface_agree(spark):
    points, true, flipped = bent()
    got = found(orientation.oriented(*frame_of(spark, points, flipped), k=9, viewpoint=(0.0, 0.0, 1000.0)))
    assert got == {(0, i): tuple(np.round(v, 9) + 0.0) for i, v in enumerate(true)}


@pytest.mark.parametrize("radius", [None, 6])
def test_tree_orientation_of_random_clouds(spark, radius):
    """Several frames and trees, a point on its own, repeated places, and a cloud of which most looks away."""
    rng = random.Random(11)
    points = [(f, 100 * f + i, *(rng.randrange(9) for _ in "xyz")) for f in range(2) for i in range(45)] + [(0, 99, 60, 60, 60), (1, 199, 4, 4, 4), (1, 198, 4, 4, 4)]
    normals = [[rng.uniform(-1, 1) for _ in "xyz"] for _ in points]
    got = found(orientation.oriented(*frame_of(spark, points, normals), k=4, squared_radius=radius, viewpoint=(3.0, 50.0, -7.0)))
    assert got == plain_oriented(points, normals, 4, radius, (3.0, 50.0, -7.0))


def test_cube_sees_a_closed_surface(spark):
    """All normals of a hollow ball with a dent of points inside point outwards, whatever their flips."""
    rng, points, true = random.Random(5), [], []
    for x in range(-7, 8):
        for y in range(-7, 8):
            for z in range(-7, 8):
                if 36 <= x * x + y * y + z * z <= 49:
                    points.append((0, len(points), x, y, z))
                    true.append(np.array([x, y, z]) / np.linalg.norm([x, y, z]))
    flipped = [v * rng.choice([1, -1]) for v in true]
    got = found(orientation.oriented(*frame_of(spark, points, flipped), strategy="cube", k=9))
    assert got == {(0, i): tuple(np.round(v, 9) + 0.0) for i, v in enumerate(true)}
    by_view = found(orientation.oriented(*frame_of(spark, points, flipped), strategy="viewpoint", viewpoint=(0.0, 0.0, 0.0)))
    assert by_view == {(0, i): tuple(np.round(-v, 9) + 0.0) for i, v in enumerate(true)}


def test_orientation_of_nothing(spark):
    for strategy in ("tree", "cube", "viewpoint"):
        assert orientation.oriented(*frame_of(spark, [], []), strategy=strategy).count() == 0
    with pytest.raises(ValueError):
        orientation.oriented(*frame_of(spark, [], []), strategy="other")


def test_normal_pipeline_on_a_plane(spark):
    points = [(0, 10 * i + j, i, j, 3) for i in range(8) for j in range(8)]
    got = found(orientation.pipeline(cloud(spark, points), 9, 2, viewpoint=(0.0, 0.0, 50.0)))
    assert {k: tuple(np.round(v, 6) + 0.0) for k, v in got.items()} == {(0, p[1]): (0.0, 0.0, 1.0) for p in points}


# ---- patches --------------------------------------------------------------------------------------------------------

AXES = [(0, 2, 1), (1, 2, 0), (2, 0, 1)]


def plain_segments(points, planes, lim):
    """Round after round over one frame: members by (round, start), pixels, open points."""
    place = {p[1]: p[2:5] for p in points}
    colour = {p[1]: p[5:8] for p in points}
    near = neighbours_of(points, lim.neighbours)
    adjacent, d2 = {p: set() for p in place}, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _, a, b in near:
        adjacent[a].add(b)
        adjacent[b].add(a)
    open_, members, pixels, flagged, r = dict.fromkeys(place, float("inf")), {}, {}, set(), 0
    while True:
        comps, done = [], set()
        for p in sorted(open_):
            if p in done:
                continue
            comp, stack = {p}, [p]
            while stack:
                for b in adjacent[stack.pop()]:
                    if b in open_ and b not in comp and planes[b] == planes[p]:
                        comp.add(b)
                        stack.append(b)
            done |= comp
            far = [q for q in comp if open_[q] > lim.detection]
            if len(comp) >= lim.least_points and far:
                comps.append((min(far), comp))
        if not comps:
            break
        taken = {}
        if lim.expand:
            order = sorted(comps, key=lambda c: (-len(c[1]), c[0]))
            full = dict(comps)
            for start, comp in order:
                flagged |= comp
                plane = planes[start]
                more = {n for _, a, n in near if a in comp and n not in flagged and d2(place[a], place[n]) <= 2 and planes[n] != plane and abs(planes[n] - plane) != 3}
                flagged |= more
                taken[start] = more
            comps = [(s, full[s] | taken[s]) for s in sorted(full)]
        made = set()
        for start, comp in comps:
            plane = planes[start]
            k, t, bt = AXES[plane % 3]
            way = 1 if plane < 3 else -1
            flat = {p: (place[p][t], place[p][bt], way * place[p][k]) for p in comp}
            u1, v1, least = (min(f[i] for f in flat.values()) for i in range(3))
            low = least // lim.level * lim.level
            low = low if plane < 3 else min(low, 0)
            tops, peak = {}, {}
            for p, (u, v, d) in flat.items():
                tops[u, v] = min(tops.get((u, v), (d, p)), (d, p))
            for (u, v), (d, _) in tops.items():
                b = ((u - u1) // lim.block, (v - v1) // lim.block)
                peak[b] = min(peak.get(b, d), d)
            for (u, v), (d, p) in tops.items():
                if d - peak[(u - u1) // lim.block, (v - v1) // lim.block] > lim.peak or d + lim.thickness > low + lim.deepest:
                    continue
                layer = [f[2] for q, f in flat.items() if f[:2] == (u, v) and f[2] - d <= lim.thickness and all(abs(x - y) < lim.colour for x, y in zip(colour[q], colour[p]))]
                pixels[r, start, u, v] = (way * d, way * max(layer))
                for e in pixels[r, start, u, v]:
                    at = [0, 0, 0]
                    at[k], at[t], at[bt] = e, u, v
                    made.add(tuple(at))
            members |= {(r, start, p): plane for p in comp}
        r += 1
        open_ = {p: min([o, *(d2(place[p], m) for m in made)]) for p, o in open_.items()}
        open_ = {p: o for p, o in open_.items() if o > lim.selection}
        if not open_:
            break
    return members, pixels, set(open_)


def folded(seed, n=220):
    """A surface with a fold, a second sheet behind it, some stray points and repeated places."""
    rng, points, planes = random.Random(seed), [], {}
    for i in range(n):
        x, y = rng.randrange(14), rng.randrange(14)
        z = abs(x - 7) * (seed % 3) + rng.choice([0, 0, 0, 1, 6])
        points.append((0, i, x, y, z, *(rng.choice([10, 200]) if k == seed % 3 else 50 for k in range(3))))
        planes[i] = rng.choice([2, 2, 2, 2, 5, 0]) if seed % 2 else (2 if x < 7 else 3)
    for i in range(n, n + 5):
        points.append((0, i, *(rng.randrange(100) for _ in "xyz"), 1, 2, 3))
        planes[i] = rng.randrange(6)
    return points, planes


@pytest.mark.parametrize(("seed", "more"), [(3, {"expand": True, "detection": 4}), (4, {"peak": 2, "block": 4, "level": 4, "deepest": 9, "thickness": 2})])
def test_segments(spark, seed, more):
    limits = patch_segmentation.Limits(**{"neighbours": 6, "least_points": 5, "detection": 2, "selection": 1, "thickness": 3} | more)
    points, planes = folded(seed)
    members, pixels, left = plain_segments(points, planes, limits)
    found = patch_segmentation.segment(cloud(spark, points), spark.createDataFrame([(0, p, j) for p, j in planes.items()], "frame int, pid long, plane int"), limits)
    names = {r.patch: (r.round, r.start) for r in found.patches.collect()}
    assert sorted(names) == list(range(len(names))) and [names[k] for k in sorted(names)] == sorted(names.values())
    got = [(*names[r.patch], r.pid) for r in found.members.collect()]
    assert sorted(got) == sorted(members)
    assert {(*names[r.patch], r.u, r.v): (r.d0, r.d1) for r in found.pixels.collect()} == pixels
    assert {r.pid for r in found.raw.collect()} == left


def test_segments_of_nothing(spark):
    found = patch_segmentation.segment(cloud(spark, []), spark.createDataFrame([], "frame int, pid long, plane int"))
    assert [df.count() for df in (found.members, found.pixels, found.patches, found.raw)] == [0] * 4


def test_pipeline_of_a_box(spark):
    """The six sides of a hollow box become six patches, whatever side a normal pointed to."""
    side = range(9)
    points = sorted({(x, y, z) for x in side for y in side for z in side if 0 in (x, y, z) or 8 in (x, y, z)})
    found = patch_segmentation.pipeline(cloud(spark, [(0, i, *p) for i, p in enumerate(points)]), patch_segmentation.Limits(neighbours=9, least_points=20), 9)
    sizes = [r.n for r in found.patches.collect()]
    assert len(sizes) == 6 and min(sizes) > 40 and found.raw.count() == 0


# ---- voxels ---------------------------------------------------------------------------------------------------------


def plain_refined(points, normals, planes, edge, reach, neighbours, strength, rounds):
    cells, first = {}, {}
    for p in sorted(points, key=lambda p: p[1]):
        c = tuple((v + edge // 2) // edge for v in p[2:5])
        cells.setdefault(c, []).append(p[1])
        first.setdefault(c, p[1])
    order = sorted(cells, key=first.get)
    planes = dict(planes)
    score = lambda c: [sum(planes[p] == j for p in cells[c]) for j in range(6)]
    scores = {c: score(c) for c in order}
    kind = {c: "single" if len(cells[c]) == 1 else "none" if sum(map(bool, scores[c])) == 1 else "multi" for c in order}
    best = {c: int(np.argmax(scores[c])) for c in order}
    heard, weight, span, sizes = {}, {}, 1 if edge >= 4 else 2, []
    for c in order:
        total, heard[c] = 0, []
        for _, _, o in sorted((d, first[o], o) for o in order if (d := sum((a - b) ** 2 for a, b in zip(c, o))) <= reach):
            heard[c].append(o)
            total += len(cells[o])
            if total >= neighbours:
                break
        weight[c] = strength / total
    for _ in range(rounds):
        changed = []
        for c in order:
            if kind[c] == "none":
                continue
            smooth = np.sum([scores[o] for o in heard[c]], axis=0)
            for o in heard[c]:
                if max(abs(a - b) for a, b in zip(c, o)) <= span and kind[o] == "none" and best[o] != int(np.argmax(smooth)):
                    kind[o] = "indirect"
            if kind[c] != "multi" and np.count_nonzero(smooth) == 1 and smooth[best[c]] > 0:
                continue
            changed.append(c)
            for p in cells[c]:
                x, y, z = normals[p]
                planes[p] = int(np.argmax([a + weight[c] * s for a, s in zip((x, y, z, -x, -y, -z), smooth)]))
        for c in order:
            scores[c] = score(c)
        for c in changed:
            best[c] = int(np.argmax(scores[c]))
            if kind[c] != "single":
                kind[c] = "none" if sum(map(bool, scores[c])) == 1 else "multi"
        sizes.append(len(changed))
    return planes, sizes


@pytest.mark.parametrize(("edge", "reach", "neighbours", "strength"), [(4, 3, 40, 1.0), (2, 9, 200, 8.0)])
def test_grid_refinement(spark, edge, reach, neighbours, strength):
    """Planes and the voxels of each round are those of a walk in order; fewer voxels are recomputed than there are."""
    rng = random.Random(edge * reach)
    points, normals, planes = [], {}, {}
    for i in range(420):
        x, y = rng.randrange(20), rng.randrange(20)
        points.append((0, i, x, y, (x + y) // 9))
        planes[i] = (2 if x < 10 else 0) if rng.random() < 0.93 else rng.randrange(6)
        v = np.array([rng.uniform(-0.2, 0.2) + (x >= 10), rng.uniform(-0.3, 0.3), rng.uniform(-0.2, 0.2) + (x < 10)])
        normals[i] = tuple(float(c) for c in v / np.linalg.norm(v))
    expected, sizes = plain_refined(points, normals, planes, edge, reach, neighbours, strength, 4)
    rows = cloud(spark, points).join(spark.createDataFrame([(0, p, j) for p, j in planes.items()], "frame int, pid long, plane int"), ["frame", "pid"])
    df, got_sizes = voxels.refined(rows, spark.createDataFrame([(0, i, *v) for i, v in normals.items()], NORMAL), edge, reach, neighbours, strength, 4)
    assert {r.pid: r.plane for r in df.collect()} == expected
    assert got_sizes == sizes and sizes[-1] < len({tuple((v + edge // 2) // edge for v in p[2:5]) for p in points})


def test_large_frames_and_small_ones_have_one_forest(spark, monkeypatch):
    """Frames that one task contracts against rounds over all tasks: equal components, trees and signs along them, and frames of both kinds in one table."""
    rng = random.Random(7)
    edges = {(f, *sorted(rng.sample(range(40), 2))) for f, n in ((0, 30), (1, 200), (2, 3)) for _ in range(n)}
    rows = [(f, u, v, rng.randrange(4) / 4 if f else float("nan") if rng.random() < 0.1 else 0.5, rng.choice((1, -1))) for f, u, v in sorted(edges)]
    df = spark.createDataFrame(rows, "frame int, u long, v long, weight double, sign int")
    found, kinds = [], []
    rounds = contraction._contracted
    monkeypatch.setattr(contraction, "_contracted", lambda e, *more: (kinds.append({r.frame for r in e.select("frame").distinct().collect()}), rounds(e, *more))[1])
    for held in (1 << 18, 0, 50):
        monkeypatch.setattr(contraction, "HELD", held)
        trees = {}
        for r in contraction.spanning_forest(df).collect():
            trees.setdefault((r.frame, r.root), []).append((r.pid, r.sign))
        first = {k: dict(t)[min(t)[0]] for k, t in trees.items()}  # roots are arbitrary, signs count against the least vertex
        found.append(({(k[0], *sorted((p, s * first[k]) for p, s in t)) for k, t in trees.items()}, sorted(map(tuple, contraction.components(df).collect()))))
    assert found[0] == found[1] == found[2]
    assert kinds == [{0, 1, 2}] * 2 + [{1}] * 2  # no rounds for frames that a task takes


def test_neighbours_are_looked_for_once(spark, monkeypatch):
    """Estimated, smoothed and oriented normals share one search for nearest points, and smoothing shuffles no pairs."""
    from cirrus.operators import neighbours, normals

    calls, real = [], neighbours.nearest
    for module in (normals, orientation):
        monkeypatch.setattr(module, "nearest", lambda *a, **more: (calls.append(a[2]), real(*a, **more))[1])
    rng = random.Random(3)
    points = cloud(spark, [(0, i, rng.randrange(9), rng.randrange(9), 0) for i in range(30)])
    assert orientation.pipeline(points, 5, 1, (3, 5, 0.5), "tree", (4.0, 4.0, 99.0)).count() == 30 and calls == [5]
    given = points.selectExpr("frame", "pid", "0.0D AS nx", "0.0D AS ny", "1.0D AS nz")
    plan = normals.smoothed(points, given, 3, 5, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert not any("nn_pid" in line for line in plan.split("\n") if "Exchange hashpartitioning(frame" in line and "kx" not in line)
