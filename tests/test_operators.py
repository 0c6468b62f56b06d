"""Operators that SQL can't express, and edge cases: ties, isolated points, empty tables, files."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.functions import checksums
from cirrus.operators import conformance, neighbours, normals, packing, segmentation, transfer
from cirrus.sources import ply, rawvideo

SF = "/root/testdata/sf0.001"
POINT = "frame int, pid long, x int, y int, z int"


def cloud(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], POINT + ", r int, g int, b int")


def random_rows(n, seed=1, frames=2, size=30):
    rng = random.Random(seed)
    return [(f, f * 1000 + i, *(rng.randrange(size) for _ in "xyz")) for f in range(frames) for i in range(n)]


def brute(a, b, k):
    out = []
    for f, p, *xyz in a:
        near = sorted((sum((u - v) ** 2 for u, v in zip(xyz, q[2:])), q[1]) for q in b if q[0] == f)[:k]
        out += [(f, p, i + 1, q, d) for i, (d, q) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5])
def test_nearest(spark, k):
    a, b = [*random_rows(40), (0, 999, 2000, 2000, 2000)], [*random_rows(30, 2), (1, 5000, 3, 3, 3), (1, 5001, 3, 3, 3)]
    got = sorted(tuple(r) for r in neighbours.nearest(cloud(spark, a), cloud(spark, b), k).collect())
    assert got == brute(a, b, k)


def test_nearest_with_fewer_points_than_asked_for(spark):
    a, b = [(0, 1, 0, 0, 0)], [(0, 7, 5, 5, 5)]
    assert [tuple(r) for r in neighbours.nearest(cloud(spark, a), cloud(spark, b), 3).collect()] == [(0, 1, 1, 7, 75)]


def test_nearest_of_nothing(spark):
    none, some = cloud(spark, []), cloud(spark, random_rows(3))
    assert neighbours.nearest(none, some).count() == 0 and neighbours.nearest(some, none).count() == 0


def test_within(spark):
    a = random_rows(50, 3, 1, 12)
    got = sorted((r.pid, r.nn_pid, r.d2) for r in neighbours.within(cloud(spark, a), cloud(spark, a), 10).collect())
    want = sorted((p[1], q[1], d) for p in a for q in a if (d := sum((u - v) ** 2 for u, v in zip(p[2:], q[2:]))) <= 10)
    assert got == want


def test_components(spark):
    rows = random_rows(60, 5, 2, 9)
    got = {(r.frame, r.pid): r.label for r in segmentation.components(cloud(spark, rows), 2).collect()}
    parent = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in rows:
        for q in rows:
            if p[0] == q[0] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:])) <= 2:
                a, b = sorted((root((p[0], p[1])), root((q[0], q[1]))))
                parent[b] = a
    assert got == {k: root(k)[1] for k in parent}


def test_normals_of_a_plane(spark):
    rows = [(0, i * 10 + j, i, j, 5) for i in range(10) for j in range(10)]
    got = normals.normals(cloud(spark, rows), 9, (5.0, 5.0, 100.0)).collect()
    assert len(got) == 100 and all(abs(r.nz - 1) < 1e-9 for r in got)


def test_votes_smooth_planes(spark):
    rows = [(0, i * 6 + j, i, j, 0) for i in range(6) for j in range(6)]
    bent = [(0, p, *((0.0, 0.2, 0.9) if p != 14 else (0.5, 0.0, 0.45))) for _, p, *_ in rows]
    got = transfer.refined_planes(cloud(spark, rows), spark.createDataFrame(bent, "frame int, pid long, nx double, ny double, nz double"), 9, 2, 3.0, [1.0, 1.0, 1.0])
    assert {r.plane for r in got.collect()} == {2} and got.count() == 36


def test_mixed_colours_lie_between(spark):
    a, b = random_rows(20, 1, 1), random_rows(20, 2, 1)
    got = transfer.mixed(cloud(spark, a), cloud(spark, b))
    assert got.count() == 20 and {r.r for r in got.collect()} == {1}


def test_packing_covers_nothing_twice(spark):
    rng = random.Random(1)
    sizes = [(rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(30)]
    spots, height = packing.first_fit(sizes, 8, 2)
    seen = set()
    for (u, v), (u0, v0, switched) in zip(sizes, spots):
        w, h = (v, u) if switched else (u, v)
        cells = {(x, y) for x in range(u0, u0 + w) for y in range(v0, v0 + h)}
        assert not cells & seen and max(x for x, _ in cells) < 8 and max(y for _, y in cells) < height
        seen |= cells


def test_matching_is_greedy_in_order(spark):
    schema = "frame int, patch int, view_id int, u1 int, v1 int, size_u int, size_v int"
    before = spark.createDataFrame([(1, 0, 2, 0, 0, 10, 10), (1, 1, 2, 2, 0, 10, 10), (1, 2, 3, 0, 0, 10, 10)], schema)
    now = spark.createDataFrame([(1, 0, 2, 1, 0, 10, 10), (1, 1, 2, 50, 50, 4, 4), (1, 2, 3, 0, 1, 10, 10)], schema)
    assert sorted(tuple(r) for r in packing.matched(before, now).collect()) == [(1, 0, 0), (1, 1, None), (1, 2, 2)]


def test_crc16_is_the_bitwise_one(spark):
    """Bits shifted in from the left, two zero bytes after the text."""
    texts = ["", "a", "ab", "0123456789" * 7, "zz"]
    expected = []
    for t in texts:
        c = 0xFFFF
        for byte in t.encode() + b"\0\0":
            for k in range(7, -1, -1):
                c = ((c << 1 | byte >> k & 1) & 0xFFFF) ^ (0x1021 if c & 0x8000 else 0)
        expected.append(c)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(checksums.crc16(F.col("v"))).collect()] == expected


def test_rate_windows_over_gaps_in_frame_numbers(spark):
    rows = [(7 * k + (k % 3) * 5000, k) for k in range(100)]
    df = spark.createDataFrame(rows, "frame_id int, num_proj long")
    got = {r.frame_id: r.total for r in conformance.sliding_sums(df).collect()}
    order = sorted(rows)
    assert got == {order[k][0]: sum(n for _, n in order[k - 29 : k + 1]) for k in range(29, 100)}


def test_crc16_and_frame_md5(spark):
    df = spark.createDataFrame([("123456789",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(checksums.crc16(F.col("v"))).collect()] == [0xE5CC, None, 0x1D0F]
    rows = [(0, 2, 1, 2, 3), (0, 1, 4, 5, 6)]
    data = struct.pack("<6h", 4, 5, 6, 1, 2, 3) + bytes([1, 2, 3] * 2)
    assert checksums.frame_md5(cloud(spark, rows)).first().md5 == hashlib.md5(data).hexdigest()


@pytest.mark.parametrize("form", ["ascii", "binary"])
def test_ply_round_trip(spark, tmp_path, form):
    rows = random_rows(20, 4, 3)
    ply.write(cloud(spark, rows), f"file://{tmp_path}/c", form)
    back = ply.read(spark, f"file://{tmp_path}/c")
    assert sorted((r.frame, r.x, r.y, r.z, r.r, r.g, r.b) for r in back.collect()) == sorted((r[0], *r[2:], 1, 2, 3) for r in rows)
    some = ply.read(spark, f"{tmp_path}/c/cloud_%08d.ply", start=1, end=9)
    assert {r.frame for r in some.select("frame").distinct().collect()} == {1, 2}


def test_ply_header_with_more_properties():
    head = b"ply\nformat binary_big_endian 1.0\ncomment made by hand\nelement vertex 2\nproperty double x\nproperty short y\nproperty float z\nproperty float nx\nproperty ushort reflectance\nproperty uchar extra\nelement face 0\nproperty list uchar int vertex_index\nend_header\n"
    body = struct.pack(">dhffHB", 1.9, -2, -3.7, 0.5, 65535, 9) + struct.pack(">dhffHB", 4, 5, 6, 1, 7, 9)
    got = ply.parse(head + body)
    assert got["x"].tolist() == [1, 4] and got["y"].tolist() == [-2, 5] and got["z"].tolist() == [-3, 6] and got["reflectance"].tolist() == [65535, 7]


@pytest.mark.parametrize("nbyte", [1, 2])
def test_raw_video(spark, tmp_path, nbyte):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 255, 3 * (6 * 4 + 2 * 3 * 2)).astype(f"<u{nbyte}").tobytes()
    (tmp_path / "v.yuv").write_bytes(data)
    video = rawvideo.read(spark, f"file://{tmp_path}/v.yuv", width=6, height=4, form="yuv420", nbyte=nbyte, frames_per_task=2)
    assert b"".join(r.data for r in rawvideo.frame_bytes(video, nbyte).orderBy("frame").collect()) == data
    assert rawvideo.pixels(video).count() == len(data) // nbyte


def test_everything_works_without_the_training_data_operators(spark, tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/cirrus", tmp_path / "cirrus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_components_by_size(spark):
    """Sizes and places of components against a walk over adjacent points."""
    import random

    from cirrus.operators import segmentation

    rng = random.Random(4)
    points = {(f, rng.randrange(9), rng.randrange(9), rng.randrange(3)) for f in (0, 1) for _ in range(60)}
    rows = [(f, i, x, y, z) for i, (f, x, y, z) in enumerate(sorted(points))]
    got = {(r.frame, r.pid): r.label for r in segmentation.components(spark.createDataFrame(rows, "frame int, pid long, x int, y int, z int"), 2).collect()}
    want = {}
    for f, i, *_ in rows:
        if (f, i) in want:
            continue
        todo = [(f, i)]
        want[f, i] = i
        while todo:
            _, j = todo.pop()
            for g, k, *p in rows:
                if g == f and (g, k) not in want and sum((a - b) ** 2 for a, b in zip(p, rows[j][2:])) <= 2:
                    want[g, k] = i
                    todo.append((g, k))
    assert got == want


def test_tiles_borrow_and_layout(spark):
    from cirrus.operators import tiles

    patches = spark.createDataFrame([(0, p, s, s) for p, s in enumerate((30, 29, 28, 20, 18))] + [(1, 0, 5, 5)], "frame int, patch int, size_u int, size_v int")
    tiled = tiles.of_segments(patches, 16)
    assert {(r.frame, r.patch): r.tile for r in tiled.collect()} == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 3): 2, (0, 4): 1, (1, 0): 0}
    raw = spark.createDataFrame([(0, 65)], "frame int, n long")
    placed = {(r.frame, r.tile): (r.left_, r.top, r.width, r.height) for r in tiles.layout(tiled, raw, 48, 16, 64).collect()}
    assert placed == {(0, 0): (0, 0, 48, 32), (0, 1): (48, 0, 16, 0), (0, 2): (0, 32, 48, 32), (0, 3): (0, 64, 64, 2), (1, 0): (0, 0, 48, 16), (1, 1): (48, 0, 16, 0), (1, 2): (0, 16, 48, 0), (1, 3): (0, 16, 64, 0)}
    assert tiles.of_segments(patches.limit(0), 16).count() == 0


def test_voxel_edges(spark):
    """A voxel alone with its point, one with two planes, one of another plane beside it, and one far from all."""
    from cirrus.operators import voxels

    rows = [(0, 0, 0, 0, 1), (0, 4, 0, 0, 2), (0, 5, 0, 0, 2), (0, 40, 0, 0, 3), (0, 41, 0, 0, 3), (0, 44, 0, 0, 3), (0, 45, 0, 0, 5), (0, 20, 0, 0, 0), (0, 21, 0, 0, 0)]
    got = {r.vx: (r.edge, r.plane) for r in voxels.edges(spark.createDataFrame(rows, "frame int, x int, y int, z int, plane int"), 4).collect()}
    # 10 and 11 touch, but 11's least plane of its ties is 3, which 10 has too
    assert got == {0: ("single", 1), 1: ("indirect", 2), 10: ("none", 3), 11: ("direct", 3), 5: ("none", 0)}


def test_push_pull_of_empty_and_single_pixels(spark):
    from cirrus.operators import images

    schema = "frame int, x int, y int, c0 int, c1 int, c2 int, occ int"
    rows = [(0, 0, 0, 9, 8, 7, 0), (0, 2, 1, 10, 20, 30, 1), (1, 0, 0, 5, 5, 5, 0)]
    got = {(r.frame, r.x, r.y): (r.c0, r.c1, r.c2) for r in images.push_pull(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, x, y): (10, 20, 30) for x in range(3) for y in range(2)}
    assert images.push_pull(spark.createDataFrame([], schema)).count() == 0


def test_colour_smoothing_keeps_colours_inside_a_patch(spark):
    from cirrus.operators import smoothing

    schema = "frame int, pid long, x int, y int, z int, patch int, c0 int, c1 int, c2 int"
    rows = [(0, 0, 10, 10, 10, 0, 1000, 1, 1), (0, 1, 11, 10, 10, 1, 5000, 9, 9), (0, 2, 60, 60, 60, 0, 1000, 1, 1), (0, 3, 61, 60, 60, 0, 5000, 9, 9)]
    got = {r.pid: (r.c0, r.moved) for r in smoothing.colour_smoothed(spark.createDataFrame(rows, schema), 6, 1e6, 1e6, 1.0).collect()}
    assert got[2] == (1000, False) and got[3] == (5000, False)
    assert got[0][1] and 1000 < got[0][0] < 5000 and got[1][1] and 1000 < got[1][0] < 5000


def test_smoothed_normals_and_decoded_occupancy_at_their_edges(spark):
    from cirrus.operators import images, normals

    points = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 1, 0, 0), (0, 2, 50, 0, 0)], "frame int, pid long, x int, y int, z int")
    given = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 0.0, 0.0, -1.0), (0, 2, 0.0, 0.0, 0.0)], "frame int, pid long, nx double, ny double, nz double")
    got = {r.pid: r.nz for r in normals.smoothed(points, given, 4, 8, 0.5, rounds=2).collect()}
    assert got == {0: 1.0, 1: -1.0, 2: 0.0}
    video = spark.createDataFrame([(0, 0, 0, 3), (0, 1, 0, 1)], "frame int, x int, y int, value int")
    size = spark.createDataFrame([(0, 3, 1)], "frame int, w int, h int")
    assert {(r.x, r.y, r.occ) for r in images.decoded_occupancy(video, size, 2, 1).collect()} == {(0, 0, 1), (1, 0, 1), (2, 0, 0)}
    assert {r.occ for r in images.decoded_occupancy(video, size, 2, None).collect()} == {3, 1}


def test_sidecar_of_groups(spark, tmp_path):
    from cirrus.sources import sidecar

    sums = spark.createDataFrame([(f, f"AB{f:02d}") for f in range(6)], "frame int, md5 string")
    sidecar.write(sums, str(tmp_path / "sums"), 4)
    got = sorted((r.gof, r.place, r.md5) for r in sidecar.read(spark, str(tmp_path / "sums")).collect())
    assert got == [(f // 4, f % 4, f"ab{f:02d}") for f in range(6)]


def test_ranked_pairs_stay_in_their_cells(spark):
    """Points and their copies are shuffled once each; no pair is, whatever is ranked or summed over a point's pairs."""
    from cirrus.operators import smoothing

    points = cloud(spark, random_rows(20)).selectExpr("*", "pid % 2 AS patch", "true AS boundary")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (smoothing.radius_smoothed(points, 40, 16, 9, 4), neighbours.within_first(points, points, 16, 40))]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2]
