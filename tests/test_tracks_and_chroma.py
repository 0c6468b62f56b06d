"""Tracks of patches in batch and as a stream, and chroma filters, against plain versions."""

import random

import pytest

from cirrus.operators import chroma
from cirrus.streaming import tracks

PATCHES = "frame long, patch int, view_id int, u1 int, v1 int, size_u int, size_v int"


def drifting(seed, frames=70, gaps=(37,)):
    """Patches that drift, change view or vanish, and a frame without any."""
    rng, rows = random.Random(seed), []
    places = [[rng.randrange(40), rng.randrange(40), rng.randrange(4, 12), rng.randrange(4, 12), rng.randrange(3)] for _ in range(9)]
    for f in range(frames):
        for i, p in enumerate(places):
            p[0], p[1] = p[0] + rng.choice([-1, 0, 0, 1, 1]), p[1] + rng.choice([-1, 0, 1])
            if rng.random() < 0.02:
                p[4] = rng.randrange(3)
            if f not in gaps and rng.random() > 0.01:
                rows.append((f, i, p[4], p[0], p[1], p[2], p[3]))
    return rows


def plain_tracks(rows, group):
    frames, out = {}, []
    for f, *p in rows:
        frames.setdefault(f, []).append(p)
    for g in {f // group for f in frames}:
        mine = sorted(f for f in frames if f // group == g)
        live = [[p[0], mine[0], mine[0], p, [p[0]]] for p in sorted(frames[mine[0]])]
        for f in range(mine[0] + 1, mine[-1] + 1):
            free, after = sorted(frames.get(f, [])), []
            for t in live:
                scored = [(tracks.overlap(t[3], p), -k) for k, p in enumerate(free) if p[1] == t[3][1]]
                best = max(scored, default=(0, 0))
                if best[0] > 0.2:
                    p = free.pop(-best[1])
                    after.append([t[0], t[1], f, p, [*t[4], p[0]]])
                else:
                    out.append((g, *t[:3], t[4]))
            live = after
        out += [(g, *t[:3], t[4]) for t in live]
    return sorted(out)


def found(df):
    return sorted((r.gof, r.track, r.first_frame, r.last_frame, list(r.patches)) for r in df.collect())


@pytest.mark.parametrize("group", [8, 32])
def test_tracks(spark, group):
    rows = drifting(group)
    assert found(tracks.tracks(spark.createDataFrame(rows, PATCHES), group)) == plain_tracks(rows, group)


def test_tracks_of_nothing(spark):
    assert tracks.tracks(spark.createDataFrame([], PATCHES)).count() == 0


def test_streamed_tracks_survive_a_restart(spark, tmp_path):
    """Frames arrive in files out of order; the stream stops in between and goes on from its checkpoint. A late frame moves the time on at the end."""
    rows, rng = drifting(3), random.Random(1)
    order = sorted(range(70), key=lambda f: f + rng.randrange(6))
    parts = [order[i : i + 10] for i in range(0, 70, 10)] + [[10_000]]
    rows.append((10_000, 0, 0, 0, 0, 1, 1))
    spark.createDataFrame([], PATCHES).write.parquet(f"{tmp_path}/in")
    for half in (parts[:4], parts[4:]):
        for part in half:
            spark.createDataFrame([r for r in rows if r[0] in part], PATCHES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(PATCHES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            run = tracks.streamed_tracks(stream, 16).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    got = found(spark.read.parquet(f"{tmp_path}/out"))
    assert got == [t for t in plain_tracks(rows, 16) if t[2] < 10_000]


# ---- chroma ---------------------------------------------------------------------------------------------------------


def fir(line, taps, shift, at, back):
    return sum(w * line[min(max(at + t - back, 0), len(line) - 1)] for t, w in enumerate(taps)) / (1 << shift)


def plain_halved(image, taps):
    rows = [[fir(r, taps.horizontal, taps.shift, 2 * j, (len(taps.horizontal) - 1) // 2) for j in range(len(r) // 2)] for r in image]
    return [[fir(c, taps.vertical, taps.shift, 2 * i, (len(taps.vertical) - 1) // 2) for c in zip(*rows)] for i in range(len(image) // 2)]


def plain_doubled(image, taps):
    columns = list(zip(*image))
    tall = [[fir(c, taps.vertical1 if m % 2 else taps.vertical0, 8, m // 2 + m % 2, (len(taps.vertical1 if m % 2 else taps.vertical0) + 1) // 2) for m in range(2 * len(c))] for c in columns]
    return [[fir(r, taps.horizontal1 if m % 2 else taps.horizontal0, 8, m // 2 + m % 2, (len(taps.horizontal1 if m % 2 else taps.horizontal0) + 1) // 2) for m in range(2 * len(r))] for r in zip(*tall)]


@pytest.mark.parametrize("name", ["F0", "TM5", "FV", "WCS"])
def test_halved_planes(spark, name):
    """Frames of several sizes, some pixels missing."""
    rng = random.Random(8)
    images = {0: [[rng.randrange(256) for _ in range(10)] for _ in range(6)], 1: [[rng.randrange(256) for _ in range(2)] for _ in range(4)]}
    images[0][2][3] = 0
    rows = [(f, x, y, v) for f, im in images.items() for y, line in enumerate(im) for x, v in enumerate(line) if v or (x, y) != (3, 2)]
    got = {(r.frame, r.x, r.y): r.c for r in chroma.halved(spark.createDataFrame(rows, "frame int, x int, y int, c int"), ["c"], chroma.DOWN[name]).collect()}
    assert got == pytest.approx({(f, x, y): v for f, im in images.items() for y, line in enumerate(plain_halved(im, chroma.DOWN[name])) for x, v in enumerate(line)})


@pytest.mark.parametrize("name", ["F0", "LS4", "TM"])
def test_doubled_planes(spark, name):
    rng = random.Random(9)
    image = [[rng.randrange(256) for _ in range(6)] for _ in range(4)]
    rows = [(0, x, y, v) for y, line in enumerate(image) for x, v in enumerate(line)]
    got = {(r.x, r.y): r.c for r in chroma.doubled(spark.createDataFrame(rows, "frame int, x int, y int, c int"), ["c"], chroma.UP[name]).collect()}
    assert got == pytest.approx({(x, y): v for y, line in enumerate(plain_doubled(image, chroma.UP[name])) for x, v in enumerate(line)})


def test_grey_comes_back(spark):
    """Grey frames have no chroma, so the way to 4:2:0 and back changes nothing."""
    rows = [(0, x, y, *[(16 * x + y) % 256] * 3) for x in range(8) for y in range(6)]
    pixels = spark.createDataFrame(rows, "frame int, x int, y int, r int, g int, b int")
    luma, small = chroma.rgb_to_yuv420(pixels)
    assert {(r.u, r.v) for r in small.collect()} == {(128, 128)} and small.count() == 12
    assert sorted(tuple(r) for r in chroma.yuv420_to_rgb(luma, small).collect()) == sorted(rows)
    assert {(r.x, r.y): r.luma for r in chroma.yuv420_to_yuv444(luma, small).collect()} == {(r[1], r[2]): 257 * r[3] for r in rows}
