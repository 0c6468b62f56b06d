"""Registered queries on voxels, tiles, tracks, push-pull filling, smoothing and whole reports of distortion."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrus.functions import geometry
from cirrus.operators import images, metrics, neighbours, normals, patches, segmentation, smoothing, tiles, voxels
from cirrus.plans.lineage import shared_dir
from cirrus.plans.queries import _CENTRES, _D2, _EIGHT, _patched, sql
from cirrus.plans.registry import query
from cirrus.sources import sidecar
from cirrus.sources.derived import table

# ---- voxels ---------------------------------------------------------------------------------------------------------

_COUNTED = "s AS (SELECT frame, x // 4 AS vx, y // 4 AS vy, z // 4 AS vz, plane, count(*) AS n FROM segments GROUP BY ALL)"
_VOXELS = "d AS (SELECT frame, vx, vy, vz, sum(n) AS total, count(*) AS planes, arg_max(plane, n * 10 - plane) AS plane, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE plane = {j}), 0) AS BIGINT) AS s{j}" for j in range(6)) + " FROM s GROUP BY frame, vx, vy, vz)"


@query(
    "A16_voxel_scores",
    sql(
        f"WITH {_COUNTED}, {_VOXELS} SELECT frame, vx, vy, vz, s0, s1, s2, s3, s4, s5, plane, CASE WHEN total = 1 THEN 'single' WHEN planes > 1 THEN 'direct' WHEN EXISTS (SELECT 1 FROM d e WHERE e.frame = d.frame AND e.vx BETWEEN d.vx - 1 AND d.vx + 1 "
        "AND e.vy BETWEEN d.vy - 1 AND d.vy + 1 AND e.vz BETWEEN d.vz - 1 AND d.vz + 1 AND (e.total = 1 OR e.planes > 1) AND e.plane <> d.plane) THEN 'indirect' ELSE 'none' END AS edge FROM d",
        "segments",
    ),
)
def voxel_scores(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.edges(table(spark, sf, "segments"), 4)


@query("A17_dominant_plane", sql(f"WITH {_COUNTED} SELECT frame, vx, vy, vz, plane, n FROM s QUALIFY row_number() OVER (PARTITION BY frame, vx, vy, vz ORDER BY n DESC, plane) = 1", "segments"))
def dominant_plane(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.dominant(table(spark, sf, "segments"), 4)


@query("O12_component_sizes")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Components of adjacent points of each frame, largest first; of equal ones, the one with the smaller label."""
    sizes = segmentation.components(table(spark, sf, "cloud_rec"), 2).groupBy("frame", "label").agg(F.count("*").alias("size"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("size"), "label")) - 1)


# ---- neighbours and distortion --------------------------------------------------------------------------------------


@query("J02_radius_join", sql(f"SELECT frame, pid, nn_pid, d2, rank FROM (SELECT a.frame, a.pid, b.pid AS nn_pid, CAST({_D2} AS BIGINT) AS d2, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS rank FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame AND {_D2} <= 6) t WHERE rank <= 5", "cloud_src", "cloud_rec"))
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest points within a radius, nearest first."""
    return neighbours.within_first(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec"), 6, 5)


_UNIT = {"y": "0.2126::DOUBLE*{p}.r + 0.7152::DOUBLE*{p}.g + 0.0722::DOUBLE*{p}.b", "u": "-0.1146::DOUBLE*{p}.r - 0.3854::DOUBLE*{p}.g + 0.5::DOUBLE*{p}.b", "v": "0.5::DOUBLE*{p}.r - 0.4542::DOUBLE*{p}.g - 0.0458::DOUBLE*{p}.b"}


def _way_sql(a: str, b: str, way: str) -> str:
    differ = ", ".join(f"(({e.format(p='a')}) - ({e.format(p='b')})) / 255.0::DOUBLE AS d{c}" for c, e in _UNIT.items())
    near = f"SELECT a.frame, {_D2} AS d2, {differ}, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS k FROM {a} a JOIN {b} b ON a.frame = b.frame"
    return f"SELECT frame, '{way}' AS way, count(*) AS n, avg(d2) AS mse, CAST(max(d2) AS BIGINT) AS hausdorff, " + ", ".join(f"avg(d{c} * d{c}) AS mse_{c}" for c in "yuv") + f" FROM ({near}) t WHERE k = 1 GROUP BY frame"


_BOTH = f"w AS ({_way_sql('cloud_src', 'cloud_rec', 'ab')} UNION ALL {_way_sql('cloud_rec', 'cloud_src', 'ba')})"


@query("A08_two_way_distance", sql(f"WITH {_BOTH} SELECT frame, way, n, round(mse, 6) AS mse, hausdorff, round(mse_y, 6) AS mse_y, round(mse_u, 6) AS mse_u, round(mse_v, 6) AS mse_v FROM w", "cloud_src", "cloud_rec"))
def two_way_distance(spark: SparkSession, sf: str) -> DataFrame:
    ways = metrics.two_way(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec"))
    return ways.select("frame", "way", "n", F.round("mse", 6).alias("mse"), "hausdorff", *[F.round(f"mse_{c}", 6).alias(f"mse_{c}") for c in "yuv"])


def _psnr_sql(value: str, factor: str) -> str:
    return f"round(CASE WHEN {value} = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10({factor} / nullif({value}, 0)) END, 5)"


@query("A14_metric_report", sql(f"WITH {_BOTH}, m AS (SELECT frame, max(mse) AS mse, max(hausdorff) AS hausdorff, max(mse_y) AS y, max(mse_u) AS u, max(mse_v) AS v FROM w GROUP BY frame) SELECT frame, round(mse, 6) AS mse, hausdorff, {_psnr_sql('mse', '3.0 * 1023 * 1023')} AS psnr, {_psnr_sql('hausdorff::DOUBLE', '3.0 * 1023 * 1023')} AS hausdorff_psnr, " + ", ".join(f"{_psnr_sql(c, '1.0::DOUBLE')} AS psnr_{c}" for c in "yuv") + " FROM m", "cloud_src", "cloud_rec"))
def metric_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.report(metrics.two_way(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")))


#: Regions of a frame, and cuts along the longest, the next and the shortest side.
_ROIS, _CUTS = [([8, 8, 0], [40, 60, 200]), ([30, 20, 10], [500, 500, 60])], (4, 2, 3)


def _chunk_sql() -> str:
    roi = ", ".join(f"({i}, {', '.join(map(str, low + high))})" for i, (low, high) in enumerate(_ROIS))
    sides = " UNION ALL ".join(f"SELECT frame, roi, {k} AS axis, min({c}) AS low, max({c}) - min({c}) + 1 AS len FROM q GROUP BY frame, roi" for k, c in enumerate("xyz"))
    cuts = "CASE row_number() OVER (PARTITION BY frame, roi ORDER BY len DESC, axis) " + " ".join(f"WHEN {i + 1} THEN {n}" for i, n in enumerate(_CUTS)) + " END"
    ranges = "rg AS (SELECT s.*, i, low + round(i * (len / cuts::DOUBLE)) AS first, low + round((i + 1) * (len / cuts::DOUBLE) - 1) AS last FROM s, range(10) AS r(i) WHERE i < cuts)"
    joins = " ".join(f"JOIN rg r{c} ON r{c}.frame = q.frame AND r{c}.roi = q.roi AND r{c}.axis = {k} AND q.{c} BETWEEN r{c}.first AND r{c}.last" for k, c in enumerate("xyz"))
    return (
        f"WITH roi(roi, lx, ly, lz, hx, hy, hz) AS (VALUES {roi}), q AS (SELECT p.frame, p.pid, p.x, p.y, p.z, roi FROM cloud_src p JOIN roi ON p.x BETWEEN lx AND hx AND p.y BETWEEN ly AND hy AND p.z BETWEEN lz AND hz), "
        f"s AS (SELECT *, {cuts} AS cuts FROM ({sides}) t), {ranges} SELECT q.frame, q.pid, CAST(q.roi * {_CUTS[0] * _CUTS[1] * _CUTS[2]} + (rx.i * ry.cuts + ry.i) * rz.cuts + rz.i AS INTEGER) AS chunk FROM q {joins}"
    )


@query("U05_roi_chunks", sql(_chunk_sql(), "cloud_src"))
def roi_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.roi_chunks(table(spark, sf, "cloud_src"), _ROIS, _CUTS)


@query(
    "J26_reference_frames",
    sql(
        "WITH e AS (SELECT frame_id, idx, (CASE WHEN (num_eom + idx) % 4 = 3 THEN -1 ELSE 1 END) * (1 + (frame_id + idx) % 3) AS delta FROM log_frames, (VALUES (0), (1), (2), (3)) i(idx)), "
        "r AS (SELECT frame_id, idx, frame_id - sum(delta) OVER (PARTITION BY frame_id ORDER BY idx) AS reference FROM e) "
        "SELECT r.frame_id, r.idx, CAST(r.reference AS INTEGER) AS reference, b.num_proj AS points FROM r JOIN log_frames b ON b.frame_id = r.reference WHERE r.reference >= 0",
        "log_frames",
    ),
)
def reference_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of four references a frame: each steps from the one before by its signed difference; those below 0 go. Sums run within a row."""
    log = table(spark, sf, "log_frames")
    at, entries = F.col("frame_id").cast("long"), []
    for i in range(4):
        at = at - F.when((F.col("num_eom") + i) % 4 == 3, -1).otherwise(1) * (1 + (F.col("frame_id") + i) % 3)
        entries.append(F.struct(F.lit(i).alias("idx"), at.alias("to")))
    listed = log.select("frame_id", F.inline(F.array(*entries))).where("to >= 0").select("frame_id", "idx", F.col("to").cast("int").alias("reference"))
    return listed.join(log.select(F.col("frame_id").alias("reference"), F.col("num_proj").alias("points")), "reference").select("frame_id", "idx", "reference", "points")


# ---- tiles and tracks -----------------------------------------------------------------------------------------------

_TILES = (
    "o AS (SELECT frame, patch, CAST(ceil(greatest(size_u, size_v) / 4.0) * 4 AS INTEGER) AS side, row_number() OVER (PARTITION BY frame ORDER BY greatest(size_u, size_v) DESC, least(size_u, size_v) DESC, patch) AS n FROM patches), "
    "t AS (SELECT *, CASE WHEN n <= 3 THEN 0 WHEN side < 16 THEN 1 ELSE 2 END AS t0 FROM o), c AS (SELECT frame, count(*) FILTER (WHERE t0 = 1) AS c1, count(*) FILTER (WHERE t0 = 2) AS c2, max(n) AS m FROM t GROUP BY frame), "
    "tl AS (SELECT t.frame, t.patch, t.side, t0, CASE WHEN n = m AND n > 3 AND c1 = 0 THEN 1 WHEN n = m AND n > 3 AND c2 = 0 THEN 2 ELSE t0 END AS tile FROM t JOIN c ON t.frame = c.frame)"
)
_LAYOUT = (
    "h AS (SELECT frame, coalesce(max(side) FILTER (WHERE t0 = 0), 0) AS h0, coalesce(max(side) FILTER (WHERE t0 = 1), 0) AS h1, coalesce(max(side) FILTER (WHERE t0 = 2), 0) AS h2 FROM tl GROUP BY frame), "
    "rw AS (SELECT frame, count(*) AS n FROM cloud_src WHERE pri = '1-URGENT' GROUP BY frame), b AS (SELECT h.*, CAST(ceil(coalesce(n, 0) / 64.0) AS INTEGER) AS h3 FROM h LEFT JOIN rw ON h.frame = rw.frame), "
    "pl AS (SELECT frame, 0 AS tile, 0 AS left_, 0 AS top, 48 AS width, h0 AS height FROM b UNION ALL SELECT frame, 1, 48, 0, 16, h1 FROM b UNION ALL SELECT frame, 2, 0, h0, 48, h2 FROM b UNION ALL SELECT frame, 3, 0, greatest(h0 + h2, h1), 64, h3 FROM b)"
)


def _tiled(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.of_segments(table(spark, sf, "patches"), 16, 4)


def _laid(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "cloud_src").where("pri = '1-URGENT'").groupBy("frame").agg(F.count("*").alias("n"))
    return tiles.layout(_tiled(spark, sf), raw, 48, 16, 64)


@query("R38_tiles_of_segments", sql(f"WITH {_TILES} SELECT frame, patch, tile FROM tl", "patches"))
def tiles_of_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _tiled(spark, sf).select("frame", "patch", "tile")


@query("R39_tile_layout", sql(f"WITH {_TILES}, {_LAYOUT} SELECT * FROM pl", "patches"))
def tile_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _laid(spark, sf)


@query("J16_block_owner_of_frame", sql(f"WITH {_TILES}, {_LAYOUT} SELECT p.frame, p.x // 16 + left_ // 16 AS block_x, p.y // 16 + top // 16 AS block_y, max(p.patch) + 1 AS owner FROM pixels p JOIN tl ON p.frame = tl.frame AND p.patch = tl.patch JOIN pl ON pl.frame = tl.frame AND pl.tile = tl.tile WHERE p.occ = 1 GROUP BY ALL", "pixels"))
def block_owner_of_frame(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.atlas_block_owner(table(spark, sf, "pixels"), _tiled(spark, sf), _laid(spark, sf))


@query("R57_first_frame_tracks", sql("SELECT frame // 8 AS gof, patch AS track, frame AS first_frame FROM patches QUALIFY frame = min(frame) OVER (PARTITION BY frame // 8)", "patches"))
def first_frame_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tracks(table(spark, sf, "patches"), 8)


@query(
    "R56_padded_occupancy",
    sql(
        "WITH z AS (SELECT frame, patch, frame // 8 AS gof, (size_u + 3) // 4 AS su, (size_v + 3) // 4 AS sv FROM patches), g AS (SELECT gof, patch FROM z QUALIFY frame = min(frame) OVER (PARTITION BY gof)), "
        "n AS (SELECT z.frame, z.patch, CASE WHEN g.patch IS NULL THEN su ELSE max(su) OVER (PARTITION BY z.gof, z.patch) END AS wu, CASE WHEN g.patch IS NULL THEN sv ELSE max(sv) OVER (PARTITION BY z.gof, z.patch) END AS wv FROM z LEFT JOIN g ON z.gof = g.gof AND z.patch = g.patch), "
        "k AS (SELECT DISTINCT frame, patch, u // 4 AS bu, v // 4 AS bv FROM patch_pixels WHERE eom > 5), a AS (SELECT frame, patch, wv, CAST(unnest(range(wu)) AS INTEGER) AS bu FROM n), q AS (SELECT frame, patch, bu, CAST(unnest(range(wv)) AS INTEGER) AS bv FROM a) "
        "SELECT q.*, CASE WHEN k.bu IS NULL THEN 0 ELSE 1 END AS occ FROM q LEFT JOIN k ON q.frame = k.frame AND q.patch = k.patch AND q.bu = k.bu AND q.bv = k.bv",
        "patch_pixels",
    ),
)
def padded_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy of patches in blocks of 4 by 4 pixels, padded to the size of their track."""
    fours = [F.expr(f"CAST((size_{c} + 3) div 4 AS INT)").alias(f"size_{c}") for c in "uv"]
    blocks = table(spark, sf, "patch_pixels").where("eom > 5").select("frame", "patch", *[F.expr(f"CAST({c} div 4 AS INT)").alias(f"b{c}") for c in "uv"])
    return tiles.padded_blocks(blocks, table(spark, sf, "patches").select("frame", "patch", *fours), 8)


# ---- push-pull and smoothing ----------------------------------------------------------------------------------------


@query("I45_pulled_layer", sql("SELECT frame, x // 2 AS x, y // 2 AS y, " + ", ".join(f"CAST(sum({c}) // count(*) AS INTEGER) AS {c}" for c in images.CHANNELS) + ", 1 AS occ FROM pixels WHERE occ = 1 GROUP BY frame, x // 2, y // 2", "pixels"))
def pulled_layer(spark: SparkSession, sf: str) -> DataFrame:
    return images.pulled(table(spark, sf, "pixels"))


def _push_pull_sql(depth: int) -> str:
    """A canvas of at most 2 ** depth on each side."""
    ctes = ["b0 AS (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY frame HAVING max(occ) = 1)", "l0 AS (SELECT frame, x, y, c0, c1, c2 FROM pixels WHERE occ = 1)"]
    for i in range(1, depth + 1):
        ctes += [f"b{i} AS (SELECT frame, (w + 1) // 2 AS w, (h + 1) // 2 AS h FROM b{i - 1})", f"l{i} AS (SELECT frame, x // 2 AS x, y // 2 AS y, " + ", ".join(f"CAST(sum({c}) // count(*) AS INTEGER) AS {c}" for c in images.CHANNELS) + f" FROM l{i - 1} GROUP BY frame, x // 2, y // 2)"]
    ctes.append(f"f{depth} AS (SELECT * FROM l{depth})")
    weight = "(CASE WHEN m.x = e.x // 2 THEN 12 ELSE 4 END) * (CASE WHEN m.y = e.y // 2 THEN 12 ELSE 4 END)"
    for i in range(depth - 1, -1, -1):
        ctes.append(f"a{i} AS (SELECT frame, h, CAST(unnest(range(w)) AS INTEGER) AS x FROM b{i})")
        ctes.append(f"g{i} AS (SELECT frame, x, CAST(unnest(range(h)) AS INTEGER) AS y FROM a{i})")
        means = ", ".join(f"CAST(sum(m.{c} * {weight}) // sum({weight}) AS INTEGER) AS {c}" for c in images.CHANNELS)
        ctes.append(
            f"f{i} AS (SELECT * FROM l{i} UNION ALL SELECT e.frame, e.x, e.y, {means} FROM (SELECT g.* FROM g{i} g ANTI JOIN l{i} l ON g.frame = l.frame AND g.x = l.x AND g.y = l.y) e JOIN f{i + 1} m ON m.frame = e.frame "
            "AND m.x IN (e.x // 2, e.x // 2 - 1 + 2 * (e.x % 2)) AND m.y IN (e.y // 2, e.y // 2 - 1 + 2 * (e.y % 2)) GROUP BY e.frame, e.x, e.y)"
        )
    return f"WITH {', '.join(ctes)} SELECT * FROM f0"


@query("I46_filled_pixels", sql(_push_pull_sql(6), "pixels"))
def filled_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return images.push_pull(table(spark, sf, "pixels"))


@query(
    "R46_smoothed_points",
    sql(
        f"WITH {_CENTRES}, d AS (SELECT p.frame, p.pid, p.x, p.y, p.z, cx, cy, cz, coalesce(((p.x - 8) % 16 IN (0, 1, 14, 15) OR (p.y - 8) % 16 IN (0, 1, 14, 15)) AND least(p.x, p.y, p.z) >= 3 AND greatest(p.x, p.y, p.z) + 3 < 1020 "
        "AND n > 0 AND round(n * ((p.x - cx) ** 2 + (p.y - cy) ** 2 + (p.z - cz) ** 2), 6) + 0.5 >= 2 * greatest(4, n), false) AS far FROM cloud_src p LEFT JOIN c ON p.frame = c.frame AND p.pid = c.pid) "
        "SELECT frame, pid, " + ", ".join(f"CASE WHEN far THEN CAST(floor(round(c{c}, 6) + 0.5) AS INTEGER) ELSE {c} END AS {c}" for c in "xyz") + ", CASE WHEN far THEN 3 ELSE 0 END AS type FROM d",
        "cloud_src",
    ),
)
def smoothed_points(spark: SparkSession, sf: str) -> DataFrame:
    edge = " OR ".join(f"({c} - 8) % 16 IN (0, 1, 14, 15)" for c in "xy")
    return smoothing.grid_smoothed(_patched(spark, sf).withColumn("boundary", F.expr(edge)), 6, 4, 1024)


_AT_EDGE = "(x - 8) % 16 IN (0, 1, 14, 15) OR (y - 8) % 16 IN (0, 1, 14, 15)"
_EDGED = f"pt AS (SELECT *, ((x - 8) // 16) * 3 + (y - 8) // 16 AS patch, ({_AT_EDGE}) AS boundary FROM cloud_src)"


def _edged(spark: SparkSession, sf: str) -> DataFrame:
    return _patched(spark, sf).withColumn("boundary", F.expr(_AT_EDGE))


@query(
    "R44_smoothed_frames",
    sql(
        f"WITH {_EDGED}, ends AS (SELECT frame, 5 * ((greatest(max(x), max(y), max(z)) + 4) // 5) AS top FROM pt GROUP BY frame), inner_ AS (SELECT pt.* FROM pt JOIN ends USING (frame) WHERE least(x, y, z) >= 2 AND greatest(x, y, z) + 2 < top), "
        "m AS (SELECT frame, x // 5 AS kx, y // 5 AS ky, z // 5 AS kz, count(*) AS held, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, count(DISTINCT patch) > 1 AS mixed FROM inner_ GROUP BY ALL), "
        "e AS (SELECT p.frame, p.pid, mixed, coalesce(held, 0) AS held, coalesce(ax, p.x) AS ax, coalesce(ay, p.y) AS ay, coalesce(az, p.z) AS az, "
        + " * ".join(f"(CASE WHEN o{c} = 0 THEN 9 - 2 * ((p.{c} - 2) % 5) ELSE 2 * ((p.{c} - 2) % 5) + 1 END)" for c in "xyz")
        + f" AS w FROM inner_ p JOIN {_EIGHT} LEFT JOIN m ON m.frame = p.frame AND " + " AND ".join(f"m.k{c} = (p.{c} - 2) // 5 + o{c}" for c in "xyz") + " WHERE p.boundary), "
        "c AS (SELECT frame, pid, CAST(sum(w * held) // 1000 AS BIGINT) AS n, sum(w * ax) / 1000 AS cx, sum(w * ay) / 1000 AS cy, sum(w * az) / 1000 AS cz FROM e GROUP BY frame, pid HAVING bool_or(coalesce(mixed, false))), "
        "d AS (SELECT p.*, cx, cy, cz, coalesce(n > 0 AND round(n * ((p.x - cx) ** 2 + (p.y - cy) ** 2 + (p.z - cz) ** 2), 6) + 0.5 >= 2 * greatest(1, n), false) AS moved FROM pt p LEFT JOIN c ON p.frame = c.frame AND p.pid = c.pid) "
        "SELECT frame, pid, " + ", ".join(f"CASE WHEN moved THEN CAST(floor(round(c{c}, 6) + 0.5) AS INTEGER) ELSE {c} END AS {c}" for c in "xyz") + ", CASE WHEN moved THEN 3 WHEN boundary THEN 1 ELSE 0 END AS type, moved FROM d",
        "cloud_src",
    ),
)
def smoothed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame's own grid; points at its ends are in no cell."""
    return smoothing.smoothed_frames(_edged(spark, sf), "grid", 5, 1)


def _balls(squared_radius: int, k: int, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT a.frame, a.pid, b.pid AS other, {_D2} AS d2, a.patch AS own, b.patch, b.x, b.y, b.z, b.r, b.g, b.b, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS rank FROM pt a JOIN pt b ON a.frame = b.frame AND {_D2} <= {squared_radius} WHERE {where}) t WHERE rank <= {k})"


@query(
    "R47_moved_points",
    sql(
        f"WITH {_EDGED}, s AS (SELECT frame, pid, count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS s{c}" for c in "xyz") + f", bool_or(d2 <= 9 AND patch <> own) AS met FROM {_balls(16, 40)} GROUP BY frame, pid), "
        "d AS (SELECT pt.*, n, sx, sy, sz, met, met AND floor((sx - n * x) ** 2 + (sy - n * y) ** 2 + (sz - n * z) ** 2 + n / 2.0) / n >= 4 AS moved FROM pt JOIN s ON pt.frame = s.frame AND pt.pid = s.pid) "
        "SELECT frame, pid, " + ", ".join(f"CAST(CASE WHEN moved THEN (s{c} + n // 2) // n ELSE {c} END AS INTEGER) AS {c}" for c in "xyz") + ", CASE WHEN met AND boundary THEN 2 WHEN boundary THEN 1 ELSE 0 END AS type, moved FROM d",
        "cloud_src",
    ),
)
def moved_points(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothing by balls: where another patch is near and the mean of the points around is far."""
    return smoothing.smoothed_frames(_edged(spark, sf), "radius", threshold=4, k=40, squared_radius=16, squared_reach=9)


@query(
    "R51_presmoothed_colours",
    sql(
        f"WITH {_EDGED}, near AS (SELECT *, (2126 * r + 7152 * g + 722 * b) // 10000 AS luma FROM {_balls(16, 40, 'a.boundary')}), "
        "p AS (SELECT frame, pid, count(*) AS c FROM near GROUP BY frame, pid, luma), h AS (SELECT frame, pid, -sum(c / n * log2(c / n)) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY frame, pid) AS n FROM p) t GROUP BY frame, pid), "
        "s AS (SELECT frame, pid, " + ", ".join(f"CAST((sum({c}) + count(*) // 2) // count(*) AS INTEGER) AS m{c}" for c in "rgb") + " FROM near GROUP BY frame, pid), "
        "d AS (SELECT pt.*, mr, mg, mb, coalesce(abs(mr - r) + abs(mg - g) + abs(mb - b) >= 60 AND round(entropy, 9) < 4.9, false) AS taken FROM pt LEFT JOIN s ON pt.frame = s.frame AND pt.pid = s.pid LEFT JOIN h ON pt.frame = h.frame AND pt.pid = h.pid) "
        "SELECT frame, pid, " + ", ".join(f"CASE WHEN taken THEN m{c} ELSE {c} END AS {c}" for c in "rgb") + ", taken FROM d",
        "cloud_src",
    ),
)
def presmoothed_colours(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.presmoothed(_edged(spark, sf), 40, 16, 60, 4.9)


_TINTED = "pt AS (SELECT frame, pid, x, y, z, ((x - 8) // 16) * 3 + (y - 8) // 16 AS patch, g * 256 AS c0, r * 256 AS c1, b * 256 AS c2 FROM cloud_src)"


@query(
    "R50_colour_smoothing",
    sql(
        f"WITH {_TINTED}, m AS (SELECT frame, x // 6 AS kx, y // 6 AS ky, z // 6 AS kz, count(*) AS n, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2, abs(avg(c0) - median(c0)) AS uneven, count(DISTINCT patch) > 1 AS mixed FROM pt GROUP BY ALL), "
        "q AS (SELECT *, (x - 3) // 6 AS lx, (y - 3) // 6 AS ly, (z - 3) // 6 AS lz FROM pt), q1 AS (SELECT q.*, coalesce(f.m0, q.c0) AS y0, coalesce(f.n > 1 AND f.uneven > 5120, false) AS rough FROM q LEFT JOIN m f ON f.frame = q.frame AND f.kx = lx AND f.ky = ly AND f.kz = lz), "
        "w AS (SELECT q1.*, m.n, m.m0, m.m1, m.m2, m.mixed, " + " * ".join(f"(CASE WHEN o{c} = 0 THEN 12 - ((({c} - l{c} * 6) - 3) * 2 + 1) ELSE (({c} - l{c} * 6) - 3) * 2 + 1 END)" for c in "xyz") + " AS w, m.n IS NOT NULL AND (ox + oy + oz = 0 OR (abs(y0 - m.m0) <= 16384 AND (m.n = 1 OR m.uneven <= 5120))) AS ok "
        f"FROM q1 JOIN {_EIGHT} LEFT JOIN m ON m.frame = q1.frame AND m.kx = lx + ox AND m.ky = ly + oy AND m.kz = lz + oz), "
        "s AS (SELECT frame, pid, c0, c1, c2, bool_or(coalesce(mixed, false)) AND NOT bool_or(rough) AS meets, " + ", ".join(f"CAST(floor(round(sum(w * CASE WHEN ok THEN m{i} ELSE c{i} END) / 1728.0, 6) + 0.5) AS INTEGER) AS n{i}" for i in range(3)) + " FROM w GROUP BY frame, pid, c0, c1, c2) "
        "SELECT frame, pid, " + ", ".join(f"CASE WHEN meets AND abs(n0 - c0) * 10.0 / 256.0 >= 10 THEN n{i} ELSE c{i} END AS c{i}" for i in range(3)) + ", meets AND abs(n0 - c0) * 10.0 / 256.0 >= 10 AS moved FROM s",
        "cloud_src",
    ),
)
def colour_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Trilinear smoothing of 16-bit colours where patches meet, with its gates on luma."""
    return smoothing.colour_smoothed(_patched(spark, sf).select("frame", "pid", "x", "y", "z", "patch", *[(F.col(c) * 256).alias(n) for c, n in zip("grb", images.CHANNELS)]), 6, 5120.0, 16384.0, 10.0)


_MIX = ", ".join(f"0.75::DOUBLE * p.n{c} + 0.25::DOUBLE * CASE WHEN l > 0 THEN coalesce(s{c}, 0) / l ELSE 0 END AS t{c}" for c in "xyz")


@query(
    "R05_smoothed_normals",
    sql(
        "WITH p AS (SELECT frame, pid, x, y, z, (r - 128) / 128.0::DOUBLE AS nx, (g - 128) / 128.0::DOUBLE AS ny, (b - 128) / 128.0::DOUBLE AS nz FROM cloud_src), "
        f"k AS (SELECT a.frame, a.pid, sign(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) AS d, b.nx, b.ny, b.nz, b.pid AS other, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS n FROM p a JOIN p b ON a.frame = b.frame AND {_D2} <= 3), "
        "s AS (SELECT frame, pid, " + ", ".join(f"sum(CASE WHEN d < 0 THEN -n{c} ELSE n{c} END) AS s{c}" for c in "xyz") + " FROM k WHERE n <= 6 AND other <> pid GROUP BY frame, pid), l AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS l FROM s), "
        f"t AS (SELECT p.frame, p.pid, {_MIX} FROM p LEFT JOIN l ON p.frame = l.frame AND p.pid = l.pid), u AS (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS len FROM t) "
        "SELECT frame, pid, " + ", ".join(f"round(CASE WHEN len > 0 THEN t{c} / len ELSE t{c} END, 5) AS n{c}" for c in "xyz") + " FROM u",
        "cloud_src",
    ),
)
def smoothed_normals(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    given = src.select("frame", "pid", *[((F.col(c) - 128) / 128.0).alias(n) for c, n in zip("rgb", ("nx", "ny", "nz"))])
    return normals.smoothed(src, given, 3, 6, 0.25).select("frame", "pid", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


# ---- boxes, turns, occupancy of decoders, sidecars ------------------------------------------------------------------

_BOX = ", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in "xyz")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _patched(spark, sf).groupBy("frame", "patch").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))])


@query("J14_patch_neighbours", sql(f"WITH b AS (SELECT frame, ((x - 8) // 16) * 3 + (y - 8) // 16 AS patch, {_BOX} FROM cloud_src GROUP BY ALL) SELECT a.frame, a.patch, b.patch AS other FROM b a JOIN b ON a.frame = b.frame AND a.patch <> b.patch AND greatest(a.lx, b.lx) - least(a.hx, b.hx) <= 1 AND greatest(a.ly, b.ly) - least(a.hy, b.hy) <= 1 AND greatest(a.lz, b.lz) - least(a.hz, b.hz) <= 1", "cloud_src"))
def patch_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return patches.neighbours_of(_boxes(spark, sf))


@query("P09_merged_boxes", sql(f"SELECT frame // 8 AS gof, {_BOX} FROM (SELECT frame, x, y, z FROM cloud_src UNION ALL SELECT frame, x, y, z FROM cloud_rec) t GROUP BY frame // 8", "cloud_src", "cloud_rec"))
def merged_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of patches merged into boxes of groups of frames, with the points of the second cloud added."""
    ends = [(n, f, c) for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    gof = F.expr("CAST(frame div 8 AS INT)").alias("gof")
    of_points = table(spark, sf, "cloud_rec").select(gof, *[F.col(c).alias(f"{n}{c}") for n, _, c in ends])
    return _boxes(spark, sf).select(gof, *[f"{n}{c}" for n, _, c in ends]).unionByName(of_points).groupBy("gof").agg(*[f(f"{n}{c}").alias(f"{n}{c}") for n, f, c in ends])


@query("P07_boxes_within", sql(f"WITH b AS (SELECT frame, ((x - 8) // 16) * 3 + (y - 8) // 16 AS patch, {_BOX} FROM cloud_src GROUP BY ALL), r AS (SELECT frame, ((x - 8) // 16) * 3 + (y - 8) // 16 AS patch, {_BOX} FROM cloud_rec GROUP BY ALL) SELECT b.frame, b.patch, NOT (r.lx < b.lx OR r.ly < b.ly OR r.lz < b.lz OR r.hx > b.hx OR r.hy > b.hy OR r.hz > b.hz) AS held FROM b JOIN r ON b.frame = r.frame AND b.patch = r.patch", "cloud_src", "cloud_rec"))
def boxes_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a patch's box in the first cloud holds its box in the second one."""
    ends = [(n, f, c) for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    patch = F.expr("((x - 8) div 16) * 3 + (y - 8) div 16").alias("patch")
    second = table(spark, sf, "cloud_rec").groupBy("frame", patch).agg(*[f(c).alias(f"{n}{c}2") for n, f, c in ends])
    held = [F.col(f"l{c}2") >= F.col(f"l{c}") for c in "xyz"] + [F.col(f"h{c}2") <= F.col(f"h{c}") for c in "xyz"]
    return _boxes(spark, sf).join(second, ["frame", "patch"]).select("frame", "patch", F.array_min(F.array(*held)).alias("held"))


@query("F15_turned_points", sql("WITH a AS (SELECT frame, pid, x * cos(pi() / 6) - y * sin(pi() / 6) AS x, x * sin(pi() / 6) + y * cos(pi() / 6) AS y, z FROM cloud_src) SELECT frame, pid, round(x, 5) AS x, round(y * cos(pi() / 4) - z * sin(pi() / 4), 5) AS y, round(y * sin(pi() / 4) + z * cos(pi() / 4), 5) AS z FROM a", "cloud_src"))
def turned(spark: SparkSession, sf: str) -> DataFrame:
    """Points turned by the product of two rotations."""
    m = geometry.product(geometry.rotation(math.pi / 4, (1.0, 0.0, 0.0)), geometry.rotation(math.pi / 6, (0.0, 0.0, 1.0)))
    return table(spark, sf, "cloud_src").select("frame", "pid", *[F.round(F.col("x") * r[0] + F.col("y") * r[1] + F.col("z") * r[2], 5).alias(c) for c, r in zip("xyz", m)])


@query("F14_matrix_product", sql("SELECT frame, patch, u1 * size_u + v1 * size_v + d1 * view_id AS m00, u1 * size_v + v1 * view_id + d1 * size_u AS m01, size_v * size_v + size_u * view_id + view_id * size_u AS m11 FROM patches", "patches"))
def matrix_product(spark: SparkSession, sf: str) -> DataFrame:
    u, v, d, su, sv, w = (F.col(c) for c in ("u1", "v1", "d1", "size_u", "size_v", "view_id"))
    m = geometry.product([[u, v, d], [sv, su, w], [w, d, u]], [[su, sv, w], [sv, w, su], [w, su, sv]])
    return table(spark, sf, "patches").select("frame", "patch", m[0][0].alias("m00"), m[0][1].alias("m01"), m[1][1].alias("m11"))


@query("I27_decoded_occupancy", sql("WITH b AS (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY frame), v AS (SELECT frame, x // 4 AS bx, y // 4 AS by_, sum(occ) AS value FROM pixels GROUP BY ALL), a AS (SELECT frame, h, CAST(unnest(range(w)) AS INTEGER) AS x FROM b), g AS (SELECT frame, x, CAST(unnest(range(h)) AS INTEGER) AS y FROM a) SELECT g.frame, g.x, g.y, CASE WHEN value > 13 THEN 1 ELSE 0 END AS occ FROM g JOIN v ON g.frame = v.frame AND g.x // 4 = bx AND g.y // 4 = by_", "pixels"))
def decoded_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy from a video of a quarter of the size whose values count occupied pixels."""
    pixels = table(spark, sf, "pixels")
    video = pixels.groupBy("frame", *images.cells(pixels, 4)).agg(F.sum("occ").alias("value"))
    size = pixels.groupBy("frame").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return images.decoded_occupancy(video, size, 4, 13)


@query("S16_checksum_sidecar", sql("SELECT frame // 4 AS gof, row_number() OVER (PARTITION BY frame // 4 ORDER BY frame) - 1 AS place, md5(n || ',' || s) AS md5 FROM (SELECT frame, count(*) AS n, CAST(sum(x * 7 + z) AS BIGINT) AS s FROM cloud_rec GROUP BY frame) t", "cloud_rec"))
def checksum_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Checksums of frames written as sidecar files of groups of frames and read back."""
    sums = table(spark, sf, "cloud_rec").groupBy("frame").agg(F.md5(F.concat_ws(",", F.count("*"), F.sum(F.col("x") * 7 + F.col("z")))).alias("md5"))
    folder = f"{shared_dir(spark)}/cirrus/sidecar-{uuid.uuid4().hex}"
    sidecar.write(sums, folder, 4)
    return sidecar.read(spark, folder)
