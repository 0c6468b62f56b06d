"""Further registered queries: files, kernels, streams, and operators that are one expression or one aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrus.functions import checksums
from cirrus.operators import normals, packing
from cirrus.plans.lineage import shared_dir
from cirrus.plans.queries import sql
from cirrus.plans.registry import query
from cirrus.sources import ply
from cirrus.sources.derived import table
from cirrus.streaming import frames


@query("S01_ply_round_trip", sql("SELECT frame, x, y, z, r, g, b FROM cloud_src", "cloud_src"))
def ply_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Frames written as binary PLY files and read back."""
    folder = f"{shared_dir(spark)}/cirrus/ply-{uuid.uuid4().hex}"
    ply.write(table(spark, sf, "cloud_src"), folder)
    return ply.read(spark, folder).select("frame", "x", "y", "z", "r", "g", "b")


@query("R01_normals")
def surface_normals(spark: SparkSession, sf: str) -> DataFrame:
    return normals.normals(table(spark, sf, "cloud_src"), 9, (24.0, 24.0, 1000.0))


@query("A09_point_to_plane")
def point_to_plane(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "cloud_rec"), table(spark, sf, "cloud_src")
    return normals.point_to_plane(a, b, normals.normals(b, 9, (24.0, 24.0, 1000.0)))


def sized(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patches").withColumn("size_u0", F.expr("1 + patch % 3")).withColumn("size_v0", F.expr("CAST(1 + patch div 3 AS INT)"))


@query("R17_flexible_packing")
def flexible_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.flexible(sized(spark, sf))


@query("J09_patch_matching")
def patch_matching(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "patches")
    return packing.matched(now.withColumn("frame", F.col("frame") + 1), now)


@query("F31_frame_md5")
def frame_md5(spark: SparkSession, sf: str) -> DataFrame:
    return checksums.frame_md5(table(spark, sf, "cloud_rec"), canonical=True)


@query("F35_crc16", sql("SELECT row_idx, k, CAST(list_reduce(list_prepend(7439, list_transform(string_split(v, ''), lambda x: ascii(x))), lambda c, b: xor(xor((c << 8) & 65535, (xor((xor(c >> 8, b) & 255), (xor(c >> 8, b) & 255) >> 4) << 12) & 65535), xor((xor((xor(c >> 8, b) & 255), (xor(c >> 8, b) & 255) >> 4) << 5) & 65535, xor((xor(c >> 8, b) & 255), (xor(c >> 8, b) & 255) >> 4)))) AS INTEGER) AS crc16 FROM enc_log", "enc_log"))
def crc16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "enc_log").select("row_idx", "k", checksums.crc16(F.col("v")).alias("crc16"))


@query("F34_text_md5", sql("SELECT row_idx, k, md5(v) AS md5 FROM enc_log", "enc_log"))
def text_md5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "enc_log").select("row_idx", "k", F.md5("v").alias("md5"))


@query("O15_streamed_groups", sql("SELECT frame_id // 32 AS gof, count(*) AS frames, CAST(sum(num_proj) AS BIGINT) AS points, max(frame_id) AS last_frame FROM log_frames GROUP BY frame_id // 32", "log_frames"))
def streamed_groups(spark: SparkSession, sf: str) -> DataFrame:
    events = frames.stream(spark, f"{sf}/events.parquet")
    records = events.select(F.col("event_id").cast("int").alias("frame_id"), (F.col("user_id") * 20000).cast("long").alias("num_proj"))
    return frames.drained(frames.groups_of_frames(records), "gof", "gof")


# ---- one expression or one aggregate each -------------------------------------------------------------------------


def simple(name: str, source: str, spark_select: list[str], duck_select: str | None = None, where: str | None = None) -> None:
    """Registers a projection that both engines spell (nearly) alike."""
    tail = f" WHERE {where}" if where else ""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, source)
        return (rows.where(where) if where else rows).selectExpr(*spark_select)

    query(name, sql(f"SELECT {duck_select or ', '.join(spark_select)} FROM {source}{tail}", source))(build)


simple("P14_colour_difference", "cloud_src", ["frame", "pid", "(r - g) * (r - g) + (g - b) * (g - b) AS d2"])
simple("P22_normal_coordinate", "patches", ["frame", "patch", "CASE WHEN view_id % 2 = 0 THEN 5 + d1 ELSE greatest(0, d1 - 5) END AS coordinate"])
simple("P24_depth_of_point", "patch_pixels", ["frame", "pid", "d1 - d0 AS thickness"])
simple("P32_block_copy", "pixels", ["frame", "x - 16 AS x", "y - 8 AS y", "c0"], where="x BETWEEN 16 AND 31 AND y BETWEEN 8 AND 31")
simple("P11_colour_fill", "cloud_src", ["frame", "pid", "x", "y", "z", "0 AS r", "255 AS g", "127 AS b"])
simple("I04_swapped_channels", "pixels", ["frame", "x", "y", "c2 AS c0", "c1", "c0 AS c2"])
simple("I14_unit_rgb", "pixels", ["frame", "x", "y", "round(CAST(c0 AS DOUBLE) / 255, 6) AS r"])
simple("I15_clamped_yuv", "pixels", ["frame", "x", "y", "round(greatest(least((CAST(c0 AS DOUBLE) * 1.2 - 10) / 255, CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)), 6) AS y_unit"], "frame, x, y, round(greatest(least((c0::DOUBLE * 1.2::DOUBLE - 10) / 255, 1::DOUBLE), 0::DOUBLE), 6) AS y_unit")
simple("I19_whole_rgb", "pixels", ["frame", "x", "y", "CAST(greatest(least(floor(c0 * 4 + 0.5), 1023), 0) AS INT) AS r10"])
simple("I25_eom_in_occupancy", "patch_pixels", ["frame", "patch", "pid", "CASE WHEN eom > 0 THEN eom + 1 ELSE 1 END AS symbol"])
simple("I30_geometry_residual", "pixels", ["frame", "x", "y", "least(abs(d1 - d0), 9) AS residual"])
simple("F07_clip", "cloud_src", ["frame", "pid", "greatest(least(r * 2 - 100, 255), 0) AS clipped"])
simple("F08_nearly_equal", "cloud_src", ["frame", "pid", "abs(r - g) < 10 AS near"])
simple("F13_matrix_vector", "cloud_src", ["frame", "pid", "2 * x - y + z AS a", "x + 3 * y AS b", "4 * z - x AS c"])
simple("F23_token_split", "enc_log", ["row_idx", "split(concat(k, ' ', v), '[ ]+')[1] AS second"], "row_idx, string_split(concat(k, ' ', v), ' ')[2] AS second")
simple("F24_parameter", "enc_log", ["row_idx", "regexp_extract(concat('a=1 ', k, '=', v), 'Points=([0-9]+)', 1) AS value"])
simple("F26_file_names", "enc_log", ["row_idx", "regexp_extract(concat('/d/', file, '_', v, '.log'), '([^/]*)[.]([^.]*)$', 1) AS base", "regexp_extract(concat('/d/', file, '_', v, '.log'), '([^/]*)[.]([^.]*)$', 2) AS ext"])
simple("F27_video_names", "log_frames", ["frame_id", "format_string('%s_%dx%d_%dbit_p420.yuv', 'geo', num_eom * 64, 128, 10) AS name"], "frame_id, printf('%s_%dx%d_%dbit_p420.yuv', 'geo', num_eom * 64, 128, 10) AS name")
simple("F28_patch_types", "patches", ["frame", "patch", "CASE WHEN orientation = 0 THEN 'intra' WHEN orientation = 1 THEN 'inter' WHEN orientation = 2 THEN 'merge' WHEN orientation = 3 THEN 'skip' WHEN orientation = 4 THEN 'raw' ELSE 'eom' END AS kind"])
simple("A39_limit", "log_frames", ["frame_id", "num_proj > 1000000 AS over"])
simple("A36_toolset_violations", "log_frames", ["frame_id", "num_eom > 5 AS eom_off", "num_raw > 4000 AND num_eom > 0 AS raw_off"])


def grouped(name: str, source: str, keys: list[str], spark_aggs: list[str], duck_aggs: list[str] | None = None, where: str | None = None) -> None:
    """Registers an aggregate that both engines spell (nearly) alike."""
    tail = f" WHERE {where}" if where else ""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = table(spark, sf, source)
        return (rows.where(where) if where else rows).groupBy(*[F.expr(k) for k in keys]).agg(*[F.expr(a) for a in spark_aggs])

    query(name, sql(f"SELECT {', '.join(keys + (duck_aggs or spark_aggs))} FROM {source}{tail} GROUP BY ALL", source))(build)


grouped("P34_all_zero", "pixels", ["frame"], ["bool_and(occ = 0) AS all_zero", "max(c0) AS top"])
grouped("A20_second_layer", "patch_pixels", ["frame", "patch", "u"], ["min(d0) AS near", "max(CASE WHEN d1 - d0 <= 2 THEN d1 END) AS far", "bit_or(shiftleft(1, eom)) AS bits"], ["min(d0) AS near", "max(CASE WHEN d1 - d0 <= 2 THEN d1 END) AS far", "bit_or(1 << eom) AS bits"])
grouped("A25_mean_luma", "pixels", ["frame", "patch"], ["round(avg(c0), 6) AS mean"])
grouped("A26_median_luma", "pixels", ["frame", "patch"], ["CAST(median(c0) AS DOUBLE) AS median"])
grouped("A30_running_totals", "log_frames", ["num_eom"], ["CAST(sum(num_proj + num_raw) AS BIGINT) AS total", "count(*) AS frames"])
grouped("A37_layer_counts", "patch_pixels", ["frame", "patch"], ["count(*) AS d0s", "CAST(count_if(d1 > d0) AS BIGINT) AS d1s", "max(d1) AS size_d"])
grouped("I23_occupied_blocks", "pixels", ["frame", "patch"], ["CAST(count_if(occ = 1) AS BIGINT) AS occupied", "min(x) AS left_", "max(x) AS right_"])


@query("O08_patch_order", sql("SELECT frame, patch, row_number() OVER (PARTITION BY frame ORDER BY size_v DESC, size_u DESC, patch) - 1 AS place FROM patches", "patches"))
def patch_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("frame").orderBy(F.desc("size_v"), F.desc("size_u"), "patch")
    return table(spark, sf, "patches").select("frame", "patch", (F.row_number().over(w).cast("long") - 1).alias("place"))


@query("O11_matched_first", sql("SELECT frame, patch, row_number() OVER (PARTITION BY frame ORDER BY view_id < 6 DESC, orientation, patch) - 1 AS place FROM patches", "patches"))
def matched_first(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("frame").orderBy((F.col("view_id") < 6).desc(), "orientation", "patch")
    return table(spark, sf, "patches").select("frame", "patch", (F.row_number().over(w).cast("long") - 1).alias("place"))


@query("M25_tile_offsets", sql("SELECT frame, patch, CAST(sum(size_u) OVER (PARTITION BY frame ORDER BY patch) - size_u AS BIGINT) AS left_ FROM patches", "patches"))
def tile_offsets(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("frame").orderBy("patch")
    return table(spark, sf, "patches").select("frame", "patch", (F.sum("size_u").over(w) - F.col("size_u")).alias("left_"))


@query("A31_size_report", sql("SELECT row_idx, CAST(sum(length(v)) AS BIGINT) AS total, CAST(sum(length(v)) FILTER (WHERE k = 'NumProjPoints') AS BIGINT) AS geometry, CAST(sum(length(v)) - sum(length(v)) FILTER (WHERE k = 'NumProjPoints') AS BIGINT) AS metadata FROM enc_log GROUP BY row_idx", "enc_log"))
def size_report(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("v")
    geometry = F.sum(F.when(F.col("k") == "NumProjPoints", n))
    return table(spark, sf, "enc_log").groupBy("row_idx").agg(F.sum(n).alias("total"), geometry.alias("geometry"), (F.sum(n) - geometry).alias("metadata"))


@query("I33_scattered_attributes", sql("SELECT q.frame, q.pid % 2 AS map, q.u AS x, q.v AS y, min(q.r) AS c0 FROM patch_pixels q GROUP BY ALL", "patch_pixels"))
def scattered_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patch_pixels").groupBy("frame", (F.col("pid") % 2).alias("map"), F.col("u").alias("x"), F.col("v").alias("y")).agg(F.min("r").alias("c0"))


@query("P36_tile_shift", sql("SELECT q.frame, q.patch, q.x + p.u0 * 100 AS x, q.y + p.v0 * 100 AS y FROM pixels q JOIN patches p ON q.frame = p.frame AND q.patch = p.patch", "pixels", "patches"))
def tile_shift(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "patches").select("frame", "patch", "u0", "v0")
    return table(spark, sf, "pixels").join(p, ["frame", "patch"]).select("frame", "patch", (F.col("x") + F.col("u0") * 100).alias("x"), (F.col("y") + F.col("v0") * 100).alias("y"))


@query("U07_lossless_difference", sql("SELECT frame, x, y, z FROM cloud_src EXCEPT ALL SELECT frame, x, y, z FROM cloud_rec", "cloud_src", "cloud_rec"))
def lossless_difference(spark: SparkSession, sf: str) -> DataFrame:
    place = ["frame", "x", "y", "z"]
    return table(spark, sf, "cloud_src").select(place).exceptAll(table(spark, sf, "cloud_rec").select(place))
