"""Registered queries on atlas assembly: placement, layers, reconstruction, colour cells, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrus.functions import color, geometry
from cirrus.operators import conformance, images, neighbours, patches
from cirrus.plans.more_queries import grouped, simple
from cirrus.plans.queries import _D2, _levels_sql, _points_sql, sql
from cirrus.plans.registry import query
from cirrus.sources.derived import table

VIEWS = "views(view_id, turn, normal, tangent, bitangent, mode) AS (VALUES " + ", ".join(str((i, *v)) for i, v in enumerate(geometry.VIEWS)) + ")"


@query("P15_view_axes", sql(f"WITH {VIEWS} SELECT p.frame, p.patch, v.turn, v.normal, v.tangent, v.bitangent, v.mode FROM patches p JOIN views v ON p.view_id = v.view_id", "patches"))
def view_axes(spark: SparkSession, sf: str) -> DataFrame:
    views = spark.createDataFrame([(i, *v) for i, v in enumerate(geometry.VIEWS)], "view_id int, turn int, normal int, tangent int, bitangent int, mode int")
    return table(spark, sf, "patches").join(F.broadcast(views), "view_id").select("frame", "patch", "turn", "normal", "tangent", "bitangent", "mode")


@query("P17_unturned_points", sql("SELECT frame, pid, (x - z + 64) / 2.0 AS x, CAST(y AS DOUBLE) AS y, (x + z - 64) / 2.0 AS z FROM cloud_src", "cloud_src"))
def unturned_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = geometry.unrotate45(1, F.col("x"), F.col("y"), F.col("z"), 64)
    return table(spark, sf, "cloud_src").select("frame", "pid", x.alias("x"), y.alias("y"), z.alias("z"))


@query("P21_canvas_blocks", sql("SELECT frame, patch, CASE WHEN u0 < 2 AND v0 < 2 THEN u0 + 2 * v0 END AS block FROM patches", "patches"))
def canvas_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The block of a patch's first block on a canvas two blocks wide and high; null outside it."""
    x, y = geometry.patch_to_canvas(F.col("orientation"), F.lit(0), F.lit(0), F.col("u0"), F.col("v0"), F.lit(1), F.lit(1), 1)
    return table(spark, sf, "patches").select("frame", "patch", F.when((x < 2) & (y < 2), x + 2 * y).alias("block"))


@query("P27_local_window", sql("SELECT frame, patch, pid, u AS lu, v AS lv FROM patch_pixels", "patch_pixels"))
def local_window(spark: SparkSession, sf: str) -> DataFrame:
    there = patches.placed(table(spark, sf, "patch_pixels").drop("u0"), table(spark, sf, "patches"))
    u, v = geometry.canvas_to_patch(*[F.col(c) for c in ("orientation", "x", "y", "u0", "v0", "size_u0", "size_v0")], 16)
    return there.select("frame", "patch", "pid", u.alias("lu"), v.alias("lv"))


RING = [(1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)]


@query("P30_border_points", sql("SELECT p.frame, p.x, p.y FROM (SELECT * FROM pixels WHERE occ = 1) p LEFT JOIN (SELECT frame, x, y FROM pixels WHERE occ = 1) q ON q.frame = p.frame AND abs(q.x - p.x) + abs(q.y - p.y) BETWEEN 1 AND 2 GROUP BY p.frame, p.x, p.y HAVING count(q.x) < 12", "pixels"))
def border_points(spark: SparkSession, sf: str) -> DataFrame:
    full = table(spark, sf, "pixels").where("occ = 1").select("frame", "x", "y")
    seen = images.shifted(full, RING).groupBy("frame", "x", "y").agg(F.count("*").alias("n"))
    return full.join(seen, ["frame", "x", "y"], "left").where(F.coalesce("n", F.lit(0)) < len(RING)).select("frame", "x", "y")


@query("P38_sparser_patches", sql("SELECT q.frame, q.patch, q.u // 2 AS u, q.v // 2 AS v, q.d0 FROM patch_pixels q JOIN (SELECT frame, patch, row_number() OVER (PARTITION BY frame ORDER BY size_v DESC, size_u DESC, patch) AS n FROM patches) p ON q.frame = p.frame AND q.patch = p.patch AND p.n <= 3 WHERE q.u % 2 = 0 AND q.v % 2 = 0", "patch_pixels", "patches"))
def sparser_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Every second pixel across and down of the three largest patches of a frame."""
    w = Window.partitionBy("frame").orderBy(F.desc("size_v"), F.desc("size_u"), "patch")
    top = table(spark, sf, "patches").withColumn("n", F.row_number().over(w)).where("n <= 3").select("frame", "patch")
    some = table(spark, sf, "patch_pixels").where("u % 2 = 0 AND v % 2 = 0").join(top, ["frame", "patch"], "left_semi")
    return some.select("frame", "patch", F.expr("CAST(u div 2 AS INT)").alias("u"), F.expr("CAST(v div 2 AS INT)").alias("v"), "d0")


@query("J19_raw_geometry", sql("SELECT frame, pid, CAST(n % 16 AS BIGINT) AS x, CAST(n // 16 AS BIGINT) AS y FROM (SELECT frame, pid, row_number() OVER (PARTITION BY frame ORDER BY pid) - 1 AS n FROM cloud_src WHERE pri = '1-URGENT') t", "cloud_src"))
def raw_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Places of raw points in a stripe sixteen wide, in pid order within a frame."""
    n = F.row_number().over(Window.partitionBy("frame").orderBy("pid")).cast("long") - 1
    return table(spark, sf, "cloud_src").where("pri = '1-URGENT'").withColumn("n", n).select("frame", "pid", (F.col("n") % 16).alias("x"), F.expr("n div 16").alias("y"))


@query("J27_reference_list_steps", sql("SELECT user_id AS grp, event_id AS idx, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events", "log_frames"))
def reference_list_steps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("idx"), (F.col("event_id") - F.lag("event_id").over(w)).alias("step"))


@query("J22_checksums_agree", sql("SELECT bool_and(a.h = b.h) AS same, count(*) AS n FROM (SELECT row_idx, md5(string_agg(v, ',' ORDER BY k)) AS h FROM enc_log GROUP BY row_idx) a JOIN (SELECT row_idx, md5(string_agg(v, ',' ORDER BY k)) AS h FROM dec_log GROUP BY row_idx) b ON a.row_idx = b.row_idx", "enc_log", "dec_log"))
def checksums_agree(spark: SparkSession, sf: str) -> DataFrame:
    def sums(name: str, out: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("k", "v")))
        return table(spark, sf, name).groupBy("row_idx").agg(F.md5(F.concat_ws(",", F.transform(parts, lambda s: s["v"]))).alias(out))

    return sums("enc_log", "a").join(sums("dec_log", "b"), "row_idx").agg(F.bool_and(F.col("a") == F.col("b")).alias("same"), F.count("*").alias("n"))


@query("A22_surface_thickness", sql("SELECT frame, patch, max(t) AS thickness FROM (SELECT q.frame, q.patch, s.t, avg(abs(q.r - q.g)) AS e FROM patch_pixels q JOIN (VALUES (1), (2), (3), (4)) s(t) ON q.d1 - q.d0 <= s.t GROUP BY q.frame, q.patch, s.t HAVING avg(abs(q.r - q.g)) < 86) t GROUP BY frame, patch", "patch_pixels"))
def surface_thickness(spark: SparkSession, sf: str) -> DataFrame:
    """The largest thickness of four whose pixels differ little enough in colour on average; null patches have none."""
    per = table(spark, sf, "patch_pixels").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("d1 - d0 <= t").groupBy("frame", "patch", "t").agg(F.avg(F.abs(F.col("r") - F.col("g"))).alias("e"))
    return per.where("e < 86").groupBy("frame", "patch").agg(F.max("t").alias("thickness"))


@query("A24_colour_cells", sql("SELECT frame, x // 6 AS kx, y // 6 AS ky, z // 6 AS kz, count(*) AS n, CAST(sum(r) AS BIGINT) AS sr, CAST(median(g) AS DOUBLE) AS luma FROM cloud_src GROUP BY ALL", "cloud_src"))
def colour_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = [F.floor(F.col(c) / 6).cast("int").alias(f"k{c}") for c in "xyz"]
    return table(spark, sf, "cloud_src").groupBy("frame", *cells).agg(F.count("*").alias("n"), F.sum("r").alias("sr"), F.median("g").alias("luma"))


@query("U02_residual_points", sql(f"SELECT frame, pid, CAST(d2 AS BIGINT) AS d2 FROM (SELECT a.frame, a.pid, min({_D2}) AS d2 FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame GROUP BY a.frame, a.pid) t WHERE d2 > 1", "cloud_src", "cloud_rec"))
def residual_points(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")).where("d2 > 1").select("frame", "pid", "d2")


@query("F05_unit_yuv", sql("SELECT frame, pid, round((-0.1146::DOUBLE*r - 0.3854::DOUBLE*g + 0.5::DOUBLE*b) / 255.0::DOUBLE + 0.5::DOUBLE, 5) AS u FROM cloud_src", "cloud_src"))
def unit_yuv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").select("frame", "pid", F.round(color.rgb_to_yuv_unit(F.col("r"), F.col("g"), F.col("b"))[1], 5).alias("u"))


@query("I10_yuv_frame", sql("SELECT frame, x, y, CAST(round(0.2126::DOUBLE*c0 + 0.7152::DOUBLE*c1 + 0.0722::DOUBLE*c2) AS INT) AS luma FROM pixels", "pixels"))
def yuv_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", color.rgb_to_yuv(F.col("c0"), F.col("c1"), F.col("c2"))[0].alias("luma"))


@query("I13_rgb_frame", sql("SELECT frame, x, y, CAST(greatest(least(round(c0 + 1.5748::DOUBLE*(c2-128)), 255), 0) AS INT) AS red FROM pixels", "pixels"))
def rgb_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", color.yuv_to_rgb(F.col("c0"), F.col("c1"), F.col("c2"))[0].alias("red"))


@query("I31_interleaved_maps", sql("SELECT frame, x, y, CASE WHEN (x + y) % 2 = 0 THEN d0 ELSE d1 END AS depth FROM pixels", "pixels"))
def interleaved_maps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", F.when((F.col("x") + F.col("y")) % 2 == 0, F.col("d0")).otherwise(F.col("d1")).alias("depth"))


@query("I52_depth_steps", sql("SELECT p.frame, p.x, p.y, max(abs(q.d0 - p.d0)) AS step FROM pixels p JOIN pixels q ON q.frame = p.frame AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY p.frame, p.x, p.y", "pixels"))
def depth_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The largest difference in depth to the four neighbours."""
    near = images.shifted(table(spark, sf, "pixels"), [(1, 0), (-1, 0), (0, 1), (0, -1)], "d0").select("frame", "x", "y", F.col("d0").alias("other"))
    return table(spark, sf, "pixels").join(near, ["frame", "x", "y"]).groupBy("frame", "x", "y").agg(F.max(F.abs(F.col("other") - F.col("d0"))).alias("step"))


@query("R41_reconstruction", sql(_points_sql().replace("SELECT q.frame", "SELECT 'patch' AS origin, q.frame", 1) + " UNION ALL SELECT 'raw', frame, -1, pid, x, y, z FROM cloud_src WHERE pri = '1-URGENT'", "patch_pixels", "patches", "cloud_src"))
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all patches and the raw points."""
    drawn = patches.points_of(table(spark, sf, "patch_pixels"), table(spark, sf, "patches")).withColumn("origin", F.lit("patch"))
    raw = table(spark, sf, "cloud_src").where("pri = '1-URGENT'").select("frame", F.lit(-1).alias("patch"), "pid", *[F.col(c).cast("long").alias(c) for c in "xyz"], F.lit("raw").alias("origin"))
    return drawn.unionByName(raw)


@query("R61_block_modes", sql("SELECT p.frame, p.x, p.y, coalesce(m.mode, 0) AS mode FROM pixels p LEFT JOIN (SELECT frame, patch, 1 + min(eom) AS mode FROM patch_pixels WHERE eom > 5 GROUP BY frame, patch) m ON p.frame = m.frame AND p.patch = m.patch", "pixels", "patch_pixels"))
def block_modes(spark: SparkSession, sf: str) -> DataFrame:
    modes = table(spark, sf, "patch_pixels").where("eom > 5").groupBy("frame", "patch").agg((F.min("eom") + 1).alias("mode"))
    return table(spark, sf, "pixels").join(modes, ["frame", "patch"], "left").select("frame", "x", "y", F.coalesce("mode", F.lit(0)).alias("mode"))


@query(
    "M32_conformance_report",
    sql(
        f"WITH {_levels_sql()}, d AS (SELECT CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'MISSING' WHEN a.v = b.v THEN 'MATCH' ELSE 'DIFF' END AS item FROM enc_log a FULL JOIN dec_log b ON a.file = b.file AND a.row_idx = b.row_idx AND a.k = b.k), "
        "s AS (SELECT sum(num_proj) OVER w AS total, count(*) OVER w AS n FROM log_frames WINDOW w AS (ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) "
        "SELECT item, count(*) AS n FROM d GROUP BY item UNION ALL SELECT 'level ' || level || ' per frame', count(*) FILTER (WHERE num_proj > proj) FROM log_frames, levels GROUP BY level "
        "UNION ALL SELECT 'level ' || level || ' per second', count(*) FILTER (WHERE total > proj_s) FROM s, levels WHERE n = 30 GROUP BY level",
        "enc_log", "dec_log", "log_frames",
    ),
)
def conformance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Log comparison, limits per frame and limits per second in one table."""
    log = table(spark, sf, "log_frames")
    compared = conformance.compared(table(spark, sf, "enc_log"), table(spark, sf, "dec_log")).groupBy(F.col("status").alias("item")).agg(F.count("*").alias("n"))
    name = lambda what: F.concat(F.lit("level "), F.col("level"), F.lit(what))
    frame = conformance.over_frame_limits(log).select(name(" per frame").alias("item"), F.col("proj_over").alias("n"))
    second = conformance.at_levels(conformance.sliding_sums(log)).groupBy("level").agg(F.count_if(F.col("total") > F.col("proj_s")).alias("n")).select(name(" per second").alias("item"), "n")
    return compared.unionByName(frame).unionByName(second)


simple("P25_rotated_sizes", "patches", ["frame", "patch", "CASE WHEN orientation IN (0, 3, 5, 7) THEN size_u ELSE size_v END AS across", "CASE WHEN orientation IN (0, 3, 5, 7) THEN size_v ELSE size_u END AS down"])
simple("P05_contains", "cloud_src", ["frame", "pid", "x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20 AND z BETWEEN 16 AND 24 AS held"])
simple("P33_block_replaced", "pixels", ["frame", "x", "y", "CASE WHEN x BETWEEN 8 AND 15 AND y BETWEEN 8 AND 15 THEN 0 ELSE c0 END AS c0"])
simple("F10_unit_vectors", "cloud_src", ["frame", "pid", "CASE WHEN x * x + y * y + z * z > 0 THEN round(z / sqrt(x * x + y * y + z * z), 6) ELSE 0 END AS uz"])
simple("F19_code_lengths", "cloud_src", ["frame", "pid", "CAST(ceil(log2(r + 2)) AS INT) AS bits"])
simple("F29_unit_names", "log_frames", ["frame_id", "CASE num_eom WHEN 0 THEN 'VPS' WHEN 1 THEN 'AD' WHEN 2 THEN 'OVD' WHEN 3 THEN 'GVD' WHEN 4 THEN 'AVD' ELSE 'RSVD' END AS unit"])
simple("M26_codec_names", "log_frames", ["frame_id", "CASE num_eom % 3 WHEN 0 THEN 'avc1' WHEN 1 THEN 'hvc1' ELSE 'vvc1' END AS codec"])
simple("M11_log_records", "log_frames", ["frame_id", "concat('AtlasFrameIndex=', frame_id, ', NumProjPoints=', num_proj, ', NumRawPoints=', num_raw) AS line"])
simple("R15_patch_orientation", "patches", ["frame", "patch", "CASE WHEN size_u > size_v THEN 1 ELSE 0 END AS orientation"])
simple("R31_eom_rows", "patches", ["frame", "patch", "CAST(ceil(size_u * size_v / 64.0) AS INT) AS rows"])
simple("I17_unit_yuv16", "pixels", ["frame", "x", "y", "round((CAST(c1 AS DOUBLE) * 4 - 512) / 1023, 6) AS u"])
grouped("P35_video_all_zero", "pixels", ["x", "y"], ["bool_and(c0 = 0) AS all_zero"])
grouped("P30_patch_boxes", "patch_pixels", ["frame", "patch"], ["min(u) AS u_min", "max(u) AS u_max", "min(v) AS v_min", "max(v) AS v_max", "min(d0) AS d_min", "max(d0) AS d_max"])
grouped("M39_bitstream_statistics", "enc_log", ["k"], ["CAST(sum(length(v)) AS BIGINT) AS bytes", "count(*) AS units"])
