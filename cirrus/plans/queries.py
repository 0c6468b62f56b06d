"""One registered query for each operator: on the given tables as a whole, with the same in SQL beside it.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cirrus.functions import color, geometry
from cirrus.operators import conformance, images, metrics, neighbours, patches, points, segmentation, smoothing, transfer
from cirrus.plans.registry import query
from cirrus.sources.derived import table, with_tables

LOG_NAMES = ("NumProjPoints", "NumRawPoints", "NumEomPoints")


def rgb() -> list:
    return [F.col(c) for c in "rgb"]


def sql(text: str, *names: str) -> str:
    return with_tables(text, *names)


# ---- points -------------------------------------------------------------------------------------------------------


@query("P01_append", sql("SELECT frame, pid, x, y, z FROM cloud_src UNION ALL SELECT frame, pid, x, y, z FROM cloud_rec", "cloud_src", "cloud_rec"))
def append(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["frame", "pid", "x", "y", "z"]
    return table(spark, sf, "cloud_src").select(cols).unionByName(table(spark, sf, "cloud_rec").select(cols))


@query("P02_box_empty", sql("SELECT frame, NOT coalesce(bool_or(x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 30 AND z BETWEEN 16 AND 18), false) AS is_empty FROM cloud_src GROUP BY frame", "cloud_src"))
def box_empty(spark: SparkSession, sf: str) -> DataFrame:
    hit = geometry.inside([F.col(c) for c in "xyz"], [20, 10, 16], [40, 30, 18])
    return table(spark, sf, "cloud_src").groupBy("frame").agg((~F.bool_or(hit)).alias("is_empty"))


@query("P03_points_in_box", sql("SELECT frame, pid FROM cloud_src WHERE x BETWEEN 12 AND 30 AND y BETWEEN 12 AND 44 AND z BETWEEN 16 AND 40", "cloud_src"))
def points_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").where(geometry.inside([F.col(c) for c in "xyz"], [12, 12, 16], [30, 44, 40])).select("frame", "pid")


@query(
    "P08_boxes_meet",
    sql(
        """SELECT a.frame, a.patch AS a, b.patch AS b FROM bx a JOIN bx b ON a.frame = b.frame AND a.patch < b.patch AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1""",
        "patch_pixels",
        "patches",
    ).replace(") SELECT a.frame, a.patch AS a", "), bx AS (SELECT q.frame, q.patch, min(q.u + p.u1) - 1 AS x0, max(q.u + p.u1) + 1 AS x1, min(q.v + p.v1) - 1 AS y0, max(q.v + p.v1) + 1 AS y1, min(q.d0 + p.d1) AS z0, max(q.d0 + p.d1) AS z1 FROM patch_pixels q JOIN patches p ON q.frame = p.frame AND q.patch = p.patch GROUP BY q.frame, q.patch) SELECT a.frame, a.patch AS a"),
)
def boxes_meet(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "patch_pixels").drop("d1").join(table(spark, sf, "patches").select("frame", "patch", "u1", "v1", "d1"), ["frame", "patch"])
    x, y, z = F.col("u") + F.col("u1"), F.col("v") + F.col("v1"), F.col("d0") + F.col("d1")
    box = q.groupBy("frame", "patch").agg((F.min(x) - 1).alias("x0"), (F.max(x) + 1).alias("x1"), (F.min(y) - 1).alias("y0"), (F.max(y) + 1).alias("y1"), F.min(z).alias("z0"), F.max(z).alias("z1"))
    side = lambda s: box.select("frame", *[F.col(c).alias(c + s) for c in box.columns[1:]])
    ends = lambda s: [(F.col(f"{c}0{s}"), F.col(f"{c}1{s}")) for c in "xyz"]
    return side("a").join(side("b"), "frame").where((F.col("patcha") < F.col("patchb")) & geometry.boxes_meet(ends("a"), ends("b"))).select("frame", F.col("patcha").alias("a"), F.col("patchb").alias("b"))


@query("P12_truncated_colour", sql("SELECT frame, pid, (r * 259 + g) % 256 AS r8 FROM cloud_src", "cloud_src"))
def truncated_colour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").select("frame", "pid", ((F.col("r") * 259 + F.col("g")) % 256).alias("r8"))


@query("P13_colour_similarity", sql("SELECT a.frame, a.pid, abs(a.r - b.r) < 3 AND abs(a.g - b.g) < 3 AND abs(a.b - b.b) < 3 AS similar, (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) AS d2 FROM cloud_src a JOIN cloud_rec b ON a.pid = b.pid", "cloud_src", "cloud_rec"))
def colour_similarity(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec").select("pid", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    other = [F.col(f"{c}2") for c in "rgb"]
    return a.join(b, "pid").select("frame", "pid", color.similar(rgb(), other, 3).alias("similar"), color.squared(rgb(), other).alias("d2"))


@query("A01_first_of_place", sql("SELECT frame, x, y, z, pid, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY frame, x, y, z ORDER BY pid) AS n FROM cloud_rec) t WHERE n = 1", "cloud_rec"))
def first_of_place(spark: SparkSession, sf: str) -> DataFrame:
    return points.first_of_each_place(table(spark, sf, "cloud_rec")).select("frame", "x", "y", "z", "pid", "r", "g", "b")


@query("A02_average_of_place", sql("SELECT frame, x, y, z, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b, count(*) AS n FROM cloud_rec GROUP BY frame, x, y, z", "cloud_rec"))
def average_of_place(spark: SparkSession, sf: str) -> DataFrame:
    return points.averaged_places(table(spark, sf, "cloud_rec"))


@query("A03_centroid", sql("SELECT frame, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, count(*) AS n FROM cloud_rec GROUP BY frame", "cloud_rec"))
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return points.centroids(table(spark, sf, "cloud_rec"))


@query("A04_bounding_box", sql("SELECT frame, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM cloud_rec GROUP BY frame", "cloud_rec"))
def bounding_box(spark: SparkSession, sf: str) -> DataFrame:
    return points.boxes(table(spark, sf, "cloud_rec"))


@query("A15_voxels", sql("SELECT frame, (x + 2) // 4 AS vx, (y + 2) // 4 AS vy, (z + 2) // 4 AS vz, min(pid) AS first_pid, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r FROM cloud_rec GROUP BY frame, (x + 2) // 4, (y + 2) // 4, (z + 2) // 4", "cloud_rec"))
def voxel_cells(spark: SparkSession, sf: str) -> DataFrame:
    return points.voxels(table(spark, sf, "cloud_rec"), 4)


@query("A18_axis_weights", sql("SELECT frame, count(DISTINCT y * 100000 + z) AS yz, count(DISTINCT z * 100000 + x) AS zx, count(DISTINCT x * 100000 + y) AS xy FROM cloud_rec GROUP BY frame", "cloud_rec"))
def axis_weights(spark: SparkSession, sf: str) -> DataFrame:
    return points.axis_weights(table(spark, sf, "cloud_rec"))


@query("O01_canonical_order", sql("SELECT frame, pid, row_number() OVER (PARTITION BY frame ORDER BY x, y, z, r, g, b, pid) - 1 AS place FROM cloud_rec", "cloud_rec"))
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    return points.canonical_order(table(spark, sf, "cloud_rec"))


def _morton_sql(x: str, y: str, z: str, bits: int = 16) -> str:
    return " + ".join(f"(((CAST({c} AS BIGINT) >> {i}) & 1) << {3 * i + k})" for i in range(bits) for k, c in enumerate((z, y, x)))


@query("O06_morton", sql(f"SELECT frame, pid, {_morton_sql('x', 'y', 'z')} AS morton FROM cloud_rec", "cloud_rec"))
def morton_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_rec").select("frame", "pid", geometry.morton(F.col("x"), F.col("y"), F.col("z")).alias("morton"))


@query("U01_missed_points", sql("SELECT frame, pid FROM cloud_src s WHERE NOT EXISTS (SELECT 1 FROM cloud_rec r WHERE r.frame = s.frame AND r.x = s.x AND r.y = s.y AND r.z = s.z)", "cloud_src", "cloud_rec"))
def missed_points(spark: SparkSession, sf: str) -> DataFrame:
    return points.missed(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")).select("frame", "pid")


@query("U03_pruned_points", sql("SELECT a.frame, a.pid, round(sum(1.0 / ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))), 6) AS density FROM cloud_src a JOIN cloud_src b ON a.frame = b.frame AND a.pid <> b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 10 GROUP BY a.frame, a.pid HAVING sum(1.0 / ((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) > 2", "cloud_src"))
def pruned_points(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    near = neighbours.within(src, src, 10).where("pid <> nn_pid").groupBy("frame", "pid").agg(F.sum(1.0 / F.col("d2")).alias("s"))
    return near.where("s > 2").select("frame", "pid", F.round("s", 6).alias("density"))


@query("U04_boxed_points", sql("SELECT frame, box_x, box_y, box_z, n, dense_rank() OVER (PARTITION BY frame ORDER BY box_x, box_y, box_z) - 1 AS patch FROM (SELECT frame, x // 16 AS box_x, y // 16 AS box_y, z // 16 AS box_z, count(*) AS n FROM cloud_rec GROUP BY ALL) t", "cloud_rec"))
def boxed_points(spark: SparkSession, sf: str) -> DataFrame:
    return points.boxed(table(spark, sf, "cloud_rec"), 16)


@query("J07_normals_by_place", sql("SELECT s.frame, s.pid, max(r.pid) AS last_pid FROM cloud_src s LEFT JOIN cloud_rec r ON s.frame = r.frame AND s.x = r.x AND s.y = r.y AND s.z = r.z GROUP BY s.frame, s.pid", "cloud_src", "cloud_rec"))
def normals_by_place(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "cloud_rec").groupBy("frame", "x", "y", "z").agg(F.max("pid").alias("last_pid"))
    return table(spark, sf, "cloud_src").join(last, ["frame", "x", "y", "z"], "left").select("frame", "pid", "last_pid")


@query("J25_voxel_payload", sql("SELECT s.frame, s.pid, v.n FROM cloud_src s JOIN (SELECT frame, (x + 4) // 8 AS vx, (y + 4) // 8 AS vy, (z + 4) // 8 AS vz, count(*) AS n FROM cloud_src GROUP BY ALL) v ON s.frame = v.frame AND (s.x + 4) // 8 = v.vx AND (s.y + 4) // 8 = v.vy AND (s.z + 4) // 8 = v.vz", "cloud_src"))
def voxel_payload(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    cell = [F.floor((F.col(c) + 4) / 8).cast("long").alias(f"v{c}") for c in "xyz"]
    return src.select("frame", "pid", *cell).join(points.voxels(src, 8).select("frame", "vx", "vy", "vz", "n"), ["frame", "vx", "vy", "vz"]).select("frame", "pid", "n")


@query("F37_rounded_cells", sql("SELECT frame, pid, (x + 4) // 8 AS cx, (x + 4) % 8 AS ox FROM cloud_src", "cloud_src"))
def rounded_cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").select("frame", "pid", F.expr("CAST((x + 4) div 8 AS INT)").alias("cx"), F.expr("(x + 4) % 8").alias("ox"))


@query("F09_vector_algebra", sql("SELECT frame, pid, x*x + y*y + z*z AS norm2, round(x / sqrt(x*x + y*y + z*z), 6) AS ux, y * b - z * g AS cross_x, z * r - x * b AS cross_y, x * g - y * r AS cross_z, x * r + y * g + z * b AS dot FROM cloud_src", "cloud_src"))
def vector_algebra(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").selectExpr("frame", "pid", "x*x + y*y + z*z AS norm2", "round(x / sqrt(x*x + y*y + z*z), 6) AS ux", "y * b - z * g AS cross_x", "z * r - x * b AS cross_y", "x * g - y * r AS cross_z", "x * r + y * g + z * b AS dot")


@query("F20_bit_lengths", sql("SELECT frame, pid, CASE WHEN r = 0 THEN -1 ELSE length(ltrim(bin(r), '0')) - 1 END AS floor_log2, CASE WHEN r <= 1 THEN 0 ELSE length(ltrim(bin(r - 1), '0')) END AS ceil_log2 FROM cloud_src", "cloud_src"))
def bit_lengths(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    return table(spark, sf, "cloud_src").select("frame", "pid", F.when(r == 0, -1).otherwise(F.length(F.bin(r)) - 1).cast("long").alias("floor_log2"), F.when(r <= 1, 0).otherwise(F.length(F.bin(r - 1))).cast("long").alias("ceil_log2"))


@query("F17_bit_depths", sql("SELECT frame, pid, r << 2 AS up, (r * 4) >> 2 AS down, least(r * 4, 255) AS clipped FROM cloud_src", "cloud_src"))
def bit_depths(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("r")
    return table(spark, sf, "cloud_src").select("frame", "pid", color.change_depth(r, 8, 10, True).alias("up"), color.change_depth(r * 4, 10, 8, True).alias("down"), color.change_depth(r * 4, 10, 8, False).alias("clipped"))


@query("F01_rgb_to_yuv", sql("SELECT frame, pid, CAST(round(0.2126::DOUBLE*r + 0.7152::DOUBLE*g + 0.0722::DOUBLE*b) AS INT) AS y8, CAST(round(-0.114572::DOUBLE*r - 0.385428::DOUBLE*g + 0.5::DOUBLE*b + 128.0::DOUBLE) AS INT) AS u8, CAST(round(0.5::DOUBLE*r - 0.454153::DOUBLE*g - 0.045847::DOUBLE*b + 128.0::DOUBLE) AS INT) AS v8 FROM cloud_src", "cloud_src"))
def rgb_to_yuv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").select("frame", "pid", *[c.alias(n) for c, n in zip(color.rgb_to_yuv(*rgb()), ("y8", "u8", "v8"))])


@query("F03_yuv_to_rgb", sql("SELECT frame, pid, CAST(greatest(least(round(r + 1.5748::DOUBLE*(b-128)), 255), 0) AS INT) AS r8, CAST(greatest(least(round(r - 0.18733::DOUBLE*(g-128) - 0.46813::DOUBLE*(b-128)), 255), 0) AS INT) AS g8, CAST(greatest(least(round(r + 1.85563::DOUBLE*(g-128)), 255), 0) AS INT) AS b8 FROM cloud_src", "cloud_src"))
def yuv_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").select("frame", "pid", *[c.alias(n) for c, n in zip(color.yuv_to_rgb(*rgb()), ("r8", "g8", "b8"))])


@query("I16_unit_to_whole", sql("SELECT frame, pid, CAST(greatest(least(round(65535.0::DOUBLE * (r / 255.0::DOUBLE)), 65535), 0) AS INT) AS y16, CAST(greatest(least(round(1023.0::DOUBLE * (g / 255.0::DOUBLE - 0.5) + 512.0), 1023), 0) AS INT) AS u10, round((b * 4 - 512.0) / 1023.0, 6) AS v_unit FROM cloud_src", "cloud_src"))
def unit_to_whole(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda c: F.col(c) / F.lit(255.0)
    return table(spark, sf, "cloud_src").select("frame", "pid", color.unit_to_whole(unit("r"), 16, False).alias("y16"), color.unit_to_whole(unit("g") - 0.5, 10, True).alias("u10"), F.round(color.whole_to_unit(F.col("b") * 4, 10, True), 6).alias("v_unit"))


@query("P16_turned_points", sql("SELECT frame, pid, x + z AS x1, y AS y1, 64 - x + z AS z1, ((x + z) - (64 - x + z) + 64) / 2.0 AS back FROM cloud_src", "cloud_src"))
def turned_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = geometry.rotate45(1, F.col("x"), F.col("y"), F.col("z"), 64)
    return table(spark, sf, "cloud_src").select("frame", "pid", x.alias("x1"), y.alias("y1"), z.alias("z1"), geometry.unrotate45(1, x, y, z, 64)[0].alias("back"))


# ---- neighbours and metrics ---------------------------------------------------------------------------------------

_D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_NN = f"nn AS (SELECT a.frame, a.pid, min({_D2}) AS d2 FROM {{a}} a JOIN {{b}} b ON a.frame = b.frame GROUP BY a.frame, a.pid)"
_WAY = "w{n} AS (SELECT frame, count(*) AS n, CAST(sum(d2) AS BIGINT) AS sse, CAST(max(d2) AS BIGINT) AS hausdorff, round(sum(d2) / count(*), 6) AS mse, round(CASE WHEN sum(d2) = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(3.0 * 1023 * 1023 / (CASE WHEN sum(d2) = 0 THEN 1 ELSE sum(d2) / count(*) END)) END, 6) AS psnr, round(CASE WHEN max(d2) = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(3.0 * 1023 * 1023 / (CASE WHEN max(d2) = 0 THEN 1 ELSE max(d2) END)) END, 6) AS hausdorff_psnr FROM nn{n} GROUP BY frame)"


def _ways() -> str:
    one = _NN.format(a="cloud_src", b="cloud_rec").replace("nn AS", "nn1 AS", 1)
    two = _NN.format(a="cloud_rec", b="cloud_src").replace("nn AS", "nn2 AS", 1)
    return f"WITH {one}, {_WAY.format(n=1)}, {two}, {_WAY.format(n=2)} "


@query("A05_point_to_point", sql(_ways() + "SELECT * FROM w1", "cloud_src", "cloud_rec"))
def point_to_point(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.one_way(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec"))


@query("A10_symmetric_distortion", sql(_ways() + "SELECT w1.frame, greatest(w1.mse, w2.mse) AS mse, greatest(w1.hausdorff, w2.hausdorff) AS hausdorff, least(w1.psnr, w2.psnr) AS psnr, least(w1.hausdorff_psnr, w2.hausdorff_psnr) AS hausdorff_psnr FROM w1 JOIN w2 ON w1.frame = w2.frame", "cloud_src", "cloud_rec"))
def symmetric_distortion(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")
    return metrics.symmetric(metrics.one_way(a, b), metrics.one_way(b, a))


@query("J01_nearest_neighbours", sql(f"SELECT frame, pid, rank, nn_pid, d2 FROM (SELECT a.frame, a.pid, b.pid AS nn_pid, CAST({_D2} AS BIGINT) AS d2, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS rank FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame) t WHERE rank <= 4", "cloud_src", "cloud_rec"))
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec"), 4)


@query("J05_radius_adjacency", sql(f"SELECT a.frame, a.pid, count(*) AS degree, CAST(sum(b.pid) AS BIGINT) AS sum_pid FROM cloud_src a JOIN cloud_src b ON a.frame = b.frame AND {_D2} <= 3 GROUP BY a.frame, a.pid", "cloud_src"))
def radius_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    return neighbours.within(src, src, 3).groupBy("frame", "pid").agg(F.count("*").alias("degree"), F.sum("nn_pid").alias("sum_pid"))


@query("J08_tied_neighbours", sql(f"SELECT frame, pid, count(*) AS ties, CAST(min(d2) AS BIGINT) AS d2 FROM (SELECT a.frame, a.pid, {_D2} AS d2, rank() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}) AS k FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame) t WHERE k = 1 GROUP BY frame, pid", "cloud_src", "cloud_rec"))
def tied_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.tied(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")).groupBy("frame", "pid").agg(F.count("*").alias("ties"), F.min("d2").alias("d2"))


_YUV = "((0.2126::DOUBLE*{p}.r + 0.7152::DOUBLE*{p}.g + 0.0722::DOUBLE*{p}.b) / 255.0::DOUBLE)"


@query("A06_colour_distortion", sql(f"SELECT frame, round(avg(dy * dy), 6) AS mse_y FROM (SELECT a.frame, {_YUV.format(p='a')} - {_YUV.format(p='b')} AS dy, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS k FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame) t WHERE k = 1 GROUP BY frame", "cloud_src", "cloud_rec"))
def colour_distortion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.colour(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")).select("frame", "mse_y")


@query("C06_distance_weighted_colour", sql(f"SELECT frame, pid, round(sum(r / (d2 * d2)) / sum(1.0 / (d2 * d2)), 4) AS r FROM (SELECT a.frame, a.pid, b.r, greatest({_D2}, 1)::DOUBLE AS d2, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS k FROM cloud_src a JOIN cloud_rec b ON a.frame = b.frame) t WHERE k <= 5 GROUP BY frame, pid", "cloud_src", "cloud_rec"))
def distance_weighted_colour(spark: SparkSession, sf: str) -> DataFrame:
    rec = table(spark, sf, "cloud_rec")
    near = neighbours.nearest(table(spark, sf, "cloud_src"), rec, 5).join(rec.select("frame", F.col("pid").alias("nn_pid"), "r"), ["frame", "nn_pid"])
    d2 = F.greatest(F.col("d2"), F.lit(1)).cast("double")
    return near.groupBy("frame", "pid").agg(F.round(F.sum(F.col("r") / (d2 * d2)) / F.sum(1.0 / (d2 * d2)), 4).alias("r"))


_ONE = "(SELECT frame, pid, nn, r FROM (SELECT a.frame, a.pid, b.pid AS nn, {r} AS r, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY " + _D2 + ", b.pid) AS k FROM {a} a JOIN {b} b ON a.frame = b.frame) t WHERE k = 1)"


@query("C05_two_way_colour", sql(f"WITH f AS {_ONE.format(a='cloud_src', b='cloud_rec', r='b.r')}, w AS (SELECT frame, nn AS pid, CAST(round(avg(r)) AS INT) AS r FROM {_ONE.format(a='cloud_rec', b='cloud_src', r='a.r')} t GROUP BY frame, nn) SELECT f.frame, f.pid, coalesce(w.r, f.r) AS r FROM f LEFT JOIN w ON f.frame = w.frame AND f.pid = w.pid", "cloud_src", "cloud_rec"))
def two_way_colour(spark: SparkSession, sf: str) -> DataFrame:
    return transfer.two_way(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")).select("frame", "pid", "r")


@query("C07_mixed_colour")
def mixed_colour(spark: SparkSession, sf: str) -> DataFrame:
    return transfer.mixed(table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec"))


@query("R08_refined_planes")
def refined_planes(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    normals = src.select("frame", "pid", *[((F.col(c) - 128) / F.lit(128.0)).alias(n) for c, n in zip("rgb", ("nx", "ny", "nz"))])
    return transfer.refined_planes(src, normals, 9, 3, 3.0, [1.0, 1.0, 1.0])


@query("R47_radius_smoothing", sql(f"SELECT a.frame, a.pid, round(avg(b.x), 6) AS cx, round(avg(b.y), 6) AS cy, round(avg(b.z), 6) AS cz FROM cloud_src a JOIN cloud_src b ON a.frame = b.frame AND {_D2} <= 8 GROUP BY a.frame, a.pid", "cloud_src"))
def radius_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    near = neighbours.within(src, src, 8).join(src.select("frame", F.col("pid").alias("nn_pid"), "x", "y", "z"), ["frame", "nn_pid"])
    return near.groupBy("frame", "pid").agg(*[F.round(F.avg(c), 6).alias(f"c{c}") for c in "xyz"])


@query("R12_components", None)
def adjacent_components(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.components(table(spark, sf, "cloud_rec"), 2)


@query("R07_initial_planes", sql("SELECT frame, pid, CASE WHEN m = s0 THEN 0 WHEN m = s1 THEN 1 WHEN m = s2 THEN 2 WHEN m = s3 THEN 3 WHEN m = s4 THEN 4 ELSE 5 END AS plane FROM (SELECT *, greatest(s0, s1, s2, s3, s4, s5) AS m FROM (SELECT frame, pid, CAST(r - 128 AS DOUBLE) AS s0, (g - 128) * 0.9::DOUBLE AS s1, (b - 128) * 0.8::DOUBLE AS s2, (r - 128) * -1.0::DOUBLE AS s3, (g - 128) * -0.9::DOUBLE AS s4, (b - 128) * -0.8::DOUBLE AS s5 FROM cloud_src) t) t", "cloud_src"))
def initial_planes(spark: SparkSession, sf: str) -> DataFrame:
    normals = table(spark, sf, "cloud_src").select("frame", "pid", *[(F.col(c) - 128).cast("double").alias(n) for c, n in zip("rgb", ("nx", "ny", "nz"))])
    return patches.initial_planes(normals, [1.0, 0.9, 0.8])


# ---- patches ------------------------------------------------------------------------------------------------------


def _canvas_sql() -> str:
    lu, lv = "(p.size_u0 * 16 - 1 - q.u)", "(p.size_v0 * 16 - 1 - q.v)"
    x = {0: "q.u", 1: "q.v", 2: lv, 3: lu, 4: "q.v", 5: lu, 6: lv, 7: "q.u", 8: "q.v"}
    y = {0: "q.v", 1: "q.u", 2: "q.u", 3: lv, 4: lu, 5: "q.v", 6: lu, 7: lv, 8: "q.u"}
    case = lambda c: "CASE p.orientation " + " ".join(f"WHEN {k} THEN {v}" for k, v in c.items()) + " END"
    return f"SELECT q.frame, q.patch, q.pid, {case(x)} + p.u0 * 16 AS x, {case(y)} + p.v0 * 16 AS y FROM patch_pixels q JOIN patches p ON q.frame = p.frame AND q.patch = p.patch"


@query("P19_patch_to_canvas", sql(_canvas_sql(), "patch_pixels", "patches"))
def patch_to_canvas(spark: SparkSession, sf: str) -> DataFrame:
    return patches.placed(table(spark, sf, "patch_pixels"), table(spark, sf, "patches")).select("frame", "patch", "pid", "x", "y")


@query("P20_canvas_to_patch", sql("SELECT frame, patch, pid, u, v FROM patch_pixels", "patch_pixels"))
def canvas_to_patch(spark: SparkSession, sf: str) -> DataFrame:
    there = patches.placed(table(spark, sf, "patch_pixels"), table(spark, sf, "patches"))
    u, v = geometry.canvas_to_patch(*[F.col(c) for c in ("orientation", "x", "y", "u0", "v0", "size_u0", "size_v0")], 16)
    return there.select("frame", "patch", "pid", u.alias("u"), v.alias("v"))


def _points_sql() -> str:
    dim = "views(view_id, turn, normal, tangent, bitangent, mode) AS (VALUES " + ", ".join(str((i, *v)) for i, v in enumerate(geometry.VIEWS)) + ")"
    along = "CASE WHEN w.mode = 0 THEN q.d0 + p.d1 ELSE greatest(0, p.d1 - q.d0) END"
    axis = lambda k: f"CAST(CASE {k} WHEN w.normal THEN {along} WHEN w.tangent THEN q.u + p.u1 ELSE q.v + p.v1 END AS BIGINT)"
    return f"WITH {dim} SELECT q.frame, q.patch, q.pid, {axis(0)} AS x, {axis(1)} AS y, {axis(2)} AS z FROM patch_pixels q JOIN patches p ON q.frame = p.frame AND q.patch = p.patch JOIN views w ON p.view_id = w.view_id"


@query("P23_patch_points", sql(_points_sql(), "patch_pixels", "patches"))
def patch_points(spark: SparkSession, sf: str) -> DataFrame:
    return patches.points_of(table(spark, sf, "patch_pixels"), table(spark, sf, "patches"))


@query("P25_switched_sides", sql("SELECT frame, patch, orientation NOT IN (0, 3, 5, 7) AS switched FROM patches", "patches"))
def switched_sides(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patches").select("frame", "patch", (~F.col("orientation").isin(*geometry.UPRIGHT)).alias("switched"))


@query("A19_depth_maps", sql("SELECT frame, patch, u, v, max(d0) AS depth FROM patch_pixels GROUP BY frame, patch, u, v", "patch_pixels"))
def depth_maps(spark: SparkSession, sf: str) -> DataFrame:
    return patches.depth_maps(table(spark, sf, "patch_pixels"), 1)


@query("A21_peak_filter", sql("SELECT frame, patch, pid FROM (SELECT *, min(d0) OVER (PARTITION BY frame, patch, u // 8, v // 8) AS peak FROM patch_pixels) t WHERE d0 - peak <= 3", "patch_pixels"))
def peak_filter(spark: SparkSession, sf: str) -> DataFrame:
    return patches.peak_filtered(table(spark, sf, "patch_pixels"), 8, 3).select("frame", "patch", "pid")


@query("A28_eom_population", sql("SELECT frame, patch, CAST(sum(bit_count(eom & 1023)) AS BIGINT) AS bits FROM patch_pixels GROUP BY frame, patch", "patch_pixels"))
def eom_population(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patch_pixels").groupBy("frame", "patch").agg(F.sum(F.bit_count(F.col("eom").bitwiseAND(F.lit(1023)))).alias("bits"))


@query("A38_canvas_sizes", sql("SELECT frame, max((v0 + size_v0) * 16) AS height, max((u0 + size_u0) * 16) AS width FROM patches GROUP BY frame", "patches"))
def canvas_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "patches").groupBy("frame").agg(F.max((F.col("v0") + F.col("size_v0")) * 16).alias("height"), F.max((F.col("u0") + F.col("size_u0")) * 16).alias("width"))


@query("O09_patch_order", sql("SELECT frame, patch, row_number() OVER (PARTITION BY frame ORDER BY greatest(size_u, size_v) DESC, least(size_u, size_v) DESC, patch) - 1 AS place FROM patches", "patches"))
def patch_order(spark: SparkSession, sf: str) -> DataFrame:
    return patches.by_size(table(spark, sf, "patches"))


@query("O17_horizons", sql("SELECT frame, patch, u, min(v) AS top, max(v) AS bottom FROM patch_pixels GROUP BY frame, patch, u", "patch_pixels"))
def patch_horizons(spark: SparkSession, sf: str) -> DataFrame:
    return patches.horizons(table(spark, sf, "patch_pixels"))


@query("R30_stacked_rows", sql("SELECT frame, patch, n, CAST(ceil(n / 64.0) AS BIGINT) AS rows, CAST(sum(ceil(n / 64.0)) OVER (PARTITION BY frame ORDER BY patch) - ceil(n / 64.0) AS BIGINT) AS top FROM (SELECT frame, patch, count(*) AS n FROM patch_pixels GROUP BY frame, patch) t", "patch_pixels"))
def stacked_rows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "patch_pixels").groupBy("frame", "patch").agg(F.count("*").alias("n"))
    return patches.stacked(sizes, 4, 16)


@query("J13_rectangle_iou", sql("SELECT frame, a, b, round(i / (ar - i), 6) AS iou FROM (SELECT a.frame, a.patch AS a, b.patch AS b, greatest(0, least(a.u1 + a.size_u, b.u1 + b.size_u) - greatest(a.u1, b.u1)) * greatest(0, least(a.v1 + a.size_v, b.v1 + b.size_v) - greatest(a.v1, b.v1)) AS i, a.size_u * a.size_v + b.size_u * b.size_v AS ar FROM patches a JOIN patches b ON a.frame = b.frame AND a.patch < b.patch) t", "patches"))
def rectangle_iou(spark: SparkSession, sf: str) -> DataFrame:
    return patches.overlapping(table(spark, sf, "patches")).select("frame", "a", "b", F.round("iou", 6).alias("iou"))


@query("J15_block_owner", sql("SELECT frame, x // 16 AS block_x, y // 16 AS block_y, max(patch) + 1 AS owner FROM pixels WHERE occ = 1 GROUP BY ALL", "pixels"))
def block_owner(spark: SparkSession, sf: str) -> DataFrame:
    return patches.block_owner(table(spark, sf, "pixels"))


@query("R40_layers", sql("SELECT frame, patch, pid, 0 AS layer, d0 AS depth FROM patch_pixels UNION ALL SELECT frame, patch, pid, 1, d1 FROM patch_pixels WHERE d1 <> d0", "patch_pixels"))
def layers(spark: SparkSession, sf: str) -> DataFrame:
    both = F.array(F.struct(F.lit(0).alias("layer"), F.col("d0").alias("depth")), F.struct(F.lit(1).alias("layer"), F.col("d1").alias("depth")))
    kept = F.filter(both, lambda s: (s["layer"] == 0) | (s["depth"] != F.col("d0")))
    return table(spark, sf, "patch_pixels").select("frame", "patch", "pid", F.explode(kept).alias("s")).select("frame", "patch", "pid", "s.layer", "s.depth")


@query("J18_attribute_fetch", sql("SELECT q.frame, q.pid, p.c0, p.c1, p.c2 FROM patch_pixels q JOIN patches h ON q.frame = h.frame AND q.patch = h.patch JOIN pixels p ON p.frame = q.frame AND p.x = q.u + 16 * h.u0 AND p.y = q.v + 16 * h.v0", "patch_pixels", "patches", "pixels"))
def attribute_fetch(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "patch_pixels").join(table(spark, sf, "patches").select("frame", "patch", "u0", "v0"), ["frame", "patch"])
    at = q.select("frame", "pid", (F.col("u") + 16 * F.col("u0")).alias("x"), (F.col("v") + 16 * F.col("v0")).alias("y"))
    return at.join(table(spark, sf, "pixels"), ["frame", "x", "y"]).select("frame", "pid", "c0", "c1", "c2")


_EIGHT = " JOIN ".join(f"(VALUES (0), (1)) o{c}(o{c}) ON true" for c in "xyz")
#: A point's place (x2) between the centres of the cells x0 and x0 + 1 of 6 places, as 2 w + 1; the cells' points; the eight weights and means.
_CENTRES = (
    "p AS (SELECT frame, pid, x, y, z, " + ", ".join(f"({c} - 3) // 6 AS {c}0, 2 * ({c} - 3 - 6 * (({c} - 3) // 6)) + 1 AS {c}2" for c in "xyz") + " FROM cloud_src), "
    "m AS (SELECT x // 6 AS kx, y // 6 AS ky, z // 6 AS kz, frame, count(*) AS held, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, count(DISTINCT ((x - 8) // 16) * 3 + (y - 8) // 16) > 1 AS mixed FROM cloud_src GROUP BY ALL), "
    "e AS (SELECT p.*, m.mixed, coalesce(m.held, 0) AS held, coalesce(m.ax, p.x) AS ax, coalesce(m.ay, p.y) AS ay, coalesce(m.az, p.z) AS az, CAST((CASE WHEN i = 0 THEN 12 - x2 ELSE x2 END) * (CASE WHEN j = 0 THEN 12 - y2 ELSE y2 END) * (CASE WHEN k = 0 THEN 12 - z2 ELSE z2 END) AS BIGINT) AS weight "
    "FROM p, range(2) AS r1(i), range(2) AS r2(j), range(2) AS r3(k) LEFT JOIN m ON m.frame = p.frame AND m.kx = x0 + i AND m.ky = y0 + j AND m.kz = z0 + k), "
    "c AS (SELECT frame, pid, CAST(sum(weight * held) // 1728 AS BIGINT) AS n, sum(weight * ax) / 1728 AS cx, sum(weight * ay) / 1728 AS cy, sum(weight * az) / 1728 AS cz FROM e GROUP BY frame, pid HAVING bool_or(mixed))"
)


@query("R45_grid_centroids", sql(f"WITH {_CENTRES} SELECT frame, pid, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cz, 4) AS cz FROM c", "cloud_src"))
def grid_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.grid_centroids(_patched(spark, sf), 6)


@query("A23_cell_means", sql("SELECT frame, x // 6 AS kx, y // 6 AS ky, z // 6 AS kz, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz, count(DISTINCT ((x - 8) // 16) * 3 + (y - 8) // 16) > 1 AS mixed FROM cloud_src GROUP BY ALL", "cloud_src"))
def cell_means(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.cell_means(_patched(spark, sf), 6)


def _patched(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cloud_src").withColumn("patch", F.expr("((x - 8) div 16) * 3 + (y - 8) div 16"))


# ---- images -------------------------------------------------------------------------------------------------------


@query("I02_chroma_halved", sql("SELECT frame, x // 2 AS x, y // 2 AS y, CAST((sum(c1) + 2) // 4 AS BIGINT) AS c1, CAST((sum(c2) + 2) // 4 AS BIGINT) AS c2 FROM pixels GROUP BY frame, x // 2, y // 2", "pixels"))
def chroma_halved(spark: SparkSession, sf: str) -> DataFrame:
    return images.chroma_halved(table(spark, sf, "pixels"))


@query("I03_chroma_doubled", sql("SELECT p.frame, p.x, p.y, h.c1 FROM pixels p JOIN (SELECT frame, x // 2 AS hx, y // 2 AS hy, CAST((sum(c1) + 2) // 4 AS BIGINT) AS c1 FROM pixels GROUP BY ALL) h ON p.frame = h.frame AND p.x // 2 = h.hx AND p.y // 2 = h.hy", "pixels"))
def chroma_doubled(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "pixels")
    half = images.chroma_halved(pixels).select("frame", F.col("x").alias("hx"), F.col("y").alias("hy"), "c1")
    return pixels.select("frame", "x", "y", F.expr("x div 2").alias("hx"), F.expr("y div 2").alias("hy")).join(half, ["frame", "hx", "hy"]).select("frame", "x", "y", "c1")


@query("I05_upsampled", sql("SELECT frame, x * 2 + i.s AS x, y * 2 + j.s AS y, c0 FROM pixels, (VALUES (0), (1)) i(s), (VALUES (0), (1)) j(s)", "pixels"))
def upsampled(spark: SparkSession, sf: str) -> DataFrame:
    return images.upsampled(table(spark, sf, "pixels").select("frame", "x", "y", "c0"), 2)


KERNEL = {(a, b): 64 >> (abs(a) + abs(b)) for a in (-1, 0, 1) for b in (-1, 0, 1)}


@query("I22_occupancy_filter", sql("SELECT p.frame, p.x, p.y, CAST(sum(q.occ * k.w) AS BIGINT) >> 4 AS value FROM pixels p JOIN (VALUES " + ", ".join(str((a, b, w)) for (a, b), w in KERNEL.items()) + ") k(a, b, w) ON true JOIN pixels q ON q.frame = p.frame AND q.x = p.x + k.a AND q.y = p.y + k.b GROUP BY p.frame, p.x, p.y", "pixels"))
def occupancy_filter(spark: SparkSession, sf: str) -> DataFrame:
    return images.filtered(table(spark, sf, "pixels"), KERNEL, 4)


@query("I51_boundary_pixels", sql("SELECT p.frame, p.x, p.y, count(q.x) < 9 AS border FROM (SELECT * FROM pixels WHERE occ = 1) p JOIN (SELECT * FROM pixels WHERE occ = 1) q ON q.frame = p.frame AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY p.frame, p.x, p.y", "pixels"))
def boundary_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return images.boundary(table(spark, sf, "pixels"))


@query("P29_near_empty", sql("SELECT p.frame, p.x, p.y, count(q.x) < 25 AS border FROM (SELECT * FROM pixels WHERE occ = 1) p JOIN (SELECT * FROM pixels WHERE occ = 1) q ON q.frame = p.frame AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 GROUP BY p.frame, p.x, p.y", "pixels"))
def near_empty(spark: SparkSession, sf: str) -> DataFrame:
    return images.boundary(table(spark, sf, "pixels"), 2)


@query("A33_block_occupancy", sql("SELECT frame, x // 4 AS x, y // 4 AS y, max(occ) AS occ FROM pixels GROUP BY frame, x // 4, y // 4", "pixels"))
def block_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return images.block_occupancy(table(spark, sf, "pixels"), 4)


@query("A34_refined_occupancy", sql("WITH a AS (SELECT frame, x, y, count(*) OVER (PARTITION BY frame, x // 2, y // 2) AS n FROM pixels WHERE occ = 1), b AS (SELECT *, count(*) OVER (PARTITION BY frame, x // 4, y // 4) AS m FROM a WHERE n > 1) SELECT frame, x, y FROM b WHERE m >= 14", "pixels"))
def refined_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return images.refined_occupancy(table(spark, sf, "pixels"), 2, 4, 14)


@query("I26_thresholded_occupancy", sql("SELECT frame, x, y, sum(occ) OVER (PARTITION BY frame, x // 4, y // 4) > 13 AS \"on\" FROM pixels", "pixels"))
def thresholded_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    return images.thresholded(table(spark, sf, "pixels"), 4, 13)


@query("I29_attribute_residual", sql("SELECT a.frame, a.x, a.y, greatest(least(a.c0 - b.c0, 127), -128) + 128 AS residual FROM pixels a JOIN pixels b ON b.frame = a.frame + 1 AND a.x = b.x AND a.y = b.y", "pixels"))
def attribute_residual(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "pixels")
    return images.residual(pixels, pixels.withColumn("frame", F.col("frame") - 1), "c0")


@query("I41_map_average", sql("SELECT frame, x, y, CASE WHEN occ = 1 THEN d0 ELSE (d0 + d1 + 1) >> 1 END AS d0 FROM pixels", "pixels"))
def map_average(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", F.when(F.col("occ") == 1, F.col("d0")).otherwise(F.shiftright(F.col("d0") + F.col("d1") + 1, 1)).alias("d0"))


@query("I43_coarse_layer", sql("SELECT frame, x // 2 AS x, y // 2 AS y, round(avg(c0), 6) AS c0, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2, count(*) AS weight FROM pixels WHERE occ = 1 GROUP BY frame, x // 2, y // 2", "pixels"))
def coarse_layer(spark: SparkSession, sf: str) -> DataFrame:
    return images.mip(table(spark, sf, "pixels"))


@query("A27_entropy", sql("SELECT frame, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT frame, count(*) / sum(count(*)) OVER (PARTITION BY frame) AS p FROM pixels GROUP BY frame, c0) t GROUP BY frame", "pixels"))
def pixel_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return images.entropy(table(spark, sf, "pixels"), "c0")


@query("A35_changed_occupancy", sql("SELECT a.frame, count(*) FILTER (WHERE a.occ = 0 AND b.occ = 1) AS set_, count(*) FILTER (WHERE a.occ = 1 AND b.occ = 0) AS cleared FROM pixels a JOIN (SELECT frame, x // 4 AS bx, y // 4 AS by, max(occ) AS occ FROM pixels GROUP BY ALL) b ON a.frame = b.frame AND a.x // 4 = b.bx AND a.y // 4 = b.by GROUP BY a.frame", "pixels"))
def changed_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    pixels = table(spark, sf, "pixels").select("frame", "occ", F.expr("x div 4").alias("bx"), F.expr("y div 4").alias("by"))
    block = pixels.groupBy("frame", "bx", "by").agg(F.max("occ").alias("now"))
    both = pixels.join(block, ["frame", "bx", "by"])
    return both.groupBy("frame").agg(F.count_if((F.col("occ") == 0) & (F.col("now") == 1)).alias("set_"), F.count_if((F.col("occ") == 1) & (F.col("now") == 0)).alias("cleared"))


@query("I53_frame_sizes", sql("SELECT frame, CAST(ceil(greatest(max(x) + 1, 40) / 64.0) * 64 AS BIGINT) AS width, CAST(ceil(greatest(max(y) + 1, 40) / 64.0) * 64 AS BIGINT) AS height FROM pixels GROUP BY frame", "pixels"))
def frame_sizes(spark: SparkSession, sf: str) -> DataFrame:
    up = lambda c: (F.ceil(F.greatest(F.max(c) + 1, F.lit(40)) / 64) * 64).cast("long")
    return table(spark, sf, "pixels").groupBy("frame").agg(up("x").alias("width"), up("y").alias("height"))


# ---- logs ---------------------------------------------------------------------------------------------------------


@query("J21_log_comparison", sql("SELECT coalesce(a.file, b.file) AS file, coalesce(a.row_idx, b.row_idx) AS row_idx, coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'MISSING' WHEN a.v = b.v THEN 'MATCH' ELSE 'DIFF' END AS status FROM enc_log a FULL JOIN dec_log b ON a.file = b.file AND a.row_idx = b.row_idx AND a.k = b.k", "enc_log", "dec_log"))
def log_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return conformance.compared(table(spark, sf, "enc_log"), table(spark, sf, "dec_log"))


def _levels_sql() -> str:
    return "levels(level, proj_s, eom_s, raw_s, proj, eom, raw) AS (VALUES " + ", ".join(str((i, *v)) for i, v in enumerate(conformance.LEVELS)) + ")"


@query("A32_level_limits", sql(f"WITH {_levels_sql()} SELECT level, count(*) FILTER (WHERE num_proj > proj) AS proj_over, count(*) FILTER (WHERE num_eom > eom) AS eom_over, count(*) FILTER (WHERE num_raw > raw) AS raw_over FROM log_frames, levels GROUP BY level", "log_frames"))
def level_limits(spark: SparkSession, sf: str) -> DataFrame:
    return conformance.over_frame_limits(table(spark, sf, "log_frames"))


@query("O14_rate_window", sql("SELECT frame_id, CAST(total AS BIGINT) AS total FROM (SELECT frame_id, sum(num_proj) OVER w AS total, count(*) OVER w AS n FROM log_frames WINDOW w AS (ORDER BY frame_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) t WHERE n = 30", "log_frames"))
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    return conformance.sliding_sums(table(spark, sf, "log_frames"))


@query("O15_groups_of_frames", sql("SELECT frame_id // 32 AS gof, count(*) AS frames, CAST(sum(num_proj) AS BIGINT) AS points FROM log_frames GROUP BY frame_id // 32", "log_frames"))
def groups_of_frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "log_frames").groupBy(F.expr("CAST(frame_id div 32 AS INT)").alias("gof")).agg(F.count("*").alias("frames"), F.sum("num_proj").alias("points"))


@query("O16_order_counts", sql("WITH l AS (SELECT user_id AS grp, event_id AS idx, event_id % 16 AS lsb FROM events), s AS (SELECT *, lag(lsb) OVER (PARTITION BY grp ORDER BY idx) AS p FROM l), d AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN p - lsb >= 8 THEN 16 WHEN lsb - p > 8 THEN -16 ELSE 0 END AS step FROM s) SELECT grp, idx, CAST(sum(step) OVER (PARTITION BY grp ORDER BY idx) + lsb AS BIGINT) AS count FROM d", "log_frames"))
def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("idx"), (F.col("event_id") % 16).alias("lsb"))
    return conformance.order_counts(rows, 4)


@query("A29_size_statistics", sql("SELECT frame_id // 32 AS gof, k, CAST(sum(length(v)) AS BIGINT) AS bytes, grouping_id(frame_id // 32, k) AS level FROM (SELECT row_idx AS frame_id, k, v FROM enc_log) t GROUP BY ROLLUP (frame_id // 32, k)", "enc_log"))
def size_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "enc_log").select(F.expr("CAST(row_idx div 32 AS INT)").alias("gof"), "k", F.length("v").alias("n"))
    return rows.rollup("gof", "k").agg(F.sum("n").alias("bytes"), F.grouping_id().alias("level"))


@query("S18_log_lines", sql("SELECT row_idx, CASE WHEN v LIKE '0%' THEN 'zero' ELSE k END AS kind, count(*) AS n FROM enc_log GROUP BY ALL", "enc_log"))
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as lines "row=..., key=value" and parsed again: blanks stripped, split at commas and equals signs."""
    lines = table(spark, sf, "enc_log").select(F.concat(F.lit("row = "), F.col("row_idx"), F.lit(", "), "k", F.lit(" = "), "v").alias("line"))
    pairs = lines.select(F.str_to_map(F.regexp_replace("line", r"\s+", ""), F.lit(","), F.lit("=")).alias("kv"))
    rows = pairs.select(F.col("kv")["row"].cast("int").alias("row_idx"), F.explode("kv").alias("k", "v")).where(F.col("k").isin(*LOG_NAMES))
    return rows.groupBy("row_idx", F.when(F.col("v").startswith("0"), "zero").otherwise(F.col("k")).alias("kind")).agg(F.count("*").alias("n"))


@query("J24_checksum_comparison", sql("SELECT a.row_idx, md5(a.t) = md5(b.t) AS same FROM (SELECT row_idx, string_agg(k || '=' || v, ',' ORDER BY k) AS t FROM enc_log GROUP BY row_idx) a FULL JOIN (SELECT row_idx, string_agg(k || '=' || v, ',' ORDER BY k) AS t FROM dec_log GROUP BY row_idx) b ON a.row_idx = b.row_idx", "enc_log", "dec_log"))
def checksum_comparison(spark: SparkSession, sf: str) -> DataFrame:
    def sums(name: str, out: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.concat("k", F.lit("="), "v")))  # a frame has a handful of keys
        return table(spark, sf, name).groupBy("row_idx").agg(F.md5(F.concat_ws(",", parts)).alias(out))

    return sums("enc_log", "a").join(sums("dec_log", "b"), "row_idx", "full_outer").select("row_idx", (F.col("a") == F.col("b")).alias("same"))
