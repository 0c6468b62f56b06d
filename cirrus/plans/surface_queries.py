"""Registered queries on oriented normals, planes refined by voxels, patch segmentation and weighted colour transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.functions import geometry
from cirrus.operators import chroma, colour_transfer, dilation, fills, neighbours, orientation, patch_segmentation, patches, quality, voxels
from cirrus.operators.colour_transfer import Way
from cirrus.plans.queries import _D2, sql
from cirrus.plans.registry import query
from cirrus.sources.derived import table
from cirrus.streaming import tracks

# ---- normals --------------------------------------------------------------------------------------------------------


def _given(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    src = table(spark, sf, "cloud_src")
    return src, src.select("frame", "pid", *[((F.col(c) - 128) / 128.0).alias(n) for c, n in zip("rgb", orientation.N)])


def _short(df: DataFrame, digits: int = 5) -> DataFrame:
    """To so many digits; a negative zero as zero."""
    return df.select("frame", "pid", *[F.when(F.round(c, digits) == 0, 0.0).otherwise(F.round(c, digits)).alias(c) for c in orientation.N])


@query("R03_tree_normals")
def tree_normals(spark: SparkSession, sf: str) -> DataFrame:
    """Given normals turned along the spanning forest of the most parallel neighbours (with R04)."""
    return _short(orientation.oriented(*_given(spark, sf), "tree", 6, None, (24.0, 24.0, 1000.0)))


@query("R03_cube_normals")
def cube_normals(spark: SparkSession, sf: str) -> DataFrame:
    return _short(orientation.oriented(*_given(spark, sf), "cube", 6, None, (24.0, 24.0, 1000.0)))


@query(
    "R03_viewed_normals",
    sql(
        "SELECT frame, pid, " + ", ".join(f"CASE WHEN n{c} = 0 THEN 0.0::DOUBLE ELSE round(CASE WHEN away THEN -n{c} ELSE n{c} END, 5) END AS n{c}" for c in "xyz") + " FROM (SELECT *, nx * (24.0::DOUBLE - x) + ny * (24.0::DOUBLE - y) + nz * (1000.0::DOUBLE - z) < 0 AS away "
        "FROM (SELECT frame, pid, x, y, z, (r - 128) / 128.0::DOUBLE AS nx, (g - 128) / 128.0::DOUBLE AS ny, (b - 128) / 128.0::DOUBLE AS nz FROM cloud_src) t) t",
        "cloud_src",
    ),
)
def viewed_normals(spark: SparkSession, sf: str) -> DataFrame:
    return _short(orientation.oriented(*_given(spark, sf), "viewpoint", viewpoint=(24.0, 24.0, 1000.0)))


@query("R06_normal_pipeline")
def normal_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Normals of the second cloud estimated, smoothed once and oriented."""
    return _short(orientation.pipeline(table(spark, sf, "cloud_rec"), 9, 1, (3, 9, 0.5), "tree", (24.0, 24.0, 1000.0)))


# ---- planes and patches ---------------------------------------------------------------------------------------------


@query("R09_grid_planes")
def grid_planes(spark: SparkSession, sf: str) -> DataFrame:
    return voxels.refined(table(spark, sf, "segments"), _given(spark, sf)[1], 4, 3, 60, 3.0, 3)[0]


_LIMITS = patch_segmentation.Limits(neighbours=9, least_points=16, detection=4, selection=1)


@query("R11_patch_segments")
def patch_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of the patches that the given planes lead to."""
    return patch_segmentation.segment(table(spark, sf, "cloud_src"), table(spark, sf, "segments").select("frame", "pid", "plane"), _LIMITS).pixels


@query("R13_expanded_patches")
def expanded_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Members of patches that take in neighbours on other planes."""
    limits = patch_segmentation.Limits(neighbours=9, least_points=16, detection=4, selection=1, expand=True)
    return patch_segmentation.segment(table(spark, sf, "cloud_src"), table(spark, sf, "segments").select("frame", "pid", "plane"), limits).members


@query("R10_segmentation_chain")
def segmentation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of the second cloud, from points alone."""
    return patch_segmentation.pipeline(table(spark, sf, "cloud_rec"), _LIMITS, 9, 2).patches.select("frame", "patch", "plane", "n")


# ---- colours --------------------------------------------------------------------------------------------------------

_OWN = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in "rgb")


def _spread(name: str, key: str, most: float) -> str:
    """Rows of a list (k by distance) before the first whose colour is too far from one before it."""
    far = f"(p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b) > {most}"
    return f"{name} AS (SELECT * FROM {key} t WHERE k < coalesce((SELECT min(q.k) FROM {key} p JOIN {key} q ON p.frame = q.frame AND p.pid = q.pid AND p.k < q.k AND {far} WHERE p.frame = t.frame AND p.pid = t.pid), 1000000))"


def _averaged(name: str, rows: str, distance: str, outlier: float | None) -> str:
    w = f"(1.0::DOUBLE / ({distance} + 4.0::DOUBLE))"
    mean = ", ".join(f"sum({c} * {w}) / sum({w}) AS m{c}" for c in "rgb")
    first = f"{name}_1 AS (SELECT frame, pid, count(*) AS n, {mean}, " + ", ".join(f"sum(CAST({c} AS BIGINT)) AS s{c}" for c in "rgb") + f", sum(CAST(r * r + g * g + b * b AS BIGINT)) AS q FROM {rows} GROUP BY frame, pid)"
    if outlier is None:
        return f"{first}, {name} AS (SELECT * FROM {name}_1)"
    near = f"round((t.r - m.mr) * (t.r - m.mr) + (t.g - m.mg) * (t.g - m.mg) + (t.b - m.mb) * (t.b - m.mb), 6) <= {outlier * outlier}"
    again = f"{name}_2 AS (SELECT t.frame, t.pid, count(*) AS nears, {mean} FROM {rows} t JOIN {name}_1 m ON t.frame = m.frame AND t.pid = m.pid WHERE {near} GROUP BY t.frame, t.pid)"
    picked = ", ".join(f"CASE WHEN b.nears < a.n THEN b.m{c} ELSE a.m{c} END AS m{c}" for c in "rgb")
    return f"{first}, {again}, {name} AS (SELECT a.frame, a.pid, a.n, {picked}, a.sr, a.sg, a.sb, a.q FROM {name}_1 a LEFT JOIN {name}_2 b ON a.frame = b.frame AND a.pid = b.pid)"


def _transfer_sql(k: tuple[int, int], most_d2: tuple[int, int], most_colour: tuple[float | None, float | None], outlier: float | None, alone: bool, reach: int, peak: int) -> str:
    """Target cloud_rec, source cloud_src. The best colour is looked for by trying all of them against the sums of each list."""
    rows = f"SELECT a.frame, {{t}}.pid AS pid, {{s}}.pid AS other, {_D2} AS d2, {{s}}.r, {{s}}.g, {{s}}.b, row_number() OVER (PARTITION BY a.frame, a.pid ORDER BY {_D2}, b.pid) AS rank FROM {{a}} a JOIN {{b}} b ON a.frame = b.frame"
    ahead = rows.format(t="a", s="b", a="cloud_rec", b="cloud_src")
    behind = rows.format(t="b", s="a", a="cloud_src", b="cloud_rec")
    only = "QUALIFY min(d2) OVER (PARTITION BY frame, pid) > 0 OR rank = 1" if alone else ""
    parts = [f"f0 AS (SELECT * FROM ({ahead}) t WHERE rank <= {k[0]}), f1 AS (SELECT frame, pid, other, d2, {_OWN}, rank AS k FROM f0 WHERE (rank = 1 OR d2 <= {most_d2[0]}) {only})"]
    parts += [f"b0 AS (SELECT * FROM ({behind}) t WHERE rank <= {k[1]} AND d2 <= {most_d2[1]}), b1 AS (SELECT frame, pid, other, d2, {_OWN}, row_number() OVER (PARTITION BY frame, pid ORDER BY d2, other) AS k FROM b0)"]
    parts += [_spread(f"{c}3", f"{c}1", m) if m is not None else f"{c}3 AS (SELECT * FROM {c}1)" for c, m in zip("fb", most_colour)]
    parts += [_averaged("fm", "f3", "d2", outlier), _averaged("bm", "b3", "sqrt(d2)", outlier)]
    whole = lambda c: f"CAST(least(greatest(floor(round({c}, 6) + 0.5), 0), {peak}) AS BIGINT)"
    parts += ["ns AS (SELECT t.frame, t.n AS nt, s.n AS ns FROM (SELECT frame, count(*) AS n FROM cloud_rec GROUP BY frame) t JOIN (SELECT frame, count(*) AS n FROM cloud_src GROUP BY frame) s ON t.frame = s.frame)"]
    parts += ["c AS (SELECT f.frame, f.pid, " + ", ".join(f"{whole(f'f.m{c}')} AS c{c}, {whole(f'b.m{c}')} AS b{c}" for c in "rgb") + ", b.n, b.sr, b.sg, b.sb, b.q, nt, ns FROM fm f JOIN ns ON f.frame = ns.frame LEFT JOIN bm b ON f.frame = b.frame AND f.pid = b.pid)"]
    side = 2 * reach + 1
    steps = ", ".join(f"CAST(least(greatest(b{c} + {step} - {reach}, 0), {peak}) AS BIGINT) AS {c}" for c, step in zip("rgb", (f"i // {side * side}", f"i // {side} % {side}", f"i % {side}")))
    parts += [f"tried AS (SELECT c.*, i, {steps} FROM c, range({side**3}) AS u(i) WHERE n IS NOT NULL)"]
    one = "((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)) * (1.0::DOUBLE / nt)"
    two = "(n * r * r - 2 * r * sr + n * g * g - 2 * g * sg + n * b * b - 2 * b * sb + q) * (1.0::DOUBLE / ns)"
    parts += [f"best AS (SELECT frame, pid, r, g, b FROM tried QUALIFY row_number() OVER (PARTITION BY frame, pid ORDER BY greatest({one}, {two}), i) = 1)"]
    return "WITH " + ", ".join(parts) + " SELECT c.frame, c.pid, " + ", ".join(f"CAST(coalesce(best.{x}, c.c{x}) AS INTEGER) AS {x}" for x in "rgb") + " FROM c LEFT JOIN best ON c.frame = best.frame AND c.pid = best.pid"


@query("C01_weighted_colour", sql(_transfer_sql((4, 2), (30, 20), (None, 9000.0), 60.0, True, 1, 255), "cloud_src", "cloud_rec"))
def weighted_colour(spark: SparkSession, sf: str) -> DataFrame:
    ahead = Way(4, True, 4.0, 30, None, 60.0, True)
    behind = Way(2, True, 4.0, 20, 9000.0, 60.0)
    return colour_transfer.transferred(table(spark, sf, "cloud_rec"), table(spark, sf, "cloud_src"), ahead, behind, 1)


def _wide(df: DataFrame) -> DataFrame:
    """Colours with 16 bits."""
    return df.withColumns({c: F.col(c) * 257 for c in "rgb"})


_WIDE = _transfer_sql((5, 1), (1000, 1000), (6e8, None), None, False, 0, 65535)
for _cloud in ("cloud_src", "cloud_rec"):
    _WIDE = _WIDE.replace(f" {_cloud} ", f" (SELECT * REPLACE (r * 257 AS r, g * 257 AS g, b * 257 AS b) FROM {_cloud}) ")


@query("C04_wide_colour", sql(_WIDE, "cloud_src", "cloud_rec"))
def wide_colour(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of 16 bits, no bound on distance; a forward list is cut where its colours differ too much."""
    return colour_transfer.transferred(_wide(table(spark, sf, "cloud_rec")), _wide(table(spark, sf, "cloud_src")), Way(5, True, 4.0, 1000, 6e8), Way(1, True, 4.0, 1000), 0, 65535)


@query("C02_boundary_colour")
def boundary_colour(spark: SparkSession, sf: str) -> DataFrame:
    """Only points at the edge of a square of 16 places get a new colour."""
    edge = " OR ".join(f"({c} - 8) % 16 IN (0, 15)" for c in "xy")
    rec = _wide(table(spark, sf, "cloud_rec")).withColumn("type", F.when(F.expr(edge), 3).otherwise(0))
    return colour_transfer.boundary_transferred(rec, _wide(table(spark, sf, "cloud_src")), Way(4), Way(2), 1, 65535, 2000)


# ---- tracks ---------------------------------------------------------------------------------------------------------


@query("J11_patch_tracks")
def patch_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.tracks(table(spark, sf, "patches"), 4)


# ---- chroma filters -------------------------------------------------------------------------------------------------

_DENSE = (
    "s AS (SELECT frame, CAST(max(x) // 2 * 2 + 2 AS INT) AS w, CAST(max(y) // 2 * 2 + 2 AS INT) AS h FROM {px} GROUP BY frame), "
    "im AS (SELECT s.frame, w, h, x.x, y.y, coalesce(p.u, 0.0::DOUBLE) AS u, coalesce(p.v, 0.0::DOUBLE) AS v FROM s, range(w) AS x(x), range(h) AS y(y) LEFT JOIN {px} p ON p.frame = s.frame AND p.x = x.x AND p.y = y.y)"
)


def _fir_sql(name: str, image: str, taps: tuple[float, ...], shift: int, along: str, at: str, back: int, places: str, number: str) -> str:
    """Sums of taps along an axis of a dense image, at the places of a range, which number names."""
    end = {"x": "w", "y": "h"}[along]
    values = ", ".join(f"({t}, {float(v)}::DOUBLE)" for t, v in enumerate(taps))
    rest = "y" if along == "x" else "x"
    return (
        f"{name} AS (SELECT q.frame, q.w, q.h, q.{rest}, {number} AS {along}, sum(tap * im.u) / {float(1 << shift)}::DOUBLE AS u, sum(tap * im.v) / {float(1 << shift)}::DOUBLE AS v "
        f"FROM (SELECT DISTINCT frame, w, h, {rest}, j FROM {image}, {places}) q, (VALUES {values}) AS k(t, tap) JOIN {image} im ON im.frame = q.frame AND im.{rest} = q.{rest} AND im.{along} = least(greatest({at} + t - {back}, 0), q.{end} - 1) GROUP BY ALL)"
    )


def _halved_sql(taps: chroma.Down, image: str = "im") -> str:
    across = _fir_sql("half_w", image, taps.horizontal, taps.shift, "x", "2 * j", (len(taps.horizontal) - 1) // 2, "range(w // 2) AS r(j)", "q.j")
    down = _fir_sql("small", "half_w", taps.vertical, taps.shift, "y", "2 * j", (len(taps.vertical) - 1) // 2, "range(h // 2) AS r(j)", "q.j")
    return f"{across}, {down}"


def _doubled_sql(taps: chroma.Up, image: str) -> str:
    parts = []
    for n, (along, size, source, even, odd) in enumerate((("y", "h", image, taps.vertical0, taps.vertical1), ("x", "w", "tall", taps.horizontal0, taps.horizontal1))):
        parts.append(_fir_sql(f"even{n}", source, even, 8, along, "j", (len(even) + 1) // 2, f"range({size}) AS r(j)", "2 * q.j"))
        parts.append(_fir_sql(f"odd{n}", source, odd, 8, along, "j + 1", (len(odd) + 1) // 2, f"range({size}) AS r(j)", "2 * q.j + 1"))
        columns = "frame, x, y, " + ("w, 2 * h AS h" if along == "y" else "2 * w AS w, h") + ", u, v"
        parts.append(f"{'tall' if n == 0 else 'large'} AS (SELECT {columns} FROM even{n} UNION ALL SELECT {columns} FROM odd{n})")
    return ", ".join(parts)


_PX = "px AS (SELECT frame, x, y, CAST(c1 AS DOUBLE) AS u, CAST(c2 AS DOUBLE) AS v FROM pixels)"
_AT = "frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y"


def _planes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", F.col("c1").alias("u"), F.col("c2").alias("v"))


def _four(df: DataFrame, *channels: str) -> DataFrame:
    """To four digits; a negative zero as zero."""
    return df.select("frame", "x", "y", *[F.when(F.round(c, 4) == 0, 0.0).otherwise(F.round(c, 4)).alias(c) for c in channels])


_FOUR = ", ".join(f"CASE WHEN round({c}, 4) = 0 THEN 0.0::DOUBLE ELSE round({c}, 4) END AS {c}" for c in "uv")


@query("I07_halved_chroma", sql(f"WITH {_PX}, {_DENSE.format(px='px')}, {_halved_sql(chroma.DOWN['FV'])} SELECT {_AT}, {_FOUR} FROM small", "pixels"))
def halved_chroma(spark: SparkSession, sf: str) -> DataFrame:
    return _four(chroma.halved(_planes(spark, sf), ["u", "v"], chroma.DOWN["FV"]), "u", "v")


@query("I08_doubled_chroma", sql(f"WITH {_PX}, {_DENSE.format(px='px')}, {_doubled_sql(chroma.UP['LS3'], 'im')} SELECT {_AT}, {_FOUR} FROM large", "pixels"))
def doubled_chroma(spark: SparkSession, sf: str) -> DataFrame:
    return _four(chroma.doubled(_planes(spark, sf), ["u", "v"], chroma.UP["LS3"]), "u", "v")


_TO_UNIT = "px AS (SELECT frame, x, y, " + ", ".join(f"least(greatest({e}, -0.5::DOUBLE), 0.5::DOUBLE) AS {n}" for n, e in (("u", "-0.114572::DOUBLE * (c0 / 255.0::DOUBLE) - 0.385428::DOUBLE * (c1 / 255.0::DOUBLE) + 0.5::DOUBLE * (c2 / 255.0::DOUBLE)"), ("v", "0.5::DOUBLE * (c0 / 255.0::DOUBLE) - 0.454153::DOUBLE * (c1 / 255.0::DOUBLE) - 0.045847::DOUBLE * (c2 / 255.0::DOUBLE)"))) + " FROM pixels)"
_SMALL = f"{_TO_UNIT}, {_DENSE.format(px='px')}, {_halved_sql(chroma.DOWN['F0'])}, wh AS (SELECT frame, x, y, w // 2 AS w, h // 2 AS h, " + ", ".join(f"CAST(least(greatest(round(255.0::DOUBLE * round({c}, 9) + 128.0), 0), 255) AS INTEGER) AS {c}" for c in "uv") + " FROM small)"


def _rgb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pixels").select("frame", "x", "y", F.col("c0").alias("r"), F.col("c1").alias("g"), F.col("c2").alias("b"))


@query("I09_yuv420_chroma", sql(f"WITH {_SMALL} SELECT {_AT}, u, v FROM wh", "pixels"))
def yuv420_chroma(spark: SparkSession, sf: str) -> DataFrame:
    return chroma.rgb_to_yuv420(_rgb(spark, sf))[1]


_LUMA = "l AS (SELECT frame, x, y, CAST(least(greatest(round(255.0::DOUBLE * round(least(greatest(0.2126::DOUBLE * (c0 / 255.0::DOUBLE) + 0.7152::DOUBLE * (c1 / 255.0::DOUBLE) + 0.0722::DOUBLE * (c2 / 255.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 9)), 0), 255) AS INTEGER) AS luma FROM pixels)"
_UNITS = "un AS (SELECT frame, x, y, w, h, " + ", ".join(f"least(greatest(({c} - 128) / 255.0::DOUBLE, -0.5::DOUBLE), 0.5::DOUBLE) AS {c}" for c in "uv") + " FROM wh)"
_BACK = f"{_SMALL}, {_LUMA}, {_UNITS}, {_doubled_sql(chroma.UP['F0'], 'un')}, z AS (SELECT l.frame, l.x, l.y, l.luma / 255.0::DOUBLE AS l, u, v FROM l JOIN large g ON l.frame = g.frame AND l.x = g.x AND l.y = g.y)"
_WHOLE16 = "CAST(least(greatest(round(65535.0::DOUBLE * round({c}, 9) + {o}), 0), 65535) AS INTEGER) AS {n}"


@query("I11_yuv444_frame", sql(f"WITH {_BACK} SELECT {_AT}, {_WHOLE16.format(c='l', o='0.0', n='luma')}, {_WHOLE16.format(c='u', o='32768.0', n='u')}, {_WHOLE16.format(c='v', o='32768.0', n='v')} FROM z", "pixels"))
def yuv444_frame(spark: SparkSession, sf: str) -> DataFrame:
    return chroma.yuv420_to_yuv444(*chroma.rgb_to_yuv420(_rgb(spark, sf)))


_TO_RGB = ", ".join(f"CAST(floor(round(255.0::DOUBLE * least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE), 6) + 0.5) AS INTEGER) AS {n}" for n, e in (("r", "l + 1.5748::DOUBLE * v"), ("g", "l - 0.18733::DOUBLE * u - 0.46813::DOUBLE * v"), ("b", "l + 1.85563::DOUBLE * u")))


@query("I12_rgb_frame", sql(f"WITH {_BACK} SELECT {_AT}, {_TO_RGB} FROM z", "pixels"))
def rgb_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Frames taken to 4:2:0 and back."""
    return chroma.yuv420_to_rgb(*chroma.rgb_to_yuv420(_rgb(spark, sf)))


@query("I38_dilated_frame")
def dilated_frame(spark: SparkSession, sf: str) -> DataFrame:
    return dilation.dilated(table(spark, sf, "pixels"), ["c0", "c1", "c2"])


def _depth_sql() -> str:
    """Every depth tried against every point."""
    views = "views(view_id, turn, normal, tangent, bitangent, mode) AS (VALUES " + ", ".join(str((i, *v)) for i, v in enumerate(geometry.VIEWS)) + ")"
    along = "CASE WHEN w.mode = 0 THEN {d} + p.d1 ELSE greatest(0, p.d1 - {d}) END"
    axis = lambda k, d: f"CASE {k} WHEN w.normal THEN {along.format(d=d)} WHEN w.tangent THEN q.u + p.u1 ELSE q.v + p.v1 END"
    seen = "JOIN patches p ON q.frame = p.frame AND q.patch = p.patch JOIN views w ON p.view_id = w.view_id"
    return (
        f"WITH {views}, cloud AS (SELECT q.frame, {axis(0, 'q.d0')} AS x, {axis(1, 'q.d0')} AS y, {axis(2, 'q.d0')} AS z FROM patch_pixels q {seen}), held AS (SELECT * FROM pixels WHERE occ = 1), "
        "owner AS (SELECT frame, x // 16 AS bx, y // 16 AS by, max(patch) AS patch FROM held GROUP BY ALL), means AS (SELECT frame, x // 4 AS cx, y // 4 AS cy, sum(d0) // count(*) AS mean FROM held GROUP BY ALL), "
        "places AS (SELECT frame, cx * 4 + i AS x, cy * 4 + j AS y, mean FROM means, range(4) a(i), range(4) b(j)), "
        "q AS (SELECT e.*, o.patch, e.x - 16 * h.u0 AS u, e.y - 16 * h.v0 AS v, CASE WHEN mean + least(8, mean) > 60 THEN 60 - mean ELSE least(8, mean) END AS span FROM (SELECT * FROM places ANTI JOIN held USING (frame, x, y)) e "
        "JOIN owner o ON e.frame = o.frame AND e.x // 16 = o.bx AND e.y // 16 = o.by JOIN patches h ON h.frame = o.frame AND h.patch = o.patch), "
        f"c AS (SELECT q.*, k, {axis(0, '(mean + k)')} AS x3, {axis(1, '(mean + k)')} AS y3, {axis(2, '(mean + k)')} AS z3 FROM q JOIN (SELECT unnest(range(-7, 8)) AS k) ks ON k = 0 OR abs(k) < span {seen}), "
        "d AS (SELECT c.frame, c.x, c.y, mean, k, min((x3 - l.x) ** 2 + (y3 - l.y) ** 2 + (z3 - l.z) ** 2) AS d2 FROM c JOIN cloud l ON c.frame = l.frame GROUP BY ALL) "
        "SELECT frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(mean + k AS INTEGER) AS d0 FROM d QUALIFY row_number() OVER (PARTITION BY frame, x, y ORDER BY d2, abs(k), k DESC) = 1"
    )


def _padding_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, patches (none turned on this canvas) and the cloud that all pixels stand for."""
    upright = table(spark, sf, "patches").withColumn("orientation", F.lit(0)).hint("merge")
    return table(spark, sf, "pixels"), upright, patches.points_of(table(spark, sf, "patch_pixels"), upright)


@query("I40_padded_depths", sql(_depth_sql(), "patch_pixels", "patches", "pixels"))
def padded_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Depths of places that come in with whole cells of occupancy, by their distance to the cloud."""
    return dilation.depth_padded(*_padding_input(spark, sf), most=60)


@query("I39_padded_frame")
def padded_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The whole canvas: those depths, then waves and copies of blocks."""
    return dilation.padded(*_padding_input(spark, sf), most=60)


_CHANNELS = ("c0", "c1", "c2")


def _smoothed_push_pull_sql(depth: int) -> str:
    """Canvases of at most 4 * 2 ** depth on each side. In layer i, f is the filled layer, s its states between rounds of smoothing."""
    each = lambda form: ", ".join(form.format(c=c) for c in _CHANNELS)
    ctes = ["b0 AS (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY frame HAVING max(occ) = 1)", f"l0 AS MATERIALIZED (SELECT frame, x, y, {each('{c}')} FROM pixels WHERE occ = 1)"]
    for i in range(1, depth + 1):
        ctes += [f"b{i} AS (SELECT frame, (w + 1) // 2 AS w, (h + 1) // 2 AS h FROM b{i - 1})", f"l{i} AS MATERIALIZED (SELECT frame, x // 2 AS x, y // 2 AS y, {each('sum({c}) // count(*) AS {c}')} FROM l{i - 1} GROUP BY frame, x // 2, y // 2)"]
    ends = " ".join(f"WHEN b{i}.w <= 4 OR b{i}.h <= 4 THEN {i}" for i in range(1, depth + 1))
    ctes.append(f"ends AS MATERIALIZED (SELECT b0.frame, CASE {ends} END AS low FROM b0 " + " ".join(f"JOIN b{i} ON b0.frame = b{i}.frame" for i in range(1, depth + 1)) + ")")
    ctes.append("around AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b WHERE i <> 0 OR j <> 0)")
    for i in range(depth, -1, -1):
        ctes.append(f"g{i} AS MATERIALIZED (SELECT t.frame, w, h, low, x, CAST(unnest(range(h)) AS BIGINT) AS y FROM (SELECT b.frame, w, h, low, CAST(unnest(range(w)) AS BIGINT) AS x FROM b{i} b JOIN ends e ON b.frame = e.frame WHERE low >= {i}) t)")
        last = f"SELECT g.frame, g.x, g.y, {each('coalesce(l.{c}, 0) AS {c}')} FROM g{i} g LEFT JOIN l{i} l ON g.frame = l.frame AND g.x = l.x AND g.y = l.y WHERE low = {i}"
        if i == depth:
            ctes.append(f"f{i} AS MATERIALIZED ({last})")
            continue
        weight = "(CASE WHEN m.x = e.x // 2 THEN 12 ELSE 4 END) * (CASE WHEN m.y = e.y // 2 THEN 12 ELSE 4 END)"
        ctes.append(
            f"s{i}_0 AS MATERIALIZED (SELECT g.frame, w, h, low, g.x, g.y, {each('l.{c}')}, true AS known FROM g{i} g JOIN l{i} l ON g.frame = l.frame AND g.x = l.x AND g.y = l.y WHERE low > {i} "
            f"UNION ALL SELECT e.frame, w, h, low, e.x, e.y, {each('sum(m.{c} * ' + weight + ') // sum(' + weight + ') AS {c}')}, false FROM (SELECT g.* FROM g{i} g ANTI JOIN l{i} l ON g.frame = l.frame AND g.x = l.x AND g.y = l.y WHERE low > {i}) e "
            f"JOIN f{i + 1} m ON m.frame = e.frame AND m.x IN (e.x // 2, e.x // 2 - 1 + 2 * (e.x % 2)) AND m.y IN (e.y // 2, e.y // 2 - 1 + 2 * (e.y % 2)) GROUP BY e.frame, w, h, low, e.x, e.y)"
        )
        rounds = min(4 + depth - 1 - i, 16)
        for k in range(1, rounds + 1):
            due = f"NOT known AND {k} <= least(4 + low - 1 - {i}, 16)"
            ctes.append(
                f"s{i}_{k} AS MATERIALIZED (SELECT * FROM s{i}_{k - 1} WHERE NOT ({due}) UNION ALL SELECT t.frame, t.w, t.h, t.low, t.x, t.y, {each('(sum(u.{c}) + 4) // 8 AS {c}')}, false FROM (SELECT s.*, "
                f"least(greatest(x + i, 0), w - 1) AS ux, least(greatest(y + j, 0), h - 1) AS uy FROM s{i}_{k - 1} s, around WHERE {due}) t JOIN s{i}_{k - 1} u ON t.frame = u.frame AND u.x = ux AND u.y = uy GROUP BY t.frame, t.w, t.h, t.low, t.x, t.y)"
            )
        whole = f" UNION ALL {last}" if i else ""
        ctes.append(f"f{i} AS MATERIALIZED (SELECT frame, x, y, {each('{c}')} FROM s{i}_{rounds}{whole})")
    return f"WITH {', '.join(ctes)} SELECT frame, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {each('CAST({c} AS INTEGER) AS {c}')} FROM f0"


@query("I47_smoothed_push_pull", sql(_smoothed_push_pull_sql(4), "pixels"))
def smoothed_push_pull(spark: SparkSession, sf: str) -> DataFrame:
    return fills.smoothed_push_pull(table(spark, sf, "pixels"))


@query("I42_harmonic_fill")
def harmonic_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Values between the occupied pixels (with I43 and I44), cut off after two digits are rounded."""
    filled = fills.harmonic_fill(table(spark, sf, "pixels"))
    return filled.select("frame", "x", "y", *[F.floor(F.round(c, 2)).cast("int").alias(c) for c in _CHANNELS])


# ---- distortion -----------------------------------------------------------------------------------------------------

_MERGED = ", ".join(f"{n} AS (SELECT frame, x, y, z, min(pid) AS pid, " + ", ".join(f"CAST(sum({c}) // count(*) AS INTEGER) AS {c}" for c in ("r", "g", "b", "reflectance")) + f" FROM {{{n}}} GROUP BY frame, x, y, z)" for n in "ab")
_SHINE = "(SELECT *, CAST(pid % 1000 AS INTEGER) AS reflectance FROM {})"
_GIVEN = ", ".join(f"({c} - 128) / 128.0::DOUBLE AS n{n}" for c, n in zip("rgb", "xyz"))
_MEAN = ", ".join(f"avg(n{c}) AS n{c}" for c in "xyz")


def _tied_sql(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT frame, pid, nn_pid, d2 FROM (SELECT a.frame, a.pid, b.pid AS nn_pid, {_D2} AS d2, min({_D2}) OVER (PARTITION BY a.frame, a.pid) AS least FROM {a} a JOIN {b} b ON a.frame = b.frame) t WHERE d2 = least)"


def _scaled_sql(points: str, normals: str, ahead: str, back: str) -> str:
    return (
        f"given AS (SELECT t.frame, t.nn_pid AS pid, {_MEAN} FROM {ahead} t JOIN {normals} n ON t.frame = n.frame AND t.pid = n.pid GROUP BY t.frame, t.nn_pid), "
        f"nb AS (SELECT * FROM given UNION ALL SELECT t.frame, t.pid, {_MEAN} FROM {back} t JOIN {normals} n ON t.frame = n.frame AND t.nn_pid = n.pid WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.frame = t.frame AND g.pid = t.pid) GROUP BY t.frame, t.pid)"
    )


def _one_way_sql(name: str, way: str, a: str, b: str, near: str, normals: str) -> str:
    along = " + ".join(f"(p.{c} - q.{c}) * n.n{c}" for c in "xyz")
    each = f"(SELECT t.frame, t.pid, any_value(t.d2) AS d2, any_value(p.r) AS r, any_value(p.g) AS g, any_value(p.b) AS b, any_value(p.reflectance) AS shine, arg_min(q.reflectance, q.pid) AS shine2, avg(({along}) * ({along})) AS plane, " + ", ".join(f"floor(avg(q.{c}) + 0.5) AS {c}2" for c in "rgb")
    each += f" FROM {near} t JOIN {a} p ON t.frame = p.frame AND t.pid = p.pid JOIN {b} q ON t.frame = q.frame AND t.nn_pid = q.pid JOIN {normals} n ON t.frame = n.frame AND t.nn_pid = n.pid GROUP BY t.frame, t.pid)"
    yuv = {"y": (0.2126, 0.7152, 0.0722), "u": (-0.1146, -0.3854, 0.5), "v": (0.5, -0.4542, -0.0458)}
    differ = ", ".join("avg(pow((" + " + ".join(f"{w}::DOUBLE * ({c} - {c}2)" for w, c in zip(ws, "rgb")) + f") / 255.0::DOUBLE, 2)) AS mse_{k}" for k, ws in yuv.items())
    return f"{name} AS (SELECT frame, '{way}' AS way, count(*) AS n, avg(d2) AS mse, CAST(max(d2) AS DOUBLE) AS hausdorff, avg(plane) AS plane_mse, max(plane) AS plane_hausdorff, {differ}, avg(pow(CAST(shine - shine2 AS DOUBLE), 2)) AS mse_r FROM {each} e GROUP BY frame)"


def _psnr_columns() -> str:
    parts = []
    for m, factor in quality.MEASURES.items():
        peak = 65535.0 if m == "mse_r" else 1.0 if m.startswith("mse_") else 1023.0
        parts.append(f"round(CASE WHEN {m} = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10({factor * peak * peak}::DOUBLE / nullif({m}, 0)) END, 5) AS psnr_{m.removeprefix('mse_') if m.startswith('mse_') else m}")
    return ", ".join([f"round({m}, 6) AS {m}" for m in quality.MEASURES] + parts)


def _shining(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).withColumn("reflectance", (F.col("pid") % 1000).cast("int"))


def _normal_cloud(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "cloud_src")
    return src.select("frame", "pid", *"xyz", *[((F.col(c) - 128) / 128.0).alias(n) for c, n in zip("rgb", quality.N)])


@query("J08_scaled_normals", sql(f"WITH {_tied_sql('f', 'cloud_src', 'cloud_rec')}, {_tied_sql('k', 'cloud_rec', 'cloud_src')}, na AS (SELECT frame, pid, {_GIVEN} FROM cloud_src), {_scaled_sql('cloud_rec', 'na', 'f', 'k')} SELECT frame, pid, " + ", ".join(f"CASE WHEN n{c} = 0 THEN 0.0::DOUBLE ELSE round(n{c}, 12) END AS n{c}" for c in "xyz") + " FROM nb", "cloud_src", "cloud_rec"))
def scaled_normals(spark: SparkSession, sf: str) -> DataFrame:
    """Normals of the first cloud carried over to the second one."""
    src, rec = table(spark, sf, "cloud_src"), table(spark, sf, "cloud_rec")
    return _short(quality.scaled_normals(rec, _given(spark, sf)[1], neighbours.tied(src, rec), neighbours.tied(rec, src)), 12)


_QUALITY = (
    f"WITH {_MERGED.format(a=_SHINE.format('cloud_src'), b=_SHINE.format('cloud_rec'))}, {_tied_sql('f', 'a', 'b')}, {_tied_sql('k', 'b', 'a')}, "
    f"spot AS (SELECT frame, x, y, z, arg_max(r, pid) AS r, arg_max(g, pid) AS g, arg_max(b, pid) AS b FROM cloud_src GROUP BY frame, x, y, z), na AS (SELECT a.frame, a.pid, {_GIVEN.replace('(r', '(spot.r').replace('(g', '(spot.g').replace('(b', '(spot.b')} FROM a JOIN spot ON a.frame = spot.frame AND a.x = spot.x AND a.y = spot.y AND a.z = spot.z), "
    f"{_scaled_sql('b', 'na', 'f', 'k')}, {_one_way_sql('w1', '1', 'a', 'b', 'f', 'nb')}, {_one_way_sql('w2', '2', 'b', 'a', 'k', 'na')}, w AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2), "
    "whole AS (SELECT * FROM w UNION ALL SELECT frame, 'F', max(n), " + ", ".join(f"max({m})" for m in ("mse", "hausdorff", "plane_mse", "plane_hausdorff", "mse_y", "mse_u", "mse_v", "mse_r")) + " FROM w GROUP BY frame)"
)


@query("A12_sequence_quality", sql(f"{_QUALITY} SELECT frame, way, n, {_psnr_columns()} FROM whole", "cloud_src", "cloud_rec"))
def sequence_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions and the worse one, for each frame: places, planes, colours and reflectance (with A07, A09 and A13)."""
    return quality.evaluated(_shining(spark, sf, "cloud_src"), _shining(spark, sf, "cloud_rec"), _normal_cloud(spark, sf))
