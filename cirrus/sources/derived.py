"""Point clouds, patches, pixels and logs derived from the relational tables.

Each table is one SELECT that Spark and DuckDB both read; {div} is integer division in the engine's own spelling.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Points of a frame (48 by 48, one for each order key), in the layout of the point table.
SELECTS: dict[str, tuple[list[str], str]] = {
    "cloud_src": (
        ["orders"],
        """SELECT CAST(k {div} 2304 AS INT) AS frame, k AS pid, CAST(8 + k % 48 AS INT) AS x, CAST(8 + (k {div} 48) % 48 AS INT) AS y,
        CAST(16 + ((k % 48) * (k % 48) + ((k {div} 48) % 48) * ((k {div} 48) % 48)) {div} 128 AS INT) AS z,
        CAST(cu % 256 AS INT) AS r, CAST(CAST(floor(tp) AS BIGINT) % 256 AS INT) AS g, CAST(k % 256 AS INT) AS b, pri
        FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS cu, o_totalprice AS tp, o_orderpriority AS pri FROM orders) t""",
    ),
    "cloud_rec": (
        ["cloud_src"],
        """SELECT frame, pid, x, y, CAST(z + (pid * 31) % 3 - 1 AS INT) AS z, CAST((r + pid % 5) % 256 AS INT) AS r, g, b FROM cloud_src WHERE pri <> '1-URGENT'
        UNION ALL SELECT frame, pid + 1000000000, x, y, CAST(z + (pid * 31) % 3 - 1 AS INT), r, g, CAST(255 - b AS INT) FROM cloud_src WHERE pri = '5-LOW'""",
    ),
    "patches": (
        ["cloud_src"],
        """SELECT frame, patch, CAST(patch % 9 AS INT) AS orientation, CAST(patch % 18 AS INT) AS view_id, CAST(patch % 3 AS INT) AS u0, CAST(patch {div} 3 AS INT) AS v0,
        1 AS size_u0, 1 AS size_v0, min(x) AS u1, min(y) AS v1, min(z) AS d1, max(x) - min(x) + 1 AS size_u, max(y) - min(y) + 1 AS size_v
        FROM (SELECT *, CAST(((x - 8) {div} 16) * 3 + (y - 8) {div} 16 AS INT) AS patch FROM cloud_src) t GROUP BY frame, patch""",
    ),
    "patch_pixels": (
        ["cloud_src", "patches"],
        """SELECT c.frame, p.patch, c.pid, c.x - p.u1 AS u, c.y - p.v1 AS v, c.z - p.d1 AS d0, c.z - p.d1 + CAST(c.pid % 4 AS INT) AS d1, CAST(c.pid % 8 AS INT) AS eom, c.r, c.g, c.b
        FROM cloud_src c JOIN patches p ON c.frame = p.frame AND p.patch = ((c.x - 8) {div} 16) * 3 + (c.y - 8) {div} 16""",
    ),
    "pixels": (
        ["patch_pixels", "patches"],
        """SELECT q.frame, q.patch, q.u + 16 * p.u0 AS x, q.v + 16 * p.v0 AS y, q.d0, q.d1, q.r AS c0, q.g AS c1, q.b AS c2, CASE WHEN q.eom > 0 THEN 1 ELSE 0 END AS occ
        FROM patch_pixels q JOIN patches p ON q.frame = p.frame AND q.patch = p.patch""",
    ),
    "segments": (
        ["cloud_src"],
        """SELECT frame, pid, x, y, z, CAST((x {div} 16 + y {div} 16 * 2 + CASE WHEN b % 11 = 0 THEN 1 ELSE 0 END) % 6 AS INT) AS plane FROM cloud_src""",
    ),
    "log_frames": (
        ["events"],
        """SELECT CAST(event_id AS INT) AS frame_id, CAST(user_id * 20000 AS BIGINT) AS num_proj, CAST(floor(value) AS BIGINT) * 100 AS num_raw, CAST(event_id % 7 AS BIGINT) AS num_eom FROM events""",
    ),
    "enc_log": (
        ["log_frames"],
        """SELECT 'pcframe' AS file, frame_id AS row_idx, 'NumProjPoints' AS k, CAST(num_proj AS VARCHAR(20)) AS v FROM log_frames
        UNION ALL SELECT 'pcframe', frame_id, 'NumRawPoints', CAST(num_raw AS VARCHAR(20)) FROM log_frames
        UNION ALL SELECT 'pcframe', frame_id, 'NumEomPoints', CAST(num_eom AS VARCHAR(20)) FROM log_frames""",
    ),
    "dec_log": (
        ["enc_log", "events"],
        """SELECT l.file, l.row_idx, l.k, CASE WHEN e.event_type = 'error' AND l.k = 'NumRawPoints' THEN concat(l.v, '1') ELSE l.v END AS v
        FROM enc_log l JOIN events e ON l.row_idx = e.event_id WHERE e.event_type <> 'signup' OR l.k <> 'NumEomPoints'""",
    ),
}


def sql_of(name: str, div: str) -> str:
    return SELECTS[name][1].format(div=div)


def needs(name: str) -> list[str]:
    """The derived tables that name is made from, in order, itself last."""
    out: list[str] = []
    for n in SELECTS[name][0] if name in SELECTS else []:
        out += [x for x in needs(n) if x not in out]
    return out + [name] if name in SELECTS else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one over the base tables."""
    if name not in SELECTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: table(spark, sf_dir, n) for n in SELECTS[name][0]}
    text = re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", sql_of(name, "div"))
    return spark.sql(text, **inputs)


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL with the derived tables it names as common table expressions before it."""
    order: list[str] = []
    for n in names:
        order += [x for x in needs(n) if x not in order]
    ctes = ", ".join(f"{n} AS ({sql_of(n, '//')})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
