"""The analog views of ``sources.analog`` as common table expressions in DuckDB's SQL."""

from __future__ import annotations

from ..operators.blocks import LUMA
from ..schemas import SKIP_LABELS

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_REASONS = ", ".join(f"'{r}'" for r in SKIP_LABELS)

FILES = f"""
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS idx, CAST(round(l_extendedprice * 100) AS BIGINT) AS ob,
         CAST(round(l_discount * 100) AS BIGINT) AS pct, CAST(l_quantity AS BIGINT) AS qty,
         CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'skipped' ELSE 'failed' END AS status FROM lineitem),
v_files AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id, idx, 'IMG_' || l_partkey || '.jpg' AS name,
         '/Users/u' || (l_suppkey % 3) || '/P' || (l_suppkey % 7) || '/IMG_' || l_partkey || '.jpg' AS path, status, (status = 'done' AND l_linenumber = 7) AS converted,
         ob AS original_bytes,
         CASE WHEN status <> 'done' THEN ob WHEN l_linenumber = 7 THEN ob + ob // 4 WHEN l_linenumber = 6 THEN ob + 1000000 ELSE ob - (ob * pct * 5) // 100 END AS output_bytes,
         CASE WHEN status = 'skipped' THEN [{_REASONS}][qty % 11 + 1] END AS skip_reason, CASE WHEN status = 'failed' THEN 'decode' END AS error,
         CASE WHEN status = 'done' THEN 60 + qty % 38 END AS quality, (status = 'done' AND l_linestatus = 'F') AS lossless
  FROM lines)"""

SUMMARY = FILES + """,
v_sum AS (
  SELECT session_id, count(*) AS photos, count(*) FILTER (status = 'done') AS optimized, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
         CAST(coalesce(sum(original_bytes) FILTER (NOT converted), 0) AS BIGINT) AS original_bytes, CAST(coalesce(sum(output_bytes) FILTER (NOT converted), 0) AS BIGINT) AS output_bytes
  FROM v_files GROUP BY session_id)"""

SESSIONS = SUMMARY + """,
v_sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS started_at, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) + 1000 * coalesce(photos, 0) AS finished_at,
         coalesce(photos, 0) AS photos, coalesce(optimized, 0) AS optimized, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed,
         coalesce(original_bytes, 0) AS original_bytes, coalesce(output_bytes, 0) AS output_bytes, coalesce(greatest(original_bytes - output_bytes, 0), 0) AS saved_bytes,
         CASE WHEN o_orderstatus = 'O' THEN 'export' ELSE 'replace' END AS output_mode,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'pristine' WHEN '5-LOW' THEN 'compact' ELSE 'identical' END AS strength,
         (o_orderstatus <> 'O' AND o_orderkey % 17 <> 0 AND coalesce(optimized, 0) > 0) AS can_undo, (o_orderkey % 17 = 0) AS undone
  FROM orders LEFT JOIN v_sum ON session_id = CAST(o_orderkey AS VARCHAR))"""

BACKUPS = SESSIONS + """,
v_backups AS (
  SELECT f.session_id, f.idx, f.path AS original, '/backups/' || f.session_id || '/' || lpad(CAST(f.idx AS VARCHAR), 5, '0') || '-' || f.name AS backup,
         CASE WHEN converted THEN replace(path, '.jpg', '.JPG') END AS output, f.original_bytes, f.output_bytes, f.converted, s.started_at
  FROM v_files f JOIN v_sessions s ON s.id = f.session_id WHERE f.status = 'done' AND s.output_mode = 'replace'),
v_disk AS (SELECT backup AS path, session_id, original_bytes AS bytes FROM v_backups WHERE (original_bytes + idx) % 5 <> 0)"""

PHOTOS = """
base AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s FROM part),
headers AS (
  SELECT k AS id, 64 + (37 * k) % 7000 AS width, 64 + (53 * k) % 5000 AS height, 1 + k % 8 AS orientation,
         CASE WHEN s % 20 = 0 THEN 'exotic' WHEN s % 2 = 0 THEN 'baseline' ELSE 'progressive' END AS kind,
         CASE WHEN s % 10 = 1 THEN 4 WHEN s % 10 = 2 THEN 1 ELSE 3 END AS components, CASE WHEN s % 25 = 3 THEN 12 ELSE 8 END AS bits,
         (s % 15 = 4) AS embedded, (k % 23 = 0) AS has_marker, 70 + k % 30 AS quality_estimate, 50000 + 1000 * k AS original_bytes FROM base),
v_photos AS (SELECT *, (original_bytes * (40 + id % 70)) // 100 AS perceptual_bytes, (original_bytes * (93 + id % 8)) // 100 AS lossless_bytes FROM headers)"""

LUMA_LIST = "[" + ", ".join(map(str, LUMA)) + "]"


def spans(length: str, side: str) -> str:
    """List of [start, size] that covers 0..length."""
    n = f"greatest({length} // {side} + CASE WHEN {length} % {side} >= 96 THEN 1 ELSE 0 END, 1)"
    return f"list_transform(generate_series(0, {n} - 1), lambda i: [i * {side}, CASE WHEN i = {n} - 1 THEN {length} - i * {side} ELSE {side} END])"


TILES = PHOTOS + f""",
sided AS (SELECT id, width, height, least(greatest(greatest(width, height) // 6, 256), 768) AS side FROM v_photos),
cut AS (SELECT id, {spans("width", "side")} AS cols, {spans("height", "side")} AS rws FROM sided),
by_row AS (SELECT id, cols, len(cols) AS n_cols, unnest(rws) AS r, generate_subscripts(rws, 1) - 1 AS row_no FROM cut),
cells AS (SELECT id, r, row_no, n_cols, unnest(cols) AS c, generate_subscripts(cols, 1) - 1 AS col_no FROM by_row),
v_grid AS (SELECT id, row_no * n_cols + col_no AS tile, c[1] AS x, r[1] AS y, c[2] AS w, r[2] AS h FROM cells),
v_tiles AS (SELECT *, 800 + (7 * x + 13 * y) % 200 AS score, (7919 * tile + 31 * id) % 1000 AS difficulty FROM v_grid)"""
