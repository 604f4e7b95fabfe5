"""Registered queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jpeg, text
from ..operators import blocks, decisions, ledger, maintenance, origin, search
from ..schemas import strengths
from ..sources import analog, journal
from ..sources.shared import shared_dir
from ..streaming import events as stream
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


class State:
    """The analog ledger of one folder of tables, or of the sessions with these ids alone."""

    def __init__(self, spark: SparkSession, sf_dir: str, ids: list[str] | None = None):
        self.files = analog.files(spark, sf_dir, ids)
        self.sessions = analog.sessions(spark, sf_dir, self.files, ids)
        self.backups = analog.backups(self.files, self.sessions)
        self.disk = analog.disk(self.backups)

    def stated(self) -> DataFrame:
        return ledger.with_disk_state(self.files, self.backups, self.disk, F.expr("(output_bytes + idx) % 11 <> 0"))


@query(f"WITH {views.SUMMARY} SELECT *, greatest(original_bytes - output_bytes, 0) AS saved_bytes FROM v_sum")
def session_summary(spark, sf_dir):
    return ledger.session_summary(analog.files(spark, sf_dir))


_LIVE = """count(*) AS processed, count(*) FILTER (converted) AS converted, count(*) FILTER (NOT converted AND status = 'done') AS optimized,
CAST(coalesce(sum(original_bytes) FILTER (NOT converted), 0) AS BIGINT) AS original_bytes, CAST(coalesce(sum(output_bytes) FILTER (NOT converted), 0) AS BIGINT) AS output_bytes,
CAST(coalesce(sum(greatest(original_bytes - output_bytes, 0)) FILTER (NOT converted), 0) AS BIGINT) AS saved_bytes"""


@query(f"WITH {views.FILES} SELECT session_id, {_LIVE} FROM v_files GROUP BY session_id")
def live_stats_final(spark, sf_dir):
    return ledger.live_stats(analog.files(spark, sf_dir), "session_id")


@query(f"""WITH {views.SUMMARY}, live AS (SELECT session_id, {_LIVE} FROM v_files GROUP BY session_id)
SELECT v_sum.session_id, greatest(v_sum.original_bytes - v_sum.output_bytes, 0) AS summary_saved, live.saved_bytes AS live_saved FROM v_sum JOIN live ON live.session_id = v_sum.session_id
WHERE live.saved_bytes <> greatest(v_sum.original_bytes - v_sum.output_bytes, 0)""")
def summary_vs_live_gap(spark, sf_dir):
    files = analog.files(spark, sf_dir)
    live = ledger.live_stats(files, "session_id").select("session_id", F.col("saved_bytes").alias("live_saved"))
    return ledger.session_summary(files).select("session_id", F.col("saved_bytes").alias("summary_saved")).join(live, "session_id").filter("summary_saved <> live_saved")


@query(f"""WITH {views.FILES}, t AS (SELECT count(*) FILTER (status = 'done') AS optimized, count(*) FILTER (converted) AS converted, count(*) FILTER (status = 'skipped') AS skipped,
count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(original_bytes) FILTER (status <> 'failed' AND NOT converted), 0) AS BIGINT) AS before,
CAST(coalesce(sum(output_bytes) FILTER (status <> 'failed' AND NOT converted), 0) AS BIGINT) AS after FROM v_files)
SELECT *, greatest(before - after, 0) AS saved, CASE WHEN before = 0 THEN 0 ELSE greatest(before - after, 0) * 1000 // before END AS saved_permille FROM t""")
def batch_totals(spark, sf_dir):
    return ledger.batch_totals(analog.files(spark, sf_dir))


@query(f"""WITH {views.SESSIONS}, t AS (SELECT CAST(coalesce(sum(saved_bytes), 0) AS BIGINT) AS saved_bytes, CAST(coalesce(sum(original_bytes), 0) AS BIGINT) AS original_bytes,
CAST(coalesce(sum(optimized), 0) AS BIGINT) AS photos, count(*) AS sessions, min(started_at) AS since FROM v_sessions)
SELECT *, CASE WHEN original_bytes = 0 THEN 0 ELSE saved_bytes * 1000 // original_bytes END AS reduction_permille FROM t""")
def totals(spark, sf_dir):
    return ledger.totals(analog.sessions(spark, sf_dir))


@query(f"WITH {views.SESSIONS} SELECT * FROM v_sessions ORDER BY started_at DESC, id DESC LIMIT 50")
def history_page(spark, sf_dir):
    return ledger.history_page(analog.sessions(spark, sf_dir))


_ORIGIN = """
folders AS (SELECT session_id, idx, name, list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS folder FROM v_files),
joined AS (SELECT session_id, count(*) AS n, count(DISTINCT folder) AS folders, min(folder) AS low, max(folder) AS high, arg_min(name, idx) AS first FROM folders GROUP BY session_id),
shared AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, least(len(low), len(high))), lambda i: low[i] <> high[i])) - 1, least(len(low), len(high))) AS depth FROM joined),
kinds AS (SELECT *, list_slice(low, 1, depth) AS common, CASE WHEN folders = 1 AND n <= 3 THEN 'files' WHEN folders = 1 THEN 'folder' WHEN depth < 2 THEN 'scattered' ELSE 'folders' END AS origin_kind FROM shared),
v_origin AS (SELECT session_id, origin_kind, CASE origin_kind WHEN 'files' THEN first WHEN 'scattered' THEN NULL ELSE common[len(common)] END AS origin_name,
  CASE origin_kind WHEN 'files' THEN n - 1 WHEN 'folders' THEN folders END AS origin_count, CASE WHEN origin_kind <> 'scattered' THEN '/' || array_to_string(common, '/') END AS origin_path FROM kinds)"""


@query(f"WITH {views.FILES}, {_ORIGIN} SELECT * FROM v_origin")
def session_origin(spark, sf_dir):
    return origin.session_origins(analog.files(spark, sf_dir))


_STATED = """
stated AS (SELECT f.*, d.path AS original_path, CASE WHEN f.status = 'done' AND (f.output_bytes + f.idx) % 11 <> 0 THEN f.path END AS output_path
  FROM v_files f LEFT JOIN v_backups b ON b.session_id = f.session_id AND b.idx = f.idx LEFT JOIN v_disk d ON d.path = b.backup)"""


@query(f"""WITH {views.BACKUPS}, {_STATED}, {_ORIGIN}, page AS (SELECT * FROM v_sessions ORDER BY started_at DESC, id DESC LIMIT 50),
shown AS (SELECT DISTINCT session_id FROM stated WHERE status = 'done' AND original_path IS NOT NULL AND output_path IS NOT NULL),
sizes AS (SELECT session_id, CAST(sum(bytes) AS BIGINT) AS backup_bytes FROM v_disk GROUP BY session_id)
SELECT p.*, (NOT p.undone AND shown.session_id IS NOT NULL) AS comparable, coalesce(backup_bytes, 0) AS backup_bytes, origin_kind, origin_name, origin_count, origin_path
FROM page p LEFT JOIN shown ON shown.session_id = p.id LEFT JOIN sizes ON sizes.session_id = p.id LEFT JOIN v_origin o ON o.session_id = p.id""")
def history_overview(spark, sf_dir):
    """A page of the history: its sessions, 10,000 at most, are found first, and only their rows are read for all else."""
    page = [r.id for r in ledger.history_page(analog.starts(spark, sf_dir)).collect()]
    state = State(spark, sf_dir, page)
    return ledger.history_overview(state.sessions, state.stated(), state.disk, origin.session_origins(state.files))


@query(f"WITH {views.BACKUPS} SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS backup_bytes, count(DISTINCT session_id) AS folders FROM v_disk")
def backup_space(spark, sf_dir):
    return State(spark, sf_dir).disk.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("backup_bytes"), F.count_distinct("session_id").alias("folders"))


@query(f"""WITH {views.BACKUPS}, r AS (SELECT session_id, string_agg(idx || ':' || path || ':' || status || ':' || original_bytes || ':' || output_bytes, ';' ORDER BY idx) AS results FROM v_files GROUP BY session_id),
b AS (SELECT session_id, string_agg(idx || ':' || original || ':' || backup || ':' || coalesce(output, ''), ';' ORDER BY idx) AS backups FROM v_backups GROUP BY session_id)
SELECT s.id, s.saved_bytes, coalesce(results, '') AS results, coalesce(backups, '') AS backups FROM v_sessions s LEFT JOIN r ON r.session_id = s.id LEFT JOIN b ON b.session_id = s.id""")
def record_nested(spark, sf_dir):
    state = State(spark, sf_dir)
    nested = ledger.nested_records(state.sessions, state.files, state.backups)
    results = F.transform("results", lambda r: F.concat_ws(":", r["idx"], r["path"], r["status"], r["original_bytes"], r["output_bytes"]))
    kept = F.transform("backups", lambda b: F.concat_ws(":", b["idx"], b["original"], b["backup"], F.coalesce(b["output"], F.lit(""))))
    return nested.select("id", "saved_bytes", F.concat_ws(";", results).alias("results"), F.concat_ws(";", kept).alias("backups"))


@query(f"WITH {views.SESSIONS} SELECT f.session_id, f.idx, f.path FROM v_files f WHERE f.session_id = (SELECT id FROM v_sessions ORDER BY started_at DESC, id DESC LIMIT 1) ORDER BY f.idx")
def session_files(spark, sf_dir):
    """Paths of the newest session, in order."""
    files = analog.files(spark, sf_dir)
    newest = ledger.history_page(analog.sessions(spark, sf_dir, files), 1).select(F.col("id").alias("session_id"))
    return files.join(F.broadcast(newest), "session_id", "left_semi").select("session_id", "idx", "path").orderBy("idx")


@query(f"WITH {views.SESSIONS} SELECT id FROM v_sessions WHERE can_undo")
def undoable_ids(spark, sf_dir):
    return maintenance.undoable_ids(analog.sessions(spark, sf_dir))


@query("SELECT source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '-' END || doc_id AS id FROM documents WHERE regexp_full_match(source || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '-' END || doc_id, '[A-Za-z0-9-]{1,32}')")
def valid_ids(spark, sf_dir):
    ids = analog.table(spark, sf_dir, "documents").selectExpr("concat(source, CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '-' END, doc_id) AS id")
    return maintenance.valid_ids(ids)


@query(f"WITH {views.BACKUPS}, {_STATED} SELECT session_id, idx, path, original_path FROM stated WHERE status = 'done' AND original_path IS NOT NULL AND output_path IS NOT NULL")
def comparable_files(spark, sf_dir):
    return ledger.comparable(State(spark, sf_dir).stated()).select("session_id", "idx", "path", "original_path")


@query(f"WITH {views.BACKUPS}, {_STATED} SELECT session_id, idx, original_path, output_path FROM stated WHERE status = 'done'")
def available_files(spark, sf_dir):
    """Done files with what is left of their original and output."""
    return State(spark, sf_dir).stated().filter("status = 'done'").select("session_id", "idx", "original_path", "output_path")


@query(f"""WITH {views.SESSIONS}, newest AS (SELECT max(started_at) AS now FROM v_sessions)
SELECT id, started_at, (can_undo AND started_at >= now - 7 * 86400000) AS can_undo, (started_at < now - 7 * 86400000) AS expired FROM v_sessions, newest""")
def prune_backups(spark, sf_dir):
    """Sessions after a retention of seven days, their folders named by the start."""
    sessions = analog.sessions(spark, sf_dir)
    now = sessions.agg(F.max("started_at").alias("now")).first()["now"] or 0
    folders = sessions.select(F.col("started_at").cast("string").alias("folder"), "id", "started_at", "can_undo")
    old = maintenance.expired(folders, now, 7, "folder").select("id").withColumn("expired", F.lit(True))
    left = folders.join(old, "id", "left").withColumn("expired", F.coalesce("expired", F.lit(False)))
    return left.select("id", "started_at", (F.col("can_undo") & ~F.col("expired")).alias("can_undo"), "expired")


@query(f"""WITH {views.BACKUPS}, c AS (SELECT b.session_id, count(*) AS recorded, count(d.path) AS on_disk FROM v_backups b LEFT JOIN v_disk d ON d.path = b.backup GROUP BY b.session_id)
SELECT id, coalesce(recorded, 0) AS recorded, coalesce(on_disk, 0) AS on_disk, CASE WHEN coalesce(on_disk, 0) = 0 THEN 'discard' WHEN on_disk < recorded THEN 'shrink' ELSE 'keep' END AS decision
FROM v_sessions LEFT JOIN c ON c.session_id = id WHERE can_undo""")
def reconcile_backups(spark, sf_dir):
    state = State(spark, sf_dir)
    return maintenance.reconcile_plan(state.sessions, state.backups, state.disk)


@query(f"""WITH {views.BACKUPS}, gone AS (SELECT id FROM v_sessions WHERE can_undo AND id NOT IN (SELECT session_id FROM v_disk))
SELECT b.session_id, b.idx, b.backup FROM v_backups b JOIN v_sessions s ON s.id = b.session_id
WHERE b.session_id NOT IN (SELECT id FROM gone) AND (NOT s.can_undo OR b.backup IN (SELECT path FROM v_disk))""")
def reconciled_backups(spark, sf_dir):
    """Backups recorded after reconciliation."""
    state = State(spark, sf_dir)
    return maintenance.reconcile(state.sessions, state.backups, state.disk)[1].select("session_id", "idx", "backup")


@query(f"WITH {views.BACKUPS} SELECT id, saved_bytes, (can_undo AND id NOT IN (SELECT session_id FROM v_disk)) AS can_undo FROM v_sessions")
def discard_all(spark, sf_dir):
    state = State(spark, sf_dir)
    return maintenance.discard_finished(state.sessions, state.backups, state.disk)[0].select("id", "saved_bytes", "can_undo")


def _journal(backups: DataFrame) -> DataFrame:
    """Journal lines of backups; every fiftieth line is cut short."""
    lines = journal.journal_lines(backups)
    return lines.withColumn("line", F.expr("CASE WHEN (cast(session_id as bigint) + idx) % 50 = 0 THEN substring(line, 1, 20) ELSE line END"))


_JOURNAL = "v_journal AS (SELECT * FROM v_backups WHERE CAST(session_id AS BIGINT) % 97 = 0 AND (CAST(session_id AS BIGINT) + idx) % 50 <> 0)"


@query(f"""WITH {views.BACKUPS}, {_JOURNAL}, s AS (SELECT j.session_id AS id, count(*) AS photos, CAST(sum(d.bytes) AS BIGINT) AS original_bytes, CAST(sum(j.output_bytes) AS BIGINT) AS output_bytes
FROM v_journal j JOIN v_disk d ON d.path = j.backup GROUP BY j.session_id)
SELECT id, photos, photos AS optimized, original_bytes, output_bytes, greatest(original_bytes - output_bytes, 0) AS saved_bytes, true AS can_undo, false AS undone FROM s""")
def recover_interrupted(spark, sf_dir):
    state = State(spark, sf_dir)
    # the scenario: every 97th session has no record yet; the journals of all sessions are read
    recorded = state.sessions.filter("cast(id as bigint) % 97 <> 0")
    return maintenance.recover(journal.parse_journal(_journal(state.backups)), recorded, state.disk)


@query(f"""WITH {views.BACKUPS} SELECT session_id, idx, original, backup, output, output_bytes AS written_bytes, started_at AS modified_ms FROM v_backups
WHERE (CAST(session_id AS BIGINT) + idx) % 50 <> 0""")
def journal_roundtrip(spark, sf_dir):
    """The journal lines of all backups, read back; those that were cut short are skipped."""
    parsed = journal.parse_journal(_journal(State(spark, sf_dir).backups))
    return parsed.select("session_id", "idx", "original", "backup", "output", F.col("written.bytes").alias("written_bytes"), F.col("written.modifiedMs").alias("modified_ms"))


@query(f"""WITH {views.BACKUPS}, tried AS (SELECT b.*, (d.path IS NOT NULL AND (b.output_bytes + b.idx) % 11 <> 0) AS ok FROM v_backups b JOIN v_sessions s ON s.id = b.session_id AND s.can_undo LEFT JOIN v_disk d ON d.path = b.backup),
c AS (SELECT session_id, count(*) FILTER (ok) AS restored, count(*) FILTER (NOT ok) AS kept, count(DISTINCT original) FILTER (ok) AS paths FROM tried GROUP BY session_id),
back AS (SELECT f.session_id, CAST(coalesce(sum(greatest(f.original_bytes - f.output_bytes, 0)) FILTER (NOT f.converted), 0) AS BIGINT) AS taken FROM v_files f
  WHERE EXISTS (SELECT 1 FROM tried t WHERE t.ok AND t.session_id = f.session_id AND t.original = f.path) GROUP BY f.session_id)
SELECT s.id, coalesce(restored, 0) AS restored, coalesce(kept, 0) AS kept, greatest(s.optimized - coalesce(paths, 0), 0) AS optimized, s.original_bytes, s.output_bytes + coalesce(taken, 0) AS output_bytes,
  greatest(s.saved_bytes - coalesce(taken, 0), 0) AS saved_bytes, (coalesce(kept, 0) > 0) AS can_undo, (coalesce(kept, 0) = 0) AS undone
FROM v_sessions s LEFT JOIN c ON c.session_id = s.id LEFT JOIN back ON back.session_id = s.id WHERE s.can_undo""")
def undo_session(spark, sf_dir):
    state = State(spark, sf_dir)
    backups = state.backups.withColumn("intact", F.expr("(output_bytes + idx) % 11 <> 0"))
    return maintenance.undo(state.sessions, state.files, backups, state.disk)


@query(f"""WITH {views.SESSIONS}, patch AS (SELECT id, started_at, 0 AS optimized, true AS undone FROM v_sessions WHERE CAST(id AS BIGINT) % 5 = 0
UNION ALL SELECT 'new-' || id, started_at + 1, optimized, false FROM v_sessions WHERE CAST(id AS BIGINT) % 50 = 0)
SELECT id, started_at, optimized, undone FROM v_sessions WHERE id NOT IN (SELECT id FROM patch) UNION ALL SELECT * FROM patch""")
def upsert_record(spark, sf_dir):
    current = analog.sessions(spark, sf_dir).select("id", "started_at", "optimized", "undone")
    old = current.filter("cast(id as bigint) % 5 = 0").selectExpr("id", "started_at", "0L AS optimized", "true AS undone")
    new = current.filter("cast(id as bigint) % 50 = 0").selectExpr("concat('new-', id) AS id", "started_at + 1 AS started_at", "optimized", "false AS undone")
    return maintenance.upsert(current, old.unionByName(new), "id")


@query(f"WITH {views.SESSIONS} SELECT session_id, count(*) AS files FROM v_files WHERE session_id NOT IN (SELECT id FROM v_sessions WHERE strength = 'pristine') GROUP BY session_id")
def cascade_check(spark, sf_dir):
    """Files that would be orphans if only pristine sessions were left."""
    files = analog.files(spark, sf_dir)
    return maintenance.orphans(files, analog.sessions(spark, sf_dir, files).filter("strength = 'pristine'")).groupBy("session_id").agg(F.count("*").alias("files"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SKIP_LABELS.items())


@query(f"""WITH {views.FILES} SELECT session_id, idx, '"' || path || '","' || status || '",' || original_bytes || ',' || output_bytes || ',' ||
printf('%.1f', CASE WHEN original_bytes > 0 THEN 100.0::DOUBLE * (1.0::DOUBLE - output_bytes::DOUBLE / original_bytes::DOUBLE) ELSE 0 END) || ',' || coalesce(CAST(quality AS VARCHAR), '') || ',,"' ||
coalesce(error, CASE skip_reason {_LABELS} END, '') || '","' || CASE WHEN status = 'done' THEN path ELSE '' END || '"' AS line FROM v_files""")
def csv_log(spark, sf_dir):
    files = analog.files(spark, sf_dir).withColumn("outputs", F.expr("CASE WHEN status = 'done' THEN array(path) ELSE array() END"))
    return text.csv_log(files)


def _bytes_sql(b: str, base: int) -> str:
    m, g = base**2, base**3
    fixed = lambda unit, scale, digits: f"((({b} * {scale} + {unit // 2}) // {unit}) // {scale}) || '.' || lpad(CAST((({b} * {scale} + {unit // 2}) // {unit}) % {scale} AS VARCHAR), {digits}, '0')"
    return f"CASE WHEN {b} >= {g} THEN {fixed(g, 100, 2)} || ' GB' WHEN {b} >= {m} THEN {fixed(m, 10, 1)} || ' MB' ELSE (({b} + {base // 2}) // {base}) || ' KB' END"


@query(f"""WITH {views.FILES}, x AS (SELECT session_id, idx, original_bytes AS b, original_bytes * 977 AS large FROM v_files)
SELECT session_id, idx, {_bytes_sql('b', 1000)} AS shown, {_bytes_sql('large', 1000)} AS large, {_bytes_sql('large', 1024)} AS binary_units FROM x""")
def bytes_text(spark, sf_dir):
    large = F.col("original_bytes") * 977
    return analog.files(spark, sf_dir).select("session_id", "idx", text.bytes_text(F.col("original_bytes")).alias("shown"), text.bytes_text(large).alias("large"), text.bytes_text(large, 1024).alias("binary_units"))


@query("""WITH x AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 37 % 400000 AS ms FROM events)
SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN ((ms + 50) // 1000) || CASE WHEN (ms + 50) // 100 % 10 = 0 THEN '' ELSE '.' || ((ms + 50) // 100 % 10) END || ' s'
ELSE (ms // 60000) || ' min ' || ((ms % 60000 + 500) // 1000) || ' s' END AS shown FROM x""")
def duration_text(spark, sf_dir):
    ms = F.expr("cast(round(value * 100) as bigint) * 37 % 400000")
    return analog.table(spark, sf_dir, "events").select("event_id", text.duration_text(ms).alias("shown"))


@query(r"""WITH d AS (SELECT doc_id, '/Users/ana/' || source || '/x' || (doc_id % 5) || '/IMG ' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.heic' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.Jpg' WHEN 4 THEN '.mov' ELSE '' END AS path,
  CASE doc_id % 4 WHEN 0 THEN '../' || lang || '/y' WHEN 1 THEN '  ' WHEN 2 THEN '2048 px: "web"?' ELSE lang || '\b|c.' END AS label FROM documents),
e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^/]\.([^./]+)$', 1) AS ext, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '^(/Users/ana/[^/]*)', 1) AS root,
  trim(regexp_replace(label, '[/\\:*?"<>|]', '-', 'g'), ' ') AS dashed FROM d),
f AS (SELECT *, CASE WHEN regexp_replace(regexp_replace(dashed, '^\.+', ''), '[. ]+$', '') = '' THEN 'Size' ELSE regexp_replace(regexp_replace(dashed, '^\.+', ''), '[. ]+$', '') END AS safe FROM e)
SELECT doc_id, name, CASE WHEN lower(ext) IN ('jpg', 'jpeg', 'jpe', 'jfif') THEN 'jpeg' WHEN lower(ext) IN ('heic', 'heif', 'hif') THEN 'heic' WHEN lower(ext) = 'mov' THEN 'video' ELSE 'other' END AS kind,
  regexp_replace(path, '\.[^./]+$', '') || '.' || CASE WHEN ext <> '' AND upper(ext) = ext THEN 'JPG' ELSE 'jpg' END AS converted, '~/' || substr(path, 12) AS short, safe AS label,
  '/out/' || regexp_extract(root, '[^/]*$') || substr(parent, length(root) + 1) || '/' || safe || '/' || name AS export FROM f""")
def path_functions(spark, sf_dir):
    path = "concat('/Users/ana/', source, '/x', doc_id % 5, '/IMG ', doc_id, CASE doc_id % 6 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.heic' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.Jpg' WHEN 4 THEN '.mov' ELSE '' END) AS path"
    label = r"""CASE doc_id % 4 WHEN 0 THEN concat('../', lang, '/y') WHEN 1 THEN '  ' WHEN 2 THEN '2048 px: "web"?' ELSE concat(lang, '\\b|c.') END AS label"""
    rows = analog.table(spark, sf_dir, "documents").selectExpr("doc_id", path, label, "concat('/Users/ana/', source) AS root")
    p = F.col("path")
    return rows.select(
        "doc_id", text.file_name(p).alias("name"), text.media_kind(p).alias("kind"), text.converted_name(p).alias("converted"), origin.shorten_home(p, "/Users/ana").alias("short"),
        text.safe_label(F.col("label")).alias("label"), text.export_path(p, F.col("root"), "/out", F.col("label"), 2).alias("export"),
    )


@query(r"""WITH n AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN lang || '0 ' || (2 + doc_id % 3) ELSE lang || (doc_id % 3) END || '.jpg' AS name FROM documents),
r AS (SELECT *, regexp_extract(name, '^(.*)\.jpg$', 1) AS stem, row_number() OVER (PARTITION BY source, name ORDER BY doc_id) - 1 AS k FROM n),
taken AS (SELECT source, regexp_extract(name, '^(.*) ([0-9]+)\.jpg$', 1) AS stem, list_sort(list(DISTINCT CAST(regexp_extract(name, ' ([0-9]+)\.jpg$', 1) AS INT))) AS numbers FROM n WHERE regexp_matches(name, ' [0-9]+\.jpg$') GROUP BY 1, 2),
f AS (SELECT r.*, list_filter(generate_series(2, 2 + k + len(coalesce(numbers, []))), lambda x: NOT list_contains(coalesce(numbers, []), x)) AS free FROM r LEFT JOIN taken t ON t.source = r.source AND t.stem = r.stem)
SELECT doc_id, source, name, CASE WHEN k = 0 THEN name ELSE stem || ' ' || free[k] || '.jpg' END AS "unique" FROM f""")
def unique_names(spark, sf_dir):
    names = analog.table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "concat(CASE WHEN doc_id % 7 = 0 THEN concat(lang, '0 ', 2 + doc_id % 3) ELSE concat(lang, doc_id % 3) END, '.jpg') AS name")
    return text.unique_names(names, "source", "name", "doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def ordered_distinct(spark, sf_dir):
    """Each text once, where it comes first; texts are shuffled as hashes."""
    docs = analog.table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(r"""SELECT page_id, md5(s) AS digest, length(s) AS chars FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '\s+href\s*=\s*("[^"]*"|''[^'']*'')', '', 'g'), '<href[^>]*/>', '', 'g'), '(?s)<href[^>]*>.*?</href>', '', 'g') AS s FROM pages)""")
def strip_attributes(spark, sf_dir):
    stripped = text.strip_property(F.col("html"), "href")
    return analog.table(spark, sf_dir, "pages").select("page_id", stripped.alias("s")).select("page_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("chars"))


_SIZES = [(0, "original", None, None), (1, "2048 px", "long_edge", 2048), (2, "width 1000", "max_width", 1000), (3, "height 800", "max_height", 800)]


@query(f"""WITH {views.PHOTOS}, sizes(size_no, label, mode, pixels) AS (VALUES (0, 'original', NULL, NULL), (1, '2048 px', 'long_edge', 2048), (2, 'width 1000', 'max_width', 1000), (3, 'height 800', 'max_height', 800)),
e AS (SELECT id, size_no, label, width, height, pixels, CASE mode WHEN 'long_edge' THEN greatest(width, height) WHEN 'max_width' THEN CASE WHEN orientation >= 5 THEN height ELSE width END
  ELSE CASE WHEN orientation >= 5 THEN width ELSE height END END AS edge FROM v_photos, sizes),
s AS (SELECT *, CAST(pixels AS DOUBLE) / CAST(edge AS DOUBLE) AS scale FROM e)
SELECT id, size_no, label, CASE WHEN scale < 1 THEN greatest(CAST(floor(width * scale + 0.5) AS BIGINT), 1) END AS target_width, CASE WHEN scale < 1 THEN greatest(CAST(floor(height * scale + 0.5) AS BIGINT), 1) END AS target_height FROM s""")
def size_matrix(spark, sf_dir):
    sizes = spark.createDataFrame(_SIZES, "size_no int, label string, mode string, pixels long")
    return decisions.size_matrix(analog.photos(spark, sf_dir), sizes)


@query(f"""WITH {views.PHOTOS} SELECT id, CASE WHEN kind = 'exotic' OR bits <> 8 THEN 'exoticJpeg' WHEN components = 4 THEN 'cmyk' WHEN width * height > 20000000 THEN 'tooLarge' WHEN embedded THEN 'embeddedMedia' END AS skip_reason,
(NOT (id % 5 = 0 AND components = 3)) AS requantizable FROM v_photos""")
def skip_decision(spark, sf_dir):
    photos = analog.photos(spark, sf_dir)
    transform = F.when(F.col("id") % 5 == 0, 0).when(F.col("id") % 5 == 1, 1)
    return photos.select("id", decisions.jpeg_precheck(20_000_000).alias("skip_reason"), decisions.requantizable(transform, F.col("components")).alias("requantizable"))


@query("""WITH h AS (SELECT event_id, user_id % 2 = 0 AS on_, event_id % 7 = 0 AS sequence, event_id % 5 = 0 AS stereo, event_id % 3 = 0 AS hdr FROM events)
SELECT event_id, CASE WHEN NOT on_ THEN 'conversionOff' WHEN sequence THEN 'unsupported' WHEN stereo THEN 'spatialPhoto' WHEN hdr THEN 'hdrPhoto' END AS skip_reason FROM h""")
def heic_decision(spark, sf_dir):
    flags = analog.table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 2 = 0 AS enabled", "event_id % 7 = 0 AS sequence", "event_id % 5 = 0 AS stereo", "event_id % 3 = 0 AS hdr")
    return flags.select("event_id", decisions.heic_precheck(F.col("enabled")).alias("skip_reason"))


@query(f"""WITH {views.PHOTOS}, g AS (SELECT *, (original_bytes - lossless_bytes) * 100 >= original_bytes AS l, (original_bytes - perceptual_bytes) * 100 >= original_bytes * 3 AS p FROM v_photos)
SELECT id, CASE WHEN has_marker THEN 'alreadyOptimized' WHEN quality_estimate < 90 THEN CASE WHEN l THEN 'lossless' ELSE 'noGain' END
WHEN (original_bytes - perceptual_bytes) * 100 >= original_bytes * 10 THEN 'perceptual' WHEN p AND l AND lossless_bytes * 100 <= perceptual_bytes * 103 THEN 'lossless' WHEN p THEN 'perceptual' WHEN l THEN 'lossless' ELSE 'noGain' END AS decision FROM g""")
def render_decision(spark, sf_dir):
    return analog.photos(spark, sf_dir).select("id", decisions.render_decision().alias("decision"))


_SCALED = "list_transform({base}, lambda x: CAST(least(greatest((x * {scale} + 50) // 100, 1), 255) AS INT))"
_SCALE = "CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END"


@query(f"""WITH q AS (SELECT vec_id, CAST(1 + vec_id % 100 AS INT) AS q FROM embeddings), t AS (SELECT vec_id, q, {_SCALED.format(base=views.LUMA_LIST, scale=f"({_SCALE})")} AS tab FROM q),
r AS (SELECT vec_id, q, list_sort(list_transform(generate_series(1, 64), lambda i: greatest(tab[i], 1) * 100.0::DOUBLE / ({views.LUMA_LIST})[i]))[33] AS s FROM t)
SELECT vec_id, q AS quality, CAST(least(greatest(floor(CASE WHEN s <= 100 THEN (200 - s) / 2 ELSE 5000 / s END + 0.5), 1), 100) AS INT) AS estimate FROM r""")
def quality_estimate(spark, sf_dir):
    tables = analog.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(1 + vec_id % 100 as int) AS quality")
    return tables.withColumn("tab", blocks.scaled_table(F.col("quality"))).select("vec_id", "quality", blocks.estimate_quality(F.col("tab")).alias("estimate"))


@query(f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x * 1000) AS INT)) AS coef, CAST(1 + vec_id % 100 AS INT) AS q FROM embeddings),
t AS (SELECT vec_id, coef, {_SCALED.format(base=views.LUMA_LIST, scale=f"({_SCALE})")} AS target, {_SCALED.format(base=views.LUMA_LIST, scale=20)} AS source FROM c),
m AS (SELECT *, list_transform(generate_series(1, 64), lambda i: least(greatest(target[i], source[i], 1), 255)) AS merged FROM t)
SELECT vec_id, array_to_string(list_transform(generate_series(1, 64), lambda i: sign(coef[i]) * ((abs(coef[i]) * source[i] * 2 + merged[i]) // (2 * merged[i]))), ',') AS levels FROM m""")
def requantize(spark, sf_dir):
    rows = analog.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int")).alias("coef"), (1 + F.col("vec_id") % 100).cast("int").alias("q"))
    steps = rows.withColumns({"target": blocks.scaled_table(F.col("q")), "source": blocks.scaled_table(F.lit(90))}).withColumn("merged", blocks.merge_steps(F.col("target"), F.col("source")))
    return steps.select("vec_id", F.concat_ws(",", blocks.requantize(F.col("coef"), F.col("source"), F.col("merged")).cast("array<string>")).alias("levels"))


@query("""WITH c AS (SELECT l_orderkey AS image, l_linenumber AS component, l_suppkey % 2 AS slot, l_partkey AS first_step FROM lineitem)
SELECT image, slot, arg_min(first_step, CAST(component AS BIGINT) * 1000000000 + first_step) AS step FROM c GROUP BY image, slot""")
def slot_steps(spark, sf_dir):
    """The first component of each table slot decides its steps."""
    rows = analog.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image", "l_suppkey % 2 AS slot", "cast(l_linenumber as bigint) * 1000000000 + l_partkey AS component", "array(l_partkey) AS steps")
    return blocks.slot_steps(rows, "image").select("image", "slot", F.get("steps", F.lit(0)).alias("step"))


@query(f"WITH {views.TILES} SELECT * FROM v_grid")
def tile_grid(spark, sf_dir):
    return blocks.tile_grid(analog.photos(spark, sf_dir))


@query(f"WITH {views.TILES} SELECT g.id, count(*) AS tiles, CAST(sum(w * h) AS BIGINT) AS covered, (sum(w * h) = any_value(p.width * p.height)) AS whole FROM v_grid g JOIN v_photos p ON p.id = g.id GROUP BY g.id")
def tile_cover_check(spark, sf_dir):
    photos = analog.photos(spark, sf_dir)
    area = blocks.tile_grid(photos).groupBy("id").agg(F.count("*").alias("tiles"), F.sum(F.col("w") * F.col("h")).alias("covered"))
    return area.join(photos, "id").select("id", "tiles", "covered", (F.col("covered") == F.col("width") * F.col("height")).alias("whole"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.tile_grid(analog.photos(spark, sf_dir)).selectExpr("*", "800 + (7 * x + 13 * y) % 200 AS score", "(7919 * tile + 31 * id) % 1000 AS difficulty")


@query(f"WITH {views.TILES} SELECT id, CAST(sum(score * w * h) * 100 // greatest(sum(w * h), 1) AS BIGINT) AS mean_hundredths, min(score) AS worst, count(*) AS tiles FROM v_tiles GROUP BY id")
def tile_scores(spark, sf_dir):
    return blocks.tile_summary(_tiles(spark, sf_dir))


@query(f"""WITH {views.TILES}, r AS (SELECT id, tile, difficulty, row_number() OVER (PARTITION BY id ORDER BY difficulty DESC, tile) AS rank, count(*) OVER (PARTITION BY id) AS n FROM v_tiles)
SELECT id, tile, difficulty, rank FROM r WHERE rank <= greatest(n // 6, 8)""")
def watch_list(spark, sf_dir):
    return blocks.watch_list(_tiles(spark, sf_dir)).select("id", "tile", "difficulty", "rank")


@query("""WITH s(strength, tg, tw, mg, mw) AS (VALUES ('pristine', 94.0, 91.0, 0.5, 1.0), ('identical', 91.5, 86.5, 1.5, 3.0), ('compact', 89.0, 82.5, 3.0, 6.0)),
b AS (SELECT p_partkey AS id, 85.0 + p_size % 12 AS best_global, 78.0 + p_size % 15 AS best_worst FROM part)
SELECT id, strength, CAST(least(tg, best_global - mg) * 10 AS BIGINT) AS global10, CAST(least(tw, best_worst - mw) * 10 AS BIGINT) AS worst10 FROM b, s""")
def strength_targets(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(s) for s in ("pristine", "identical", "compact")]))
    best = analog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.lit(85.0) + F.col("p_size") % 12).alias("best_global"), (F.lit(78.0) + F.col("p_size") % 15).alias("best_worst"), names.alias("strength"))
    return decisions.ceiling_targets(strengths(spark), best).select("id", "strength", (F.col("ceiling_global") * 10).cast("long").alias("global10"), (F.col("ceiling_worst") * 10).cast("long").alias("worst10"))


_SLACK = "CASE WHEN id % 50 = 0 THEN -10 ELSE 8 * ({0} - (60 + id % 30)) - CASE WHEN {0} % 7 = 0 THEN 3 ELSE 0 END END"


@query(f"""WITH RECURSIVE {views.PHOTOS},
r AS (SELECT id, 0 AS probes, 78::BIGINT AS probe, NULL::BIGINT AS fq, NULL::DOUBLE AS fs, NULL::BIGINT AS pq, NULL::DOUBLE AS ps, false AS settled FROM v_photos
UNION ALL
SELECT id, probes + 1, CAST(CASE WHEN settled2 THEN probe WHEN pq2 IS NOT NULL AND fq2 IS NOT NULL THEN least(greatest(ceil(fq2 + ((-fs2) * (pq2 - fq2)) / (ps2 - fs2)), fq2 + 1), pq2 - 1)
  WHEN pq2 IS NOT NULL THEN greatest(probe - jump2, 45) ELSE least(probe + jump2, 97) END AS BIGINT), fq2, fs2, pq2, ps2, settled2
FROM (SELECT *, CASE WHEN moved IS NOT NULL AND abs(was - s) < 0.3::DOUBLE THEN greatest(jump, 2 * abs(moved - probe)) ELSE jump END AS jump2,
    coalesce(pq2 - fq2 <= 1, false) OR coalesce(ps2 < 0.7::DOUBLE OR pq2 <= 45, false) OR (pq2 IS NULL AND fq2 >= 97) AS settled2
  FROM (SELECT *, CASE WHEN s >= 0 AND fq IS NULL THEN pq WHEN s < 0 AND pq IS NULL THEN fq END AS moved, CASE WHEN s >= 0 AND fq IS NULL THEN ps WHEN s < 0 AND pq IS NULL THEN fs END AS was,
      CASE WHEN s >= 0 THEN probe ELSE pq END AS pq2, CASE WHEN s >= 0 THEN s ELSE ps END AS ps2, CASE WHEN s < 0 THEN probe ELSE fq END AS fq2, CASE WHEN s < 0 THEN s ELSE fs END AS fs2,
      CASE WHEN s >= 0 THEN floor(least(greatest(abs(s) / 0.8::DOUBLE, 1), 20)) ELSE ceil(least(greatest(abs(s) / 0.8::DOUBLE, 1), 20)) END AS jump
    FROM (SELECT *, CAST({_SLACK.format("probe")} AS DOUBLE) / 10 AS s FROM r WHERE NOT settled))))
SELECT id, pq AS quality, CAST(probes AS BIGINT) AS probes FROM r WHERE settled""")
def lowest_passing(spark, sf_dir):
    """Bracketing search per photo at the identical strength; every fiftieth photo passes nowhere."""
    curve = F.expr(f"transform(sequence(45, 97), q -> {_SLACK.format('q')})")
    photos = analog.photos(spark, sf_dir).select("id", F.lit(78).alias("start"), F.lit(45).alias("low_q"), F.lit(97).alias("high_q"), curve.alias("slack10"))
    return search.search_qualities(photos)


@query("""SELECT user_id, event_id, count(*) OVER w AS processed, count(*) FILTER (event_type = 'error') OVER w AS failed, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS bytes,
CAST(1000 * count(*) OVER w // count(*) OVER (PARTITION BY user_id) AS BIGINT) AS progress_permille FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_stats(spark, sf_dir):
    """Running totals and progress after each event of a session."""
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = analog.table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    counted = rows.select("user_id", "event_id", F.count("*").over(so_far).alias("processed"), F.count_if(F.col("event_type") == "error").over(so_far).alias("failed"), F.sum("cents").over(so_far).alias("bytes"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    return counted.withColumn("progress_permille", F.expr("1000 * processed div total")).drop("total")


@query(f"""WITH {views.FILES} SELECT session_id, idx, coalesce(last_value(CASE WHEN NOT lossless THEN quality END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hint FROM v_files""")
def quality_hint(spark, sf_dir):
    """The last lossy quality before each file of a session, 0 if there is none."""
    before = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    hint = F.last(F.when(~F.col("lossless"), F.col("quality")), ignorenulls=True).over(before)
    return analog.files(spark, sf_dir).select("session_id", "idx", F.coalesce(hint, F.lit(0)).cast("long").alias("hint"))


@query(f"""WITH {views.FILES}, r AS (SELECT session_id, idx, path, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS back FROM v_files WHERE status = 'done')
SELECT session_id, idx, path, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS place FROM r WHERE back <= 3""")
def last_previews(spark, sf_dir):
    """The last three finished files of each session, oldest first."""
    mine = Window.partitionBy("session_id")
    ranked = analog.files(spark, sf_dir).filter("status = 'done'").withColumn("back", F.row_number().over(mine.orderBy(F.desc("idx")))).filter("back <= 3")
    return ranked.select("session_id", "idx", "path", F.row_number().over(mine.orderBy("idx")).cast("long").alias("place"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, CAST(arg_max(round(value * 100), event_id) AS BIGINT) AS cents FROM events GROUP BY user_id, event_type")
def latest_request(spark, sf_dir):
    rows = analog.table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return stream.latest(rows, ["user_id", "event_type"], "event_id", "cents")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS first FROM e),
b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS batch FROM g)
SELECT user_id, min(us) // 1000 AS started_ms, (max(us) + 3600000000) // 1000 AS ended_ms, count(*) AS events FROM b GROUP BY user_id, batch""")
def gathered_batches(spark, sf_dir):
    """Events gathered until an hour was quiet."""
    found = stream.gathered(analog.table(spark, sf_dir, "events"), "ts", "1 hour", "user_id")
    return found.select("user_id", F.unix_millis("batch.start").alias("started_ms"), F.unix_millis("batch.end").alias("ended_ms"), "events")


@query("""SELECT user_id AS session_id, count(*) AS processed, CAST(0 AS BIGINT) AS converted, count(*) FILTER (event_type <> 'error') AS optimized, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS original_bytes,
CAST(sum(CAST(round(value * 100) AS BIGINT) // 3) AS BIGINT) AS output_bytes, CAST(sum(greatest(CAST(round(value * 100) AS BIGINT) - CAST(round(value * 100) AS BIGINT) // 3, 0)) AS BIGINT) AS saved_bytes FROM events GROUP BY user_id""")
def stream_live_stats(spark, sf_dir):
    """Live statistics of the events read as a stream up to their present end."""
    rows = stream.as_file_events(stream.event_files(spark, sf_dir))
    return stream.streamed_live_stats(rows, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}")


@query(f"""WITH {views.PHOTOS} SELECT id, kind, width, height, bits, components, orientation, has_marker, embedded, id % 4 = 0 AS gain_map,
CAST(greatest(least(CASE WHEN quality_estimate > 0 THEN quality_estimate END, 100), 1) AS BIGINT) AS near_quality FROM v_photos""")
def jpeg_headers(spark, sf_dir):
    """Headers of synthetic files, read back from their bytes; the quality is within 1 of that of the table.

    Videos are announced by a packet or stand far behind the image; gain maps are named in three ways; every fifth file has a thumbnail with a scan of its own.
    """
    photos = analog.photos(spark, sf_dir).withColumns({"table": blocks.scaled_table(F.col("quality_estimate").cast("int")), "gain_map": F.col("id") % 4 == 0})
    read = jpeg.with_headers(jpeg.synthesize(photos)).join(photos.select("id", "quality_estimate"), "id")
    near = F.when(F.abs(blocks.estimate_quality(F.col("table")) - F.col("quality_estimate")) <= 1, F.col("quality_estimate"))
    return read.select("id", "kind", "width", "height", "bits", "components", "orientation", "has_marker", "embedded", "gain_map", near.alias("near_quality"))


from . import extra, pictures  # noqa: E402,F401  register more queries
