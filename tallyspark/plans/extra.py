"""Smaller registered queries: listings, labels, partners, set operations on arrays and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger, origin
from ..operators.ranks import ranked
from ..sources import analog
from ..sources.files import live_partners
from . import views
from .catalog import query

_TREE = "'/p/' || source || CASE doc_id % 3 WHEN 0 THEN '/a/b' WHEN 1 THEN '/a' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '/.x' ELSE '/f' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.heic' ELSE '.txt' END"


@query(f"""WITH p AS (SELECT doc_id, source, {_TREE} AS path FROM documents),
k AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'heic') AND NOT contains(path, '/.'))
SELECT doc_id, path, row_number() OVER (PARTITION BY source ORDER BY parts) AS place FROM k""")
def walk_order(spark, sf_dir):
    """Photos of each folder tree in the order of a walk: by path components, hidden names and other files left out."""
    path = F.expr(_TREE)
    rows = analog.table(spark, sf_dir, "documents").select("doc_id", "source", path.alias("path"))
    kept = rows.filter(text.media_kind(F.col("path")).isin("jpeg", "heic") & ~text.is_hidden(F.col("path")))
    return ranked(kept.withColumn("parts", origin.components(F.col("path"))), ["source"], ["parts"], "place").select("doc_id", "path", "place")


_CLIP = "'/p/' || source || '/IMG_' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN '.jpg' WHEN doc_id % 3 = 0 THEN '.MOV' ELSE '.mov' END"


@query(f"""WITH p AS (SELECT doc_id, {_CLIP} AS path FROM documents), v AS (SELECT regexp_replace(path, '\\.[^./]+$', '') AS stem, min(path) AS video FROM p WHERE lower(path) LIKE '%.mov' GROUP BY 1)
SELECT doc_id, path, video FROM p LEFT JOIN v ON v.stem = regexp_replace(path, '\\.[^./]+$', '') WHERE path LIKE '%.jpg'""")
def live_photo_partners(spark, sf_dir):
    rows = analog.table(spark, sf_dir, "documents").select("doc_id", F.expr(_CLIP.replace("(doc_id // 2)", "(doc_id div 2)")).alias("path"))
    return live_partners(rows.filter("path LIKE '%.jpg'"), rows.select("path"))


@query(f"""WITH {views.FILES}, o AS (SELECT 'IMG_' || p_partkey || '.jpg' AS name, 50000 + 1000 * p_partkey AS other_bytes FROM part)
SELECT o.name, count(*) AS pairs, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, CAST(sum(other_bytes) AS BIGINT) AS other_bytes, min(output_bytes) AS smallest
FROM v_files f JOIN o ON o.name = f.name WHERE status = 'done' GROUP BY o.name""")
def outputs_by_name(spark, sf_dir):
    """Results held against another tool's outputs of the same file names, with the sums of a benchmark."""
    other = analog.table(spark, sf_dir, "part").selectExpr("concat('IMG_', p_partkey, '.jpg') AS name", "50000L + 1000 * p_partkey AS other_bytes")
    return (
        analog.files(spark, sf_dir).filter("status = 'done'").join(other, "name").groupBy("name")
        .agg(F.count("*").alias("pairs"), F.sum("original_bytes").alias("original_bytes"), F.sum("output_bytes").alias("output_bytes"), F.sum("other_bytes").alias("other_bytes"), F.min("output_bytes").alias("smallest"))
    )


@query("""WITH t AS (SELECT doc_id, [lang || '-XX', CASE doc_id % 3 WHEN 0 THEN 'ES_mx' WHEN 1 THEN 'pt' ELSE 'EN' END] AS tags FROM documents)
SELECT doc_id, coalesce(list_filter(list_transform(tags, lambda x: lower(regexp_extract(x, '^[^-_]*'))), lambda x: x IN ('en', 'es'))[1], 'en') AS language FROM t""")
def language_choice(spark, sf_dir):
    tags = F.array(F.concat("lang", F.lit("-XX")), F.expr("CASE doc_id % 3 WHEN 0 THEN 'ES_mx' WHEN 1 THEN 'pt' ELSE 'EN' END"))
    return analog.table(spark, sf_dir, "documents").select("doc_id", text.language(tags).alias("language"))


@query(f"""WITH {views.FILES} SELECT session_id, idx, CASE WHEN original_bytes <= 0 THEN 0 ELSE greatest(0, CAST(floor((original_bytes - output_bytes) * 1000 / original_bytes) AS BIGINT)) END AS saved_permille,
CASE WHEN output_bytes > original_bytes THEN '+' ELSE '' END || ((output_bytes - original_bytes) * 100 // original_bytes) || ' %' AS change FROM v_files""")
def percent_text(spark, sf_dir):
    o, r = F.col("original_bytes"), F.col("output_bytes")
    change = F.concat(F.when(r > o, "+").otherwise(""), F.expr("(output_bytes - original_bytes) * 100 div original_bytes").cast("string"), F.lit(" %"))
    return analog.files(spark, sf_dir).select("session_id", "idx", text.saved_permille(o, r).alias("saved_permille"), change.alias("change"))


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS owner, CAST(p_size AS BIGINT) * 997 % 40000 AS pixels FROM part WHERE CAST(p_size AS BIGINT) * 997 % 40000 BETWEEN 16 AND 30000),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY id) AS place FROM s) SELECT id, owner, pixels || ' px' AS label, place FROM r WHERE place <= 4""")
def size_presets(spark, sf_dir):
    """The first four valid sizes of each owner."""
    rows = analog.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS owner", "cast(p_size as bigint) * 997 % 40000 AS pixels").filter("pixels BETWEEN 16 AND 30000")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("id")).cast("long")).filter("place <= 4")
    return placed.select("id", "owner", F.concat(F.col("pixels").cast("string"), F.lit(" px")).alias("label"), "place")


@query("""WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_id % 13) FILTER (event_id % 2 = 0)) AS watch, list_sort(list(DISTINCT event_id % 17) FILTER (event_id % 3 = 0)) AS ranked FROM events GROUP BY user_id),
b AS (SELECT user_id, coalesce(watch, []) AS watch, coalesce(ranked, []) AS ranked FROM a)
SELECT user_id, array_to_string(list_sort(list_filter(ranked, lambda x: NOT list_contains(watch, x))), ',') AS extra, array_to_string(list_sort(list_distinct(list_concat(watch, ranked))), ',') AS together, list_has_any(watch, ranked) AS overlap,
array_to_string(list_sort(list_intersect(watch, ranked)), ',') AS common FROM b""")
def array_sets(spark, sf_dir):
    """Differences, unions and intersections of tile lists."""
    kept = analog.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.expr("CASE WHEN event_id % 2 = 0 THEN event_id % 13 END")).alias("watch"), F.collect_set(F.expr("CASE WHEN event_id % 3 = 0 THEN event_id % 17 END")).alias("ranked"))
    text_of = lambda a: F.concat_ws(",", F.array_sort(a).cast("array<string>"))
    return kept.select(
        "user_id", text_of(F.array_except("ranked", "watch")).alias("extra"), text_of(F.array_union("watch", "ranked")).alias("together"), F.arrays_overlap("watch", "ranked").alias("overlap"),
        text_of(F.array_intersect("watch", "ranked")).alias("common"),
    )


@query("""WITH e AS (SELECT user_id, event_id AS item, [event_id + 1, event_id + 5] AS refs, CASE WHEN event_id % 2 = 0 THEN 'dimg' ELSE 'cdsc' END AS kind FROM events),
x AS (SELECT user_id, item, kind, unnest(refs) AS target FROM e)
SELECT x.user_id, x.target, count(*) AS referring, min(x.item) FILTER (x.kind = 'dimg') AS first_tile FROM x JOIN events i ON i.event_id = x.target AND i.user_id = x.user_id GROUP BY x.user_id, x.target""")
def item_references(spark, sf_dir):
    """Items that refer to another item of the same file, through exploded reference lists."""
    rows = analog.table(spark, sf_dir, "events").selectExpr("user_id", "event_id")
    edges = rows.selectExpr("user_id", "event_id AS item", "CASE WHEN event_id % 2 = 0 THEN 'dimg' ELSE 'cdsc' END AS kind", "explode(array(event_id + 1, event_id + 5)) AS target")
    met = edges.join(rows.withColumnRenamed("event_id", "target"), ["user_id", "target"])
    return met.groupBy("user_id", "target").agg(F.count("*").alias("referring"), F.min(F.when(F.col("kind") == "dimg", F.col("item"))).alias("first_tile"))


@query(f"WITH {views.SESSIONS} SELECT id, strftime(epoch_ms(started_at), '%Y-%m-%d') AS day, strftime(epoch_ms(started_at), '%m/%Y') AS month, (finished_at - started_at) // 1000 AS seconds FROM v_sessions")
def session_dates(spark, sf_dir):
    at = F.timestamp_millis("started_at")
    return analog.sessions(spark, sf_dir).select("id", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "MM/yyyy").alias("month"), F.expr("(finished_at - started_at) div 1000").alias("seconds"))


@query(f"""WITH {views.FILES} SELECT session_id, idx, 'v1 q=' || quality || ' s=' || (80 + idx % 10) || '.' || (quality % 10) || CASE WHEN converted THEN ' from=heic' WHEN lossless THEN ' lossless' ELSE '' END AS marker FROM v_files WHERE status = 'done'""")
def marker_text(spark, sf_dir):
    score = (F.lit(80) + F.col("idx") % 10) + (F.col("quality") % 10) / 10
    tail = F.when(F.col("converted"), " from=heic").when(F.col("lossless"), " lossless").otherwise("")
    return analog.files(spark, sf_dir).filter("status = 'done'").select("session_id", "idx", F.concat(F.lit("v1 q="), F.col("quality").cast("string"), F.lit(" s="), text.one_decimal(score), tail).alias("marker"))


@query(f"""WITH {views.FILES} SELECT session_id, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (skip_reason = 'conversionOff') AS conversion_off,
bool_or(status = 'done' AND output_bytes < original_bytes) AS any_saved FROM v_files GROUP BY session_id""")
def status_counts(spark, sf_dir):
    saved = (F.col("status") == "done") & (F.col("output_bytes") < F.col("original_bytes"))
    return analog.files(spark, sf_dir).groupBy("session_id").agg(
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("skip_reason") == "conversionOff").alias("conversion_off"), F.bool_or(saved).alias("any_saved")
    )


@query(f"WITH {views.SESSIONS}, p AS (SELECT * FROM v_sessions ORDER BY started_at DESC, id DESC LIMIT 100) SELECT (SELECT count(*) FROM p) AS shown, (SELECT count(*) FROM v_sessions) - (SELECT count(*) FROM p) AS hidden, (SELECT min(started_at) FROM p) AS oldest")
def grown_page(spark, sf_dir):
    """The history after asking for a second page: how much is shown and how much is left."""
    sessions = analog.sessions(spark, sf_dir)
    page = ledger.history_page(sessions, 2 * ledger.PAGE).agg(F.count("*").alias("shown"), F.min("started_at").alias("oldest"))
    return page.crossJoin(F.broadcast(sessions.agg(F.count("*").alias("n")))).select("shown", (F.col("n") - F.col("shown")).alias("hidden"), "oldest")
