"""The registered queries of the text operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next, containment, fingerprint

    both = compare_with_next(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("own"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        containment(own, edited).alias("near_edited"), F.when(following.isNull(), 0.0).otherwise(containment(own, following)).alias("near_next"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import drop_repeats, words_digest

    return words_digest(drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, held_out, score_texts, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import audio_column, wave_payload

    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(text).cast("long").alias("n_bytes"))
    payload, size = wave_payload(F.col("media"))
    spans = F.concat_ws(" ", F.transform("spans", lambda s: F.concat_ws("-", s["start_s"].cast("string"), s["end_s"].cast("string"))))
    return (
        audio_column(docs).withColumn("payload", payload)
        .select(
            "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
            F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
            F.sha2("media", 256).alias("media_sha256"), F.concat_ws("|", F.sha2("log_mel", 256), spans).alias("feature"),
        )
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_frequent_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from .pieces import encode_texts

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode_texts(docs, model).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its source's tree, in directories of ten thousand and of a thousand ids; one of fewer than 100 words is named as a notice."""
    from .licenses import scan

    digits = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    short = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")) < 100
    path = F.concat_ws("/", "source", F.substring(digits, 1, 8), F.substring(digits, 9, 1), F.concat(F.when(short, "NOTICE-").otherwise("text-"), digits))
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_audio_features": op5_audio_features,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_license_scan": op10_license_scan,
}

_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, list_transform(generate_series(1, len(ws) - 12), lambda i: md5(array_to_string(list_slice(ws, i, i + 12), ' '))) AS g FROM w WHERE len(ws) >= 13),
flat AS (SELECT doc_id, unnest(g) AS h, generate_subscripts(g, 1) AS pos FROM grams),
firsts AS (SELECT h, min(doc_id) AS first FROM flat GROUP BY h),
hit AS (SELECT flat.doc_id, flat.pos FROM flat JOIN firsts ON flat.h = firsts.h WHERE firsts.first < flat.doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM hit CROSS JOIN range(13) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (gone.pos IS NULL) AS text
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op7_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
rows AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM rows),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
