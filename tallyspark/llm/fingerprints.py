"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions only.

A sketch keeps every hash of a ``SHINGLE``-word shingle that lies in the lowest 1/``SCALE`` of
the hash range, whatever the length of the text, so sketches merge by union, and the share of
one sketch that is in another one estimates containment however unequal the texts are.  Beside
it stand a finer sketch, of every word hash in the lowest 1/``WORD_SCALE`` of its range, the
number of different shingles and one hash of the whole set.

Containment of a in b, in this order: equal sets contain each other (1); a set and an empty one
don't (0); else the share of a's shingle sketch that b's has; if no shingle of a short a was
retained, the share of its word sketch that b's has, to the power of ``SHINGLE``, as all words
of a shingle must be there; if no word was retained either, 0.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  Defined results: null counts as
empty; a text without words has an empty sketch and set, one of fewer words than a shingle has the
hash of all its words; two empty texts are alike (1); a merged sketch knows of its set only that it
has as many shingles as the larger part; very long texts are sketched whole;
rows of equal doc_id share the next document, of which the row with the smallest text hash
counts; a null doc_id has no next document; a single document is followed by itself.
Only doc_id and text are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, materialize

SHINGLE, SCALE, WORD_SCALE = 5, 4, 2
BELOW = -(1 << 63) + (1 << 64) // SCALE
WORDS_BELOW = -(1 << 31) + (1 << 32) // WORD_SCALE
SKETCH = "struct<n: bigint, whole: bigint, hashes: array<bigint>, words: array<int>>"
BLANKS = " \t\n\x0b\x0c\r"


def _struct(n: Column, whole: Column, hashes: Column, words: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), whole.alias("whole"), hashes.alias("hashes"), words.alias("words"))


def sketch(text: Column) -> Column:
    """struct(n, whole, hashes, words): shingles of the text, their set's hash, and the retained hashes of shingles and words in ascending order."""

    def hashed(words: Column) -> Column:
        return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound(shingled(h), lambda found: sketched(found, h)))

    def shingled(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k if k else i) for k in range(SHINGLE)]))
        return F.when(F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(F.array_distinct(every))

    def sketched(found: Column, h: Column) -> Column:
        words = F.filter(F.transform(F.array_distinct(h), lambda x: F.hash(x)), lambda x: x < WORDS_BELOW)
        return bound(F.sort_array(found), lambda ordered: _struct(F.size(found), F.xxhash64(ordered), F.filter(ordered, lambda x: x < BELOW), F.sort_array(F.array_distinct(words))))

    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    none = _struct(F.lit(0), F.lit(0).cast("long"), F.array().cast("array<bigint>"), F.array().cast("array<int>"))
    return F.when(trimmed == "", none).otherwise(hashed(F.split(trimmed, r"[\x20\x09-\x0D]+")))


def merged(a: Column, b: Column) -> Column:
    """Sketch of both texts' shingles; n is the least number they can have, whole is null unless the sets are equal or one is empty."""
    whole = F.when((b["n"] == 0) | (a["whole"] == b["whole"]), a["whole"]).when(a["n"] == 0, b["whole"])
    return _struct(F.greatest(a["n"], b["n"]), whole, F.sort_array(F.array_union(a["hashes"], b["hashes"])), F.sort_array(F.array_union(a["words"], b["words"])))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        return F.size(F.array_intersect(x, y)) / F.size(x)

    return (
        F.when((a["n"] == 0) | (b["n"] == 0), ((a["n"] == 0) & (b["n"] == 0)).cast("double"))
        .when((a["n"] == b["n"]) & (a["whole"] == b["whole"]), 1.0)
        .when(F.size(a["hashes"]) > 0, share(a["hashes"], b["hashes"]))
        .when(F.size(a["words"]) > 0, F.pow(share(a["words"], b["words"]), F.lit(SHINGLE)))
        .otherwise(0.0)
    )


def fingerprint(s: Column) -> Column:
    """``n:whole:shingle hashes:word hashes``, the hashes as base64 of their big-endian bytes."""
    shingles = F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0"))
    words = F.transform(s["words"], lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    packed = [F.base64(F.unhex(F.concat_ws("", part))) for part in (shingles, words)]
    return F.concat_ws(":", s["n"].cast("string"), F.coalesce(F.hex(s["whole"]), F.lit("")), *packed)


def with_next(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, the last one followed by the first.

    Ids are dealt into ranges; a window finds successors within a range, and the ranges' first ids, one row each, those across.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.first("first").over(every)).alias("after"))
    within = ranged.withColumn("next", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    return within.join(F.broadcast(after), "range").select("doc_id", F.coalesce("next", "after").alias("next_id"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, and the sketches ``own``, ``edited_sketch`` and ``next_sketch`` (null without a next document).

    edited: the last quarter of the text replaced by as much from the start of the next document.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # both joins read this one exchange of the texts: the same columns, filter and key; sketches are made behind it
    texts = every.filter("doc_id is not null")
    lengths = texts.select("doc_id", F.length("text").alias("n"))
    per_id = materialize(lengths.groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows")))
    repeated = not per_id.filter("rows > 1").isEmpty()
    order = with_next(per_id.select("doc_id"))
    asked = order.join(per_id, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("previous"), F.floor(F.col("n") / 4).cast("int").alias("taken"))
    given = texts.join(asked.hint("merge"), "doc_id").select("previous", F.substring(F.col("text"), F.lit(1), F.col("taken")).alias("lead"), sketch(F.col("text")).alias("next_sketch"), *([F.xxhash64("text").alias("h")] if repeated else []))
    if repeated:
        given = given.groupBy("previous").agg(F.min_by(F.struct("lead", "next_sketch"), "h").alias("x")).select("previous", "x.*")
    nameless = every.filter("doc_id is null").select("doc_id", "text", F.lit("").alias("lead"), F.lit(None).cast(SKETCH).alias("next_sketch"))
    followed = texts.join(given.hint("merge"), F.col("doc_id") == F.col("previous")).select("doc_id", "text", "lead", "next_sketch").unionAll(nameless)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("lead"), F.lit(1), quarter))
    return followed.select("doc_id", "text", "next_sketch", edited.alias("edited")).withColumns({"own": sketch(F.col("text")), "edited_sketch": sketch(F.col("edited"))})
