"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every ``WINNOW`` consecutive ``GRAM``-word hashes the smallest
(the rightmost of equal ones) is kept, so every window of ``WINDOW`` = GRAM + WINNOW - 1 words
owns exactly one anchor, and equal windows own equal anchors.  Documents meet on anchors that
more than one of them has.  An anchor is extended both ways by at most a window, to all the windows that own
it, and not word by word against one other document: two texts agree over a window's words if and only if
their windows' hashes are equal, so a match that is extended to ``WINDOW`` words or more is a run of equal
windows, and joining the runs gives the same maximal repeats without a row for any pair of documents
(held against word-by-word extension in the tests).  Each window's first document is found by a minimum.  Hot anchors and windows are counted before they are shuffled, joins on them are left
to Spark's splitting of skewed partitions, and no pair of documents is ever made.

A repeat is a window whose word sequence also starts in a document with a smaller doc_id.
Windows are judged on the input.  Exact copies of a text with a smaller doc_id are repeats as
a whole and don't take part in the search.

Defined results: null, empty and blank texts have no words; texts of fewer words than a window
lose nothing; rows with equal doc_id count as one document, so they don't remove each other's
words; a null doc_id never owns a window and loses nothing; very long texts are searched whole; other columns
pass through, but for columns called ``n_words``, ``n_removed`` and ``repeats``, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, discard, gram_hashes, materialize, small_batches, spare, without

GRAM, WINNOW = 5, 9
WINDOW = GRAM + WINNOW - 1


def owners(grams: np.ndarray, winnow: int = WINNOW) -> np.ndarray:
    """For each run of ``winnow`` consecutive hashes the position of its smallest, the rightmost of equal ones."""
    n = len(grams) - winnow + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[winnow - 1 :].copy(), np.arange(winnow - 1, len(grams))
    for back in range(1, winnow):
        other = grams[winnow - 1 - back : len(grams) - back]
        smaller = other < best
        best[smaller] = other[smaller]
        at[smaller] = np.arange(winnow - 1 - back, len(grams) - back)[smaller]
    return at


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id) for each different anchor of a text."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, texts in chunks(batch.column(1).to_pylist()):
            words, found, rows = Words(texts), [], []
            for i in range(len(words)):
                grams = gram_hashes(words.hashes[words.bounds[i] : words.bounds[i + 1]], GRAM)
                own = np.unique(grams[np.unique(owners(grams))])
                found.append(own)
                rows.append(np.full(len(own), ids[first + i], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found))), pa.array(np.concatenate(rows))], ["anchor", "doc_id"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, pos) for each window that owns one of the row's anchors."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        wanted = batch.column(2)
        for first, texts in chunks(batch.column(1).to_pylist()):
            words, out = Words(texts), []
            for i in range(len(words)):
                own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                grams = gram_hashes(own, GRAM)
                at = owners(grams)
                anchors = wanted[first + i].values.to_numpy(zero_copy_only=False)
                pos = np.flatnonzero(np.isin(_signed(grams[at]), anchors))
                h1, h2 = gram_hashes(own, WINDOW, 2)[pos], gram_hashes(own, WINDOW, 3)[pos]
                out.append((h1, (h2 >> np.uint64(32)).astype(np.uint32), np.full(len(pos), ids[first + i], np.int64), pos.astype(np.int32)))
            h1, h2, doc, pos = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h1)), pa.array(h2.view(np.int32)), pa.array(doc), pa.array(pos)], ["h1", "h2", "doc_id", "pos"])


def covered(n_words: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + window, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) of the runs of removed words: the maximal repeats."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, starts: the first words of repeated windows), (doc_id of exact copies of an earlier text)."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    anchors = texts.mapInArrow(_anchors, "anchor long, doc_id long")
    once = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    keyed = texts.select("doc_id", F.xxhash64("text").alias("k1"), F.crc32(F.col("text").cast("binary")).alias("k2"), F.octet_length("text").alias("k3"))
    first = materialize(keyed.groupBy("k1", "k2", "k3").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "k3", "first"))
    copies = materialize(keyed.join(first, ["k1", "k2", "k3"]).filter("doc_id > first").select("doc_id").distinct().join(once, "doc_id", "left_anti"))
    shared = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    seeds = (
        anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        .join(copies, "doc_id", "left_anti")
    )
    found = materialize(texts.join(seeds, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_windows, "h1 long, h2 int, doc_id long, pos int"))
    discard(shared)
    firsts = materialize(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "first"))
    repeated = materialize(found.join(firsts, ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("pos").alias("starts")))
    discard(found)
    discard(firsts)
    return repeated, copies


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with ``text`` cut down to the kept words, joined by one space where words went, and n_words, n_removed, repeats.

    repeats: [start, end) of the maximal repeats in words.  A text that loses nothing stays as it is.
    """
    docs = without(docs, "n_words", "n_removed", "repeats")
    repeated, copies = repeated_windows(docs)
    names = docs.columns
    flags = repeated.withColumn("copied", F.lit(False)).unionByName(copies.select("doc_id", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copied")))
    doc, first, whole = spare(names, "doc", "starts", "copied")
    marks = flags.select(F.col("doc_id").alias(doc), F.col("starts").alias(first), F.col("copied").alias(whole))
    joined = docs.withColumn(doc, F.col("doc_id").cast("long")).join(marks, doc, "left").select(*[F.col(f"`{c}`") for c in names], first, whole)
    at = names.index("text")
    repeats = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, copied = batch.column(len(names)), batch.column(len(names) + 1).to_pylist()
            values, kept, n_words, n_gone, found = batch.column(at).to_pylist(), [], [], [], []
            for first, texts in chunks(values):
                words = Words(texts)
                for i in range(len(words)):
                    row, a, b = first + i, words.bounds[i], words.bounds[i + 1]
                    n = int(b - a)
                    gone = np.zeros(n, bool)
                    if copied[row]:
                        gone[:] = n >= WINDOW
                    elif starts[row].is_valid and n:
                        gone = covered(n, starts[row].values.to_numpy(zero_copy_only=False).astype(np.int64))
                    n_words.append(n)
                    n_gone.append(int(gone.sum()))
                    found.append([{"start": x, "end": y} for x, y in spans(gone)])
                    if n_gone[-1]:
                        left = [words.data[words.starts[a + j] : words.ends[a + j]] for j in np.flatnonzero(~gone)]
                        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                    else:
                        kept.append(values[row])
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(found, repeats)], [*names, "n_words", "n_removed", "repeats"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(span))])
    return joined.mapInArrow(drop, schema)


def words_digest(texts: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): SHA-256 of the words joined by one space."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return texts.select("doc_id", "n_words", "n_removed", "text").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
