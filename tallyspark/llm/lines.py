"""Line dedup: exact reference counts per line key behind sharded cuckoo filters.

State is a ``LineIndex``: a table of (k1, k2, n_docs), how many documents hold a line key (128-bit hash
of the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased), and for each shard of
keys a cuckoo filter with the sorted frequent keys behind it.  When documents come or go,
``LineIndex.updated`` adds their counts up and inserts into the filters the keys that became frequent and
deletes those that no longer are, so a decision taken earlier is undone as soon as a count falls;
a filter that is full is built anew from its keys.  Lookups ask the filter first and the keys
second, so no line is lost to a false positive.

While there are at most ``SHIPPED_KEYS`` frequent keys the shards are broadcast; beyond that
lines are sent to their key's shard, of which each task holds one at a time: a shard with many
lines (a line of a third of all documents, say) is dealt to several tasks, each with its own copy.

Defined results: a null or empty text is one empty line and is never dropped; empty keys
are never dropped; a line repeated within a document counts once; equal rows count as two
documents; a null doc_id is a document like any other; very long texts are split whole; other
columns pass through unchanged, but for columns called ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, spare, without

BLANKS = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1
#: Keys of one filter shard, frequent keys up to which shards are sent to every executor (about 19 bytes each), and lines that one task holds against a shard.
SHARD_KEYS, SHIPPED_KEYS, SHARD_LINES = 1 << 16, 1 << 21, 1 << 20


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> int | None:
    """128-bit key of a line, None for one that is too short to be dropped."""
    key = line.strip(BLANKS).lower()
    if not key or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_intdigest(key)


def halves(key: int) -> tuple[int, int]:
    high, low = key >> 64, key & 0xFFFFFFFFFFFFFFFF
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


class CuckooFilter:
    """Set of 64-bit hashes by 16-bit tags in two buckets of four; supports deletion."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.84))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table, self.mask = table, np.uint64(len(table) - 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = hashes.astype(np.uint64)
        tags = (hashes >> np.uint64(48)).astype(np.uint16)
        tags[tags == 0] = 1
        first = hashes & self.mask
        return tags, first, self.other(first, tags)

    def other(self, bucket: np.ndarray, tags: np.ndarray) -> np.ndarray:
        return bucket ^ ((tags.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tags, first, second = self.places(hashes)
        return ((self.table[first] == tags[:, None]) | (self.table[second] == tags[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> None:
        for tag, first, second in zip(*self.places(hashes)):
            if not (self._put(first, tag) or self._put(second, tag)):
                self._kick(second, tag)

    def delete(self, hashes: np.ndarray) -> None:
        for tag, *where in zip(*self.places(hashes)):
            for bucket in where:
                at = np.flatnonzero(self.table[bucket] == tag)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def _put(self, bucket: int, tag: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = tag
        return bool(len(free))

    def _kick(self, bucket: int, tag: int) -> None:
        for turn in range(self.KICKS):
            slot = turn % self.SLOTS
            tag, self.table[bucket, slot] = self.table[bucket, slot], tag
            bucket = self.other(np.array([bucket]), np.array([tag]))[0]
            if self._put(bucket, tag):
                return
        raise OverflowError("cuckoo filter is full")

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        """A filter of all the hashes; twice as large as long as they don't fit."""
        capacity = len(hashes)
        while True:
            made = cls(capacity)
            try:
                made.insert(hashes)
                return made
            except OverflowError:
                capacity = 2 * capacity + 8


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, n_docs): in how many documents each line key is."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for text in batch.column(0):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found.extend(halves(k) for k in {line_key(line, min_chars) for line in raw.split(b"\n")} if k is not None)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)], ["k1", "k2"])

    return small_batches(docs).select("text").mapInArrow(keys, "k1 long, k2 long").groupBy("k1", "k2").agg(F.count("*").alias("n_docs"))


def merge_counts(counts: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The table after documents came or went: the same as one counted afresh."""
    parts = counts
    for delta, sign in ((added, 1), (deleted, -1)):
        if delta is not None:
            parts = parts.unionByName(line_counts(delta).withColumn("n_docs", F.col("n_docs") * sign))
    return parts.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


SHARD_ROW = "shard int, n_keys long, filter binary, keys binary"


def shard_of(k1, shards: int):
    return F.pmod(F.shiftright(k1, 7), F.lit(shards)).cast("int")


def _in_order(pdf: pd.DataFrame) -> np.ndarray:
    """(k2, k1) rows in ascending order."""
    return pdf.sort_values(["k2", "k1"])[["k2", "k1"]].to_numpy(np.int64)


def _shard_row(shard: int, table: CuckooFilter, keys: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_keys": [len(keys)], "filter": [table.table.tobytes()], "keys": [np.ascontiguousarray(keys).tobytes()]})


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, n_keys, filter, keys): one cuckoo filter and its exact key table, sorted, for each shard that has keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _in_order(pdf)
        return _shard_row(pdf["shard"].iloc[0], CuckooFilter.of(keys[:, 0].view(np.uint64)), keys)

    return frequent.select(shard_of(F.col("k1"), shards).alias("shard"), "k1", "k2").groupBy("shard").applyInPandas(build, SHARD_ROW)


def change_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The shards after the keys of (k1, k2, come) rows were inserted where ``come`` is true, deleted where it is false."""

    def change(held: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
        shard = int((held if len(held) else delta)["shard"].iloc[0])
        if len(held):
            table = CuckooFilter(table=np.frombuffer(held["filter"].iloc[0], np.uint16).reshape(-1, CuckooFilter.SLOTS).copy())
            keys = np.frombuffer(held["keys"].iloc[0], np.int64).reshape(-1, 2)
        else:
            table, keys = CuckooFilter(), np.zeros((0, 2), np.int64)
        gone, new = (_in_order(delta[delta["come"] == come]) for come in (False, True))
        keys = pd.DataFrame(keys, columns=["k2", "k1"])
        if len(gone):
            keys = keys[~keys.set_index(["k2", "k1"]).index.isin([tuple(x) for x in gone.tolist()])]
        keys = _in_order(pd.concat([keys, pd.DataFrame(new, columns=["k2", "k1"])]))
        table.delete(gone[:, 0].view(np.uint64))
        try:
            table.insert(new[:, 0].view(np.uint64))
        except OverflowError:
            table = CuckooFilter.of(keys[:, 0].view(np.uint64))
        return _shard_row(shard, table, keys)

    marked = changes.select(shard_of(F.col("k1"), shards).alias("shard"), "k1", "k2", "come")
    return filters.groupBy("shard").cogroup(marked.groupBy("shard")).applyInPandas(change, SHARD_ROW)


@dataclass
class LineIndex:
    """Reference counts and filter shards of a corpus, both written out in the shared folder."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, counts: DataFrame | None = None) -> LineIndex:
        counts = materialize(line_counts(docs, min_chars)) if counts is None else counts
        frequent = counts.filter(F.col("n_docs") >= min_docs)
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        return cls(counts, materialize(build_filters(frequent, shards)), shards, min_docs, min_chars)

    def updated(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> LineIndex:
        """The index after documents came or went; the counts are those of a fresh index, the filters hold the same keys."""
        after = materialize(merge_counts(self.counts, added, deleted))
        was, now = (F.coalesce(F.col(c), F.lit(0)) >= self.min_docs for c in ("b.n_docs", "a.n_docs"))
        both = (F.col("b.k1") == F.col("a.k1")) & (F.col("b.k2") == F.col("a.k2"))
        changes = (
            self.counts.alias("b").join(after.alias("a"), both, "full").filter(was != now)
            .select(F.coalesce("a.k1", "b.k1").alias("k1"), F.coalesce("a.k2", "b.k2").alias("k2"), now.alias("come"))
        )
        return LineIndex(after, materialize(change_filters(self.filters, changes, self.shards)), self.shards, self.min_docs, self.min_chars)


class _Shard:
    """Which of some keys are in a shard: its filter first, its sorted keys behind it; both are views of the row's bytes."""

    def __init__(self, table: bytes, keys: bytes):
        self.filter = CuckooFilter(table=np.frombuffer(table, np.uint16).reshape(-1, CuckooFilter.SLOTS))
        self.keys = np.frombuffer(keys, np.int64).reshape(-1, 2)

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        found = self.filter.contains(k2.view(np.uint64))
        maybe = np.flatnonzero(found)
        at, end = (np.searchsorted(self.keys[:, 0], k2[maybe], side) for side in ("left", "right"))
        same = np.zeros(len(maybe), bool)
        while (open_ := at < end).any():  # one round, but for different keys of equal k2
            same[open_] |= self.keys[at[open_], 1] == k1[maybe[open_]]
            at = at + 1
        found[maybe] = same
        return found


class _Lookup:
    """Which of some keys are frequent, over all shards."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int):
        self.shards, self.held = shards, {shard: _Shard(table, keys) for shard, table, keys in rows}

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        found, shard = np.zeros(len(k1), bool), (k1 >> 7) % self.shards
        for s in np.unique(shard):
            if s in self.held:
                at = np.flatnonzero(shard == s)
                found[at] = self.held[s](k1[at], k2[at])
        return found


def _rebuilt(raw: bytes, lines: list[bytes], gone: set[int]) -> str:
    kept = raw if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone)
    return kept.decode("utf-8", "surrogatepass")


def _out_schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def drop_frequent_lines(docs: DataFrame, index: LineIndex | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shipped_keys: int = SHIPPED_KEYS) -> DataFrame:
    """docs without the lines whose key is in at least ``min_docs`` documents, with n_lines and n_dropped.

    index: counts and filters to go by, with their own limits; by default those of docs.
    """
    docs = small_batches(without(docs, "n_lines", "n_dropped"))
    index = LineIndex.of(docs, min_docs, min_chars) if index is None else index
    min_chars, shards = index.min_chars, index.shards
    if (index.filters.agg(F.sum("n_keys")).first()[0] or 0) > shipped_keys:
        return _drop_by_shard(docs, index)
    rows = [(r["shard"], bytes(r["filter"]), bytes(r["keys"])) for r in index.filters.collect()]
    sent, at = docs.sparkSession.sparkContext.broadcast(rows), docs.columns.index("text")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(sent.value, shards)
        for batch in batches:
            texts, split, where, keys = batch.column(at).to_pylist(), [], [], []
            for i, text in enumerate(texts):
                raw = (text or "").encode("utf-8", "surrogatepass")
                split.append((raw, lines := raw.split(b"\n")))
                for j, line in enumerate(lines):
                    if (key := line_key(line, min_chars)) is not None:
                        where.append((i, j))
                        keys.append(halves(key))
            gone: dict[int, set[int]] = {}
            if keys:
                both = np.array(keys, np.int64)
                for x in np.flatnonzero(lookup(both[:, 0].copy(), both[:, 1].copy())):
                    gone.setdefault(where[x][0], set()).add(where[x][1])
            new = [None if text is None else _rebuilt(*split[i], gone.get(i, set())) for i, text in enumerate(texts)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            counted = [pa.array([len(s[1]) for s in split], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(split))], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *counted], [*batch.schema.names, "n_lines", "n_dropped"])

    return docs.mapInArrow(drop, _out_schema(docs))


def _drop_by_shard(docs: DataFrame, index: LineIndex) -> DataFrame:
    """The same for any number of frequent keys: rows are numbered, lines go to their shard, and drop lists are joined back."""
    row, gone_lines = spare(docs.columns, "row", "gone")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    min_chars = index.min_chars

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for j, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        out.append((row, j, *halves(key)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["row", "line", "k1", "k2"])

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, a shard's filter in front of its lines."""
        shard = None
        for batch in batches:
            first = batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
            bounds = [0, *np.flatnonzero(first).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if first[a]:
                    shard, part = _Shard(part.column("filter")[0].as_py(), part.column("keys")[0].as_py()), part.slice(1)
                k1, k2, row, line = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k1", "k2", "row", "line"))
                gone = shard(k1, k2) if len(k1) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(line[gone])], ["row", "line"])

    keyed = materialize(numbered.select(row, "text").mapInArrow(lines, "row long, line long, k1 long, k2 long").withColumn("shard", shard_of(F.col("k1"), index.shards)))
    parts = F.broadcast(  # a row of two numbers for each shard of SHARD_KEYS keys
        index.filters.select("shard").join(keyed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_LINES).cast("int").alias("parts")), "shard")
    )
    dealt = keyed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("row", "line"), "parts").cast("int").alias("part"), "row", "line", "k1", "k2", F.lit(None).cast("binary").alias("filter"), F.lit(None).cast("binary").alias("keys"))
    filters = index.filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.lit(None).cast("long").alias(c) for c in ("row", "line", "k1", "k2")], "filter", "keys")
    found = (
        filters.unionAll(dealt).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
        .select("row", "line", "k1", "k2", "filter", "keys").mapInArrow(held, "row long, line long")
    )
    gone = found.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(gone_lines))
    joined = numbered.join(gone, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], gone_lines)
    at = docs.columns.index("text")

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, n_lines, n_gone = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                split = raw.split(b"\n")
                new.append(None if text is None else _rebuilt(raw, split, set(gone or ())))
                n_lines.append(len(split))
                n_gone.append(len(gone or ()))
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(drop, _out_schema(docs))
