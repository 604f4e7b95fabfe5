"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Texts with equal sets of word shingles are one class from the start, stood for by one row.
Signatures of ``HASHES`` MinHash values are cut into bands; texts that share a band meet in a
bucket.  Pairs of small buckets are compared value by value, ``STEP`` at a time, and dropped
as soon as the posterior probability of reaching the threshold falls below ``TOLERANCE``;
large buckets are kept whole at first.  What is left joins texts to candidate groups; in groups that may hold
a large bucket all pairs go through the same comparison of MinHash values, and what survives is verified exactly.  A large group
meets block by block (at most ``BLOCK`` texts a side); there a text is stood for by its signature and the
shingles in which it differs from the group's first text, few where texts are near copies:
sets that differ from a third one by d and e differ from each other by the symmetric difference of d and e.
From each block only numbers of links and a spanning forest go on, never a row per pair, so
a group of n near copies costs n * n / BLOCK small rows.  Groups and classes are found by
alternating star contractions, all joins of which Spark can split.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, unchanged.  Defined results: a text of
fewer words than a shingle has one shingle, all its words; texts without words are copies of
each other (null counts as empty) and linked to nothing else; equal rows are copies; a null
doc_id is a document like any other, but names a class only if no other id is in it; of equal similarities and
sizes nothing depends on order; very long texts are compared whole; no column but doc_id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, discard, gram_hashes, materialize, mix, small_batches, spare

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 5, 32, 1e-6
HASHES = BANDS * ROWS
#: Largest bucket whose pairs are listed; texts and shingles of one side of a block; texts of a task of small groups.
SMALL, BLOCK, BLOCK_SHINGLES, TASK = 32, 1024, 1_000_000, 1000

_RANDOM = np.random.Generator(np.random.PCG64(80))
_FACTORS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of word hashes."""
    return np.unique(gram_hashes(words, min(n, len(words)), 7 if len(words) >= n else 7 + len(words))) if len(words) else np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        low = np.minimum(low, (found[i : i + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return mix(low)


def posterior(matches: np.ndarray, compared: int, threshold: float, bits: int = 8) -> np.ndarray:
    """Probability that the similarity is at least ``threshold`` after so many equal values, prior uniform."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / (1 << bits)
    logs = matches[:, None] * np.log(p) + (compared - matches)[:, None] * np.log1p(-p)
    weight = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, smallest number of equal ones to go on with)."""
    out = []
    for compared in range(STEP, HASHES + 1, STEP):
        alive = posterior(np.arange(compared + 1), compared, threshold) >= tolerance
        out.append((compared, int(np.argmax(alive))))
    return out


def alive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows survive incremental comparison."""
    left, equal, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for compared, least in steps:
        equal[left] += (a[left, before:compared] == b[left, before:compared]).sum(axis=1)
        left, before = left[equal[left] >= least], compared
    kept = np.zeros(len(a), bool)
    kept[left] = True
    return kept


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch.column(1).to_pylist()):
            words, k1, k2, n, sigs, bands = Words(texts), [], [], [], [], []
            for i in range(len(words)):
                found = shingles(words.hashes[words.bounds[i] : words.bounds[i + 1]])
                k1.append(mix(found).sum(dtype=np.uint64))
                k2.append(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                n.append(len(found))
                full = signature(found)
                sigs.append((full & np.uint64(0xFF)).astype(np.uint8).tobytes())
                rolled = _BAND_SEEDS.copy()
                for r in range(ROWS):
                    rolled = mix(rolled * np.uint64(0x2545F4914F6CDD1D) + full[r::ROWS])
                bands.append(rolled.view(np.int64) if len(found) else np.zeros(0, np.int64))
            as_long = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (k1, k2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), *as_long, pa.array(n, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["rid", "k1", "k2", "n", "sig", "bands"],
            )


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs within each list of at most SMALL ids."""
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids in batch.column(0):
            own = np.sort(ids.values.to_numpy(zero_copy_only=False))
            i, j = np.triu_indices(len(own), 1)
            a.append(own[i])
            b.append(own[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _prune(threshold: float):
    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(threshold)
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            kept = pa.array(alive(a, b, steps))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return prune


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest id that each node of (a, b) edges can reach.

    Minima are written out before they are joined, so that Spark can split the edges of a hub.
    """
    current = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(current)
    while before[0]:
        # large star: neighbours above a node go to its smallest neighbour
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), release=False)
        large = materialize(both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), release=False)
        # small star: neighbours below a node, and itself, go to the smallest of them
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), release=False)
        small = large.join(least, "b")
        done, current = current, materialize(small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(small.select(F.col("m").alias("a"), "b")).filter("a < b").distinct(), release=False)
        for used in (done, low, large, least):
            discard(used)
        if (state := mark(current)) == before:
            break
        before = state
    return current.select(F.col("b").alias("node"), F.col("a").alias("label")).unionAll(current.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def overlaps(sets: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[term] > 1
    owner, term = owner[shared], rank[term[shared]]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    out, width, total = np.zeros((m, m)), max(1, cells // m), int(rank[-1]) + 1 if len(rank) else 0
    for first in range(0, total, width):
        a, b = np.searchsorted(term, [first, first + width])
        dense = np.zeros((m, min(width, total - first)), np.float32)
        dense[owner[a:b], term[a:b] - first] = 1
        out += dense @ dense.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have at least the Jaccard similarity ``threshold``."""
    sizes = np.array([len(s) for s in sets], float)
    both = overlaps(sets)
    found = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
    np.fill_diagonal(found, False)
    return found


def alive_pairs(sigs: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of rows survive incremental comparison of their signatures, as a matrix."""
    m = len(sigs)
    out = np.zeros((m, m), bool)
    for first in range(0, m, 256):
        part = np.arange(first, min(first + 256, m))
        left, right = (x.ravel() for x in np.meshgrid(part, np.arange(m), indexing="ij"))
        above = left < right
        left, right = left[above], right[above]
        equal, before = np.zeros(len(left), np.int16), 0
        for compared, least in steps:
            for column in range(before, compared):
                equal += sigs[left, column] == sigs[right, column]
            kept, before = equal >= least, compared
            left, right, equal = left[kept], right[kept], equal[kept]
            if 2 * len(left) > len(part) * m // 2:  # most pairs are near copies: verification is cheaper than the rest of the comparison
                break
        out[left, right] = out[right, left] = True
    return out


def linked_by_differences(sizes: np.ndarray, differences: list[np.ndarray], threshold: float) -> np.ndarray:
    """The same for sets given by their sizes and by how they differ from one common set."""
    apart = np.array([len(d) for d in differences], float)
    apart = apart[:, None] + apart - 2 * overlaps(differences)
    total = sizes[:, None] + sizes
    found = (total - apart) / 2 >= threshold * (total + apart) / 2 - 1e-9
    np.fill_diagonal(found, False)
    return found


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    new, out = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if new[root]:
            new[root], stack = False, [root]
            while stack:
                at = stack.pop()
                near = np.flatnonzero(adjacent[at] & new)
                new[near] = False
                out += [(at, int(x)) for x in near]
                stack += near.tolist()
    return out


def _verify(threshold: float):
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        kind, a, b, n = [], [], [], []
        steps = least_matches(threshold)
        for (_, i, j), group in rows.groupby(["label", "i", "j"], sort=False):
            if group["sig"].iloc[0] is not None:
                pairs = alive_pairs(np.stack([np.frombuffer(x, np.uint8) for x in group["sig"]]), steps)
                side = group["block"].to_numpy()
                if i != j:
                    pairs &= side[:, None] != side
                some = pairs.any(axis=1)
                group, pairs = group[some], pairs[np.ix_(some, some)]
                if not len(group):
                    continue
                found = pairs & linked_by_differences(group["size"].to_numpy(float), [np.asarray(s, np.int64) for s in group["shingles"]], threshold)
            else:
                found = linked([np.asarray(s, np.int64) for s in group["shingles"]], threshold)
            ids, copies = group["rid"].to_numpy(), group["copies"].to_numpy()
            links = np.array([copies[row].sum() for row in found])
            for x in np.flatnonzero(links):
                kind.append(0), a.append(ids[x]), b.append(0), n.append(links[x])
            for x, y in forest(found):
                kind.append(1), a.append(ids[x]), b.append(ids[y]), n.append(0)
        return pd.DataFrame({"kind": np.array(kind, np.int32), "a": np.array(a, np.int64), "b": np.array(b, np.int64), "n": np.array(n, np.int64)})

    return verify


def _with_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its number of shingles and their hashes in ascending order; a column ``lead`` of such hashes by what the text has and lead hasn't, or the other way round."""
    for batch in batches:
        leads = batch.column("lead") if "lead" in batch.schema.names else None
        kept = [i for i, name in enumerate(batch.schema.names[:-1]) if name != "lead"]
        for first, texts in chunks(batch.column(batch.num_columns - 1).to_pylist()):
            words = Words(texts)
            found = [np.sort(shingles(words.hashes[words.bounds[i] : words.bounds[i + 1]]).view(np.int64)) for i in range(len(words))]
            sizes = [len(x) for x in found]
            if leads is not None:
                found = [np.setxor1d(x, leads[first + i].values.to_numpy(zero_copy_only=False), assume_unique=True) for i, x in enumerate(found)]
            columns = [batch.column(i).slice(first, len(texts)) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], [*[batch.schema.names[i] for i in kept], "size", "shingles"])


def numbered(docs: DataFrame, rid: str = "rid") -> DataFrame:
    """docs with ``rid``, different in every row: the doc_id where that is so already."""
    found = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    if found["n"] == found["known"] and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn(rid, F.col("doc_id").cast("long"))
    return materialize(docs.withColumn(rid, F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, rid, class_id (the smallest doc_id of its class) and n_links (documents of at least that similarity to it)."""
    base = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return _near_duplicates(base, threshold)


def _near_duplicates(base: DataFrame, threshold: float) -> DataFrame:
    sigs = materialize(small_batches(base).select("rid", "text").mapInArrow(_signatures, "rid long, k1 long, k2 long, n int, sig binary, bands array<long>"))
    equal = materialize(sigs.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")))
    members = sigs.select("rid", "k1", "k2").join(equal, ["k1", "k2"]).select("rid", "rep", "copies")
    reps = equal.select(F.col("rep").alias("rid"), "copies")
    stand = sigs.join(reps.select("rid"), "rid", "left_semi").filter("n > 0")

    places = stand.select("rid", F.explode("bands").alias("h"))
    buckets = materialize(places.groupBy("h").agg(F.count("*").alias("size"), F.min("rid").alias("lead")).filter("size > 1"))
    met = places.join(buckets, "h")
    listed = met.filter(F.col("size") <= SMALL).groupBy("h").agg(F.collect_list("rid").alias("ids")).select("ids").mapInArrow(_pairs, "a long, b long").distinct()
    left, right = (stand.select(F.col("rid").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b"))
    survivors = listed.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(threshold), "a long, b long")
    stars = met.filter((F.col("size") > SMALL) & (F.col("rid") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("rid").alias("b"))
    groups = materialize(connected(survivors.unionAll(stars)))

    sized = groups.join(stand.select("rid", "n"), groups["node"] == F.col("rid")).groupBy("label").agg(F.count("*").alias("texts"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("texts") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = (
        groups.join(sized.select("label", "texts", blocks.alias("blocks")), "label").join(reps, groups["node"] == reps["rid"])
        .select("rid", "label", "copies", "texts", "blocks", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"))
    )
    dealt = materialize(dealt)
    tasks = max(1, -(-dealt.filter("blocks = 1").count() // TASK))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(tasks))).otherwise(F.xxhash64("label", "i", "j").bitwiseOR(F.lit(1 << 40)))
    texts, members_of = base.select("rid", "text"), "rid long, label long, copies long, blocks int, block int"
    whole = (
        dealt.filter(F.col("texts") <= SMALL).join(texts, "rid").select("rid", "label", "copies", "blocks", "block", "text")
        .mapInArrow(_with_shingles, f"{members_of}, size long, shingles array<long>").withColumn("sig", F.lit(None).cast("binary"))
    )
    # only groups of more than SMALL texts can hold a bucket whose pairs weren't compared; each block of one gets the shingles of the group's first text, so no join key has more rows than a block
    compared = dealt.filter(F.col("texts") > SMALL)
    leads = (
        compared.filter("rid = label").join(texts, "rid").select("label", "blocks", "text")
        .mapInArrow(_with_shingles, "label long, blocks int, size long, shingles array<long>")
        .select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("shingles").alias("lead"))
    )
    large = (
        compared.join(texts, "rid").join(stand.select("rid", "sig"), "rid").join(leads, ["label", "block"])
        .select("rid", "label", "copies", "blocks", "block", "sig", "lead", "text")
        .mapInArrow(_with_shingles, f"{members_of}, sig binary, size long, shingles array<long>")
    )
    sets = (
        whole.unionByName(large).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .withColumn("task", task).select("task", "rid", "label", "copies", "block", "i", "j", "size", "sig", "shingles")
    )
    checked = materialize(sets.groupBy("task").applyInPandas(_verify(threshold), "kind int, a long, b long, n long"))

    counts = checked.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = connected(checked.filter("kind = 1").select("a", "b")).select(F.col("node").alias("rep"), "label")
    ids = base.select("rid", "doc_id").join(members, "rid").join(classes, "rep", "left").join(counts, "rep", "left")
    ids = ids.select("doc_id", "rid", F.coalesce("label", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    ids = materialize(ids)
    named = materialize(ids.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("kept")))
    for used in (sigs, equal, buckets, groups, dealt, checked):
        discard(used)
    return ids.join(named, "class").select("doc_id", "rid", "class_id", "n_links", (F.col("rid") == F.col("kept")).alias("is_kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row with the smallest doc_id of each class (of equal ids the first one), with docs' columns."""
    (rid,) = spare(docs.columns, "rid")
    rows = numbered(docs, rid)
    found = _near_duplicates(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(rid).alias("rid")), threshold)
    return rows.join(found.filter("is_kept").select(F.col("rid").alias(rid)), rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
