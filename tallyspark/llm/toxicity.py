"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

Text is cut into windows of ``WINDOW`` words, one every ``STEP`` words.  Both dictionaries are made by
zstandard's dictionary training: the ordinary one from ordinary windows, the toxic one from what
is left of toxic documents when words are taken out that ordinary documents have about as
often (``CONTRAST``); training is repeated on what the dictionary doesn't hold yet.  A word counts as more frequent in toxic documents from ``ERRORS`` standard errors on.  The toxic
compressor has its dictionary in front of the ordinary one, so that both reach ordinary
content equally far back and lengths differ only where the toxic part is of use.  A window is
compressed behind a fixed carrier of ordinary text, without which zstandard stores short blocks raw.
The largest, the three largest and the mean difference of the two lengths over a document's
windows go through a logistic curve, which is fitted, like the odds of each difference, on the
half of the sample that no dictionary has seen.

The model is fitted on a bounded sample (``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled documents
with the smallest id hashes); scoring reads every whole text.  The labels are capped apart, so the
intercept is moved from the sample's share of label 1 to that of all labelled documents outside
the held-out quarter: a score means the same at every size.

Defined results: null, empty and blank texts have no windows and get the score of a document
without evidence; equal texts get equal scores, repeated rows each get their own row; very long texts
are scored whole, window by window; a null doc_id is never held out, nor learned from; without
labels of both kinds every score is the share of label 1 (0 if there are none).  Other columns
pass through; a column that is called ``score`` already is replaced.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

MAX_TOXIC, MAX_ORDINARY = 3000, 6000
#: A document is rejected from this score on.
THRESHOLD = 0.3
#: Words of a window, and from one window to the next.
WINDOW, STEP = 8, 4
#: A word goes to the toxic dictionary if toxic documents have it so many times as often as ordinary ones, by so many standard errors.
CONTRAST, ERRORS = 4.0, 1.5
#: zstandard's level; bytes of the dictionaries; training rounds of the toxic one; windows that train the ordinary one, and commonest words behind them.
LEVEL, ORDINARY_BYTES, TOXIC_BYTES, ROUNDS, ORDINARY_WINDOWS, COMMON_WORDS, CARRIER_BYTES = 8, 16384, 512, 6, 30_000, 4000, 96
#: Bytes of the segments that training chooses from, and of the strings it counts: a short word with its blanks.
SEGMENT, COUNTED = 16, 6


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    odds: dict[int, float] = field(default_factory=dict)
    weights: tuple[float, ...] = ()
    base: float = 0.0


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - STEP), STEP)] if words else []


class Distance:
    """Differences of windows' lengths under both dictionaries, and what documents get for them."""

    def __init__(self, model: Model):
        self.model, self.carrier = model, model.ordinary[-CARRIER_BYTES:]
        self.coders = []
        for content in (model.ordinary, model.toxic + model.ordinary):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def differences(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves, for each window."""
        (plain, toxic), carrier = self.coders, self.carrier
        return [len(plain(w)) - len(toxic(w)) for w in (carrier + window for window in windows_of(words_of(text)))]

    def features(self, found: list[int]) -> tuple[float, ...]:
        odds = self.model.odds
        best = sorted((odds.get(d, 0.0) for d in set(found)), reverse=True)[:1]
        most = sorted(found)[-3:]
        return (best[0] if best else 0.0), sum(max(0, d) for d in most), (100 * sum(found) / (len(found) + 10)), math.log1p(len(found))

    def score(self, text: str | None) -> float:
        w = self.model.weights
        margin = w[0] + sum(a * b for a, b in zip(w[1:], self.features(self.differences(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def trained(samples: list[bytes], size: int, **parameters: int) -> bytes:
    """The content of a dictionary trained on the samples; their last bytes if there are too few for zstandard."""
    try:
        whole = zstandard.train_dictionary(size, samples, **parameters).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
    # the format ends its tables with three recent offsets, which training sets to 1, 4 and 8
    start = whole.find(struct.pack("<3I", 1, 4, 8))
    return whole[start + 12 :] if start >= 0 else whole


def toxic_content(samples: list[bytes]) -> bytes:
    """Dictionary content trained on the samples, then on those it doesn't hold yet, and so on."""
    content, left = b"", samples
    for _ in range(ROUNDS):
        if len(left) < max(8, 0.02 * len(samples)):
            break
        content += trained([x for x in left for _ in range(4)], TOXIC_BYTES, k=SEGMENT, d=COUNTED)
        left = [x for x in left if x not in content and x[:-1] not in content and x[1:] not in content]
    # training cuts segments of one length: samples that none holds whole stand in front as they are, the commonest nearest
    rest = sorted(Counter(left).items(), key=lambda x: (-x[1], x[0]))[: TOXIC_BYTES // SEGMENT]
    return b"".join(x for x, _ in reversed(rest)) + content


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) contents for the words of documents of both kinds."""
    counts = [Counter(w for words in side for w in set(words)) for side in (toxic, ordinary)]

    def telling(word: bytes) -> bool:
        n, m = counts[0][word] + 0.5, counts[1][word] + 0.5
        ratio = math.log(n / (len(toxic) + 1)) - math.log(m / (len(ordinary) + 1))
        return n > 2 and ratio - ERRORS * math.sqrt(1 / n + 1 / m) >= math.log(CONTRAST)

    chosen_words = {w for w in counts[0] if telling(w)}
    residue = [b" " + w + b" " for words in toxic for w in dict.fromkeys(words) if w in chosen_words]
    windows = [w for words in ordinary for w in windows_of(words)[::2]]
    chosen = np.random.Generator(np.random.PCG64(4)).permutation(len(windows))[:ORDINARY_WINDOWS]
    common = sorted(counts[1].items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]
    plain = trained([windows[i] for i in chosen], ORDINARY_BYTES) + b"".join(b" " + w + b" " for w, _ in reversed(common))
    return plain, toxic_content(residue)


def fit(rows: list[tuple[str | None, int]], shares: tuple[int, int] | None = None) -> Model:
    """Model of (text, label) rows; every second row of each label calibrates.

    shares: how many documents have label 0 and 1 where the rows are a sample by label; by default the rows' own numbers.
    """
    ones = sum(y for _, y in rows)
    everywhere = shares or (len(rows) - ones, ones)
    base = everywhere[1] / sum(everywhere) if sum(everywhere) else 0.0
    halves: list[list[tuple[str | None, int]]] = [[], []]
    seen: Counter[int] = Counter()
    for text, y in rows:
        halves[seen[y] % 2].append((text, y))
        seen[y] += 1
    if min(seen[0], seen[1]) < 4:
        return Model(base=base)
    model = Model(*dictionaries(*[[words_of(text) for text, y in halves[0] if y == label] for label in (1, 0)]), base=base)
    if not model.ordinary or not model.toxic:
        return Model(base=base)
    distance = Distance(model)
    held = [(distance.differences(text), y) for text, y in halves[1]]
    having, totals = (Counter(), Counter()), [0, 0]
    for found, label in held:
        having[label].update(set(found))
        totals[label] += 1
    for d in {*having[0], *having[1]}:
        model.odds[d] = max(0.0, math.log((having[1][d] + 0.5) / (totals[1] + 10)) - math.log((having[0][d] + 0.5) / (totals[0] + 10))) if d > 0 else 0.0
    x = np.array([[1.0, *distance.features(found)] for found, _ in held])
    y = np.array([label for _, label in held], float)
    w, prior = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior, x.T @ (p - y) + prior @ w)
    w[0] += math.log(everywhere[1] / everywhere[0]) - math.log(seen[1] / seen[0])
    model.weights = tuple(float(v) for v in w)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents outside the held-out quarter; at most MAX_TOXIC + MAX_ORDINARY texts reach the driver."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = F.xxhash64("doc_id")
    ids = known.filter("label = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).unionAll(known.filter("label = 0").orderBy(order, "doc_id").limit(MAX_ORDINARY))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(order, "doc_id", "text").limit(MAX_TOXIC + MAX_ORDINARY)
    totals = {r["label"]: r["n"] for r in docs.select("doc_id").join(known, "doc_id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    return fit([(r["text"], r["label"]) for r in sample.collect()], (totals.get(0, 0), totals.get(1, 0)))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score``, the probability of label 1."""
    docs = without(docs, "score")
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(sent.value) if sent.value.weights else None
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                texts = batch.column(at).to_pylist()
                scores = [distance.score(t) if distance else sent.value.base for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return small_batches(docs).mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
