"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are length, depth, digit ratio, entropy, hyphens, labels and parameter counts of the
url, and statistics of its last host label: its share of all urls and how many labelled urls of
either kind end in it.  The trees are fitted on a bounded sample of labelled urls
(``MAX_LABELLED`` different urls with the smallest hashes).  Urls are scored where their rows lie; the
shares, of which there are at most 1 / ``LEAST_SHARE``, are broadcast.

Labels come from a table of (url, label) rows.  Without one, urls whose host has one of the words
``JUNK`` are the positive examples; this stands in for a table that the test data lack.

Defined results: a null url and one without ``://`` have an empty host and path, fit no rule
and get the trees' verdict for empty features; equal urls get equal verdicts, repeated rows each their own; very long
urls are read whole; of rules of equal length that fit the later one counts; a url with
both labels has label 1; without labels of both kinds everything is allowed.  Other columns
pass through, but for columns called host, path, rule, junk_score and verdict, which are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, spare, without

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Host words that label a url as junk for training; no feature sees words.
JUNK = ["spam", "pills", "casino", "bets", "adult", "ads-track"]
MAX_LABELLED, ROUNDS, DEPTH, BINS, RATE = 20_000, 60, 3, 32, 0.2
#: A host label of a smaller share of all urls counts as one of no share.
LEAST_SHARE = 1e-5
FEATURES = ["length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "host_entropy", "hyphens", "labels", "parameters", "fragment", "longest_label", "suffix_share", "suffix_ones", "suffix_zeros"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def suffix_of(host: str) -> str:
    return host.rpartition(".")[2]


def lexical(url: str | None, host: str, path: str, share: float, ones: int, zeros: int) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    labels = host.split(".") if host else []
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), entropy(url), entropy(host),
        host.count("-"), len(labels), len([p for p in query.split("&") if p]), float("#" in url), max(map(len, labels), default=0), share, ones, zeros,
    ]


class BoostedTrees:
    """Binary log-loss boosting of histogram trees."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[:-1])) for j in range(x.shape[1])]
        bins, p = self.binned(x), np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, bins)
        return self

    def _grow(self, bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.zeros(len(bins), int)
        for at in range(size):
            here = np.flatnonzero(node == at)
            if not len(here):
                continue
            g, h = gradient[here], hessian[here]
            value[at] = -RATE * g.sum() / (h.sum() + 1)
            if at >= 2**DEPTH - 1:
                continue
            best = 1e-6
            for j in range(bins.shape[1]):
                left_g = np.cumsum(np.bincount(bins[here, j], g, BINS + 1))[:-1]
                left_h = np.cumsum(np.bincount(bins[here, j], h, BINS + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(left_h < 1) | (h.sum() - left_h < 1)] = 0
                if gain.max() > best:
                    best, feature[at], cut[at] = gain.max(), j, int(gain.argmax())
            if feature[at] >= 0:
                node[here] = 2 * at + 1 + (bins[here, feature[at]] > cut[at])
        return feature, cut, value

    def _walk(self, tree, bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(bins), int)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (bins[np.arange(len(bins)), f] > cut[node]))
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        bins = self.binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, bins) for t in self.trees))))


def with_suffix_share(pages: DataFrame, host: str, path: str, share: str) -> DataFrame:
    """pages with columns for host, path, and the share of urls that end in the same host label."""
    suffix, n = spare([*pages.columns, host, path, share], "suffix", "n")
    found_host, found_path = host_and_path(F.col("url"))
    parts = pages.withColumns({host: found_host, path: found_path}).withColumn(suffix, F.substring_index(host, ".", -1))
    counts = materialize(parts.groupBy(suffix).agg(F.count("*").alias(n)))
    total = counts.agg(F.sum(n)).first()[0] or 1
    shares = counts.filter(F.col(n) >= LEAST_SHARE * total).select(suffix, (F.col(n) / total).alias(share))
    return parts.join(F.broadcast(shares), suffix, "left").withColumn(share, F.coalesce(share, F.lit(0.0))).drop(suffix)


def junk_label(host: Column) -> Column:
    return F.when(F.greatest(*[F.instr(host, word) for word in JUNK]) > 0, 1).otherwise(0)


class Model:
    """Trees, and how many labelled urls of either kind end in a host label."""

    def __init__(self, rows: list[tuple[str, str, str, float, int]] = ()):
        self.trees, self.ones, self.zeros = BoostedTrees(), Counter(), Counter()
        y = np.array([r[4] for r in rows], float)
        if len(y) and y.min() < y.max():
            for _, host, _, _, label in rows:
                (self.ones if label else self.zeros)[suffix_of(host)] += 1
            # a url's own label isn't among the counts it is trained with
            x = [lexical(u, h, p, s, self.ones[suffix_of(h)] - label, self.zeros[suffix_of(h)] - 1 + label) for u, h, p, s, label in rows]
            self.trees.fit(np.array(x, float), y)

    def predict(self, rows: Iterable[tuple[str | None, str, str, float]]) -> np.ndarray:
        x = [lexical(u, h, p, s, self.ones[suffix_of(h)], self.zeros[suffix_of(h)]) for u, h, p, s in rows]
        return self.trees.predict(np.array(x, float).reshape(-1, len(FEATURES)))


def train(labelled: DataFrame) -> Model:
    """Model of rows (url, host, path, share, label): label is 1, 0 or null (not used)."""
    known = labelled.filter("url is not null and label is not null")
    rows = known.groupBy("url", "host", "path").agg(F.max("share").alias("share"), F.max("label").alias("label")).orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED).collect()
    return Model([(r["url"], r["host"], r["path"], r["share"], int(r["label"])) for r in rows])


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, junk_score and verdict.

    labelled: (url, label) rows that train the trees, whether or not pages has these urls.
    """
    added = [("host", T.StringType()), ("path", T.StringType()), ("rule", T.StringType()), ("junk_score", T.DoubleType()), ("verdict", T.StringType())]
    pages = without(pages, *dict(added))
    host, path, share, rule, ruled = spare(pages.columns, "host", "path", "share", "rule", "ruled")
    parts = with_suffix_share(pages, host, path, share)
    named = [F.col(host).alias("host"), F.col(path).alias("path"), F.col(share).alias("share")]
    if labelled is None:
        examples = parts.select("url", *named, junk_label(F.col(host)).alias("label"))
    else:
        marks = labelled.filter("url is not null").groupBy("url").agg(F.max("label").alias("label"))
        suffixes = parts.groupBy(F.substring_index(host, ".", -1).alias("suffix")).agg(F.max(share).alias("share")).filter("share > 0")
        found_host, found_path = host_and_path(F.col("url"))
        apart = marks.select("url", found_host.alias("host"), found_path.alias("path"), "label")
        examples = apart.join(F.broadcast(suffixes), F.substring_index("host", ".", -1) == F.col("suffix"), "left").select("url", "host", "path", F.coalesce("share", F.lit(0.0)).alias("share"), "label")
    sent = pages.sparkSession.sparkContext.broadcast(train(examples))
    found, verdict = apply_rules(F.col(host), F.col(path), rules)
    marked = parts.withColumns({rule: found, ruled: verdict})
    kept = pages.schema.fields

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[f.name for f in kept]].copy()
            out["host"], out["path"], out["rule"] = batch[host], batch[path], batch[rule]
            out["junk_score"] = sent.value.predict(zip(batch["url"], batch[host], batch[path], batch[share]))
            out["verdict"] = batch[ruled].where(batch[ruled].notna(), np.where(out["junk_score"] >= 0.5, "block", "allow"))
            yield out

    return marked.mapInPandas(score, T.StructType([*kept, *[T.StructField(n, t) for n, t in added]]))
