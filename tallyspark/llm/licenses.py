"""License scans: sparse TF-IDF cosine of lines and licence files to templates, then inheritance from the nearest directory.

Terms are words without stop words.  A word weighs by the share of all files that have it, in
templates and files alike, so that equal mixes of files give equal cosines however many
they are.  A file's own license is that of its best line (a header) if the cosine reaches
``HEADER``.  A licence file licenses its directory: one that is named so (``NAMES``) by its own
license, or else by the template nearest to its whole text if that cosine reaches ``NAMED``; any
other file only if its whole text is nearly all template, that is if the cosine reaches
``WHOLE``.  A file without an own license takes that of the nearest directory above it that has one.
Only DataFrame functions are used.

No line reaches a cosine that its words of the templates can't give it even if all its other
words had the least weight, 1; this bound, known within a row, leaves the lines whose words are counted.

Defined results: one row for each row of files, repeated rows and rows without doc_id included, each
judged by itself; null and empty texts have no own license; very long texts and lines are read whole; equal lines
give equal cosines; ties go to the license that sorts first, in directories to the smallest id (a null
id comes last), then to the license that sorts first; a null path has no directory and inherits
nothing; an empty table gives no rows.  Other columns are not returned.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, discard, materialize

# Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
}
STOP = ["a", "an", "and", "any", "are", "be", "by", "except", "for", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "under", "with", "you", "can", "use", "work"]
HEADER, NAMED, WHOLE = 0.6, 0.2, 0.6
#: Names of licence files, without regard to case.
NAMES = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice|copyright)[^/]*$"
#: Share of files added to that of every word, so that words of no file have a weight too: the smoothing by one file of a thousand.
RARE = 0.001
_SPLIT = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w and w not in STOP]


def template_rows() -> list[tuple[str, int, str, int]]:
    """(license, template, term, count)."""
    out = []
    for name, texts in TEMPLATES.items():
        for number, text in enumerate(texts):
            found = words(text)
            out += [(name, number, w, found.count(w)) for w in sorted(set(found))]
    return out


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: (w != "") & ~w.isin(STOP))


def idf(n_docs: Column, df: Column) -> Column:
    """Weight of a word by the share of files that have it: the number of files by itself changes nothing."""
    return F.log((1 + RARE) / (df / n_docs + RARE)) + 1


def document_frequencies(files: DataFrame) -> tuple[DataFrame, int]:
    """(term, df): in how many rows each word, given by its hash, is; and the number of rows (1 at least)."""
    seen = files.select(F.explode(F.array_distinct(F.split(F.lower("text"), _SPLIT))).alias("word")).select(F.xxhash64("word").alias("term"))
    return materialize(seen.groupBy("term").agg(F.count("*").alias("df"))), max(1, files.count())


class Weights:
    """Weights of the templates' words in a corpus: ``idf`` by word, ``unit[i]`` by word for the template ``names[i]``."""

    def __init__(self, frequency: DataFrame, n_docs: int):
        rows = template_rows()
        self.names = sorted({(r[0], r[1]) for r in rows})
        vocabulary = frequency.sparkSession.createDataFrame([(w,) for w in sorted({r[2] for r in rows})], "word string")
        known = vocabulary.join(frequency, F.xxhash64("word") == F.col("term"), "left").select("word", idf(F.lit(n_docs), F.coalesce("df", F.lit(0))).alias("idf"))
        self.idf = {r["word"]: r["idf"] for r in known.collect()}
        self.unit = []
        for name in self.names:
            own = {w: n * self.idf[w] for license, number, w, n in rows if (license, number) == name}
            norm = math.sqrt(sum(x * x for x in own.values()))
            self.unit.append({w: x / norm for w, x in own.items()})

    def most(self, terms: Column) -> Column:
        """Upper bound of the cosine of a list of terms to any template."""

        def table(values: dict[str, float]) -> Column:
            return F.create_map(*[F.lit(x) for item in sorted(values.items()) for x in item])

        def total(of: Column, values: dict[str, float]) -> Column:
            weights = table(values)
            return F.aggregate(of, F.lit(0.0), lambda sum_, w: sum_ + F.coalesce(F.try_element_at(weights, w), F.lit(0.0)))

        def bounded(own: Column) -> Column:
            dots = [total(own, {w: x * self.idf[w] for w, x in unit.items()}) for unit in self.unit]
            least = total(own, {w: x * x for w, x in self.idf.items()}) + F.size(terms) - F.size(own)
            return F.when(F.size(own) == 0, 0.0).otherwise(F.greatest(*dots) / F.sqrt(least))

        return bound(F.filter(terms, lambda w: w.isin(sorted(self.idf))), bounded)


def candidates(files: DataFrame, weights: Weights) -> DataFrame:
    """(rid, doc_id, path, parts): rows with a number each, and the lines (kind 'header') and whole texts ('whole') that may reach their limit."""
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    found = F.transform(F.split("text", "\n"), lambda line: terms_of(line))
    headers = F.filter(found, lambda terms: weights.most(terms) >= HEADER - 1e-6)
    whole = F.array(bound(terms_of(F.col("text")), lambda terms: F.when(weights.most(terms) >= F.when(named, NAMED).otherwise(WHOLE) - 1e-6, terms)))
    parts = F.concat(
        F.transform(headers, lambda terms, i: F.struct(F.lit("header").alias("kind"), i.alias("line"), terms.alias("terms"))),
        F.transform(F.filter(whole, lambda terms: terms.isNotNull()), lambda terms, i: F.struct(F.lit("whole").alias("kind"), i.alias("line"), terms.alias("terms"))),
    )
    some = F.arrays_overlap(F.split(F.lower("text"), _SPLIT), F.array(*[F.lit(w) for w in sorted(weights.idf)]))
    none = F.array().cast("array<struct<kind: string, line: int, terms: array<string>>>")
    return materialize(files.select("doc_id", "path", F.when(some, parts).otherwise(none).alias("parts")).withColumn("rid", F.monotonically_increasing_id()))


def best_templates(rows: DataFrame, frequency: DataFrame, n_docs: int, weights: Weights) -> DataFrame:
    """(rid, kind, license, cosine): the nearest template of each row's best line and of its whole text, exact, if it reaches HEADER or NAMED."""
    spark: SparkSession = rows.sparkSession
    names = weights.names
    columns = ", ".join(f"u{i} double" for i in range(len(names)))
    sparse = F.broadcast(spark.createDataFrame([(w, x, *[unit.get(w, 0.0) for unit in weights.unit]) for w, x in sorted(weights.idf.items())], f"word string, own double, {columns}"))
    counted = (
        rows.select("rid", F.explode("parts").alias("part")).select("rid", "part.kind", "part.line", F.explode("part.terms").alias("word"))
        .groupBy("rid", "kind", "line", "word").agg(F.count("*").alias("tf")).join(sparse, "word", "left")
    )
    # words of the templates, the frequent ones here, bring their weight along; the others look it up
    counted = materialize(counted)
    others = counted.filter("own is null").join(frequency, F.xxhash64("word") == F.col("term"), "left").withColumn("own", idf(F.lit(n_docs), F.coalesce("df", F.lit(0)))).drop("term", "df")
    weighed = counted.filter("own is not null").unionByName(others).withColumn("w", F.col("tf") * F.col("own"))
    sums = [F.sum(F.col("w") * F.col("w")).alias("w_norm"), *[F.sum(F.col("w") * F.coalesce(f"u{i}", F.lit(0.0))).alias(f"w{i}") for i in range(len(names))]]
    lines = weighed.groupBy("rid", "kind", "line").agg(*sums).select("rid", "kind", _best("w", names).alias("best"))
    best = materialize(lines.groupBy("rid", "kind").agg(F.max("best").alias("best")))
    discard(counted)
    return best.select("rid", "kind", "best.license", "best.cosine").filter(F.col("cosine") >= F.when(F.col("kind") == "header", HEADER).otherwise(NAMED))


def _best(x: str, names: list[tuple[str, int]]) -> Column:
    """struct(cosine, order, license) of the template nearest to the sums of ``x``; ``order`` is larger for licenses that sort first; null without a shared term."""
    rank = {name: -i for i, name in enumerate(sorted(TEMPLATES))}
    norm = F.sqrt(F.col(f"{x}_norm"))
    found = [F.when(F.col(f"{x}{i}") > 0, F.struct(F.round(F.col(f"{x}{i}") / norm, 9).alias("cosine"), F.lit(rank[name]).alias("order"), F.lit(name).alias("license"))) for i, (name, _) in enumerate(names)]
    return F.greatest(*found)


def ancestors(path: Column) -> Column:
    """The directories above a path, '' for the root, nearest last; for '' itself only ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))


def scan(files: DataFrame) -> DataFrame:
    """One row per row of files: doc_id, path, own_license and cosine, license in force, and the directory it is inherited from."""
    files = files.select("doc_id", "path", "text")
    frequency, n_docs = document_frequencies(files)
    weights = Weights(frequency, n_docs)
    rows = candidates(files, weights)
    best = best_templates(rows, frequency, n_docs, weights)
    headers = best.filter("kind = 'header'").select("rid", F.col("license").alias("own_license"), "cosine")
    wholes = best.filter("kind = 'whole'").select("rid", F.col("license").alias("nearest"), F.col("cosine").alias("share"))
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    directory = F.element_at(ancestors(F.col("path")), -1).alias("directory")
    found = rows.select("rid", "doc_id", "path", directory).join(headers, "rid", "left").join(wholes, "rid", "left")
    licensing = F.when(named, F.coalesce("own_license", "nearest")).when(F.col("share") >= WHOLE, F.col("nearest"))
    own = materialize(found.select("doc_id", "path", "directory", "own_license", "cosine", licensing.alias("licensing")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "licensing")
    licensed = own.filter("licensing is not null and directory is not null").groupBy("directory").agg(F.min_by("licensing", order).alias("inherited"))
    # the nearest one is looked up once for each directory, not for each of its files
    wanted = own.filter("own_license is null and directory is not null").select("directory").distinct()
    near = (
        wanted.select("directory", F.posexplode(F.concat(ancestors(F.col("directory")), F.array("directory"))).alias("depth", "above"))
        .join(licensed.withColumnRenamed("directory", "above"), "above")
        .groupBy("directory").agg(F.max_by(F.struct("above", "inherited"), "depth").alias("near"))
    )
    discard(rows)
    discard(frequency)
    return (
        own.join(near, "directory", "left")
        .select(
            "doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.inherited").alias("license"),
            F.when(F.col("own_license").isNull(), F.col("near.above")).alias("inherited_from"),
        )
    )
