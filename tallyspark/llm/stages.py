"""The stages of the corpus pipeline, each around one operator with its production parameters.

Every stage works on all rows of the one before; all but the last return exactly the columns they
got, whatever their names, with n_chars, if there is one, brought up to the text that is left.

Defined results: null and empty texts, very long texts, ties and repeated rows are what the
operator of the stage says they are; rows with a null doc_id go through every stage; an empty
table gives an empty table; a column that is called like one of an operator's results is the
caller's own and comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

#: Score from which the pipeline rejects a document; higher than the classifier's own threshold to spare clean documents.
REJECT = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject; a text that is null or blank stays unless most labelled documents are toxic."""
    from .toxicity import score_texts, train

    named, restored = set_aside(docs, "score")
    return restored(score_texts(named, train(named, table(spark, sf_dir, "labels"))).filter(F.col("score") < REJECT))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are in many of them; a null text stays null, one that loses all lines becomes empty."""
    from .lines import drop_frequent_lines

    named, restored = set_aside(docs, "n_lines", "n_dropped")
    return _counted(restored(drop_frequent_lines(named)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies, that with the smallest id; all texts without words are one class."""
    from .jaccard import keep_one

    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; a text that loses nothing stays as it is."""
    from .substring import drop_repeats

    named, restored = set_aside(docs, "n_words", "n_removed", "repeats")
    return _counted(restored(drop_repeats(named)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, bin_id, place; a null or empty text is one piece of length 0."""
    from .packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("packing", packing)]
