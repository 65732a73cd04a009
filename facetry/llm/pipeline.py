"""The stages of the corpus pipeline; each works on all that the one before kept.

Every stage takes documents with any further columns, whatever their names, and all but the last return the same columns.
Null and empty texts have no language and go with the first stage; in the later ones they stay as they are. Repeated rows
are treated alike, and near-duplicate removal leaves one of those that share a doc_id. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, lines, packing, simhash
from .common import bounded, first_per_id, release, stash, stashed, table
from .queries import tokenizer_path

#: Near duplicates: 256-bit SimHash of distinct five-word shingles. Texts of Jaccard similarity 0.8 differ in 39 bits on average,
#: with a deviation of 6, and unlike texts in 128, with one of 8. So 80 bits keep every candidate; the exact similarity decides.
NEAR_BITS, NEAR_PERCENT = 80, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the others go, those without a letter among them.

    Documents pass through where they are read. Repeated rows go or stay together; an empty table teaches and keeps nothing.
    """
    found = language.identify(docs, language.learn(docs), keep=docs.columns)
    return found.where("not rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without blocks of lines that an earlier one has; n_chars follows the text.

    Rows that share a doc_id lose the same blocks and don't take any from each other; rows without doc_id or text stay as
    they are.
    """
    out = lines.without(docs, lines.removed_runs(docs, rare=None))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class linked by similarity.

    Null and empty texts are one class; rows that share a doc_id are one document and leave one row; documents without
    doc_id aren't judged and leave one row.
    """
    found = simhash.jaccard_classes(docs, width=5, words=4, max_distance=NEAR_BITS, percent=NEAR_PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return first_per_id(docs.join(bounded(stash(gone, "near-duplicates")), "doc_id", "left_anti").select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows that share a doc_id go or stay together; rows without doc_id stay."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(bounded(stash(found, "contaminated")), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in windows of 2048 ids; a null text is packed as an empty one, repeated rows each."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read by the next.

    What a stage stored on its way, and its own input, are deleted once its result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), stashed()
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        release(spark, before)
    return docs
