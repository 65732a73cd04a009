"""The numbered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, suffixes
from .common import table
from .language import held_out, identify, learn
from .licenses import scan_licenses
from .lines import dedup_lines
from .media import media_features, to_media
from .packing import pack
from .simhash import simhash_classes


def tokenizer_path() -> str:
    """The packing queries' vocabulary file; it lies outside the repository."""
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that it shares with an earlier one, however common the lines are."""
    return dedup_lines(table(spark, sf_dir, "documents"), rare=None)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents."""
    found = simhash_classes(table(spark, sf_dir, "documents"), width=4, words=1, max_distance=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's text, stored as Ogg and read back."""
    return media_features(to_media(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier."""
    found = suffixes.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, one row per piece."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.render(chat.maximal_conversations(table(spark, sf_dir, "conversations")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_licenses": op2_licenses,
        "op3_simhash": op3_simhash,
        "op4_ogg": op4_ogg,
        "op5_decontamination": op5_decontamination,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_packing": op7_packing,
        "op8_language_id": op8_language_id,
        "op9_chat": op9_chat,
        "op10_html": op10_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontam.SQL, "op6_suffix_dedup": suffixes.SQL, "op9_chat": chat.SQL}
