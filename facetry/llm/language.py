"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Rows sampled per language (as a mean), most words of a language's dictionary, and its most bytes: the model's size.
SAMPLE_ROWS, DICT_WORDS, DICT_BYTES = 400, 8000, 1 << 15
LEVEL = 6
#: A text is rejected if the second best size is within this share of the best.
MIN_MARGIN = 0.002
#: Bytes of a block. Every block follows LEAD bytes of the dictionary's own end, since zstandard stores a tiny frame raw;
#: each starts with the whole dictionary, so what that saves, and the margin, grows with the text.
BLOCK_BYTES, LEAD = 1 << 16, 400


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per language, from rows with text and lang that aren't held out: the words that two
    sampled rows or more hold, the most frequent last, where references to them are cheapest.

    Rows come by a hash of doc_id with a threshold per language, about ``sample_rows`` each; their whole texts are counted
    on the cluster, each word once a row. Only the dictionaries' words reach the driver, languages x DICT_WORDS at most.
    Rows without text, lang or doc_id teach nothing; repeated rows count each; an empty table gives no dictionary.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    due = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, int((1 << 40) * min(1.0, sample_rows / n)))))
    words = rows.where(draw < due[F.col("lang")]).select("lang", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")).where("word <> ''")
    often = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # words of two rows or more come first; a tiny sample has none
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.desc("word")))
    ranked: dict[str, list[tuple[int, str]]] = {}
    for r in often.select("lang", "word", "n", rank.alias("rank")).where(F.col("rank") <= DICT_WORDS).collect():
        ranked.setdefault(r["lang"], []).append((r["n"], r["word"]))
    kept = {k: sorted(x for x in ws if x[0] > 1) or sorted(ws) for k, ws in ranked.items()}
    return {k: " ".join(w for _, w in ws).encode()[-dict_bytes:].rjust(8) for k, ws in kept.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row; with the columns ``keep`` of docs in place of doc_id if given.

    A null text, one without a letter, or no learned language: ``und``, score 0, rejected. Ties go to the first
    language by name and are rejected. score is the logistic of the bytes saved over the second best language.
    All of a text is compressed, whatever its length, in blocks of BLOCK_BYTES; only ``text`` enters a prediction.
    Repeated rows each get a row; columns besides doc_id, text and ``keep`` are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, leads = [], {k: d[-LEAD:] + b" " for k, d in dictionaries.items()}
        for k in names:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for b in batches:
            lang, score, rejected = [], [], []
            for t in b.column(at):
                text = t.as_py()
                if not names or text is None or not any(map(str.isalpha, text)):
                    lang.append("und"), score.append(0.0), rejected.append(True)
                    continue
                data = text.lower().encode()
                parts = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                sizes = sorted((sum(len(c.compress(leads[k] + x)) for x in parts), k) for c, k in zip(coders, names))
                best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else math.inf
                lang.append(sizes[0][1])
                score.append(1 / (1 + math.exp(-min(second - best, 700))))
                rejected.append(second - best <= min_margin * best)
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *made], names=[f.name for f in schema])

    rows = docs.select(*keep) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = rows.columns.index("text")
    kept = range(len(rows.columns)) if keep else [0]
    schema = T.StructType([rows.schema[k] for k in kept]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, schema)
