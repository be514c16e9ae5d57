"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them
to the table documents, with each result written to the shared folder before the next stage reads it, and removes what it
has written once that is read; only what the returned rows are read from stays. Stages work on all their predecessor kept,
and all but the last return the columns of documents.

1. language: documents without a language (no text, no letter, or letters unlike any learned language) go.
2. dedup: of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the document with the least
   doc_id stays. SimHash fingerprints and the trie self-join propose what differs in two bits or fewer; as copies of that
   similarity may differ in many more, a prefix filter finds the rest, and all are verified by their shingles.
3. decontaminate: documents that hold a window of a benchmark item go.
4. personal: spans of personal data become their kind in brackets; n_chars follows the text.
5. pack: the documents' tokens are packed into sequences of at most 1024; `ids` has a piece's token ids as little-endian
   unsigned 32-bit numbers.

Nulls, empty texts, ties, repeated rows and empty tables: as each operator's docstring says. Columns beyond those of
documents are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate as leaks
from factloom.llm import language_id, near_copies, packing, personal_data
from factloom.llm.common import made_here, removed, session, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    session(spark)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__body"))
    said = language_id.predict(rows, ["__row"], language_id.learned(docs), "__body")
    like = language_id.like_learned(F.col("score"), F.col("__row.text"), language_id.letters(language_id.training(docs)))
    return said.where((F.col("lang_pred") != language_id.UNKNOWN) & like).select("__row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.size("__spans") == 0).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = personal_data.masked(docs)
    if "n_chars" not in docs.columns:
        return hidden
    length = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return hidden.withColumn("n_chars", length)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ["doc_id"], packing.tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("dedup", dedup), ("decontaminate", decontaminate), ("personal", personal), ("pack", pack)]

#: Tokens, fingerprints and learned languages are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with made_here() as own:
            docs = written(stage(spark, docs, sf_dir), name)
        removed(spark, before + own[:-1])
        before = own[-1:]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, before)
    return packed
