"""Incremental ingest as a stream of files: each batch's changed documents replace what is stored of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from collections.abc import Callable

from factloom.operators.extract import document_entities, facts_of
from factloom.operators.link import relate
from factloom.operators.store import Store, changed_documents, document_rows
from factloom.sources.pages import chunk_pages, split_pages


def process(blobs: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda found: found) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, facts and questions (with the document they are of) of blobs (doc, sha, blob)."""
    pages = split_pages(blobs)
    chunks = chunk_pages(pages)
    entities = document_entities(chunks)
    facts, questions = facts_of(chunks.join(entities, "doc"), keep=keep)
    questions = questions.withColumn("doc", F.col("evidence")[0]["doc"])
    return document_rows(pages, blobs.select("doc", "sha"), entities), facts.drop("text", "page_text", "chunk_ord", "modality_hints"), questions


def ingest_batch(store: Store, blobs: DataFrame, subject_match: str = "fuzzy") -> None:
    """Puts the changed documents in, and links anew if there were any."""
    fresh = blobs.join(changed_documents(blobs.select("doc", "sha"), store.read("documents")), ["doc", "sha"], "left_semi") if store.exists("documents") else blobs
    if fresh.isEmpty():
        return

    def keep(found: DataFrame) -> DataFrame:
        store.write("found", found)
        return store.read("found")

    store.ingest(*process(fresh, keep))
    numbered = lambda facts, documents, **how: relate(facts.withColumn("seq", F.struct("doc", "fact_id")), documents, **how)
    store.link(numbered, subject_match=subject_match)


def ingest_stream(spark: SparkSession, source: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Whole text files below `source`; runs until all are in. A batch that runs twice replaces its own facts and questions."""
    files = spark.readStream.format("text").option("wholetext", True).load(source)
    blobs = files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 16).alias("sha"), F.col("value").alias("blob"))
    return blobs.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
