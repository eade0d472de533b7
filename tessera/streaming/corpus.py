"""A corpus that follows a stream of changed documents: each micro-batch makes the next version of its chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.chunking import chunk_documents
from ..operators.incremental import update_vectors
from ..sources.corpus import commits, read_corpus, write_corpus
from ..sources.shared import written


def latest(changes: DataFrame) -> DataFrame:
    """Of changes(path, seq, removed, page, text) those of the last seq of each path; a change brings all pages of its path."""
    last = F.max("seq").over(Window.partitionBy("path"))
    return changes.withColumn("_last", last).where(F.col("seq") == F.col("_last")).drop("_last", "seq")


def apply_changes(changes: DataFrame, store: str, version: int, encoder: Callable[[DataFrame], DataFrame], chunker: Callable[[DataFrame], DataFrame] = chunk_documents) -> None:
    """Writes a version of store/chunks and store/vectors: the version before it with the changed paths chunked and encoded anew.

    It depends on the version before and on the changes alone, so applying them again writes the same again."""
    spark = changes.sparkSession
    now = written(latest(changes))
    pages = now.where("not removed").drop("removed")
    touched = now.select("path").distinct()
    fresh = chunker(pages)
    if version - 1 in commits(spark, f"{store}/vectors"):
        old = read_corpus(spark, f"{store}/chunks", version - 1)
        gone = old.join(touched, "path", "left_semi").select("id")
        write_corpus(old.join(touched, "path", "left_anti").unionByName(fresh), f"{store}/chunks", version)
        vectors = read_corpus(spark, f"{store}/vectors", version - 1).select("chunk_id", "embedding")
    elif version > 0:
        raise FileNotFoundError(f"{store} lacks version {version - 1}")
    else:
        write_corpus(fresh, f"{store}/chunks", version)
        gone, vectors = fresh.select("id").where("false"), None
    chunks = read_corpus(spark, f"{store}/chunks", version)
    vectors = encoder(chunks.select("id", "text")).where("false").select("chunk_id", "embedding") if vectors is None else vectors
    write_corpus(update_vectors(chunks, vectors, touched, gone, encoder), f"{store}/vectors", version)


def follow(changes: DataFrame, store: str, checkpoint: str, encoder: Callable[[DataFrame], DataFrame], chunker: Callable[[DataFrame], DataFrame] = chunk_documents) -> StreamingQuery:
    """Applies what a stream of changes holds now, batch by batch, and ends. Batch b makes version b, however often it is run."""
    def batch(df: DataFrame, number: int) -> None:
        apply_changes(df, store, number, encoder, chunker)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """(chunk_id, embedding, reused) of the newest version whose vectors are whole."""
    return read_corpus(spark, f"{store}/vectors", max(commits(spark, f"{store}/vectors"), default=-1))
