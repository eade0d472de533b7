"""Incremental corpus maintenance: chunks, vectors, revision state, corpus status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents


def update_chunks(old: DataFrame | None, pages: DataFrame, changed: DataFrame, removed: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, removed ids, new ids): old chunks of untouched paths and fresh chunks of changed ones."""
    if old is None or force:
        fresh = chunk_documents(pages)
        return fresh, fresh.select("id").where("false"), fresh.select("id")
    touched = changed.select("path").union(removed.select("path")).distinct()
    fresh = chunk_documents(pages.join(changed.select("path").distinct(), "path", "left_semi"))
    gone = old.join(touched, "path", "left_semi").select("id")
    return old.join(touched, "path", "left_anti").unionByName(fresh), gone, fresh.select("id")


def encode(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """(chunk_id, embedding) of rows(id, text) by any encoder of text batches, L2-normalised."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                v = np.asarray(encoder(part.text.tolist()), np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"chunk_id": part.id.to_numpy(), "embedding": list(v)})
    return rows.select("id", "text").mapInPandas(work, "chunk_id string, embedding array<float>")


def char_sum_vector(c: Column) -> Column:
    """A deterministic four-number embedding from the sum of code points, as plain Columns."""
    seed = F.aggregate(F.transform(F.split(c, ""), lambda x: F.when(x != "", F.ascii(x)).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    raw = F.transform(F.array(seed), lambda s: F.array(s % 97 + 1, s % 89 + 2, s % 83 + 3, s % 79 + 4))
    return F.get(F.transform(raw, lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))), F.lit(0))


def update_vectors(chunks: DataFrame, old: DataFrame, changed: DataFrame, removed_ids: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(chunk_id, embedding, reused): old vectors of unchanged paths that were not removed, the rest encoded anew."""
    keep = chunks.select("id", "path", "text").join(changed.select("path").distinct().withColumn("_c", F.lit(True)), "path", "left").join(removed_ids.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    keep = keep.join(old.select(F.col("chunk_id").alias("id"), "embedding"), "id", "left").withColumn("reused", F.col("_c").isNull() & F.col("_r").isNull() & F.col("embedding").isNotNull())
    fresh = encoder(keep.where("not reused").select("id", "text")).withColumn("reused", F.lit(False))
    return keep.where("reused").select(F.col("id").alias("chunk_id"), "embedding", "reused").unionByName(fresh.select("chunk_id", "embedding", "reused"))


def kb_state(events: DataFrame) -> DataFrame:
    """events(library_id, ts, seq, type) folded to revisions: library changes raise the revision, and text, chunks and
    embeddings follow each other up to it. Running sums and last values over the events of a library in the order of (ts, seq): a log is
    sorted and streamed, never gathered."""
    past = Window.partitionBy("library_id").orderBy("ts", "seq", "type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda *names: F.coalesce(F.col("type").isin(*names), F.lit(False))
    latest = lambda value: F.coalesce(F.last(value, ignorenulls=True).over(past), F.lit(0))
    now = F.col("library")
    rows = events.select("library_id", "ts", "seq", "type").withColumn("library", (F.sum(F.when(is_("library_changed"), 1).otherwise(0)).over(past) + 1).cast("int"))
    rows = rows.withColumn("text", latest(F.when(is_("text_current"), now).when(is_("invalidate_text"), 0)))
    rows = rows.withColumn("chunk", latest(F.when(is_("chunks_current") & (F.col("text") == now), now).when(is_("invalidate_text", "invalidate_chunks"), 0)))
    rows = rows.withColumn("embedding", latest(F.when(is_("embeddings_current") & (F.col("chunk") == now), now).when(is_("invalidate_text", "invalidate_chunks", "invalidate_embeddings"), 0)))
    last = rows.groupBy("library_id").agg(F.max_by(F.struct("library", "text", "chunk", "embedding"), F.struct("ts", "seq", "type")).alias("s"))
    return last.select("library_id", F.col("s.library").alias("library_rev"), F.col("s.text").alias("text_rev"), F.col("s.chunk").alias("chunk_rev"), F.col("s.embedding").alias("embedding_rev"), (F.col("s.embedding") != F.col("s.library")).alias("needs_update"))


def corpus_status(chunks: DataFrame, vectors: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """One row: documents, pages, characters and bytes of text, chunks; with vectors(chunk_id, model, embedding) also vectors of
    `model` (any without one), their least and most dimensions, and whether every chunk has exactly one."""
    text = chunks.agg(F.countDistinct("path").alias("documents"), F.countDistinct("path", "page").alias("pages"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("chunks"))
    if vectors is None:
        return text
    own = vectors if model is None else vectors.where(F.col("model") == model)
    found = own.agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least_dimensions"), F.max(F.size("embedding")).alias("most_dimensions"))
    per = own.groupBy("chunk_id").agg(F.count("*").alias("n"))
    odd = chunks.select(F.col("id").alias("chunk_id")).distinct().join(per, "chunk_id", "full").where("n is null or n <> 1").agg(F.count("*").alias("odd"))
    extra = per.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").agg(F.count("*").alias("extra"))
    one = text.select("*", *[found.select(c).scalar().alias(c) for c in found.columns])
    return one.withColumn("current", (odd.scalar() + extra.scalar()) == 0)
