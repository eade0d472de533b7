"""Benchmark decontamination by a distributed positional inverted index.

Postings (term, document, position) are stored for the terms that queries look up; each posting carries the
words around it, so that the lists of the other terms of a phrase are intersected at their offsets where the
posting is. Every phrase is looked up under its rarest term, counted over all documents; exact phrases need
every term at its offset, proximity matches need every term within the surrounding words.
DataFrame operations only. Nothing is paired but postings with the phrases of the same rare term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, cut, key_columns, packed

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def phrases(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(phrase, n, item_ids): the distinct windows of all items, with the items that contain each."""
    held = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return held.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), size).alias("phrase")).groupBy("phrase").agg(F.collect_set("item").alias("item_ids")).withColumn("n", F.size("phrase"))


def postings(docs: DataFrame, text: str, terms: DataFrame, around: int) -> DataFrame:
    """The index of the given terms: (k1, k2, term, pos, from, context), pos 0-based; context holds the words from
    position `from`, `around` on each side of the posting."""
    held = docs.select(*key_columns(F.col(text)), words(F.col(text)).alias("w"))
    every = held.select("k1", "k2", "w", F.posexplode("w").alias("pos", "term")).join(broadcast_if_small(terms), "term", "left_semi")
    first = F.greatest(F.col("pos") - around, F.lit(0))
    return every.select("k1", "k2", "term", "pos", first.alias("from"), F.slice("w", first + 1, F.col("pos") - first + 1 + around).alias("context"))


def term_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, cf): occurrences of the given terms in all documents."""
    every = docs.select(F.explode(words(F.col(text))).alias("term"))
    return every.join(broadcast_if_small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf"))


def rarest(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """phrases with (term, off): their rarest term over all documents and its first offset, ties by offset."""
    terms = found.select(F.explode("phrase").alias("term")).distinct()
    each = found.select("phrase", F.posexplode("phrase").alias("off", "term")).join(term_counts(docs, text, terms), "term", "left")
    best = each.groupBy("phrase").agg(F.min(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), F.col("off"), F.col("term"))).alias("m"))
    # A phrase with a term that no document has cannot match.
    return found.join(best.where("m.cf > 0"), "phrase").select("phrase", "n", "item_ids", F.col("m.off").alias("off"), F.col("m.term").alias("term"))


def exact_matches(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(k1, k2, begin, end, item_ids): word spans of documents, by content key, that equal a phrase."""
    wanted = cut(rarest(phrases(items, item_id, text, size), docs, text))
    index = postings(docs, text, wanted.select("term").distinct(), size - 1)
    begin = F.col("pos") - F.col("off")
    there = (begin >= F.col("from")) & (F.slice("context", F.greatest(begin - F.col("from") + 1, F.lit(1)), F.col("n")) == F.col("phrase"))
    return index.join(broadcast_if_small(wanted, 100_000), "term").where(there).select("k1", "k2", begin.alias("begin"), (begin + F.col("n")).alias("end"), "item_ids")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(k1, k2, pos, item_ids): postings of a phrase's rarest term with all its terms within size + slop words."""
    wanted = rarest(phrases(items, item_id, text, size), docs, text)
    index = postings(docs, text, wanted.select("term").distinct(), size + slop - 1)
    return index.join(broadcast_if_small(wanted, 100_000), "term").where(F.size(F.array_except("phrase", "context")) == 0).select("k1", "k2", "pos", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with (n_words, n_hit, n_items, item_list, contaminated) for each row; added names replace input columns.

    A document word inside any occurrence of a phrase is hit. A text that is null or has no words is clean; items
    without words or id match nothing; repeated documents and items each count as themselves.
    """
    spans = exact_matches(docs, items, item_id, text, size).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_list"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s.n + F.greatest(x.end - F.greatest(x.begin, s.to), F.lit(0))).alias("n"), F.greatest(x.end, s.to).alias("to")), lambda s: s.n)
    spans = spans.select("k1", "k2", covered.cast("long").alias("n_hit"), "item_list")
    row, columns = packed(docs, ("n_words", "n_hit", "n_items", "item_list", "contaminated"))
    rows = docs.select(row, *key_columns(F.col(text)), F.size(words(F.col(text))).cast("long").alias("n_words"))
    hit, list_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_list", F.array().cast("array<string>"))
    return rows.join(spans, ["k1", "k2"], "left").select(*columns(), "n_words", hit.alias("n_hit"), F.size(list_).cast("long").alias("n_items"), list_.alias("item_list"), (hit > 0).alias("contaminated"))
