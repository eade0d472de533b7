"""A corpus from the documents table: five stages, each written as Parquet and read again as the next one's input.

Language ID drops what has no language, line dedup takes boilerplate lines out, near-dedup keeps one document of each
group of near-duplicates, decontamination drops documents that contain benchmark phrases, mixing repeats documents
to target weights and shuffles them. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, language_id, line_dedup, mixing, simhash
from tessera.llm.common import shared_dir, table
from tessera.llm.queries import remainder

#: A text whose best language has a lower mean probability over its positions has no language.
LEAST_LANGUAGE = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, or no language that stands out.

    The network learns from all rows with a language but the held-out quarter of op4. A null text has no letter; null ids and
    repeated rows are rows like any other; without any labelled row there is no language to find, and nothing stays."""
    net = language_id.train(docs, F.coalesce(remainder(4) != 2, F.lit(True)))
    found = language_id.identify(docs, net)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines on more than a tenth of a source's documents; n_chars follows the text where it changed.

    Every row stays, also one left without text; a null source is a source of its own, a null text stays null."""
    out = line_dedup.drop_boilerplate(docs, "source")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of 0.8 or more on five-word shingles, verified.

    Candidates come from SimHash segments wide enough for that similarity (llm/near_copies.py). The smallest id stays, a null id
    only in a group without any other; texts without words are one group."""
    return simhash.keep_one(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain ten consecutive words of a benchmark item, or a shorter item as a whole.

    A null text contains nothing; items without words or id match nothing."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh by the square root of their size, in a global random order.

    A null source is a source of its own; rows with equal ids draw the same number; an empty table stays empty. copy_no is added."""
    return mixing.mix(docs)


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("simhash_near_dedup", keep_one_of_each), ("decontamination", drop_contaminated), ("mixing", mix_sources)]
#: The stages hold a trained network and XXH64 components, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
