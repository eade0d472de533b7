"""Line dedup by site-relative frequency.

For each host the share of its pages that contain a line is the pages with that line over all pages of the
host; lines above the ratio (and on a least number of pages) are boilerplate of that host and are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, cut, key_columns, packed

RATIO, PAGES = 0.1, 3


def _line(c):
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """(host, line, n, total): lines, as hashes, on more than `ratio` of a host's pages and on `pages` at least."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n"), _line), lambda x: x != ""), lambda x: F.xxhash64(x)))
    per_line = docs.select(F.col(host).alias("host"), F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    totals = docs.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("total"))
    return per_line.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("total")).drop("h")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and a column n_dropped; other columns are kept.

    Every row is a page, repeated rows included; pages with a null host form a host of their own. Lines are
    compared without white space at their ends; lines of white space alone are never boilerplate. A null
    text stays null, a page of boilerplate alone becomes the empty text. Hosts of fewer than `pages` pages lose
    nothing. An input column n_dropped is replaced.
    """
    row, columns = packed(docs, ("n_dropped",))
    rows = docs.select(row, F.col(host).alias("host"), F.col(text).alias("text"), *key_columns(F.coalesce(F.col(host).cast("string"), F.lit("\0")), F.col(text)))
    # A line above the ratio is on so many of its host's pages that a host has few of them; they are counted before they are broadcast.
    common = broadcast_if_small(cut(boilerplate(docs, host, text, ratio, pages).select(F.col("host").alias("h"), "line")))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(_line(x))))
    held = rows.select("k1", "k2", "host", F.explode(lines).alias("l"))
    found = held.join(common, F.col("h").eqNullSafe(F.col("host")) & (F.col("l") == F.col("line"))).groupBy("k1", "k2").agg(F.collect_set("line").alias("bad"))
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(_line(x))))
    out = rows.join(found, ["k1", "k2"], "left").withColumn("kept", F.when(F.col("bad").isNotNull(), kept))
    new = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias(text)
    dropped = F.when(F.col("bad").isNull(), 0).otherwise(F.size(split) - F.size("kept")).alias("n_dropped")
    return out.select(*[new if c == text else x for c, x in zip([c for c in docs.columns if c != "n_dropped"], columns(), strict=True)], dropped)
