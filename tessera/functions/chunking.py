"""Splitting pages into chunks as Column functions and as a job over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind

TARGET, OVERLAP, LEAST = 1800, 250, 120


def split_block(c: Column) -> Column:
    """Pieces of at most TARGET characters, cut after the last sentence or line end in a window's second half,
    each starting OVERLAP characters before the end of the one before."""
    stop = r"(?s)\A.{" + str(TARGET // 2 + 1) + r",}(?:[.!?](?= )|\n)"
    def step(s: Column, _: Column) -> Column:
        window = F.substring(c, s.at + 1, F.lit(TARGET))
        cut = F.length(F.regexp_extract(F.substring(window, 1, TARGET), stop, 0))
        size = F.when(s.at + TARGET >= F.length(c), F.length(c) - s.at).when(cut > TARGET // 2 + 1, cut).otherwise(TARGET)
        return bind(size, lambda n: F.when(s.done, s).otherwise(F.struct(
            F.greatest(s.at + n - OVERLAP, s.at + 1).alias("at"), (s.at + n >= F.length(c)).alias("done"),
            F.concat(s.out, F.array(F.regexp_replace(F.substring(c, s.at + 1, n), r"^\s+|\s+$", ""))).alias("out"))))
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))
    loops = F.sequence(F.lit(0), (F.length(c) / (TARGET // 2 - OVERLAP)).cast("int") + 1)
    return F.when(F.length(c) <= TARGET, F.array(c)).otherwise(F.filter(F.aggregate(loops, start, step, lambda s: s.out), lambda x: x != ""))


def chunk_text(c: Column) -> Column:
    """A page's chunks: blocks packed up to TARGET characters; short ones are dropped, but a short page is kept whole."""
    text = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    def packed(t: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
        blocks = F.flatten(F.transform(paragraphs, split_block))
        def pack(s: Column, b: Column) -> Column:
            joined = F.when(s.now == "", b).otherwise(F.concat(s.now, F.lit("\n\n"), b))
            fits = F.length(joined) <= TARGET
            return F.struct(F.when(fits | (s.now == ""), s.out).otherwise(F.concat(s.out, F.array(s.now))).alias("out"), F.when(fits, joined).otherwise(b).alias("now"))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
        done = F.aggregate(blocks, start, pack, lambda s: F.when(s.now == "", s.out).otherwise(F.concat(s.out, F.array(s.now))))
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < LEAST, F.array(t)).otherwise(F.filter(done, lambda x: F.length(x) >= LEAST))
    return bind(text, packed)


def chunk_id(path: Column, page: Column, ordinal: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", path, page.cast("string"), ordinal.cast("string"), F.substring(text, 1, 200)), 256), 1, 24)


def chunk_documents(pages: DataFrame) -> DataFrame:
    """pages(path, page, text, ...) to one row for each chunk, with id and ordinal from 0; blank pages give none."""
    keep = [c for c in pages.columns if c not in ("id", "ordinal", "text")]
    out = pages.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select(*keep, F.posexplode(chunk_text(F.col("text"))).alias("ordinal", "text"))
    return out.select(chunk_id(F.col("path"), F.col("page"), F.col("ordinal"), F.col("text")).alias("id"), *keep, "ordinal", "text")
