"""Library inventory: records, precedence, snapshot differences, availability, artefacts, text status."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# File types by extension.
TYPES = {"pdf": "PDF", "cbz": "CBZ", "cbr": "CBR", "png": "Image", "jpg": "Image", "jpeg": "Image", "webp": "Image", "gif": "Image", "txt": "Text", "md": "Markdown"}


def document_records(files: DataFrame, folders: DataFrame, types: dict[str, str] = TYPES) -> DataFrame:
    """files(folder, path) with key, filename, display_name, extension, type and the effective visibility.

    A file's override comes before its folder's visibility, and 'players' is the default; other files are left out."""
    table = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    name = F.regexp_extract("path", r"[^/]+$", 0)
    rows = files.withColumn("filename", name).withColumn("extension", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))).withColumn("type", F.try_element_at(table, F.col("extension"))).where("type is not null")
    joined = rows.join(folders.select(F.col("name").alias("folder"), F.col("visibility").alias("_v"), "file_visibility"), "folder")
    override = F.try_element_at("file_visibility", F.col("path"))
    return joined.withColumns({"doc_key": F.substring(F.sha2("path", 256), 1, 24), "display_name": F.regexp_replace("filename", r"\.[^.]+$", ""), "visibility": F.coalesce(override, F.col("_v"), F.lit("players")), "visibility_override": F.coalesce(override, F.lit("inherit"))}).drop("_v", "file_visibility")


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """One row for each path: within a folder the last source wins, across folders the first folder by name."""
    inner = Window.partitionBy("folder", "path").orderBy(F.desc("source_ord"))
    outer = Window.partitionBy("path").orderBy(F.lower("folder"), "folder")
    last = docs.withColumn("_n", F.row_number().over(inner)).where("_n = 1")
    return last.withColumn("_n", F.row_number().over(outer)).where("_n = 1").drop("_n")


def snapshot_diff(prev: DataFrame, curr: DataFrame, offline: DataFrame | None = None) -> DataFrame:
    """(path, change) of prev and curr(path, size, mtime): added, changed, removed, unchanged, or offline for
    paths of unavailable sources, which keep their record."""
    both = prev.select("path", F.struct("size", "mtime").alias("a")).join(curr.select("path", F.struct("size", "mtime").alias("b")), "path", "full")
    off = F.lit(False)
    if offline is not None:
        both = both.join(offline.select("path", F.lit(True).alias("_off")).distinct(), "path", "left")
        off = F.col("_off").isNotNull() & F.col("a").isNotNull()
    change = F.when(off, "offline").when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def confirm_removed(missing: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, removed): a missing source is gone only if a directory strictly above it is reachable.

    Every ancestor of a path is a key of its own, so this is an equi-join and not a range join."""
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    above = missing.select("path", F.explode(F.when(F.size(F.split("path", "/")) > 1, cut)).alias("ancestor"))
    found = above.join(sources.where("available").select(F.col("path").alias("ancestor")).distinct(), "ancestor", "left_semi").select("path").distinct().withColumn("removed", F.lit(True))
    return missing.select("path").join(found, "path", "left").fillna(False, ["removed"])


def artifact_gc(artifacts: DataFrame, docs: DataFrame, derivatives: DataFrame) -> DataFrame:
    """artifacts(artifact, path, size, mtime, complete, bytes) with keep: complete, of a known document, not superseded
    by a current derivative, and with the document's signature unless its source is offline."""
    rows = artifacts.join(docs.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), "available"), "path", "left")
    rows = rows.join(derivatives.select("path", F.col("size").alias("_ds"), F.col("mtime").alias("_dm")), "path", "left")
    current = F.coalesce((F.col("_ds") == F.col("_s")) & (F.col("_dm") == F.col("_m")), F.lit(False))
    same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))
    keep = F.col("complete") & F.col("available").isNotNull() & ~current & F.coalesce(~F.col("available") | same, F.lit(False))
    return rows.select("artifact", "bytes", keep.alias("keep"))


def prune_text(cache: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, change): cached paths that are unknown (removed) or whose signature is stale (changed); offline ones stay."""
    both = cache.join(docs.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), "available"), "path", "left")
    change = F.when(F.col("available").isNull(), "removed").when(F.col("available") & ((F.col("size") != F.col("_s")) | (F.col("mtime") != F.col("_m"))), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def extraction_status(docs: DataFrame, cache: DataFrame, version: int = 1) -> DataFrame:
    """docs(path, type, size, mtime, scanned, ocr_current) with status cached, extracted, skipped_scanned or unsupported."""
    held = cache.where(F.col("version") == version).select("path", "size", "mtime", F.lit(True).alias("_c"))
    comic = F.col("type").isin("CBZ", "CBR")
    status = (F.when(~F.col("type").isin("PDF", "Text", "Markdown", "CBZ", "CBR"), "unsupported").when((comic | ((F.col("type") == "PDF") & F.col("scanned"))) & ~F.col("ocr_current"), "skipped_scanned")
              .when(F.col("_c"), "cached").otherwise("extracted"))
    return docs.join(held, ["path", "size", "mtime"], "left").withColumn("status", status).drop("_c")


def text_status(pages: DataFrame, samples: int = 12) -> DataFrame:
    """(path, status) from pages(path, page, words): evenly spaced sample pages decide whether a text is searchable."""
    sized = pages.groupBy("path").agg(F.count("*").alias("n"))
    k = F.least(F.lit(samples), F.col("n")).cast("int")
    spot = F.when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (F.col("n") - 1) / (k - 1), 0).cast("long"))))
    picked = sized.select("path", F.explode(spot).alias("at"))
    numbered = pages.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("page")).cast("long") - 1)
    seen = numbered.join(picked, ["path", "at"]).groupBy("path").agg(F.count("*").alias("sampled"), F.count_if(F.col("words") >= 5).alias("with_words"), F.sum("words").alias("total"))
    enough = F.when(F.col("sampled") <= 2, F.col("total") >= 25).otherwise((F.col("with_words") >= F.greatest(F.lit(2), F.bround(F.col("sampled") * 0.25, 0))) & (F.col("total") >= 50))
    return seen.select("path", "sampled", "with_words", "total", F.when(enough, "searchable").otherwise("scanned").alias("status"))


def ocr_backlog(docs: DataFrame) -> DataFrame:
    """docs(path, type, display_name, scanned, ocr_current) that need OCR, with ready; the ones not ready come first."""
    need = docs.where(F.col("type").isin("CBZ", "CBR") | ((F.col("type") == "PDF") & F.col("scanned")))
    return need.select("path", "type", "display_name", F.col("ocr_current").alias("ready")).orderBy("ready", F.lower("display_name"), "path")


def upload_names(uploads: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """uploads(user, name, arrival) with safe_name and supported, whether its extension is of a known type.

    The last part of a path counts; unsafe runs become '_', spaces and dots at the ends go, and what is left empty is named 'upload'. A name
    that is taken, by existing(user, name) or an upload before it, gets the next free number from 2 on. Names that differ only in such
    numbers are worked off one after the other, as each depends on those before it; of them only the names as given are remembered."""
    last = F.regexp_extract("name", r"([^/]*)/*$", 1)
    clean = F.regexp_replace(F.regexp_replace(last, r"[^A-Za-z0-9._() \-\[\]]+", "_"), r"^[ .]+|[ .]+$", "")
    held = uploads.select(F.struct(*[F.col(f"`{c}`") for c in uploads.columns]).alias("row"), F.col("user").alias("u"), F.col("name"), F.lit(1).alias("new"), F.col("arrival").alias("at"))
    if existing is not None:
        held = held.unionByName(existing.select(F.lit(None).cast(held.schema["row"].dataType).alias("row"), F.col("user").alias("u"), "name", F.lit(0).alias("new"), F.lit(None).cast(uploads.schema["arrival"].dataType).alias("at")))
    held = held.withColumn("clean", F.when(F.coalesce(clean, F.lit("")) == "", "upload").otherwise(clean))
    suffix = F.regexp_extract("clean", r"\.[^.]*$", 0)
    held = held.withColumn("suffix", suffix).withColumn("stem", F.substr("clean", F.lit(1), F.length("clean") - F.length("suffix")))
    dealt = held.withColumn("family", F.concat(F.regexp_replace("stem", r"( \(\d+\))+$", ""), "suffix")).repartition("u", "family").sortWithinPartitions("u", "family", "new", "at", "clean")

    def name_all(batches):
        last, given, following = None, set(), {}

        def taken(stem, suffix):
            numbered = re.fullmatch(r"(.*) \(([1-9]\d*)\)", stem, re.DOTALL)
            return stem in given or bool(numbered and 2 <= int(numbered[2]) < following.get(numbered[1], 2))

        for batch in batches:
            names = []
            for user, family, stem, suffix in zip(*(batch.column(c).to_pylist() for c in ("u", "family", "stem", "suffix")), strict=True):
                if (user, family) != last:
                    last, given, following = (user, family), set(), {}
                if taken(stem, suffix):
                    n = following.get(stem, 2)
                    while taken(f"{stem} ({n})", suffix):
                        n += 1
                    following[stem] = n + 1
                    names.append(f"{stem} ({n}){suffix}")
                else:
                    given.add(stem)
                    names.append(stem + suffix)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("new"), pa.array(names, pa.string())], names=["row", "new", "safe_name"])

    out = dealt.mapInArrow(name_all, dealt.select("row", "new", F.lit("").alias("safe_name")).schema).where("new = 1")
    known = F.lower(F.regexp_extract("safe_name", r"\.([^.]*)$", 1)).isin(*TYPES)
    return out.select(*[F.col("row").getField(c).alias(c) for c in uploads.columns if c not in ("safe_name", "supported")], "safe_name", known.alias("supported"))
