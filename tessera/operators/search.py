"""Role visibility, scopes and keyword search over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_of, snippet, terms
from ..sources.shared import small, written

SEARCHED = ("PDF", "Text", "Markdown")


def visible(docs: DataFrame, role: str) -> DataFrame:
    """docs(folder_visibility, file_visibility map, visibility, ...) that a role may see; 'gm' sees all."""
    if role == "gm":
        return docs
    folder = (F.col("folder_visibility") == "players") | F.coalesce(F.exists(F.map_values("file_visibility"), lambda v: v == "players"), F.lit(False))
    return docs.where(folder & (F.col("visibility") == "players"))


def scope(docs: DataFrame, folder: str | None = None, requested: DataFrame | None = None) -> DataFrame:
    """docs of a folder (an unknown folder does not restrict) and of requested(path) if given, with the first folder by name of each path."""
    out = docs
    if folder is not None and docs.where(F.col("folder_name") == folder).limit(1).count():
        out = out.where(F.col("folder_name") == folder)
    if requested is not None:
        out = out.join(requested.select("path").distinct(), "path", "left_semi")
    first = Window.partitionBy("path").orderBy(F.lower("folder_name"), "folder_name")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def keyword_search(pages: DataFrame, queries: DataFrame, limit: int = 100) -> DataFrame:
    """The best pages of each query: all terms must occur; phrase 20, term 3 an occurrence, 10 for terms close together.

    A term holds only characters of words, so where it occurs it lies inside one run of such characters. The runs are an
    inverted index: of each query the term whose runs stand on the fewest pages names its candidates, and only these are
    read and tested for the whole query. Terms find their runs by a common piece of three characters, never by pairs of all.
    """
    low = pages.where(F.col("type").isin(*SEARCHED)).withColumn("folded", F.lower("text"))
    asked = written(queries.select("query_id", F.lower(F.trim("query")).alias("phrase"), terms(F.col("query")).alias("terms")).where(F.size("terms") > 0))
    runs = written(low.select("path", "page", F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit("[a-z0-9'_-]+"), F.lit(0)))).alias("run")))
    known = written(runs.groupBy("run").agg(F.count("*").alias("df")))
    wanted = asked.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    term = wanted.select("term").distinct().withColumn("piece", F.substring("term", 1, 3))
    spots = F.sequence(F.lit(1), F.length("run"))
    pieces = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.substring(F.col("run"), i, k)))))
    met = known.select("run", "df", F.explode(pieces).alias("piece")).join(small(term), "piece").where(F.col("run").contains(F.col("term"))).select("term", "run", "df")
    met = written(met)
    cost = met.groupBy("term").agg(F.sum("df").alias("cost"))
    best = wanted.join(cost, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "term")).alias("b")).where("b.cost > 0").select("query_id", "b.term")
    found = best.join(met.select("term", "run"), "term").join(runs, "run").select("query_id", "path", "page").distinct()
    hits = written(found).join(low, ["path", "page"]).join(small(asked), "query_id").where(F.expr("forall(terms, t -> contains(folded, t))"))
    at = F.transform("terms", lambda t: F.position(t, F.col("folded")))
    score = (20 * count_of(F.col("folded"), F.col("phrase")) + F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + 3 * count_of(F.col("folded"), t)) + F.when(F.array_max(at) - F.array_min(at) <= 250, 10).otherwise(0))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("display_name"), "page", "path")
    ranked = hits.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "path", "display_name", "page", "score", "rank", snippet(F.col("text"), F.col("phrase"), F.col("terms")).alias("snippet"))
