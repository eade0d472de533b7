"""Claims of answers and the passages of their cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, bind
from ..sources.shared import written

MARK = r"\[(\d{1,2})\]"


def answer_claims(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text) to (answer_id, line_no, source_no, claim): lines with [n], without markers and markdown."""
    lines = answers.select("answer_id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("line_no", "line"))
    claim = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", MARK, " "), r"[*_`#>]+", " "), r"\s+", " "))
    cited = lines.withColumn("claim", claim).where(F.col("claim") != "").withColumn("n", F.explode(F.regexp_extract_all("line", F.lit(MARK), F.lit(1))))
    return cited.select("answer_id", "line_no", F.col("n").cast("int").alias("source_no"), "claim")


def citation_tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9'_.+-]*"), F.lit(0)), F.lower)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def candidate_passages(c: Column) -> Column:
    """Sentences of 20 characters or more, and windows of two and three of up to 700 characters."""
    parts = F.filter(F.transform(F.split(c, r"\n+|(?<=[.!?])\s+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) >= 20)
    def windows(a: Column) -> Column:
        at = lambda p, i: F.array(p, *[F.when(F.get(a, i + k).isNotNull(), F.array_join(F.slice(a, i + 1, F.lit(k + 1)), " ")) for k in (1, 2)])
        return F.filter(F.flatten(F.transform(a, at)), lambda x: x.isNotNull() & (F.length(x) <= 700))
    return bind(parts, windows)


def citation_score(claim: Column, passage: Column) -> Column:
    """From token sets: coverage both ways, and the share of the claim's distinctive tokens."""
    both = F.size(F.array_intersect(claim, passage)).cast("double")
    special = F.filter(claim, lambda t: (F.length(t) >= 5) | t.rlike(r"\d"))
    extra = F.coalesce(0.25 * F.size(F.array_intersect(special, passage)) / F.nullif(F.size(special), F.lit(0)), F.lit(0.0))
    return F.when(both > 0, both / F.size(claim) * 0.82 + both / F.size(passage) * 0.18 + extra).otherwise(0.0)


def citation_excerpts(claims: DataFrame, sources: DataFrame, least: float = 0.20) -> DataFrame:
    """sources(answer_id, source_no, text) with the best passage for its claims, or the start of its text."""
    # Each source is split and tokenised once; its claims meet the passages that it gave.
    split = sources.join(claims.select("answer_id", "source_no").distinct(), ["answer_id", "source_no"], "left_semi").select("answer_id", "source_no", F.posexplode(candidate_passages(F.col("text"))).alias("i", "passage"))
    held = written(split.withColumn("p", citation_tokens(F.col("passage"))))
    asked = claims.select("answer_id", "source_no", "line_no", citation_tokens(F.col("claim")).alias("c"))
    scored = held.join(asked, ["answer_id", "source_no"]).withColumn("score", F.round(citation_score(F.col("c"), F.col("p")), 6)).where("score > 0")
    best = scored.groupBy("answer_id", "source_no").agg(F.max("score").alias("score"), F.max_by("passage", F.struct("score", -F.col("line_no"), -F.col("i"))).alias("passage"))
    out = sources.join(best, ["answer_id", "source_no"], "left")
    return out.select("answer_id", "source_no", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score") >= least, F.substring("passage", 1, 700)).otherwise(F.substring(F.trim("text"), 1, 520)).alias("citation_excerpt"))


def numbered_sources(hits: DataFrame) -> DataFrame:
    """(question_id, prompt): '[i] name, page p' and the text of each hit in order, joined by blank lines."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "chunk_id"))
    label = F.concat(F.when(F.col("page") > 0, F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise(""), F.lit("\n"), F.col("text"))
    rows = hits.withColumn("_n", n).withColumn("b", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.col("display_name"), label))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "b"))), lambda x: x.b), "\n\n").alias("prompt"))
