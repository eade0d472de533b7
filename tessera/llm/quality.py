"""Quality rules: counts of each text, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. A trusted target and the whole raw corpus give
two smoothed multinomials over the buckets; a text's score is the mean log-ratio of its n-grams. The threshold
is a low quantile of the trusted documents' own scores, found exactly on a histogram of fixed bounds.
DataFrame operations only; the model is one array of `BUCKETS` numbers, scoring is a map without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, cut, packed

BUCKETS = 1 << 14
#: Share of the trusted documents that may score below the threshold.
QUANTILE = 0.002


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 1).bitwiseXOR(b)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(BUCKETS - 1).cast("int")


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(h: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, from the hashes of its words."""
    def counted(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def starts(a: Column) -> Column:
            same = F.transform(a, lambda x, j: F.when((F.get(a, j - 1).h == x.h) | (F.get(a, j + 1).h == x.h), x.i))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))
        begin = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(_bind(order, starts), begin, lambda s, i: F.struct(i.alias("at"), (s.n + F.least(i - s.at, F.lit(3))).alias("n")), lambda s: s.n)
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return F.when(F.size(h) < 4, 0).otherwise(_bind(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(counted(x))))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _h (hashes of its words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_w", words(F.col(text))).withColumns({"_bare": F.array_join("_w", ""), "_h": hashes(F.col("_w"))})
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length("_bare").cast("long"),
        "n_symbols": (F.length("_bare") - F.length(F.regexp_replace("_bare", "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": _bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": _bind(F.col("_h"), repeat_words).cast("long")})
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_w", "_bare")


def model(docs: DataFrame, trusted: Column, text: str = "text") -> DataFrame:
    """One row: `m`, the log-ratios of the trusted rows to all rows by bucket. Both counts cover all their rows."""
    each = docs.select(words(F.col(text)).alias("w"), trusted.alias("t")).select("w", "t", F.posexplode("w").alias("i", "x"))
    own, after = F.xxhash64("x"), F.get("w", F.col("i") + 1)
    spots = F.array(_bucket(own), F.when(after.isNotNull(), _bucket(_pair(own, F.xxhash64(after)))))
    counts = each.select("t", F.explode(spots).alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("r"), F.sum(F.col("t").cast("long")).alias("t"))
    grid = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    # At most BUCKETS rows on each side, whatever the input.
    both = grid.join(F.broadcast(counts), "b", "left").select("b", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    lists = both.agg(F.sort_array(F.collect_list(F.struct("b", "t", "r"))).alias("l"), (F.sum("t") + BUCKETS).alias("nt"), (F.sum("r") + BUCKETS).alias("nr"))
    return lists.select(F.transform("l", lambda x: F.log((x.t + 1.0) / F.col("nt")) - F.log((x.r + 1.0) / F.col("nr"))).alias("m"))


def score(df: DataFrame, m: DataFrame) -> DataFrame:
    """Adds llr, the mean log-ratio over the n-grams of the text whose word hashes are _h, rounded to 1e-9; null without words."""
    def total(h: Column) -> Column:
        at = lambda i: F.get(F.col("_m"), _bucket(i))
        both = F.aggregate(F.sequence(F.lit(1), F.size(h) - 1), F.lit(0.0), lambda s, i: s + at(F.get(h, i)) + at(_pair(F.get(h, i - 1), F.get(h, i))))
        return at(F.get(h, F.lit(0))) + F.when(F.size(h) > 1, both).otherwise(0.0)
    value = _bind(F.col("_h"), total) / F.nullif(2 * F.size("_h") - 1, F.lit(-1))
    return df.withColumn("_m", m.scalar()).withColumn("llr", F.when(F.size("_h") > 0, F.round(value, 9))).drop("_m")


def threshold(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row, `limit`: the lower edge of the first step of 0.001 that lifts the share below it over the quantile."""
    steps = scored.where("llr is not null").groupBy(F.floor(F.col("llr") * 1000).alias("s")).agg(F.count("*").alias("n"))
    pairs = steps.agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("l"), F.sum("n").alias("n"))
    walk = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("s")), lambda a, x: F.struct((a.seen + x.n).alias("seen"), F.coalesce(a.s, F.when(a.seen + x.n > F.col("n") * quantile, x.s)).alias("s")), lambda a: a.s)
    return pairs.select((walk / 1000.0).alias("limit"))


def judge(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns of base(), llr and kept, one row for each row; added names replace input columns.

    target_ids(id) names the trusted documents; ids there may repeat or be null. A null text has no words.
    Without any trusted document with words the ratio rejects nothing. Columns in `drop` are left out of the result,
    and so of the checkpoint that holds the scored rows.
    """
    row, columns = packed(docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", *drop))
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(text).alias("text"))
    ids = target_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    # The text stays where it is read: the ids are broadcast if they were counted to be few, else the join shuffles.
    marked = rows.join(broadcast_if_small(ids, 500_000), F.col("id") == F.col("_id"), "left").withColumn("trusted", F.col("_id").isNotNull()).drop("_id", "id")
    scored = cut(score(base(marked, "text"), model(marked, F.col("trusted"), "text")).drop("_h", "text"))
    out = scored.withColumn("limit", threshold(scored.where("trusted")).scalar())
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.col("limit"), F.lit(True))
    return out.select(*columns(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", kept.alias("kept"))
