"""Mixing sources to target weights by Poisson replication.

A source's mean repetition is its target share of all rows over its own rows. Each document draws its number
of copies by inverting the Poisson distribution at a uniform number hashed from seed and document, is
exploded by that number, and the copies are dealt out and sorted by a hash, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed

#: A mean above this is drawn as a sum of independent parts, so that exp(-mean) stays normal.
PART = 64.0


def identity(id_col: str, text: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def uniform(name: Column, seed: int, part: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), part.cast("string"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) >= u for X Poisson of the mean; the terms are added up to far beyond any u."""
    most = (mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(s.c >= u, s).otherwise(F.struct((s.p * mean / i).alias("p"), (s.c + s.p * mean / i).alias("c"), i.alias("k")))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s.k)


def rates(docs: DataFrame, source: str = "source", power: float = 0.5, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, n, rate): mean repetitions so that shares follow the given weights, or n**power without them."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    weight = F.pow(F.col("n"), F.lit(power)) if weights is None else F.lit(0.0) if not weights else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("_source", F.lit("\0"))), F.lit(0.0))
    weighed = counts.withColumn("w", weight.cast("double"))
    # Rounding makes the sum independent of the order in which doubles are added.
    whole = weighed.agg(F.round(F.sum("w"), 6).alias("w"), F.sum("n").alias("n"))
    target = F.lit(float(total)) if total is not None else whole.select(F.col("n").cast("double")).scalar()
    # Weights that no source has, or that add up to nothing, repeat nothing.
    share = F.coalesce(F.try_divide("w", whole.select("w").scalar()), F.lit(0.0))
    return weighed.select("_source", "n", (share * target / F.col("n")).alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, **target) -> DataFrame:
    """docs, each row repeated by its draw and in a global random order, with column copy_no from 1.

    A null source is a source of its own; a source without a given weight gets no row, and so do all where no weight fits a source. Rows with equal id draw
    the same number; a null id is replaced by a digest of the text. An input column copy_no is replaced. Sources
    are broadcast only if counted to be few, else the join shuffles.
    """
    per = broadcast_if_small(rates(docs, source, **target).select("_source", "rate"))
    row, columns = packed(docs, ("copy_no",))
    drawn = docs.select(row, F.col(source).alias("s"), identity(id_col, text).alias("name"), F.xxhash64(text).alias("t")).join(per, F.col("s").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    one = lambda part: poisson(uniform(F.col("name"), seed, part), F.col("rate") / F.col("parts"))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), one), F.lit(0), lambda a, x: a + x)
    copies = drawn.withColumn("n", count).where("n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n"))))
    order = F.xxhash64(F.lit(seed), F.col("name"), F.col("copy_no"), F.col("t"))
    shuffled = copies.select("row", "copy_no", order.alias("order")).repartition(F.col("order")).sortWithinPartitions("order")
    return shuffled.select(*columns(), "copy_no")
