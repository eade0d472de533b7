"""URL filter: host and path rules, then a character language-model ratio for what no rule decides.

Accepted and rejected URLs (those that a rule decides) each train a smoothed variable-order Markov model
over a 40-character alphabet, contexts of 0 to 2 characters interpolated by Witten-Bell. A URL's score is
its log-likelihood difference divided by its length; the threshold is the midpoint of the mean scores of
accepted and rejected URLs of a held-out quarter. All counting and scoring is DataFrame work: the two
models end as one array of 40^3 weights, so its size does not depend on the data, and scoring is a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, packed

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: '^' pads the start; every character that is not listed counts as '*'.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0-._/~%=&?:+*"
SIZE = len(ALPHABET)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    there = url.contains("://")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null if none fits."""
    name = action = None
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        name = F.when(fits, text) if name is None else name.when(fits, text)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def trigrams(text: Column) -> Column:
    """One code for each character: two characters before it, padded by '^', and itself."""
    plain = F.concat(F.lit("^^"), F.translate(ascii_lower(text), "^123456789", "*000000000"))
    spot = lambda c: F.position(c, F.lit(ALPHABET))
    codes = F.transform(F.split(plain, ""), lambda c: F.when(spot(c) > 0, spot(c) - 1).otherwise(SIZE - 1))
    triples = F.transform(F.array(codes), lambda a: F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.get(a, i) * SIZE * SIZE + F.get(a, i + 1) * SIZE + F.get(a, i + 2)))
    return F.when(F.length(text) > 0, F.get(triples, F.lit(0))).otherwise(F.array().cast("array<int>"))


def model(labelled: DataFrame) -> DataFrame:
    """From (target, ok) to one row: `w`, the 40^3 differences of log-probabilities in millionths."""
    spark = labelled.sparkSession
    counts = labelled.select("ok", F.explode(trigrams(F.col("target"))).alias("code")).groupBy("code").agg(
        F.sum(F.col("ok").cast("long")).alias("n1"), F.sum((~F.col("ok")).cast("long")).alias("n0"))
    # The grid has 40^3 rows whatever the input, so the joins and windows below are of a fixed size.
    grid = spark.range(SIZE**3).select(F.col("id").cast("int").alias("code"))
    grid = grid.join(F.broadcast(counts), "code", "left").select(
        "code", F.expr(f"code div {SIZE * SIZE}").alias("a"), F.expr(f"code div {SIZE} % {SIZE}").alias("b"), F.expr(f"code % {SIZE}").alias("c"),
        *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n1", "n0")))

    def p(n: str) -> str:
        return f"""
        (({n} + (t2_{n} * ((u_{n} + t1_{n} * p0_{n}) / greatest(s1_{n} + t1_{n}, 1) + if(s1_{n} = 0, p0_{n}, 0D))))
          / greatest(s2_{n} + t2_{n}, 1)
          + if(s2_{n} = 0, (u_{n} + t1_{n} * p0_{n}) / greatest(s1_{n} + t1_{n}, 1) + if(s1_{n} = 0, p0_{n}, 0D), 0D))"""

    per = lambda n: f"""sum({n}) over (partition by a, b) s2_{n}, count_if({n} > 0) over (partition by a, b) t2_{n},
        sum({n}) over (partition by b, c) u_{n}, sum({n}) over (partition by b) s1_{n},
        (sum({n}) over (partition by c) + 1D) / (sum({n}) over (partition by 1) + {SIZE}) p0_{n}"""  # noqa: E731
    followers = lambda n: f"sum(if(a = 0 and u_{n} > 0, 1, 0)) over (partition by b) t1_{n}"
    return spark.sql(f"""
        with x as (select code, a, b, c, n1, n0, {per('n1')}, {per('n0')} from {{grid}}),
        y as (select *, {followers('n1')}, {followers('n0')} from x),
        z as (select code, cast(round(1e6 * (ln({p('n1')}) - ln({p('n0')}))) as bigint) w from y)
        select transform(sort_array(collect_list(struct(code, w))), x -> x.w) w from z""", grid=grid)


def score(df: DataFrame, weights: DataFrame, name: str = "score") -> DataFrame:
    """Adds the length-normalised log-likelihood difference of column `target`; null for empty targets."""
    with_model = df.withColumn("_w", weights.scalar()).withColumn("_t", trigrams(F.col("target")))
    total = F.aggregate("_t", F.lit(0).cast("long"), lambda s, i: s + F.get(F.col("_w"), i))
    return with_model.withColumn(name, total / F.nullif(F.length("target"), F.lit(0)) / 1e6).drop("_w", "_t")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, held_out: int = 4) -> DataFrame:
    """Adds host, path, rule, score and verdict to pages(url, ...), one row for each row of pages.

    Null urls and urls without '://' have empty host and path; an empty target has no score and is allowed,
    and so is every undecided url while one of the classes has no example. Extra columns are kept; input
    columns named like the added ones are replaced. Repeated urls each keep their row and count each time.
    """
    row, columns = packed(pages, ("host", "path", "rule", "score", "verdict"))
    host, path = host_and_path(F.col("url"))
    known = pages.select(row, F.col("url").alias("url")).withColumns({"host": host, "path": path})
    rule, act = rule_of(F.col("host"), F.col("path"), rules)
    known = known.withColumns({"rule": rule, "act": act, "target": F.concat("host", ascii_lower(F.col("path")))})
    labelled = known.where(F.col("act").isNotNull()).select("target", (F.col("act") == "allow").alias("ok"), (F.conv(F.substring(F.md5("url"), 1, 1), 16, 10).cast("int") < 16 // held_out).alias("held"))
    weights = cut(model(labelled.where(~F.col("held"))))
    middle = score(labelled.where("held"), weights).agg(((F.avg(F.when(F.col("ok"), F.col("score"))) + F.avg(F.when(~F.col("ok"), F.col("score")))) / 2).alias("t"))
    scored = score(known, weights).withColumn("limit", middle.scalar())
    verdict = F.coalesce(F.col("act"), F.when(F.col("score") < F.col("limit"), "block").otherwise("allow"))
    return scored.select(*columns(), "host", "path", "rule", "score", verdict.alias("verdict"))
