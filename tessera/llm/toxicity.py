"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary training texts each train an interpolated Kneser-Ney model of characters (bytes, with
everything that is no letter or digit as one separator), contexts of up to five. Counts are discounted in
proportion to the class's size, so that an expression which is rare in both classes gets its probability, from
shorter contexts down to continuation counts that both classes share, and says nothing. A toxic text is mostly ordinary
language, so its likelihood is that of a mixture: at each character the toxic model speaks with the share `MIX` and the ordinary
one otherwise. A document's evidence is the difference of the two log-likelihoods divided by its length; a logistic
curve, fitted on texts that did not train the model that judged them (two halves, crossed), turns it into a score.

Counting is done in Spark over all training texts, each different text once. Every n-gram keeps its own entry, none are merged, so
the tables grow with the expressions that occur often enough to tell. They are used in parts of at most `ENTRIES`
entries: each part holds all orders of the contexts that end in certain two bytes, so each position has all it
needs in one part, and what the driver and a task hold stays bounded whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_PLAIN, Scratch, blocks, broadcast_if_small, cut, logistic_fit, lowered, packed, texts_of

#: Longest n-gram; orders from here down share their counts between the classes.
ORDER, SHARED = 6, 2
#: Discount in counts of the smaller class, and for shared orders; share of the toxic model in toxic texts.
DISCOUNT, DISCOUNT_SHARED, MIX = 1.0, 0.75, 0.03
#: Entries of 12 bytes that are held at once.
ENTRIES = 8_000_000
#: The models: one of each half of the texts, and the one of all.
HALVES, ALL = (0, 1), 2


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER bytes at each position, the newest lowest, and each text's first position."""
    data = lowered(data)
    data = np.where(IS_PLAIN[data], data, 32).astype(np.int64)
    solid = data != 32
    keep = solid | np.concatenate(([False], solid[:-1]))
    first = np.concatenate(([0], np.cumsum(keep)))[offsets]
    data = data[keep]
    at = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    gram = data.copy()
    for j in range(1, ORDER):
        old = np.full(len(data), 32, np.int64)
        old[j:] = data[:-j]
        old[at < j] = 32
        gram |= old << (8 * j)
    return gram, first


def _low(gram, n: int):
    return gram & ((1 << 8 * n) - 1)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(model, toxic, g, c): counts of the longest n-grams by model and class over all rows of texts(text, toxic, half)."""

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(0))
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for x, y in blocks(offsets):
                gram, first = _grams(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                key, n = np.unique(gram | np.repeat(kind[x:y], np.diff(first)) << 48, return_counts=True)
                kinds = key >> 48
                yield pa.RecordBatch.from_arrays([pa.array((kinds >> 1).astype(np.int32)), pa.array((kinds & 1).astype(np.int32)), pa.array(key & ((1 << 48) - 1)), pa.array(n)], names=["half", "toxic", "g", "c"])

    counts = texts.select("text", "toxic", "half").mapInArrow(work, "half int, toxic int, g long, c long").groupBy("half", "toxic", "g").agg(F.sum("c").alias("c"))
    both = counts.select(F.explode(F.array("half", F.lit(ALL))).alias("model"), "toxic", "g", "c")
    return both.groupBy("model", "toxic", "g").agg(F.sum("c").alias("c"))


class Models:
    """The tables of all models: entries(model, n, own, toxic, g, v) and, for each model, the shared probabilities of byte pairs.

    own entries are discounted probabilities by n-gram, the others what is left to shorter contexts by context."""

    def __init__(self, counts: DataFrame, scratch: Scratch):
        level, parts = scratch.keep(counts), []
        self.classes: dict[int, set[int]] = {m: set() for m in (*HALVES, ALL)}
        for n in range(ORDER, SHARED, -1):
            total = {(r.model, r.toxic): r.n for r in level.groupBy("model", "toxic").agg(F.sum("c").alias("n")).collect()}
            for m, k in total:
                self.classes[m].add(k)
            least = {m: min(v for (k, _), v in total.items() if k == m) for m in {k for k, _ in total}}
            d = F.lit(DISCOUNT)
            for (m, k), v in total.items():
                d = F.when((F.col("model") == m) & (F.col("toxic") == k), DISCOUNT * v / least[m]).otherwise(d)
            tagged = level.withColumns({"x": F.shiftright("g", 8), "d": d})
            contexts = tagged.groupBy("model", "toxic", "x").agg(F.sum("c").alias("all"), F.sum(F.least(F.col("c").cast("double"), F.col("d"))).alias("cut"))
            rest = scratch.keep(contexts.where(F.col("cut") < F.col("all")))
            own = tagged.where("c > d").join(rest, ["model", "toxic", "x"]).select("model", F.lit(n).alias("n"), F.lit(True).alias("own"), "toxic", "g", ((F.col("c") - F.col("d")) / F.col("all")).cast("float").alias("v"))
            parts += [own, rest.select("model", F.lit(n).alias("n"), F.lit(False).alias("own"), "toxic", F.col("x").alias("g"), (F.col("cut") / F.col("all")).cast("float").alias("v"))]
            level = scratch.keep(level.groupBy("model", "toxic", F.expr(f"g & {(1 << 8 * (n - 1)) - 1}L").alias("g")).agg(F.count("*").alias("c")))
        for p in parts[1:]:
            parts[0] = parts[0].unionByName(p)
        # The two bytes of the context that stand before the newest byte, in all orders.
        self.entries = scratch.keep(parts[0].withColumn("ends", F.when(F.col("own"), F.shiftright("g", 8)).otherwise(F.col("g")).bitwiseAND(0xFFFF)))
        self.sizes = {r.model: r.n for r in self.entries.groupBy("model").agg(F.count("*").alias("n")).collect()}
        self.shared = {}
        pairs = level.groupBy("model", "g").agg(F.sum("c").alias("c")).collect()  # at most 2^16 rows for each model
        for m in {r.model for r in pairs}:
            grid = np.zeros(1 << 16)
            for r in pairs:
                if r.model == m:
                    grid[r.g] = r.c
            self.shared[m] = _pairs(grid.reshape(256, 256))

    def parts(self, model: int) -> int:
        return max(1, -(-self.sizes.get(model, 0) // ENTRIES))

    def part(self, model: int, k: int) -> Tables:
        rows = self.entries.where((F.col("model") == model) & (F.pmod(F.col("ends"), F.lit(self.parts(model))) == k)).drop("model", "ends").toArrow()
        return Tables(rows, self.shared[model], self.parts(model), k)


def _pairs(grid: np.ndarray) -> np.ndarray:
    """Kneser-Ney probabilities of a byte after one byte, from the continuation counts of pairs."""
    singles = (grid > 0).sum(0).astype(float)
    one = np.maximum(singles - DISCOUNT_SHARED, 0) / max(singles.sum(), 1) + np.minimum(singles, DISCOUNT_SHARED).sum() / max(singles.sum(), 1) / 256 + 1e-9
    mass = grid.sum(1, keepdims=True)
    left = np.where(mass > 0, np.minimum(grid, DISCOUNT_SHARED).sum(1, keepdims=True) / np.maximum(mass, 1), 1.0)
    return (np.maximum(grid - DISCOUNT_SHARED, 0) / np.maximum(mass, 1) + left * one).reshape(-1)


class Tables:
    """One part of a model as sorted arrays: for each order, n-grams and contexts with the values of both classes."""

    def __init__(self, rows: pa.Table, shared: np.ndarray, parts: int, k: int):
        self.shared, self.parts, self.k = shared, parts, k
        n, own, toxic, g, v = (rows.column(c).to_numpy() for c in ("n", "own", "toxic", "g", "v"))
        self.tables = {}
        for order in range(SHARED + 1, ORDER + 1):
            for kind, empty in ((True, 0.0), (False, 1.0)):
                here = (n == order) & (own == kind)
                keys, at = np.unique(g[here], return_inverse=True)
                values = np.full((2, len(keys)), empty, np.float32)
                values[toxic[here], at] = v[here]
                self.tables[order, kind] = keys, values

    def find(self, order: int, own: bool, x: np.ndarray) -> np.ndarray:
        keys, values = self.tables[order, own]
        empty = 0.0 if own else 1.0
        if not len(keys):
            return np.full((2, len(x)), empty)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, values[:, i], empty)

    def probabilities(self, gram: np.ndarray) -> np.ndarray:
        """(2, n): the probability of each gram's newest byte after the others, by class."""
        p = np.stack([self.shared[_low(gram, 2)]] * 2)
        for n in range(SHARED + 1, ORDER + 1):
            p = self.find(n, True, _low(gram, n)) + self.find(n, False, _low(gram, n) >> 8) * p
        return p

    def evidence(self, gram: np.ndarray) -> np.ndarray:
        """The log-likelihood difference at each position; 0 at those of other parts."""
        kind, at = np.unique(gram, return_inverse=True)
        mine = (kind >> 8 & 0xFFFF) % self.parts == self.k
        out = np.zeros(len(kind))
        p = self.probabilities(kind[mine])
        out[mine] = np.log(1 - MIX + MIX * p[1] / p[0])
        return out[at]


def evidence(rows: DataFrame, models: Models, model: int, scratch: Scratch) -> DataFrame:
    """rows(row, text) as (row, x): the mean log-likelihood difference of the characters of each text (0 without any)."""
    spark, parts = rows.sparkSession, models.parts(model)
    out = rows.withColumn("x", F.lit(0.0))
    for k in range(parts):
        shared = spark.sparkContext.broadcast(vars(models.part(model, k)))  # arrays alone: workers need no copy of the class

        def work(batches, shared=shared):
            tables = Tables.__new__(Tables)
            vars(tables).update(shared.value)
            for batch in batches:
                data, offsets = texts_of(batch.column(1))
                x = batch.column(2).to_numpy(zero_copy_only=False).copy()
                for a, b in blocks(offsets, 1 << 20):
                    gram, first = _grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    total = np.concatenate(([0.0], np.cumsum(tables.evidence(gram))))
                    x[a:b] += (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(x, 9))], names=["row", "text", "x"])

        out = out.mapInArrow(work, out.schema)
        if k + 1 < parts:
            out = scratch.keep(out)
    return out.select("row", "x")


def calibrated(models: Models, texts: DataFrame, scratch: Scratch) -> tuple[float, float]:
    """Slope (never negative) and intercept of the score over x, from each half's evidence under the other half's model."""
    steps = []
    for half in HALVES:
        rows = texts.where(F.col("half") != half).select(F.struct("toxic").alias("row"), "text")
        # A histogram of fixed steps: its size does not follow the number of documents.
        if half in models.shared and {0, 1} <= models.classes[half]:
            steps.append(evidence(rows, models, half, scratch).groupBy("row.toxic", F.round("x", 5).alias("x")).agg(F.count("*").alias("n")).toPandas())
    toxic, x, n = (np.concatenate([s[c].to_numpy(float) for s in steps]) if steps else np.zeros(0) for c in ("toxic", "x", "n"))
    if len(set(toxic)) < 2:
        return 0.0, -40.0
    scale = max(float(np.sqrt((x * x * n).sum() / n.sum())), 1e-9)
    slope, intercept = logistic_fit(x / scale, toxic, n)
    if slope <= 0:
        share = float((toxic * n).sum() / n.sum())
        return 0.0, float(np.log(share / (1 - share)))
    return slope / scale, intercept


def score(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", limit: float = 0.7) -> DataFrame:
    """docs (without its text) with score (0 to 1) and predicted (score >= limit), one row for each row.

    labels(id, toxic) marks some documents; those for which `trains` holds teach, each different text once (toxic if any of its
    rows is). Null ids or labels teach nothing; of several labels of one id the largest counts. A null or empty text, or
    one without words, has no evidence and gets the score of evidence 0. Without examples of both classes in each half
    every score is 0. Input columns named score or predicted are replaced, others are kept.
    """
    spark = docs.sparkSession
    row, columns = packed(docs, ("score", "predicted", text))
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    teach = docs.where(trains & F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(broadcast_if_small(marks, 500_000), "id")
    rows = docs.select(row, F.col(text).alias("text"))
    with Scratch(spark) as scratch:
        once = teach.groupBy(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
        texts = scratch.keep(once.select("text", "toxic", F.pmod("k2", F.lit(2)).cast("int").alias("half")))
        models = Models(gram_counts(texts), scratch)
        if not {0, 1} <= models.classes[ALL]:
            found = rows.select("row", F.lit(0.0).alias("score"))
        else:
            slope, intercept = calibrated(models, texts, scratch)
            z = F.greatest(F.least(F.col("x") * slope + intercept, F.lit(40.0)), F.lit(-40.0))
            found = evidence(rows, models, ALL, scratch).select("row", (1 / (1 + F.exp(-z))).alias("score"))
            if models.parts(ALL) > 1:
                found = cut(found)
    return found.select(*columns(), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
