"""Evidence over retrieval batches: merging, ranking, near-duplicate suppression, selection, decisions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, terms
from ..sources.shared import bucketed, small, written

OVERLAP = 0.82
#: Bytes of a part of a path's texts, whose words a task holds; names or pairs at most that are broadcast.
PART, PAIRS = 1 << 25, 200_000
# Words that say nothing about a passage; callers add names of their own by `stop`.
CONTENT_STOP = [
    "character", "characters", "rule", "rules", "using", "use", "does", "doesnt", "have", "has", "able", "even", "though", "when", "the", "and", "for", "with", "from", "this", "that", "what", "are", "is", "can", "her", "she", "his", "their", "into", "other",
]
# Phrases of procedures, strong and medium.
STRONG = ("if a player wishes to", "a player may", "a character may", "you can buy", "can buy", "may buy", "buy a new", "can add", "may add", "wishes to add", "add a shadow amp", "cannot", "may not", "must", "requires", "required", "provided", "unless", "cost would reduce", "essence cost")
MEDIUM = ("purchase", "purchasing", "acquire", "acquiring", "install", "prerequisite", "limit", "maximum", "minimum", "cost", "allowed", "permitted", "spend", "pay", "reduce")


def merge_batches(batches: DataFrame) -> DataFrame:
    """batches(question_id, query_ord, is_original, rank, chunk_id, evidence_score, ...) merged to one row for each
    question and chunk: hits, reciprocal ranks, best rank, best score and the original query's hit."""
    key = ["question_id", "query_ord", "chunk_id"]
    once = batches.groupBy(*key).agg(F.min_by(F.struct(*[c for c in batches.columns if c not in key]), "rank").alias("r")).select(*key, "r.*")
    original = F.max_by(F.struct("rank", "evidence_score"), F.when(F.col("is_original"), F.col("query_ord")))
    merged = once.groupBy("question_id", "chunk_id").agg(
        F.count("*").alias("hits"), F.round(F.sum(1 / F.col("rank")), 9).alias("rr"), F.min("rank").alias("best_rank"), F.max("evidence_score").alias("best_score"),
        F.max("is_original").alias("original_hit"), original.alias("o"))
    return merged.select("*", F.col("o.rank").alias("original_rank"), F.col("o.evidence_score").alias("original_score")).drop("o")


def evidence_rank(merged: DataFrame) -> DataFrame:
    score = F.col("best_score") + 0.025 * F.least(F.col("hits") - 1, F.lit(3)) + 0.0125 * F.least(F.col("rr"), F.lit(2.0)) + F.when(F.col("original_hit"), 0.025).otherwise(0.0)
    order = Window.partitionBy("question_id").orderBy(F.desc("rank_score"), F.desc("best_score"), F.desc("original_hit"), "best_rank", "chunk_id")
    return merged.withColumn("rank_score", F.floor(score * 1e6 + 0.5) / 1e6).withColumn("position", F.row_number().over(order))


def overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller word set; 0 for empty sets."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def near_duplicates(rows: DataFrame, limit: float = OVERLAP) -> DataFrame:
    """(question_id, a, b, overlap): pairs of one question and path whose word sets overlap by `limit` (above 0) or more.

    The smaller set of such a pair shares so many words that one of its first n - ceil(limit * n) + 1, in any one order, is among
    them; only texts that meet so are compared, not all pairs of a path."""
    by = ["question_id", "path"]
    one = written(rows.select(*by, "chunk_id", F.array_distinct(terms(F.col("text"))).alias("w")).where("size(w) > 0"))
    first = F.slice(F.transform(F.sort_array(F.transform("w", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s.x), 1, (F.size("w") - F.ceil(F.lit(limit) * F.size("w") - 1e-9) + 1).cast("int"))
    asks = one.select(*by, "chunk_id", F.size("w").alias("n"), F.explode(first).alias("x"))
    has = one.select(*by, F.col("chunk_id").alias("other"), F.size("w").alias("m"), F.explode("w").alias("x"))
    met = asks.join(has, [*by, "x"]).where("chunk_id <> other and n <= m").select(*by, F.least("chunk_id", "other").alias("a"), F.greatest("chunk_id", "other").alias("b")).distinct()
    sets = lambda i, w: one.select(*by, F.col("chunk_id").alias(i), F.col("w").alias(w))
    both = met.join(sets("a", "wa"), [*by, "a"]).join(sets("b", "wb"), [*by, "b"]).withColumn("overlap", F.round(overlap(F.col("wa"), F.col("wb")), 6))
    return both.where(F.col("overlap") >= limit).select("question_id", "a", "b", "overlap")


def greedy(rows: DataFrame, limit: int, group: str = "question_id", order: str = "position", most: int = 500, fill: bool = True, texts: DataFrame | None = None) -> DataFrame:
    """Takes rows of each group in order, skips near-duplicates of taken ones, and fills up with skipped ones if asked to.

    rows(group, order, chunk_id, path, words). A list is walked in blocks of orders; what is kept goes on to
    the next block, until the limit is filled or the group ends. With texts(chunk_id, path, text) rows come without path and words: a block's
    rows of unfilled groups get paths, and words are met by pairs of one group and path alone (`_alike`); blocks start at half more than the limit
    and double up to `most`, as few groups need more."""
    at = [] if texts is not None else ["path", "words"]
    kind = "array<struct<o:int,chunk_id:string,path:string,no:int,words:array<string>>>"  # with texts, instead of the words: the earlier ones that are like it
    none = F.array().cast(kind)
    empty = F.struct(none.alias("kept"), none.alias("late"))
    def like(k: Column, x: Column) -> Column:
        return (k.path == x.path) & (overlap(k.words, x.words) >= OVERLAP) if texts is None else F.coalesce(F.array_contains(x.words, _name(k.chunk_id, k.no)), F.lit(False))
    def step(s: Column, x: Column) -> Column:
        same = F.exists(s.kept, lambda k: like(k, x))
        room = F.size(s.kept) < limit
        return F.struct(F.when(room & ~same, F.concat(s.kept, F.array(x))).otherwise(s.kept).alias("kept"), F.when(room & same & (F.size(s.late) < limit), F.concat(s.late, F.array(x))).otherwise(s.late).alias("late"))
    def filled_up(s: Column) -> Column:
        bare = lambda l: F.transform(l, lambda x: x.withField("words", F.array().cast("array<string>")))
        return F.when(F.lit(texts is not None) | (F.size(s.kept) >= limit), F.struct(bare(s.kept).alias("kept"), bare(s.late).alias("late"))).otherwise(s)
    def walked(part: DataFrame, state: DataFrame | None) -> DataFrame:
        entry = F.struct(F.col(order).cast("int").alias("o"), "chunk_id", "path", "no" if texts is not None else F.lit(None).cast("int").alias("no"), "words" if texts is None else F.array().cast("array<string>").alias("words"))
        lists = part.groupBy(group).agg(F.sort_array(F.collect_list(entry)).cast(kind).alias("l"))
        before = lists.select(group, "l", empty.alias("s")) if state is None else state.join(lists, group, "full").select(group, F.coalesce("l", none).alias("l"), F.coalesce("s", empty).alias("s"))
        if texts is not None:
            before = _likened(written(before.withColumn("r", F.monotonically_increasing_id())), named)
        return written(before.select(group, F.aggregate("l", "s", step, filled_up).alias("s")))
    named = None if texts is None else _named(texts)
    rows = rows.select(group, order, "chunk_id", *at)
    rows = written(rows) if texts is None else bucketed(rows, group)
    edges = rows.agg(F.min(order), F.max(order)).first()
    full = F.size("s.kept") >= limit
    start, state, done, block = edges[0] or 0, None, [], most if texts is None else min(limit + limit // 2 + 1, most)
    while state is None or start <= edges[1]:
        left = rows.where(F.col(order) >= start)
        if state is not None:
            left = left.join(reduce(DataFrame.unionByName, [x.select(group) for x in done]), group, "left_anti")
            least = left.agg(F.min(order)).first()[0]
            if least is None:
                break
            start = least
        part = left.where((F.col(order) >= start) & (F.col(order) < start + block))
        state = walked(part if texts is None else _worded(part, named), state)
        done.append(state.where(full))
        state = state.where(~full)
        start, block = start + block, min(block * 2, most)
    state = reduce(DataFrame.unionByName, done, state)
    if not fill:
        return state.select(group, F.explode("s.kept").alias("x")).select(group, F.col("x.chunk_id").alias("chunk_id"), F.col("x.o").alias(order))
    filled = state.select(group, F.concat("s.kept", F.slice("s.late", F.lit(1), F.greatest(F.lit(limit) - F.size("s.kept"), F.lit(0)))).alias("l"))
    return filled.select(group, F.explode("l").alias("x")).select(group, F.col("x.chunk_id").alias("chunk_id"), F.col("x.o").alias(order))


def _words(text: Column) -> Column:
    return F.coalesce(F.array_distinct(terms(text)), F.array().cast("array<string>"))


def _name(chunk_id: Column, no: Column) -> Column:
    """One string for a chunk and the number of its text."""
    return F.concat(no.cast("string"), F.lit(":"), chunk_id)


def _named(texts: DataFrame) -> DataFrame:
    """texts(chunk_id, path, text) with `no`, which numbers those of one chunk by path and words."""
    texts = texts.select("chunk_id", "path", "text").where("chunk_id is not null")
    again = written(texts.groupBy("chunk_id").count().where("count > 1").select("chunk_id"))
    if again.isEmpty():
        return texts.withColumn("no", F.lit(0))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("path", "words"))
    repeated = texts.join(small(again), "chunk_id", "left_semi").withColumn("words", _words(F.col("text"))).withColumn("no", place).drop("words")
    return texts.join(small(again), "chunk_id", "left_anti").withColumn("no", F.lit(0)).unionByName(repeated)


def _worded(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with path and text number of their chunk; a chunk without a text is like no other."""
    return rows.join(named.select("chunk_id", "path", "no"), "chunk_id", "left")


def _likened(lists: DataFrame, named: DataFrame) -> DataFrame:
    """lists(r, l, s) whose entries have, in place of words, the names of those before them in l, or kept, that they are near-duplicates of."""
    before = lambda x, i: F.filter(F.concat("s.kept", F.slice("l", F.lit(1), i)), lambda k: k.path == x.path)
    pair = lambda k, x: F.struct(x.path.alias("path"), _name(k.chunk_id, k.no).alias("a"), _name(x.chunk_id, x.no).alias("b"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(before(x, i), lambda k: pair(k, x))))
    near = written(_alike(lists.select("r", F.inline(pairs)), named))
    found = near.groupBy("r", "b").agg(F.collect_set("a").alias("a")).groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("b", "a"))).alias("near"))
    if near.limit(PAIRS + 1).count() <= PAIRS:
        found = F.broadcast(found)
    of = lambda x: F.coalesce(F.try_element_at("near", _name(x.chunk_id, x.no)), F.array().cast("array<string>"))
    return lists.join(found, "r", "left").withColumn("l", F.transform("l", lambda x: x.withField("words", of(x))))


def _alike(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(r, a, b) of pairs(r, path, a, b), names of texts of one path, whose word sets overlap by OVERLAP.

    A task meets two parts of a path's texts, of some PART bytes each, with the pairs between them: a text's words travel once for each part of
    its path, whatever the number of its pairs. They are compared as numbers that the task gives them."""
    pairs = written(pairs)
    texts = named.select("path", _name(F.col("chunk_id"), F.col("no")).alias("name"), "text")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    if asked.limit(PAIRS + 1).count() <= PAIRS:
        texts = texts.join(F.broadcast(asked), "name", "left_semi")  # else most are asked for, and texts would be shuffled to drop few
    parts = small(written(texts.groupBy("path").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("text")) / PART)).cast("int").alias("n"))))
    part = lambda c: F.pmod(F.xxhash64(c), "n").cast("int")
    left = pairs.join(parts, "path").withColumns({"_a": part("a"), "_b": part("b")}).select("path", F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), "r", "a", "b")
    words = texts.select("path", "name", F.array_join(_words(F.col("text")), " ").alias("words")).join(parts, "path").withColumn("at", part("name"))
    right = words.select("path", "name", "words", "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("to")).select("path", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "name", "words")
    least = OVERLAP

    def compare(asked: pa.Table, texts: pa.Table) -> pa.Table:
        if not asked.num_rows or not texts.num_rows:
            return asked.select(["r", "a", "b"]).slice(0, 0)
        joined, names = texts.column("words").combine_chunks(), texts.column("name").combine_chunks()
        lists = pc.split_pattern(joined, " ")
        codes = lists.flatten().dictionary_encode()
        size = np.where(pc.equal(joined, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        start = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)])[:-1]
        marked, codes = np.zeros(len(codes.dictionary), bool), codes.indices.to_numpy(zero_copy_only=False)
        a, b = (pc.index_in(asked.column(c).combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
        alike, last = np.zeros(len(a), bool), -1
        for k in np.argsort(a, kind="stable"):
            x, y = a[k], b[k]
            if x != last:
                if last >= 0:
                    marked[codes[start[last] : start[last] + size[last]]] = False
                marked[codes[start[x] : start[x] + size[x]]] = True
                last = x
            n = min(size[x], size[y])
            alike[k] = n > 0 and np.count_nonzero(marked[codes[start[y] : start[y] + size[y]]]) / n >= least
        return asked.select(["r", "a", "b"]).filter(pa.array(alike))

    by = ["path", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "r long, a string, b string")


def select_evidence(ranked: DataFrame, texts: DataFrame, limit: int = 12, reserve: int = 3) -> DataFrame:
    """Up to `reserve` distinct ones of the original query's best hits, then the ranked rest, without near-duplicates while others are left.

    The original hits are walked until `reserve` distinct ones are found; those passed over on the way are the first to fill up."""
    by = ["question_id", "chunk_id"]
    own = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("original_score"), "original_rank", "chunk_id"))
    ranked = bucketed(ranked.where("question_id is not null"), "question_id")  # rows of no question were never selected
    hits = ranked.where("original_hit").withColumn("o", own).select(*by, "position", "o")
    first = greedy(hits, min(reserve, limit), order="o", fill=False, texts=texts).groupBy("question_id").agg(F.collect_list("chunk_id").alias("taken"))
    walk = hits.join(first, "question_id", "left").select(*by, "position", "o", F.coalesce(F.array_contains("taken", F.col("chunk_id")), F.lit(False)).alias("kept"))
    whole = Window.partitionBy("question_id")
    walk = walk.withColumns({"n": F.count_if("kept").over(whole), "last": F.max(F.when(F.col("kept"), F.col("o"))).over(whole)})
    walk = walk.select(*by, "position", "o", F.when(F.col("kept"), 0).when(F.col("chunk_id").isNotNull() & ((F.col("n") < min(reserve, limit)) | (F.col("o") < F.col("last"))), 1).otherwise(2).alias("part"))  # a null id has no turn of its own
    rest = ranked.where("original_hit is null or not original_hit").select(*by, "position", F.lit(None).cast("int").alias("o"), F.lit(2).alias("part"))
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy("part", F.when(F.col("part") < 2, F.col("o")), "position"))
    every = walk.unionByName(rest).withColumn("turn", turn)
    chosen = greedy(every, limit, order="turn", texts=texts).groupBy("question_id").agg(F.collect_list("chunk_id").alias("_chosen"))
    return ranked.join(chosen, "question_id").where(F.array_contains("_chosen", F.col("chunk_id"))).drop("_chosen")


def content_terms(c: Column, stop=()) -> Column:
    return F.filter(F.array_distinct(terms(c)), lambda t: (F.length(t) >= 3) & ~t.isin(*CONTENT_STOP, *stop))


def query_aware_rank(merged: DataFrame, asked: DataFrame, texts: DataFrame, stop=()) -> DataFrame:
    """merged with pipeline_score: best score, the best share of any of the question's queries' terms that the text holds, and passage_score if there is one."""
    lists = asked.groupBy("question_id").agg(F.collect_list(content_terms(F.col("query"), stop)).alias("queries"))
    rows = merged.join(lists, "question_id").join(texts.select("chunk_id", content_terms(F.col("text"), stop).alias("t")), "chunk_id")
    share = F.array_max(F.transform("queries", lambda q: F.coalesce(F.size(F.array_intersect(q, F.col("t"))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))))
    passage = F.coalesce("passage_score", F.lit(0.0)) if "passage_score" in merged.columns else F.lit(0.0)
    out = rows.withColumn("pipeline_score", F.round(F.col("best_score") + 0.030 * share + 0.010 * passage, 6)).drop("queries", "t")
    order = Window.partitionBy("question_id").orderBy(F.desc("pipeline_score"), F.desc("best_score"), "best_rank", "chunk_id")
    return out.withColumn("position", F.row_number().over(order))


def guarded_select(ranked: DataFrame, batches: DataFrame, chosen: DataFrame, texts: DataFrame, limit: int = 8, anchors: int = 4) -> DataFrame:
    """The best of each of the first `anchors` queries, then chosen(question_id, chunk_id, ord), then the ranked rest."""
    best = batches.where(F.col("query_ord") <= anchors).groupBy("question_id", "query_ord").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id")).groupBy("question_id", "chunk_id").agg(F.min("query_ord").alias("_a"))
    rows = ranked.join(best, ["question_id", "chunk_id"], "left").join(chosen.select("question_id", "chunk_id", F.col("ord").alias("_c")), ["question_id", "chunk_id"], "left")
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.coalesce("_a", F.lit(1000)), F.coalesce("_c", F.lit(1000)), "position"))
    return greedy(rows.withColumn("turn", turn), limit, order="turn", texts=texts)


def procedural_anchor(candidates: DataFrame) -> DataFrame:
    """The candidate of each question with most procedural wording.

    A generator counts the wording: a text is folded once, where a filter over columns would fold it anew for each phrase."""
    has = lambda low, ps: sum((F.when(low.contains(p), 1).otherwise(0) for p in ps), F.lit(0))
    counted = F.transform(F.array(fold(F.col("text"))), lambda low: F.struct(has(low, STRONG).alias("strong"), has(low, MEDIUM).alias("medium")))
    rows = candidates.select("*", F.inline(counted)).where("strong + medium > 0").withColumn("total", F.col("strong") * 4 + F.col("medium"))
    order = Window.partitionBy("question_id").orderBy(F.desc("total"), F.desc("strong"), F.desc("medium"), F.desc("score"), "chunk_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "text")


def decision(c: Column) -> Column:
    plain = F.upper(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z_ ]+", " "), r"^\s+|\s+$", ""))
    return F.when(plain.rlike(r"^YES\b"), "YES").when(plain.rlike(r"^NO\b"), "NO").otherwise("CANNOT_DETERMINE")


def rescue_merge(selected: DataFrame, rescue: DataFrame, decisions: DataFrame, texts: DataFrame, limit: int = 8, most: int = 4) -> DataFrame:
    """For undecided questions up to `most` rescue rows come before the first-pass evidence, up to `limit`."""
    open_ = decisions.where("decision = 'CANNOT_DETERMINE'").select("question_id")
    late = selected.join(open_, "question_id", "left_semi").select("question_id", "chunk_id", (F.col("position") + 1000).alias("position"))
    new = rescue.where(F.col("position") <= most).join(open_, "question_id", "left_semi").select("question_id", "chunk_id", "position")
    rows = new.unionByName(late).groupBy("question_id", "chunk_id").agg(F.min("position").alias("p"))
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy("p", "chunk_id"))
    return greedy(rows.withColumn("turn", turn), limit, order="turn", texts=texts)
