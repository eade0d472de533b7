"""Windows of a fixed number of units (words or bytes) that occur more than once in a corpus.

Equal windows have equal content-defined anchors: of the short grams inside a window, the one with the least
hash (the leftmost of equals) stands for it. So a window can occur twice only if its anchor does, and equal
windows always meet under the same anchor. The search has these steps, none of which pairs documents:

1. every distinct text is kept once in a table bucketed by its key; its anchors are written once and counted in Spark;
2. runs of windows whose anchor occurs twice or more are pieces, which a 128-bit hash of their content stands for;
3. equal pieces of an anchor are counted, combining before the shuffle; those found twice are repeated throughout, and
   the places of a piece are never gathered, they only join its key with skew handling;
4. of the kinds of pieces that are left, one of each is cut out of its text and its windows are compared under their anchor.

Where an anchor has more than `CROWD` kinds (near copies that all differ close to it), these are searched again under
longer anchors, which fewer and fewer of the edits leave out, in the end under whole windows, by steps 3 and 4. So no task gets more than that many kinds, and none are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, mix, packed, polynomial, texts_of, word_hashes, words_of

#: Kinds of pieces of one anchor up to which they are brought together in one task as they are.
CROWD = 250
#: Units whose anchors are searched at once, whatever the length of a text.
SEGMENT = 1 << 17
TEXT = ["k1", "k2"]
KIND = ["anchor", "p1", "p2"]


@dataclass(frozen=True)
class Units:
    """What a text is made of, the window's length and the anchors' length, all in units."""

    words: bool
    window: int
    gram: int

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that stand for the units of a block of texts, and each text's first unit."""
        if not self.words:
            return data, offsets
        starts, ends, first = words_of(data, offsets)
        return word_hashes(data, starts, ends), first

    def numbers(self, units: np.ndarray) -> np.ndarray:
        return units if self.words else units.astype(np.uint64) + np.uint64(1)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value, the leftmost of equals, in every `width` consecutive values.

    Of each value the upper 32 bits count; the index below them makes each entry different."""
    best, size = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(units: np.ndarray, first: np.ndarray, u: Units, keyed: bool = False) -> list[np.ndarray]:
    """Runs of windows with the same anchor place: row, first window, last window (block-wide), anchor; keyed: and two hashes of the run's units.

    Runs end where a segment does, so a long text takes no more memory than a short one."""
    n = len(units) - u.window + 1
    row_of = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    out = []
    for s in range(0, n, SEGMENT):
        part = u.numbers(units[s : min(s + SEGMENT, n) + u.window - 1])
        places = np.arange(len(part) - u.gram + 1)
        grams = mix(polynomial(part, places, places + u.gram))
        anchor = leftmost_minima(grams, u.window - u.gram + 1)
        row = row_of[s : s + len(anchor)]
        windows = np.flatnonzero(np.arange(s, s + len(anchor)) + u.window <= first[row + 1])
        if not len(windows):
            continue
        a, r = anchor[windows], row[windows]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]))))
        last = np.concatenate((new[1:], [len(windows)])) - 1
        found = [r[new], windows[new] + s, windows[last] + s, grams[a[new]]]
        if keyed:
            begin, end = windows[new], windows[last] + u.window
            found += [mix(polynomial(part, begin, end)), mix(polynomial(mix(part), begin, end) + (end - begin).astype(np.uint64))]
        out.append(found)
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * (3 if keyed else 1)
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, text, copies) for each distinct non-null text, told apart by a 128-bit key; copies combine before the shuffle."""
    keyed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), F.col(text).alias("text"))
    return keyed.groupBy(*TEXT).agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _anchors(texts: DataFrame, u: Units) -> DataFrame:
    """(k1, k2, anchor, n): each text's anchors and the places it has for each."""

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for a, b in blocks(offsets):
                row, _, _, anchor = runs(*u.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), u)
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])))) if len(row) else order
                at = pa.array(row[new] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor[new].view(np.int64)), pa.array(np.diff(np.append(new, len(row))).astype(np.int32))], names=[*TEXT, "anchor", "n"])

    return texts.select(*TEXT, "text").mapInArrow(work, "k1 long, k2 long, anchor long, n int")


def _tagged(row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return mix(anchor + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size))).astype(np.int64)


def _batch(row: np.ndarray, a: int, given: list[pa.Array], names: list[str], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The given columns at rows a + row, and new ones."""
    at = pa.array(row + a)
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in given), *(pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int32)) for v in columns.values())], names=[*names, *columns])


PIECE = "k1 long, k2 long, anchor long, p1 long, p2 long, begin int, n_windows int"


def _pieces(texts: DataFrame, u: Units) -> DataFrame:
    """(k1, k2, anchor, p1, p2, begin, n_windows): the runs of texts(k1, k2, text, anchors) under the listed anchors; p1 and p2 stand for their content."""

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            flat, bounds = _flat(batch.column(3))
            for a, b in blocks(offsets):
                units, first = u.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, begin, end, anchor, p1, p2 = runs(units, first, u, True)
                wanted = _tagged(np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])), flat[bounds[a] : bounds[b]].astype(np.int64).view(np.uint64))
                pick = np.flatnonzero(np.isin(_tagged(row, anchor), wanted))
                row, begin, end = row[pick], begin[pick], end[pick]
                yield _batch(row, a, [batch.column(0), batch.column(1)], TEXT, {"anchor": anchor[pick], "p1": p1[pick], "p2": p2[pick], "begin": begin - first[row], "n_windows": end - begin + 1})

    return texts.select(*TEXT, "text", "anchors").mapInArrow(work, PIECE)


def _contents(texts: DataFrame, kinds: DataFrame, u: Units) -> DataFrame:
    """(k1, k2, anchor, n, begin, n_windows, piece): kinds(anchor, n, at) with their content, cut out of the text they are in.

    A piece is the bytes of a run, or the hashes of its windows for words."""
    lists = kinds.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_list(F.struct("anchor", "n", "at.begin", "at.n_windows")).alias("l"))
    wanted = texts.join(lists, TEXT).select(*TEXT, "text", *[F.col(f"l.{c}").alias(c) for c in ("anchor", "n", "begin", "n_windows")])

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            (anchor, bounds), n, begin, size = _flat(batch.column(3)), *(_flat(batch.column(i))[0] for i in (4, 5, 6))
            for a, b in blocks(offsets):
                bytes_, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                units, first = u.of(bytes_, o)
                here = slice(bounds[a], bounds[b])
                row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                start, count = first[row] + begin[here], size[here].astype(np.int64)
                if u.words:
                    to = np.concatenate(([0], np.cumsum(count)))
                    at = np.repeat(start - to[:-1], count) + np.arange(to[-1])
                    piece = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(polynomial(units, at, at + u.window).view(np.int64)))
                else:
                    piece = pa.array([bytes_[x : x + c + u.window - 1].tobytes() for x, c in zip(start.tolist(), count.tolist(), strict=True)], pa.binary())
                yield _batch(row, a, [batch.column(0), batch.column(1)], TEXT, {"anchor": anchor[here].astype(np.int64).view(np.uint64), "n": np.minimum(n[here], 2), "begin": begin[here], "n_windows": count}).append_column("piece", piece)

    return wanted.mapInArrow(work, f"k1 long, k2 long, anchor long, n int, begin int, n_windows int, piece {'array<long>' if u.words else 'binary'}")


def _closer(kinds: DataFrame, u: Units, gram: int) -> DataFrame:
    """The runs of the windows of kinds(k1, k2, anchor, begin, piece), as from _pieces, under anchors of `gram` units; for words each window is its own."""
    if u.words:
        each = kinds.select(*TEXT, "anchor", "begin", F.posexplode("piece").alias("i", "h"))
        return each.select(*TEXT, F.xxhash64("anchor", "h").alias("anchor"), F.col("h").alias("p1"), F.col("h").alias("p2"), (F.col("begin") + F.col("i")).alias("begin"), F.lit(1).alias("n_windows"))
    v = Units(False, u.window, gram)

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(4))
            old, begin = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            for a, b in blocks(offsets):
                first = offsets[a : b + 1] - offsets[a]
                row, start, end, anchor, p1, p2 = runs(data[offsets[a] : offsets[b]], first, v, True)
                yield _batch(row, a, [batch.column(0), batch.column(1)], TEXT, {"anchor": mix(anchor + old[a + row]), "p1": p1, "p2": p2, "begin": begin[a + row] + start - first[row], "n_windows": end - start + 1})

    return kinds.select(*TEXT, "anchor", "begin", "piece").mapInArrow(work, PIECE)


def _resolved(texts: DataFrame, pieces: DataFrame, u: Units, compare: Callable[[DataFrame], DataFrame], scratch: Scratch, gram: int) -> DataFrame:
    """(k1, k2, begin, end): spans of the windows of pieces, as from _pieces, that occur twice or more.

    Anchors here are of `gram` units; a window's length itself needs no further step."""
    pieces = scratch.keep(pieces)
    kinds = scratch.keep(pieces.groupBy(*KIND).agg(F.count("*").alias("n"), F.min(F.struct(*TEXT, "begin", "n_windows")).alias("at")))
    twice = scratch.keep(kinds.where("n > 1").select(*KIND))
    same = pieces.join(twice, KIND).select(*TEXT, "begin", (F.col("begin") + F.col("n_windows") - 1 + u.window).alias("end"))
    # Only anchors under which a kind of one place could meet another kind are brought together.
    per = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).where("kinds > 1 and single > 0")
    per = scratch.keep(per.select("anchor", (F.col("kinds") > CROWD).alias("crowd")))
    left = kinds.join(per, "anchor")
    if gram == u.window or per.where("crowd").isEmpty():
        return same.unionByName(compare(_contents(texts, left, u)))
    longer = u.window if u.words else u.window - (u.window - gram) // 8
    # Written first: two Python steps in one stage would hold twice the workers.
    crowd = scratch.keep(_contents(texts, left.where("crowd"), u))
    again = _resolved(texts, _closer(crowd, u, longer), u, compare, scratch, longer)
    return same.unionByName(again).unionByName(compare(_contents(texts, left.where("not crowd"), u)))


def counted(kinds: DataFrame, u: Units) -> DataFrame:
    """(k1, k2, begin, end): windows of kinds of one place that also occur elsewhere, by counting their hashes under each anchor."""
    there = kinds.repartition("anchor").select(*TEXT, "anchor", "n", "begin", F.posexplode("piece").alias("i", "h"))
    found = there.withColumn("m", F.count("*").over(Window.partitionBy("anchor", "h"))).where("m > 1 and n = 1")
    begin = F.col("begin") + F.col("i")
    return found.select(*TEXT, begin.alias("begin"), (begin + u.window).alias("end"))


def repeated_spans(docs: DataFrame, u: Units, scratch: Scratch, compare: Callable[[DataFrame], DataFrame] | None = None, text: str = "text") -> DataFrame:
    """(k1, k2, text, copies, begins, ends) for each distinct text.

    begins and ends are units; a text with copies is repeated throughout. `compare` maps kinds of pieces with their contents
    (anchor, n, piece, and one place k1, k2, begin; n is 1 or, for more places, 2) to spans (k1, k2, begin, end) of those of one place; without it the windows' hashes are counted.
    """
    texts = scratch.bucketed(distinct_texts(docs, text), *TEXT)
    places = scratch.keep(_anchors(texts, u))
    often = scratch.keep(places.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    lists = places.join(often, "anchor").groupBy(*TEXT).agg(F.collect_list("anchor").alias("anchors"))
    spans = _resolved(texts, _pieces(texts.join(lists, TEXT), u), u, compare or (lambda kinds: counted(kinds, u)), scratch, u.gram)
    grouped = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("begin", "end")).alias("s")).select(*TEXT, F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))
    return texts.join(grouped, TEXT, "left")


def covered(begins, ends, n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if begins is not None and len(begins):
        np.add.at(edge, np.asarray(begins, np.int64), 1)
        np.add.at(edge, np.asarray(ends, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal true runs."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def attach(docs: DataFrame, results: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """docs (without its text) with the columns that results(k1, k2, ...) has for each row's text, null if none.

    Rows travel as one structure, so that no input column clashes with the keys."""
    row, given = packed(docs, (*columns, text))
    keyed = docs.select(row, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    return keyed.join(results.select(*TEXT, *columns), TEXT, "left").select(*given(), *columns)
