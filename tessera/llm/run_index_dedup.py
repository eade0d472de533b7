"""Long repeated byte strings by a run-length compressed Burrows-Wheeler index.

Candidate pieces meet under their anchor (see repeats.py); of all the different pieces of an anchor an index
is built: suffix order by prefix doubling, Burrows-Wheeler transform, its equal-letter runs, and for the first and
last row of each run a sample of the row's text position with its match length to the neighbouring row outside
the run. Inside a run, and only there, the match length falls by one from a text position to the next, so
the matching statistics of all positions stream from the samples alone. Positions that match somewhere else for
the whole window are marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, texts_of
from .repeats import TEXT, Units, attach, covered, repeated_spans, spans_of

WINDOW, GRAM = 400, 64
#: Bytes of pieces in one index, about; an anchor's pieces stay together.
INDEX = 1 << 18
#: Letters packed into the first sort key, of 9 bits each.
PACKED = 7


class RunIndex:
    """The run-length index of several pieces, each ended by a separator of its own."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)))
        n = int(self.first[-1])
        last = self.first[1:] - 1
        inside = np.ones(n, bool)
        inside[last] = False
        #: Letters from 1 on; all separators are 0 here, the earlier one is the lesser.
        self.text = np.zeros(n + PACKED, np.int64)
        self.text[:n][inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(PACKED):
            key |= np.where(open_, self.text[k : k + n], 0) << (9 * (PACKED - 1 - k))
            open_ &= self.text[k : k + n] > 0
        # Keys that hold a separator are different from all others; their order is that of their places.
        order = np.argsort(key)
        closed = np.flatnonzero(~open_)
        order[np.flatnonzero(~open_[order])] = closed[np.lexsort((closed, key[closed]))]
        new = np.concatenate(([True], (key[order[1:]] != key[order[:-1]]) | ~open_[order[1:]]))
        rank, width = np.empty(n, np.int64), PACKED
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels: list[tuple[int, np.ndarray]] = []
        tied = order[~(new & np.append(new[1:], True))]
        while True:
            self.levels.append((width, rank.astype(np.int32)))
            if not len(tied):
                break
            # Only suffixes that share their rank are sorted on; a rank is the first row of those that share it.
            key = rank[tied] * (n + 1) + rank[tied + width]
            tied = tied[np.argsort(key)]
            group, after = rank[tied], rank[tied + width]
            fresh = np.concatenate(([True], group[1:] != group[:-1]))
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
            new = fresh | np.concatenate(([True], after[1:] != after[:-1]))
            place = np.maximum.accumulate(np.where(new, group + np.arange(len(tied)) - start, 0))
            rank = rank.copy()
            rank[tied] = place
            tied = tied[~(new & np.append(new[1:], True))]
            width *= 2
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)
        # Each separator is a letter of its own.
        letters = np.where(inside, self.text[:n], -np.searchsorted(last, np.arange(n)))[rows - 1]
        change = letters[1:] != letters[:-1]
        heads, tails = np.flatnonzero(np.concatenate(([True], change))), np.flatnonzero(np.concatenate((change, [True])))
        #: The transform as runs: letter and length.
        self.letters, self.lengths = letters[heads], np.diff(np.concatenate((heads, [n])))
        #: Samples: text position of a run's first (last) row, and its match with the row before (after).
        self.heads = rows[heads], np.where(heads > 0, self.common(rows[heads], rows[heads - 1]), 0)
        self.tails = rows[tails], np.where(tails < n - 1, self.common(rows[tails], rows[(tails + 1) % n]), 0)
        self.n = n

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y; separators never match."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        differ, n = x != y, len(self.levels[0][1])
        for width, rank in reversed(self.levels):
            same = differ & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            out[same] += width
            x[same] += width
            y[same] += width
        for _ in range(PACKED - 1):
            differ = differ & (self.text[x] == self.text[y]) & (self.text[x] > 0)
            out[differ] += 1
            x[differ] += 1
            y[differ] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position of the text, the longest match that starts there and also starts elsewhere."""
        best = np.zeros(self.n, np.int64)
        for at, length in (self.heads, self.tails):
            order = np.argsort(at)
            at, length = at[order], length[order]
            near = np.searchsorted(at, np.arange(self.n), "right") - 1
            value = np.where(near >= 0, length[near] - (np.arange(self.n) - at[near]), 0)
            np.maximum(best, value, out=best)
        return best


def repeated_starts(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each distinct piece, the starts of windows that also start elsewhere in the pieces."""
    index = RunIndex(pieces)
    hits = np.flatnonzero(index.matching_statistics() >= window)
    cuts = np.searchsorted(hits, index.first)
    return [hits[a:b] - f for a, b, f in zip(cuts, cuts[1:], index.first, strict=False)]


def compare(kinds: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, begin, end) in bytes: windows of kinds of one place that also occur in other kinds of their anchor, or again in their own."""

    def solve(pieces: list[bytes], single: list[tuple[int, int, int] | None]):
        k1, k2, begins, ends = [], [], [], []
        for s, place in zip(repeated_starts(pieces, window), single, strict=True):
            if place is None or not len(s):
                continue
            gap = np.flatnonzero(np.diff(s) > 1)
            for a, b in zip(s[np.concatenate(([0], gap + 1))].tolist(), (s[np.concatenate((gap, [len(s) - 1]))] + window).tolist(), strict=True):
                k1.append(place[0])
                k2.append(place[1])
                begins.append(place[2] + a)
                ends.append(place[2] + b)
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=[*TEXT, "begin", "end"])

    def work(batches):
        pieces: list[bytes] = []
        single: list[tuple[int, int, int] | None] = []
        last, size = None, 0
        for batch in batches:
            for anchor, n, piece, *place in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if anchor != last and size > INDEX:
                    yield solve(pieces, single)
                    pieces, single, size = [], [], 0
                last = anchor
                pieces.append(piece)
                single.append(tuple(place) if n == 1 else None)
                size += len(piece)
        if pieces:
            yield solve(pieces, single)

    dealt = kinds.select("anchor", "n", "piece", "k1", "k2", "begin").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, "k1 long, k2 long, begin int, end int")


def kept_bytes(docs: DataFrame, text: str = "text", window: int = WINDOW, project=None) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, begins, ends, kept) for each distinct non-null text; kept is binary.

    begins and ends are the maximal removed runs of bytes. `project` narrows the result before it is written.
    """
    u = Units(words=False, window=window, gram=max(1, min(GRAM, window // 2)))

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            copies, rows = batch.column(3).to_pylist(), []
            for i in range(len(copies)):
                own = data[offsets[i] : offsets[i + 1]]
                begins, ends = batch.column(4)[i].values, batch.column(5)[i].values
                mask = covered(None if begins is None else begins.to_numpy(), None if ends is None else ends.to_numpy(), len(own))
                if copies[i] > 1 and len(own) >= window:
                    mask[:] = True
                b, e = spans_of(mask)
                rows.append((len(own), int(mask.sum()), b.tolist(), e.tolist(), own[~mask].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.binary())],
                                             names=["k1", "k2", "n_bytes", "n_removed", "begins", "ends", "kept"])

    with Scratch(docs.sparkSession) as scratch:
        found = repeated_spans(docs, u, scratch, lambda kinds: compare(kinds, window), text)
        out = found.select("k1", "k2", "text", "copies", "begins", "ends").mapInArrow(work, "k1 long, k2 long, n_bytes long, n_removed long, begins array<int>, ends array<int>, kept binary")
        return cut(out.select("k1", "k2", *project) if project else out)


def remove_long_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with `text` replaced by the bytes kept of it (binary), and n_bytes, n_removed and n_spans.

    One row for each row. A null text has no bytes and stays null; texts shorter than the window lose nothing; every
    row counts, so a repeated row that is long enough loses all its bytes. Added names replace input columns.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    out = attach(docs, kept_bytes(docs, text, window, ["n_bytes", "n_removed", F.size("begins").cast("long").alias("n_spans"), "kept"]), names, text)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in names[:3]}).withColumnRenamed("kept", text)
