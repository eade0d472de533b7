"""Substring dedup: words inside any window of `WINDOW` words that occurs more than once are removed.

Every window of consecutive words has a Rabin-Karp hash, by prefix sums over the hashes of its words; equal
windows are counted in Spark under their anchor (see repeats.py), and the repeated windows of a text
merge into maximal intervals of words, which are taken out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, texts_of
from .repeats import Units, attach, covered, repeated_spans, spans_of

WINDOW, GRAM = 35, 16


def kept_texts(docs: DataFrame, text: str = "text", window: int = WINDOW, project=None) -> DataFrame:
    """(k1, k2, n_words, n_removed, begins, ends, kept) for each distinct non-null text.

    begins and ends are the maximal removed intervals in words, kept is what remains, joined by single spaces.
    `project` (a list of column expressions) narrows the result before it is written to the shared folder.
    """
    u = Units(words=True, window=window, gram=max(1, min(GRAM, window // 2)))

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            raw, copies = data.tobytes(), batch.column(3).to_pylist()
            rows = []
            for i in range(len(copies)):
                words = raw[offsets[i] : offsets[i + 1]].split()
                begins, ends = batch.column(4)[i].values, batch.column(5)[i].values
                mask = covered(None if begins is None else begins.to_numpy(), None if ends is None else ends.to_numpy(), len(words))
                if copies[i] > 1 and len(words) >= window:
                    mask[:] = True
                b, e = spans_of(mask)
                kept = b" ".join(w for w, m in zip(words, mask.tolist(), strict=True) if not m) if len(b) else b" ".join(words)
                rows.append((len(words), int(mask.sum()), b.tolist(), e.tolist(), kept.decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.string())],
                                             names=["k1", "k2", "n_words", "n_removed", "begins", "ends", "kept"])

    with Scratch(docs.sparkSession) as scratch:
        found = repeated_spans(docs, u, scratch, text=text)
        out = found.select("k1", "k2", "text", "copies", "begins", "ends").mapInArrow(work, "k1 long, k2 long, n_words long, n_removed long, begins array<int>, ends array<int>, kept string")
        return cut(out.select("k1", "k2", *project) if project else out)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with `text` replaced by what is kept of it, and n_words and n_removed; one row for each row.

    A null text stays null with counts of 0; a text of fewer words than the window loses nothing, but its white
    space becomes single spaces. Every row counts, so a repeated row of enough words loses all of them. Input
    columns named n_words or n_removed are replaced, other columns are kept.
    """
    out = attach(docs, kept_texts(docs, text, window, ["n_words", "n_removed", "kept"]), ["n_words", "n_removed", "kept"], text)
    return out.withColumns({"n_words": F.coalesce("n_words", F.lit(0).cast("long")), "n_removed": F.coalesce("n_removed", F.lit(0).cast("long"))}).withColumnRenamed("kept", text)
