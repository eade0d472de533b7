"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes, for each of 64 bits, the majority over the XXH64 hashes of its word shingles.
Two fingerprints at most 3 bits apart agree in one of their two 32-bit halves but for at most one bit. So
the halves of all distinct fingerprints form a lookup table, every fingerprint probes it with the Hamming
ball of radius 1 around each of its halves, and complete distances are verified in the join. Of a pair
whose halves differ in a bit only the side with a 0 there needs to probe, which halves the ball.
Texts that share a fingerprint are one node, so copies are never paired with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import blocks, cut, packed, small_batches, texts_of
from .components import components

DISTANCE = 3


def fingerprint_of(words: list[bytes], width: int) -> int:
    """The fingerprint of one word sequence, as a signed 64-bit integer."""
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: 1 - width] + 1).tolist()] if width > 1 else [0, *(ends + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """docs with its text column replaced by the fingerprint (long); a null or empty text has fingerprint 0."""
    keep = [c for c in docs.columns if c not in (text, name)]
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = texts_of(column)
            out = []
            for a, b in blocks(offsets):
                raw = data[offsets[a] : offsets[b]].tobytes().lower()
                o = (offsets[a : b + 1] - offsets[a]).tolist()
                out += [fingerprint_of(raw[x:y].split(), width) for x, y in zip(o, o[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.int64())], names=[*keep, name])

    schema = docs.select(*keep, F.lit(0).cast("long").alias(name)).schema
    return docs.select(*keep, text).mapInArrow(work, schema)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of different fingerprints of prints(fp) at most 3 bits apart, from multi-index hashing."""
    halves = prints.select("fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF))).alias("part", "half"))
    table = halves.select("part", "half", F.col("fp").alias("b"))
    ball = F.concat(F.array("half"), F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("half").bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), i).cast("long"))), lambda x: x != F.col("half")))
    probes = halves.select(F.col("fp").alias("a"), "part", F.col("half").alias("own"), F.explode(ball).alias("half"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return probes.join(table, ["part", "half"]).where(near & ((F.col("own") != F.col("half")) | (F.col("a") < F.col("b")))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of docs: the smallest id among all rows that links reach.

    Rows with a null id take part; their group's smallest non-null id is its component (null if it has none).
    Texts without words share fingerprint 0 and are linked like any other. Repeated rows each give a row;
    other columns of docs are ignored; an empty table gives an empty one.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col), F.col(text)), text, width))
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(nodes.select("fp")))
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id")).join(grouped.select("fp", "root"), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def hex_digits(fp):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: a Jaccard similarity of 0.8 or more on word shingles (see near_copies).

    The row with the smallest id stays, one with a null id only if the group has no other; of rows with equal ids the one with the least
    hash of all its columns, and of rows that are equal in all columns one. Texts without words are copies of each other."""
    row, columns = packed(docs)
    marked = docs.select(row, F.xxhash64(*[F.col(c) for c in docs.columns]).alias("key"), F.xxhash64(F.lit(7), *[F.col(c) for c in docs.columns]).alias("key2"))
    name = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("k"), F.xxhash64(F.lit(7), *[F.col(c) for c in docs.columns]).alias("k2"))
    found = near_copies.groups(docs.select(name.alias("id"), F.col(text).alias("text")), "id", "text", width)
    first = found.where(F.col("id") == F.col("component_id")).select(F.col("id.k").alias("key"), F.col("id.k2").alias("key2")).distinct()
    return marked.join(first, ["key", "key2"], "left_semi").dropDuplicates(["key", "key2"]).select(*columns())
