"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, by SimHash and multi-index hashing.

At that similarity 64 bits differ in about ten, too many for a ball of a few bits, so a text gets a wide fingerprint of
independent segments (each bit the majority over the hashes of its distinct shingles). A bit of two
texts at similarity 0.8 differs with probability 0.15, two segments of 20 bits are at most one bit apart with 0.18, and
any of 16 pairs of segments with 0.95; more similar texts are found more often. Segments get as many bits as keep random meetings rare
for the number of rows, and there are as many as keep that 0.95 (`shape`). Every text probes the table of each
segment with the ball of radius 1 around its own, half of it, as the side with a 0 in a differing bit is enough;
the distance of 64 bits is verified in the join, that of all bits after it, and then the similarity itself on the whole sets.

Equal sets are one node. A large group of near copies is not paired with itself: where many nodes share a segment they
are compared with one of them first, which joins most of them. All nodes that probe such a place then meet by what differs from the set
of one node there (`differing`): two similar ones must share some of the rarest of these shingles, at places early enough, while
unlike copies of one text share little of what they changed, however alike their fingerprints are. This loses no pair. Nodes that have
met this way around the same node are not paired in the smaller places that they share as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, broadcast_if_small, cut, lowered, mix, powers, texts_of, word_hashes, words_of
from .components import components

#: Least bits of a segment, the probability that a bit differs at similarity 0.8, and that with which such a pair shall meet.
BITS, DIFFERS, RECALL = 20, 0.15, 0.95
#: Bits that may differ of the first 64 before sets are compared: at similarity 0.8 it is 10 on average, more than 18 in one pair of 500 or less.
FAR = 18
#: Nodes in one segment's place beyond which they are compared with one of them, and how often, and then meet by what differs from one.
CROWD, ROUNDS = 16, 3
#: Parts that the nodes around one node are dealt into.
SALTS = 16
_FACTOR = 0x9E3779B97F4A7C15


def shape(rows: int) -> tuple[int, int]:
    """(segments, bits) for so many rows: no more rows than places, and a pair at similarity 0.8 meets with probability RECALL."""
    bits = max(BITS, (max(rows, 1) - 1).bit_length())
    meet = (1 - DIFFERS) ** bits + bits * DIFFERS * (1 - DIFFERS) ** (bits - 1)
    return round(math.log(1 - RECALL) / math.log(1 - meet)), bits


def far_all(segments: int, bits: int) -> int:
    """Bits of all words that may differ: 3.4 standard deviations above the mean at similarity 0.8, 70 of 320."""
    n = 64 * -(-segments * bits // 64)
    return round(DIFFERS * n + 3.4 * math.sqrt(DIFFERS * (1 - DIFFERS) * n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the bounds of each row; a shorter text is one shingle."""
    data = lowered(data)
    starts, ends, before = words_of(data, offsets)
    w = word_hashes(data, starts, ends)
    n_words = np.diff(before)
    n = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    at = before[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(row), np.uint64)
    for k, factor in enumerate(powers(width + 1, _FACTOR)[1:]):
        inside = at + k < before[row + 1]
        h[inside] += mix(w[at[inside] + k]) * factor
    h = mix(h).view(np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def bit_counts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 64): how many of each row's hashes h[at[i]:at[i + 1]] have each bit, for rows that are not empty.

    Eight counters of a byte are added at once, over at most 255 hashes; these sums then add up to rows."""
    size = np.diff(at)
    parts = -(-size // 255)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(at[:-1], parts) + 255 * nth
    out = np.zeros((len(starts), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        out[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out.reshape(-1, 64), np.cumsum(parts) - parts, axis=0)


def wide_bits(h: np.ndarray, at: np.ndarray, n_words: int) -> np.ndarray:
    """(rows, n_words * 64) booleans: bits that are set in over half of a row's shingle hashes; none for an empty row."""
    out, full = np.zeros((len(at) - 1, n_words * 64), bool), np.flatnonzero(np.diff(at))
    if len(full):
        n = np.diff(at)[full]
        for j in range(n_words):
            own = mix(h.view(np.uint64) + np.uint64((j * _FACTOR + 1) & (2**64 - 1)))
            out[full, 64 * j : 64 * j + 64] = bit_counts(own, np.append(at[:-1][full], at[-1])) * 2 > n[:, None]
    return out


def _prints(docs: DataFrame, id_col: str, text: str, width: int, segments: int, bits: int) -> DataFrame:
    """(id, node, check, prints, segments): the key of the shingle set, its first 64 bits, all bits, and all segments as numbers."""
    n_words = -(-segments * bits // 64)

    def work(batches):
        weight = 1 << np.arange(bits - 1, -1, -1)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, b in blocks(offsets):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64) + np.uint64(_FACTOR)), dtype=np.uint64)))
                node = mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)
                wide = wide_bits(h, at, n_words)
                words = np.packbits(wide, axis=1).view(">i8").astype(np.int64)
                parts = (wide[:, : segments * bits].reshape(-1, segments, bits) @ weight).astype(np.int32)
                prints = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, n_words, dtype=np.int32)), pa.array(words.reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, segments, dtype=np.int32)), pa.array(parts.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(node), pa.array(np.ascontiguousarray(words[:, 0])), prints, lists], names=["id", "node", "check", "prints", "segments"])

    schema = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("check"), F.array(F.lit(0).cast("long")).alias("prints"), F.array(F.lit(0)).alias("segments")).schema
    return docs.select(id_col, text).mapInArrow(work, schema)


def _sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, hashes): the distinct shingle hashes of each row."""

    def work(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, b in blocks(offsets):
                h, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h))], names=["id", "hashes"])

    schema = docs.select(F.col(id_col).alias("id"), F.array(F.lit(0).cast("long")).alias("hashes")).schema
    return docs.select(id_col, text).mapInArrow(work, schema)


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, width: int, scratch: Scratch) -> DataFrame:
    """(node, hashes) of the wanted nodes; only their texts are split again."""
    chosen = scratch.keep(nodes.select("node", "least").join(wanted.distinct(), "node"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(broadcast_if_small(chosen.select(F.col("least").alias("id"))), "id", "left_semi")
    # A row of docs that is repeated as it is, id and all, gives its set again.
    return scratch.keep(chosen.join(_sets(texts, "id", "text", width), F.col("least") == F.col("id")).groupBy("node").agg(F.first("hashes").alias("hashes")))


def verified(pairs: DataFrame, nodes: DataFrame, sets, most: int, scratch: Scratch) -> DataFrame:
    """Those of pairs(a, b) of nodes whose sets are similar enough, of those at most `most` bits apart; sets(wanted) gives the sets."""
    every = nodes.select("node", "prints")
    both = scratch.keep(pairs.distinct()).join(every.toDF("a", "pa"), "a").join(every.toDF("b", "pb"), "b")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = scratch.keep(both.where(apart <= most).select("a", "b"))
    held = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    one, two = (held.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    common, both = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    return scratch.keep(pairs.join(one, "a").join(two, "b").where(9 * common >= 4 * both).select("a", "b"))


def differing(members: DataFrame, sets, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links and candidate pairs (a, b) among members(p, node, check, root), the nodes around each node p.

    Let D(x) be what x and p do not share, x of |x| shingles. Sets x and y are similar if they differ in at most (|x| + |y|) / 9
    shingles, so D(x) and D(y) share at least (|D(x)| + |D(y)| - (|x| + |y|) / 9) / 2: for any y at least |D(x)| - |x| / 4, and more than
    (|D(x)| + (|p| - |x|) / 9) / 2 for a y that is not similar to p. Nodes similar to p are links; of every other pair one side is not similar to
    p. Where D(x) must share t shingles, one of its |D(x)| - t + 1 rarest is among those of y as well, and what follows it must suffice."""
    held = sets(members.select("node").unionByName(members.select(F.col("p").alias("node"))))
    around = held.join(members.select(F.col("p").alias("node")).distinct(), "node").select(F.col("node").alias("p"), F.col("hashes").alias("hp"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = members.join(held, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(around, ["p", "salt"])
    rows = rows.select("p", "node", "check", "root", F.size("hashes").alias("n"), F.size("hp").alias("np"), F.concat(F.array_except("hashes", "hp"), F.array_except("hp", "hashes")).alias("delta")).withColumn("d", F.size("delta"))
    similar = 9 * F.col("d") <= F.col("n") + F.col("np")
    rows = scratch.keep(rows.where("d > 0").withColumn("root", F.when(similar, F.col("p")).otherwise(F.col("root"))).withColumn("linked", similar))
    inside = F.col("root") == F.col("p")
    least = F.greatest(F.lit(1), F.expr("d - n div 4"), F.when(inside, F.expr("(9 * d + np - n) div 18 + 1")).otherwise(1))
    tokens = rows.select("p", "node", "root", F.explode("delta").alias("token"))
    counts = tokens.groupBy("p", "token").agg(F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("mixed")).where("c > 1")
    # Shingles of one node alone come first in order, and lead to no other node.
    shared = tokens.join(counts, ["p", "token"]).groupBy("p", "node").agg(F.sort_array(F.collect_list(F.struct("c", "token", "mixed"))).alias("shared"))
    lead = rows.drop("delta").withColumn("prefix", F.col("d") - least + 1).join(shared, ["p", "node"]).withColumn("alone", F.col("d") - F.size("shared"))
    lead = lead.where("prefix > alone").select("p", "node", "check", "root", "n", "d", "alone", F.posexplode(F.slice("shared", F.lit(1), (F.col("prefix") - F.col("alone")).cast("int"))).alias("at", "s"))
    lead = scratch.keep(lead.where("s.mixed").select("p", "node", "check", "root", "n", "d", F.col("s.token").alias("token"), (F.col("d") - F.col("alone") - F.col("at")).alias("left")))
    other = lead.select("p", "token", *[F.col(c).alias(f"{c}_b") for c in ("node", "check", "root", "n", "d", "left")])
    enough = 18 * F.least("left", "left_b") >= 9 * (F.col("d") + F.col("d_b")) - F.col("n") - F.col("n_b")
    near = F.bit_count(F.col("check").bitwiseXOR(F.col("check_b"))) <= FAR
    pairs = lead.join(other, ["p", "token"]).where((F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & enough & near)
    return rows.where("linked").select(F.col("p").alias("a"), F.col("node").alias("b")), pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def links(nodes: DataFrame, bits: int, verify, sets, scratch: Scratch) -> DataFrame:
    """(node, root) of those of nodes(node, check, segments) that similar pairs connect; verify(pairs) keeps the similar ones of pairs(a, b),
    sets(wanted) gives the sets of nodes."""
    place = lambda i, v: F.shiftleft(i.cast("long"), bits).bitwiseOR(v.cast("long"))
    own = scratch.keep(nodes.select("node", "check", F.posexplode("segments").alias("i", "v")).select("node", "check", place(F.col("i"), F.col("v")).alias("h")))
    apart = (F.col("root") != F.col("root_b")) & (F.bit_count(F.col("check").bitwiseXOR(F.col("check_b"))) <= FAR)
    pair = [F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")]
    other = lambda df, *more: df.select("h", *[F.col(c).alias(f"{c}_b") for c in ("node", "check", "root", *more)])

    def rooted(df: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("node"))
        return df.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "node"))

    # How many nodes share a place never changes, so it is counted once, and only the rows of crowded places go through the rounds.
    places = scratch.keep(own.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("h"))
    crowds, found, roots = not places.isEmpty(), None, None
    crowd = scratch.keep(own.join(broadcast_if_small(places), "h")) if crowds else None
    for k in range(ROUNDS if crowds else 0):
        state = rooted(crowd, roots)
        chosen = state.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.min_by(F.struct("node", "check", "root"), F.xxhash64("node", F.lit(k))).alias("p"))
        pivots = scratch.keep(chosen.where(F.col("r") != F.col("s")).select("h", "p.node", "p.check", "p.root"))
        if pivots.isEmpty():
            break
        new = verify(state.join(other(pivots), "h").where(apart).select(*pair))
        found = new if found is None else found.unionByName(new)
        roots = scratch.keep(components(found))
    # The ball: each 0 of a segment set to 1.
    flipped = lambda i, v: F.transform(F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda b: v.bitwiseAND(b) == 0), lambda b: place(i, v.bitwiseOR(b)))
    ball = F.flatten(F.transform("segments", lambda v, i: F.concat(F.array(place(i, v)), flipped(i, v))))
    rows = rooted(nodes, roots)
    if not crowds:
        pairs = rows.select("node", "check", "root", F.explode(ball).alias("h")).join(other(rooted(own, roots)), "h").where(apart).select(*pair)
        return components(verify(pairs))
    # A crowd's place stands for the root that most of its nodes have.
    held = rooted(crowd, roots).groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("p"))
    members = scratch.keep(rows.select("node", "check", "root", F.explode(ball).alias("h")).join(broadcast_if_small(scratch.keep(held)), "h").select("p", "node", "check", "root").distinct())
    direct, meeting = differing(members, sets, scratch)
    # Two nodes around the same one have met by what differs from it, whichever other places they share, so these are not paired again.
    around = broadcast_if_small(scratch.keep(members.groupBy("node").agg(F.collect_set("p").alias("around"))).withColumnRenamed("node", "of"))
    known = lambda df: df.join(around, F.col("node") == F.col("of"), "left").drop("of")
    probes = known(rows).select("node", "check", "root", "around", F.explode(ball).alias("h"))
    table = known(rooted(own.join(broadcast_if_small(places), "h", "left_anti"), roots))
    met = F.coalesce(F.arrays_overlap("around", "around_b"), F.lit(False))
    pairs = probes.join(other(table, "around"), "h").where(apart & ~met).select(*pair)
    new, found = verify(pairs.unionByName(meeting)), direct if found is None else found.unionByName(direct)
    return components(found.unionByName(new))


def groups(docs: DataFrame, id_col: str, text: str = "text", width: int = 5) -> DataFrame:
    """(id, component_id) for each row of docs: the smallest id that similar pairs reach. Ids must be comparable;
    texts without words are equal to each other."""
    with Scratch(docs.sparkSession) as scratch:
        segments, bits = shape(docs.count())
        rows = scratch.keep(_prints(docs, id_col, text, width, segments, bits))
        nodes = scratch.keep(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("check").alias("check"), F.first("prints").alias("prints"), F.first("segments").alias("segments")))
        sets = lambda wanted: sets_of(wanted, nodes, docs, id_col, text, width, scratch)
        roots = links(nodes, bits, lambda pairs: verified(pairs, nodes, sets, far_all(segments, bits), scratch), sets, scratch)
        of = nodes.select("node", "least").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        of = scratch.keep(of)
        named = of.groupBy("root").agg(F.min("least").alias("component_id"))
        of = scratch.keep(of.join(scratch.keep(named), "root").select("node", "component_id"))
        return cut(rows.select("id", "node").join(of, "node").select(F.col("id").alias(id_col), "component_id"))
