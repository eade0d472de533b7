"""A Merkle manifest of a dataset: each language's documents are the leaves of a tree of runs of eight, the trees' roots those of another.

Trees are cut into aligned blocks of HEIGHT levels, and the roots of a tier of blocks are the leaves of the next tier. A block is one
binary value that holds its digests in the van Emde Boas order: a subtree is stored as its upper half followed by its lower subtrees,
each again split at half its height. `address` gives the place of any node in that order; hashing and the retrieval of siblings go by it.

Rows are placed by a range sort and counts of its partitions, blocks are made and read one at a time in the tasks; the driver sees the
number of tiers, the number of trees' tiers and the one root.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, Scratch, ascii_lower, broadcast_if_small, cut, partitions

#: Nodes of a run; a run becomes one node of the level above.
FAN = 8
#: Levels that a block rises: 8^4 leaves, about 150 KB of digests.
HEIGHT = 4
#: Digest bytes.
WIDE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = "tree string, tier int, block long, solo boolean, levels int, slots int, nodes binary, digest binary"


# ---- addresses ------------------------------------------------------------------------------------

def places(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes `index` of a depth in the van Emde Boas order of a complete tree of so many levels; the root has depth 0."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(depth, index, upper)
    below, wide = depth - upper, FAN ** (depth - upper)
    return places(upper) + index // wide * places(levels - upper) + address(below, index % wide, levels - upper)


def rise(slots: int, solo: bool) -> int:
    """Levels from the leaves of a block to its root: a tree's only block ends at one node, one of many goes all the way."""
    if not solo:
        return HEIGHT
    height = 0
    while FAN**height < slots:
        height += 1
    return height


# ---- kernels of a block ---------------------------------------------------------------------------

def node(children: list[bytes]) -> bytes:
    """The digest of a run, of its nodes' digests as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def lay_out(leaves: list[bytes], solo: bool) -> tuple[int, bytes]:
    """Levels of a block over these digests, and all its digests in the van Emde Boas order; places without a node hold zeros."""
    levels = rise(len(leaves), solo) + 1
    out = np.zeros((places(levels), WIDE), np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        out[address(depth, np.arange(len(row)), levels)] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, WIDE)
        row = [node(row[i : i + FAN]) for i in range(0, len(row), FAN)]
    return levels, out.tobytes()


def runs_of(nodes: bytes, levels: int, slots: int) -> list[list[list[bytes]]]:
    """For each depth but the root's, from the leaves up, the runs of stored digests, found by address."""
    out = []
    for depth in range(levels - 1, 0, -1):
        at = (address(depth, np.arange(slots), levels) * WIDE).tolist()
        row = [nodes[a : a + WIDE] for a in at]
        out.append([row[i : i + FAN] for i in range(0, slots, FAN)])
        slots = -(-slots // FAN)
    return out


def steps_of(runs: list[list[list[bytes]]], index: int) -> bytes:
    """The way of a leaf to its block's root: for each level a byte for its place in the run, one for the run's length, the others' digests."""
    out = []
    for level in runs:
        run, i = level[index // FAN], index % FAN
        out.append(bytes((i, len(run))) + b"".join(run[:i]) + b"".join(run[i + 1 :]))
        index //= FAN
    return b"".join(out)


def hex_steps(steps: bytes) -> list[tuple[bytes, bytes]]:
    """Hex text of the siblings to the left and to the right, level by level."""
    out, at = [], 0
    while at < len(steps):
        i, m = steps[at], steps[at + 1]
        middle, end = at + 2 + i * WIDE, at + 2 + (m - 1) * WIDE
        out.append((steps[at + 2 : middle].hex().encode(), steps[middle:end].hex().encode()))
        at = end
    return out


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to, as hex text."""
    for left, right in steps:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


# ---- the manifest ---------------------------------------------------------------------------------

@dataclass
class Manifest:
    """leaves(tree, pos, n, id, leaf, tampered), the tiers of blocks from the leaves up, those over the trees' roots, and the root."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    order: DataFrame
    root: bytes


def leaf_text(columns: dict[str, Column]) -> Column:
    """What a leaf hashes: each field `-` if null, else its UTF-8 byte count, a colon and its value."""
    value = {k: c.cast("string") for k, c in columns.items()}
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in value.values()])


def leaves_of(docs: DataFrame, tamper: Column) -> DataFrame:
    """(tree, id, leaf, tampered): digests of the rows, and where `tamper` holds, that of the row with A-Z of its text lower-cased."""
    own = {c: F.col(c) for c in FIELDS}
    digest = lambda cols: F.unhex(F.sha2(leaf_text(cols), 256))
    changed = tamper & F.col("text").rlike(f"[{UPPER}]")
    return docs.select(F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("tree"), F.col("doc_id").cast("long").alias("id"), digest(own).alias("leaf"),
                       F.when(changed, digest(own | {"text": ascii_lower(F.col("text"))})).alias("tampered"))


def ranked(scratch: Scratch, rows: DataFrame, *by: str) -> DataFrame:
    """rows with pos, their place within their tree by the order of `by` (nulls first), and n, the tree's number of rows.

    A range sort deals them out, whole trees or parts of one to a partition; where each part starts is a sum over the partitions. Equal
    rows are told apart by where they were read, so a row repeated very often does not stay in one partition either."""
    spark = rows.sparkSession
    read = scratch.keep(rows).withColumn("_read", F.monotonically_increasing_id())
    dealt = read.repartitionByRange(partitions(spark), "tree", *by, "_read").sortWithinPartitions("tree", *by, "_read").drop("_read")
    dealt = scratch.keep(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    parts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("tree")
    parts = parts.select("tree", "_part", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    return dealt.join(broadcast_if_small(parts), ["tree", "_part"]).select("tree", (F.col("_at") + F.col("_shift")).alias("pos"), "n", *[c for c in rows.columns if c != "tree"])


def tiers_of(scratch: Scratch, leaves: DataFrame) -> list[DataFrame]:
    """Blocks over leaves(tree, pos, n, digest), then blocks over their roots, until each tree is one node."""
    wide = FAN**HEIGHT

    def make(tier: int):
        def work(group: pa.Table) -> pa.Table:
            group = group.sort_by("pos")
            first = group.slice(0, 1).to_pylist()[0]
            solo, digests = first["n"] <= wide, group.column("digest").to_pylist()
            levels, nodes = lay_out(digests, solo)
            return pa.table({"tree": pa.array([first["tree"]], pa.string()), "tier": pa.array([tier], pa.int32()), "block": pa.array([first["block"]], pa.int64()), "solo": [solo],
                             "levels": pa.array([levels], pa.int32()), "slots": pa.array([len(digests)], pa.int32()), "nodes": pa.array([nodes], pa.binary()), "digest": pa.array([nodes[:WIDE]], pa.binary())})
        return work

    most, tiers = leaves.agg(F.max("n")).first()[0] or 0, []
    while most:
        tiers.append(scratch.keep(leaves.withColumn("block", F.expr(f"pos div {wide}")).groupBy("tree", "block").applyInArrow(make(len(tiers)), BLOCK)))
        if most <= wide:
            break
        n = Window.partitionBy("tree")
        leaves = tiers[-1].where("not solo").select("tree", F.col("block").alias("pos"), F.count("*").over(n).alias("n"), "digest")
        most = -(-most // wide)
    return tiers


def manifest(scratch: Scratch, docs: DataFrame, tamper: Column) -> Manifest | None:
    """The manifest of docs, or nothing where there is no row."""
    leaves = ranked(scratch, leaves_of(docs, tamper), "id", "leaf")
    tiers = tiers_of(scratch, leaves.select("tree", "pos", "n", F.col("leaf").alias("digest")))
    if not tiers:
        return None
    roots = tiers[0].where("solo")
    for tier in tiers[1:]:
        roots = roots.unionByName(tier.where("solo"))
    order = scratch.keep(ranked(scratch, roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "of"))
    top = tiers_of(scratch, order.drop("of"))
    return Manifest(leaves, tiers, top, order, bytes(top[-1].where("solo").first()["digest"]))


def ways(tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The blocks of the lowest tier with `way`, the siblings from their root on, and their tree's subroot, as ends(tree, way, subroot) continues."""

    def below(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        runs, n, first = runs_of(row["nodes"], row["levels"], row["slots"]), row["slots"], row["block"] * FAN**HEIGHT
        return pa.table({"tree": pa.array([row["tree"]] * n, pa.string()), "block": pa.array(range(first, first + n), pa.int64()), "way": pa.array([steps_of(runs, i) + row["way"] for i in range(n)], pa.binary()), "subroot": pa.array([row["subroot"]] * n, pa.binary())})

    ends, known = broadcast_if_small(ends), None
    for tier in reversed(tiers):
        last = tier.where("solo").join(ends, "tree")
        known = last if known is None else last.unionByName(tier.where("not solo").join(known, ["tree", "block"]))
        if tier is not tiers[0]:
            known = known.groupBy("tree", "block").applyInArrow(below, "tree string, block long, way binary, subroot binary")
    return known


def proofs(scratch: Scratch, m: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf, digests as hex text.

    The proof is the hash of the siblings' digests from the leaf to the root; the fold starts from the tampered digest where there is one."""
    top, root = ways(m.top, m.order.sparkSession.createDataFrame([("", b"", b"")], "tree string, way binary, subroot binary")), m.root.hex()

    def trees(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.to_pylist()[0] if right.num_rows else None
        rows = left.to_pylist() if place else []
        runs = runs_of(place["nodes"], place["levels"], place["slots"]) if place else []
        return pa.table({"tree": pa.array([r["of"] for r in rows], pa.string()), "way": pa.array([steps_of(runs, r["pos"] % FAN**HEIGHT) + place["way"] for r in rows], pa.binary()), "subroot": pa.array([r["digest"] for r in rows], pa.binary())})

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.to_pylist()[0] if right.num_rows else None
        rows = left.to_pylist() if place else []
        out: dict[str, list] = {c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        if place:
            runs, above, subroot = runs_of(place["nodes"], place["levels"], place["slots"]), hex_steps(place["way"]), place["subroot"].hex()
            for r in rows:
                steps = hex_steps(steps_of(runs, r["pos"] % FAN**HEIGHT)) + above
                proof = sha256()
                for pair in steps:
                    proof.update(pair[0] + pair[1])
                folded = fold((r["tampered"] or r["leaf"]).hex().encode(), steps).decode()
                for c, v in zip(out, (r["id"], r["leaf"].hex(), subroot, root, proof.hexdigest(), folded, folded == root), strict=True):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64() if c == "id" else pa.bool_() if c == "verified" else pa.string()) for c, v in out.items()})

    block = F.expr(f"pos div {FAN**HEIGHT}").alias("block")
    ends = scratch.keep(m.order.withColumn("block", block).groupBy("block").cogroup(top.groupBy("block")).applyInArrow(trees, "tree string, way binary, subroot binary"))
    blocks = ways(m.tiers, ends).select("tree", "block", "levels", "slots", "nodes", "way", "subroot")
    leaves = m.leaves.select("tree", "pos", "id", "leaf", "tampered", block)
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(judged, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def verified(docs: DataFrame, tamper: Column) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) as (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    One row for each row, other columns are not read. Within a language leaves ascend by doc_id, null first, then by digest; equal rows
    take places of their own. A null language is a tree of its own and the first; an empty one is another. Null fields hash as `-`, so
    they differ from empty ones. `tamper` null counts as false. A lone leaf is its language's subroot, a lone subroot the root; a leaf
    without any sibling has the proof of no text. An empty table gives no row."""
    with Scratch(docs.sparkSession) as scratch:
        m = manifest(scratch, docs, F.coalesce(tamper, F.lit(False)))
        if m is None:
            return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return cut(proofs(scratch, m).withColumnRenamed("id", "doc_id"))
