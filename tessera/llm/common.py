"""Shared pieces of the training-data operators: content keys, sized broadcasts, byte kernels."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable
from types import TracebackType

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kernels travel to the executors by value, so these need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java pattern of the separators between words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: A broadcast of at most so many narrow rows (some tens of MB) is allowed; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def key_columns(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the same content, as columns k1 and k2 (a 128-bit content key)."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7), *cols).alias("k2")]


def packed(df: DataFrame, without: tuple[str, ...] = (), name: str = "row") -> tuple[Column, Callable[[str], list[Column]]]:
    """The columns of df but `without` as one structure column, and a function that gives them back from it.

    An operator works on it beside columns of its own, so no input column clashes with one of these, or is lost."""
    kept = [c for c in df.columns if c not in without]
    row = (F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))).alias(name)
    return row, lambda at=name: [F.col(at).getField(c).alias(c) for c in kept]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcasting only if it was counted to be small; otherwise joins with it shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session, whose executors are this process, gets one of its own where the setting is missing."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Python tasks over texts get ROWS rows at once from here on, if the session has left Spark's number as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))


class Scratch:
    """Tables written in the shared folder for as long as a job needs them; they go when it ends or fails."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as written once and read again: later steps neither repeat it nor carry its lineage."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """df, which was grouped by the keys, as a table bucketed by them: joins on them move only their other side.

        Rows are written as the grouping has dealt them out, without another shuffle."""
        name, n = f"tessera_{uuid.uuid4().hex}", partitions(self.spark)
        self.tables.append(name)
        df.write.bucketBy(n, *keys).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return self.spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- byte kernels for Arrow batches -------------------------------------------------------------

#: Bytes worked on at once in a task; a single longer text is taken whole.
BLOCK = 1 << 19
#: Rows that a Python task is given at once, unless the session says otherwise: texts are long rows, and Spark's own 10,000 make some
#: tens of MB, of which a task holds several copies.
ROWS = 2000
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    a = column.cast(pa.large_binary())
    a = a.fill_null(b"") if a.null_count else a
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """Ranges [a, b) of rows that hold about `size` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first n powers of base modulo 2^64; those that whole blocks need are kept for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[:1] = 1
        have = np.multiply.accumulate(have)
        if 1 << 12 <= n <= BLOCK:
            _POWERS[base] = have
    return have[:n]


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of values[s:e] for many ranges, by prefix sums and inverse powers."""
    n = len(values)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n, _BASE), out=total[1:], dtype=np.uint64)
    return (total[ends] - total[starts]) * powers(n, _INVERSE)[starts]


#: Bytes of plain words: digits, a-z and everything beyond ASCII.
IS_PLAIN = np.zeros(256, bool)
IS_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the number of words before it.

    `solid` tells for each byte value whether it belongs to words; by default all but white space does."""
    solid = ~_IS_SPACE[data] if solid is None else solid[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word."""
    return mix(polynomial(data.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression, by damped Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, w = weight * (y - p), weight * p * (1 - p) + 1e-9
        ga, gb = (g * x).sum() - ridge * a, g.sum()
        haa, hab, hbb = (w * x * x).sum() + ridge, (w * x).sum(), w.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 20 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
    return float(a), float(b)
