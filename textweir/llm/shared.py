"""What the operators of this subpackage share: tables in the shared folder, hashed words, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.sources.tables import dropped, shared_dir, spread, stored

__all__ = ["Pieces", "components", "constants", "crc32_text", "dropped", "found_path", "mixed", "prepared", "runs", "shared_dir", "slices", "stored", "table", "texts_of"]

#: Rows that Spark hands to Python at once, and bytes of text that a Python task works on at once.
ARROW_ROWS = 512
SLICE_BYTES = 2_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for long texts, and this package on its Python workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return found if name in ("labels", "benchmark") else spread(found)


def found_path(name: str) -> str:
    """A file as given, or the public tokenizers' file of that name; asked for where the file is opened."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `most` bytes of the column's text, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        marks = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts in UTF-8; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C17


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = b" \t\n\x0b\x0c\r"
#: By how many of a lane's eight bytes belong to its run.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]; raw goes on for eight bytes behind the last end.

    A run is read in lanes of eight bytes, each mixed with its place, so that runs of up to eight bytes never collide and
    longer ones only as random numbers do.
    """
    count = np.maximum(ends - starts + 7 >> 3, 1)
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(first, count)
    begin = np.repeat(starts, count) + 8 * at
    left = np.clip(np.repeat(ends, count) - begin, 0, 8)
    lanes = np.lib.stride_tricks.sliding_window_view(raw, 8)[begin].view("<u8").reshape(-1) & _LANE[left]
    # One lane is the rule: its place and length go in by a sum, and mixed() is a bijection.
    lanes = mixed(lanes + (at + 1).astype(np.uint64) * np.uint64(BASE))
    return mixed((np.add.reduceat(lanes, first) if len(first) else lanes) + (ends - starts).astype(np.uint64) * M1)


class Pieces:
    """Maximal runs of bytes that are no separators, of several texts at once.

    hashes: a 64-bit hash of each run; starts, ends: its bytes in data; first: of each text, the place of its
    first run (one more entry at the end); data: the texts with one separator after each; raw: data as numbers, in lower
    case if asked, with eight more bytes. A text takes about 20 times its bytes.
    """

    def __init__(self, texts: list[bytes], separators: bytes = SPACES, lower: bool = False, empty: bool = False):
        """empty: also the empty runs between two separators, as str.split(separator) has them."""
        gap = separators[:1]
        self.data = gap.join(texts) + gap * 9
        self.raw = np.frombuffer(self.data, np.uint8)
        if lower:
            self.raw = _LOWER[self.raw]
        apart = np.zeros(256, bool)
        apart[list(separators)] = True
        cut = np.flatnonzero(apart[self.raw[:-8]])
        starts, ends = np.concatenate(([0], cut[:-1] + 1)), cut
        if not empty:
            full = ends > starts
            starts, ends = starts[full], ends[full]
        self.hashes = _hashes(self.raw, starts, ends)
        self.starts, self.ends = starts, ends
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(starts, offsets)


@lru_cache(maxsize=64)
def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


def runs(hashes: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """A hash of each k consecutive hashes; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(constants(k, seed)):
        out += hashes[j : j + n] * c
    return mixed(out)


def crc32_text(column: Column | str) -> Column:
    """crc32 of the value as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


def _starred(edges: DataFrame) -> bool:
    """Whether each node is either tied to one smaller node or has only larger ones tied to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until only stars are left. Each step is an
    aggregate with partial sums and a join that AQE can split, so a node with very many edges stays spread out. Nodes
    without an edge are not returned; null ends are dropped; loops are harmless.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct(), "edges")
    while not _starred(now):
        # Large star: each node ties its larger neighbours to the smallest of its neighbours and itself.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.distinct()
        # Small star: each node ties its smaller neighbours and itself to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        after = stored(small, "edges")
        dropped(now)
        now = after
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


