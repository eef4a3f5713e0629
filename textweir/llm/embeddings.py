"""Embedding near-duplicates: random projections to eight dimensions, decoded to points of the E8 lattice.

Each of several tables projects the unit vectors to one or two times eight orthonormal random directions, scales them, and
takes the nearest E8 points as home cell; a vector also probes the neighbouring cells that it is nearest to. How fine the
cells are, how many are probed and how many tables there are is one setting for tables of all sizes (SETTING), so whether
two vectors are found is a matter of these two alone, whatever else the table holds.

A cell first receives its vectors' ids and sketches (128 signs of random projections), 33 bytes each, and tells which of
them have a neighbour at all; only these travel as vectors, in their own precision, and are compared by cosine in
double precision, block against block. A pair that meets in several cells is counted in the first of them. Of its links
a block gives the counts and a spanning forest, so groups of copies cost no rows; equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import components, constants, dropped, mixed, prepared, stored, table

COSINE = 0.9
#: Lattice blocks, scale, probes, tables. Simulated: of pairs at cosine 0.9, 5 to 7 in 10,000 do not meet (8, 64 and 256
#: dimensions), two random vectors of 64 dimensions share a home cell with probability 2e-5.
SETTING = (2, 4.0, 7, 16)
#: Others that a caller may name, with the number of distinct vectors up to which their cells hold some hundred. Simulated: a pair at
#: cosine 0.9 meets with probability 0.996 or more, two random vectors share a home cell with 4e-3, 2e-4, 2e-5 and 8e-7.
SETTINGS = ((200_000, 1, 4.0, 3, 5), (5_000_000, 1, 6.0, 7, 8), (200_000_000, 2, 4.0, 7, 14), (1 << 62, 2, 5.0, 7, 28))
#: Sketches of neighbours differ in at most so many of 128 signs: at cosine 0.9 all but 2 in 100,000 do, of random pairs 1 in a million.
SKETCH_WORDS, SKETCH_DIFFER = 2, 36
#: Rows of a cell that are compared at once: sketches, vectors.
SKETCH_ROWS, BLOCK_ROWS = 1000, 500
#: Pairs whose cells are compared at once.
PAIR_ROWS = 20_000


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of each row: of D8 (integers of even sum) and D8 + 1/2, the nearer (Conway and Sloane)."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(axis=1)
        rows = np.arange(len(y))
        flip = np.where(off[rows, worst] >= 0, 1.0, -1.0)
        near[rows, worst] += np.where(near.sum(axis=1) % 2 != 0, flip, 0.0)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@lru_cache(maxsize=1)
def e8_neighbours() -> np.ndarray:
    """Twice the 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


@lru_cache(maxsize=256)
def projection(dim: int, number: int) -> np.ndarray:
    """Eight orthonormal random directions (random ones for under eight dimensions)."""
    g = np.random.default_rng(1000 + number).normal(size=(dim, 8))
    return np.linalg.qr(g)[0] if dim >= 8 else g / np.sqrt(8)


def cells(unit: np.ndarray, blocks: int, scale: float, probes: int, tables: int) -> np.ndarray:
    """rows x tables x (1 + probes) keys; the first of each table is the home cell.

    A cell's key is a sum over its coordinates, so a neighbour's is the home's and what the step between them adds.
    """
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    near = e8_neighbours()
    for t in range(tables):
        home, gains, steps = np.full(n, constants(64, 93)[t % 64] + np.uint64(dim * 64 + t)), [], []
        for k in range(blocks):
            by = constants(16, 91)[8 * k : 8 * k + 8]
            # 64 dimensions are the measure of the scale.
            y = unit @ projection(dim, t * 2 + k) * (scale * np.sqrt(dim / 64))
            point = e8_decode(y)
            home += (point.astype(np.uint64) * by).sum(axis=1, dtype=np.uint64)
            gains.append((2 * y - point) @ near.T)
            steps.append((near.astype(np.uint64) * by).sum(axis=1, dtype=np.uint64))
        best = np.argpartition(-np.concatenate(gains, axis=1), probes, axis=1)[:, :probes]
        out[:, t, 0] = home
        out[:, t, 1:] = home[:, None] + np.concatenate(steps)[best]
    return mixed(out).view(np.int64)


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(77).normal(size=(dim, 64 * SKETCH_WORDS))


def sketches(unit: np.ndarray) -> np.ndarray:
    """rows x SKETCH_WORDS numbers: the signs of random projections."""
    return np.packbits(unit @ _planes(unit.shape[1]) >= 0, axis=1).view(np.uint64)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, v): the components' bytes; null where the vector can have no link."""
    for batch in batches:
        column = batch.column(1)
        at = column.offsets.to_numpy()
        values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False)[: at[-1] if len(at) else 0])  # nulls are nan
        count = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[at[1:]] - c[at[:-1]]  # noqa: B023, E731
        usable = np.asarray(column.is_valid()) & (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0)
        size = values.dtype.itemsize
        v = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((at.astype(np.int64) * size).tobytes()), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(usable), v, None).cast(pa.binary())], ["vec_id", "v"])


def _units(v: list[bytes], single: bool) -> np.ndarray:
    """Equally long vectors as unit vectors in double precision, very large and small components included."""
    x = np.frombuffer(b"".join(v), "<f4" if single else "<f8").reshape(len(v), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The places and values of a column's rows of each length."""
    values = column.to_pylist()
    sizes = np.array([len(v) for v in values])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, [values[i] for i in at.tolist()]


def _hashed(batches: Iterator[pa.RecordBatch], single: bool, setting: tuple) -> Iterator[pa.RecordBatch]:
    """(node, v) -> (key, node, home, sketch) for each table's home cell and probed cells."""
    for batch in batches:
        for at, v in _by_length(batch.column(1)):
            unit = _units(v, single)
            keys = cells(unit, *setting).reshape(len(v), -1)
            row = np.repeat(np.arange(len(v)), keys.shape[1])
            home = np.tile(np.arange(keys.shape[1]) % (1 + setting[2]) == 0, len(v))
            sketch = pa.array([x.tobytes() for x in sketches(unit)], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(at[row])), pa.array(home), sketch], ["key", "node", "home", "sketch"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first `keys` columns, as tables; batches are sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of both blocks of a group, and whether they are one block."""
    side = group.column("side").to_numpy()
    if group.column("i")[0].as_py() == group.column("j")[0].as_py():
        return np.arange(len(side)), np.arange(len(side)), True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, i, j, side, node, home, sketch) -> (key, node, home) of those with a neighbour's sketch beside them."""
    out = []
    for group in _groups(batches, 3):
        left, right, same = _sides(group)
        if group.num_rows < 2 or not len(left) or not len(right):
            continue
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        home = group.column("home").to_numpy()
        differ = sum(np.bitwise_count(sketch[left, w][:, None] ^ sketch[right, w][None]) for w in range(SKETCH_WORDS))
        close = (differ <= SKETCH_DIFFER) & (home[left][:, None] | home[right][None])
        if same:
            np.fill_diagonal(close, False)
        hit = np.zeros(group.num_rows, bool)
        hit[left[close.any(axis=1)]] = True
        hit[right[close.any(axis=0)]] = True
        if hit.any():
            out.append(group.select(["key", "node", "home"]).filter(pa.array(hit)))
        if sum(len(x) for x in out) > 5000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out = []
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def _first_cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair (rows x tables x keys each) the cell where it counts: the smaller home of the first table in which they meet."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    none = np.iinfo(np.int64).max
    for t in range(a.shape[1]):
        x, y = a[open_, t], b[open_, t]
        key = np.minimum(np.where((y == x[:, :1]).any(axis=1), x[:, 0], none), np.where((x == y[:, :1]).any(axis=1), y[:, 0], none))
        met = key != none
        out[open_[met]] = key[met]
        open_ = open_[~met]
        if not len(open_):
            break
    return out


def _links(batches: Iterator[pa.RecordBatch], least: float, single: bool, setting: tuple) -> Iterator[pa.RecordBatch]:
    """Sorted (key, i, j, side, node, home, weight, v) -> (a, b, 0) of a spanning forest of each block pair's links, and
    (a, a, n) of each node's links there, weights counted."""

    def keyed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.empty((batch.num_rows, setting[3] * (1 + setting[2])), np.int64)
            for at, v in _by_length(batch.column("v")):
                keys[at] = cells(_units(v, single), *setting).reshape(len(v), -1)
            yield batch.append_column("keys", pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]))

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def written() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["a", "b", "n"])

    for group in _groups(keyed(), 3):
        left, right, same = _sides(group)
        if group.num_rows < 2 or not len(left) or not len(right):
            continue
        node, home, weight = (group.column(c).to_numpy() for c in ("node", "home", "weight"))
        x = _units(group.column("v").to_pylist(), single)
        near = (x[left] @ x[right].T >= least) & (home[left][:, None] | home[right][None])
        a, b = np.nonzero(np.triu(near, 1) if same else near)
        a, b = left[a], right[b]
        if not len(a):
            continue
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), setting[3], -1)
        first = [_first_cell(keys[a[k : k + PAIR_ROWS]], keys[b[k : k + PAIR_ROWS]]) for k in range(0, len(a), PAIR_ROWS)]
        here = np.concatenate(first) == group.column("key")[0].as_py()
        a, b = a[here], b[here]
        if not len(a):
            continue
        n = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
        linked = np.flatnonzero(n)
        out.append((node[linked], node[linked], n[linked]))
        top = np.arange(len(node))
        while True:  # labels sink along links; then a node is tied to its label
            low = np.minimum(top[a], top[b])
            new = top.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == top).all():
                break
            top = new
        tied = np.flatnonzero(top != np.arange(len(node)))
        out.append((node[tied], node[top[tied]], np.zeros(len(tied))))
        if len(out) > 200:
            yield written()
    yield written()


def _in_blocks(rows: DataFrame, job: Callable, schema: str, names: list[str], rows_at_once: int) -> DataFrame:
    """rows (key, node, ...) -> job over each pair of blocks of each key of two rows or more; rows of a key go to blocks by a hash of the node.

    The counts, up to one for each cell of each vector, are never broadcast: Spark sizes them by the vectors' files, as if a
    vector had one cell.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("m"), F.max("home").alias("home")).where("m > 1 and home").select("key", F.ceil(F.col("m") / rows_at_once).cast("int").alias("blocks"))
    dealt = rows.join(counts.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "peer").alias("i"), F.greatest("own", "peer").alias("j"), (F.col("own") > F.col("peer")).cast("int").alias("side"), *names)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(job, schema)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, setting: tuple | None = None, rows_at_once: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components have no links; neither have those with a
    null id, whose component is null. Vectors of different lengths are never linked. A cosine of exactly `least` is a link, as
    double precision has it. Rows of one id count each as a vector; repeated rows are linked with each other. Other
    columns are ignored, whatever their names; an empty table gives an empty result. setting: as SETTING, which None stands
    for. It decides which links are found and never follows the table's size; a coarser one is cheaper for small tables.
    """
    prepared(vectors.sparkSession)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    single = given.schema["embedding"].dataType.simpleString() == "array<float>"
    if not single:
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = given.mapInArrow(_usable, "vec_id long, v binary").withColumn("digest", F.unhex(F.sha2("v", 256)))
    nodes = rows.where("vec_id is not null and v is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, then read from files
    setting = setting or SETTING
    hashed = nodes.select("node", "v").mapInArrow(lambda x: _hashed(x, single, setting), "key long, node long, home boolean, sketch binary")
    met = _in_blocks(hashed, _met, "key long, node long, home boolean", ["node", "home", "sketch"], SKETCH_ROWS).distinct()
    met = stored(met, "met")
    # Nor are tables whose files say little of their rows: numbers of nodes take some bytes there, and ten times as much in a broadcast.
    full = met.hint("merge").join(nodes.select("node", "weight", "v"), "node")
    found = stored(_in_blocks(full, lambda x: _links(x, least, single, setting), "a long, b long, n long", ["node", "home", "weight", "v"], rows_at_once), "links")
    dropped(met)
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comps = components(found.where("a <> b").select("a", "b"))
    of = nodes.select("node", "digest", "least", "weight").join(comps.hint("merge"), "node", "left").join(counts.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = of.groupBy("component").agg(F.min("least").alias("top"))
    of = of.join(top, "component").select("digest", "top", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = rows.select("vec_id", "digest").join(of, "digest", "left")
    alone = F.col("vec_id").isNull() | F.col("top").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("top"))
    return out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n")).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op6_e8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.s > 0 AND b.s > 0 AND list_dot_product(a.e, b.e) >= 0.9 * a.s * b.s),
r(vec_id, peer) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.peer),
m AS (SELECT vec_id, min(peer) AS c FROM r GROUP BY 1),
k AS (SELECT a, count(*)::BIGINT AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m USING (vec_id) LEFT JOIN k ON k.a = v.vec_id
"""
