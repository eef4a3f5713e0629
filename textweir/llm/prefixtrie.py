"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn is its digest, a conversation the sequence of its turns' digests, up to the first turn that no other has at that
place: what follows is a chain of nodes with one member, made from the turns' own rows. Sequences are sorted in runs of bounded size; each
row of a run carries its longest common prefix (LCP, in turns) with the row before. The runs are written, dealt by ranges
of (sequence, id) - so copies of one conversation are split by id - and a loser tree merges the runs of a range: of two
rows the one that shares more turns with the row put out last is the smaller one, and turns are compared only behind
an equal LCP. Each merged row closes the nodes of the open path that it does not share, and a closed node is finished.

The paths of a range's first and last row may go on in its neighbours. Their nodes are put out as parts, a row or two
for each range, and a second pass over these rows, in the order of the ranges, joins the parts on a stack of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweir.llm.shared import crc32_text, prepared, stored, table

#: Bytes of a turn's digest (SHA-256).
WIDTH = 32
#: Bytes of sequences that are sorted at once, and that a range holds (about; ranges are drawn from a sample).
RUN_BYTES, RANGE_BYTES = 8_000_000, 16_000_000

RUNS = "run long, pos int, lcp int, conv_id long, key binary, sizes array<long>, n_turns long"
NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
#: kind n: a finished node, under parent_id or, if its parent is a part, under parent_key. kind e: an end at a part.
#: kind p: the parts along one path, an entry for each depth from 0.
MERGED = f"kind string, {NODE}, parent_id long, parent_key binary, ends_sha256 string, place long, nth int, key binary, parts array<array<long>>"
STITCHED = f"{NODE}, node_key binary, parent_key binary"

EMPTY_SHA = hashlib.sha256().hexdigest()
ROOT = bytes(WIDTH)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([(n, types[t]) for n, t in (f.split() for f in ddl.split(", "))])


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two sequences share, of which `known` are known."""
    n, i = min(len(a), len(b)) // WIDTH, known
    while i < n and a[i * WIDTH : (i + 1) * WIDTH] == b[i * WIDTH : (i + 1) * WIDTH]:
        i += 1
    return i


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turns, n_turns) as sorted runs with LCPs; turns are (d, digest, size) in order."""
    schema, part, count = _arrow(RUNS), TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def run() -> Iterator[pa.RecordBatch]:
        nonlocal count
        held.sort(key=lambda r: r[:2])
        last, out = b"", []
        for pos, (key, conv, sizes, n) in enumerate(held):
            out.append((part << 32 | count, pos, common_turns(last, key) if pos else 0, conv, key, sizes, n))
            last = key
            if len(out) == 5000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)
        held.clear()
        count += 1

    for batch in batches:
        for conv, turns, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.append((b"".join(t["digest"] for t in turns), conv, [t["size"] for t in turns], n))
            size += 100 + 40 * len(turns)
            if size >= RUN_BYTES:
                yield from run()
                size = 0
    if held:
        yield from run()


class LoserTree:
    """Merges sorted runs of (lcp, key, conv_id, ...): each row's lcp is with the row before it in its run.

    Every stored loser's LCP is with the row that beat it, which is the row put out last whenever the loser is met again.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.width = 1 << max(len(runs) - 1, 0).bit_length()
        self.heads: list[tuple | None] = [r[0] if r else None for r in runs] + [None] * (self.width - len(runs))
        self.lcps = [0] * self.width
        self.losers = [0] * self.width
        self.compared = 0
        self.winner = self._play(1) if runs else 0

    def _beats(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two leaves; the loser's LCP becomes that with the winner."""
        a, b = self.heads[x], self.heads[y]
        if a is None or b is None:
            return (x, y) if b is None else (y, x)
        if self.lcps[x] != self.lcps[y]:
            return (x, y) if self.lcps[x] > self.lcps[y] else (y, x)
        n = common_turns(a[1], b[1], self.lcps[x])
        self.compared += n - self.lcps[x] + 1
        low, high = n * WIDTH, (n + 1) * WIDTH
        if (a[1][low:high], a[2]) > (b[1][low:high], b[2]):
            x, y = y, x
        self.lcps[y] = n
        return x, y

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        winner, self.losers[node] = self._beats(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple]:
        """The rows in order of (key, conv_id), each with its LCP with the row before."""
        while self.heads and (row := self.heads[w := self.winner]) is not None:
            yield (self.lcps[w], *row[1:])
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            self.lcps[w] = self.heads[w][0] if self.heads[w] else 0
            node = w + self.width >> 1
            while node:
                w, self.losers[node] = self._beats(w, self.losers[node])
                node >>= 1
            self.winner = w


class _Node:
    """A node of the open path. Members and sums hold what its closed children and own ends gave so far."""

    __slots__ = ("children", "depth", "edge", "ends", "first", "key", "kids", "leaves", "n", "saved", "size")

    def __init__(self, depth: int, size: int, key: bytes, edge: bool):
        self.depth, self.size, self.key, self.edge = depth, size, key, edge
        self.first: int | None = None
        self.n = self.kids = self.leaves = self.saved = 0
        self.ends: list[int] = []  # at most a range's rows
        self.children: list[tuple] = []

    def adds(self, first: int | None, n: int, kids: int, leaves: int, saved: int) -> None:
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved

    def row(self) -> tuple:
        """As NODE."""
        return self.first, self.depth, self.n, self.kids, self.leaves or 1, self.saved + (self.n - 1) * self.size


def _child_key(key: bytes, digest: bytes) -> bytes:
    """A node's key from its parent's: equal for equal sequences of turns."""
    return hashlib.sha256(key + digest).digest()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, sorted by run and place in the run, as MERGED."""
    runs: list[list[tuple]] = []
    last_run = None
    for batch in batches:
        for run, lcp, conv, key, sizes, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
            if run != last_run:
                runs.append([])
                last_run, lcp = run, 0  # the row before is in another range
            runs[-1].append((lcp, key, conv, sizes, n))
    schema, place = _arrow(MERGED), TaskContext.get().partitionId()
    out: list[tuple] = []
    path: list[_Node] = []
    first_path: list[_Node] = []
    first_key = key = b""
    none = (None,) * 6

    def shut(node: _Node) -> None:
        """Puts out the node's children, whose parent is known by now, and hands the node to its own parent."""
        parent = path[node.depth - 1]
        out.extend(("n", *row, node.first, None, ends, None, None, None, None) for row, ends in node.children)
        row = node.row()
        parent.adds(row[0], row[2], 1, row[4], row[5])
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        if parent.edge:
            out.append(("n", *row, None, parent.key, ends, None, None, None, None))
        else:
            parent.children.append((row, ends))

    for lcp, key, conv, sizes, n in LoserTree(runs):
        while path and path[-1].depth > lcp:
            node = path.pop()
            if not node.edge:
                shut(node)
        starts = not path
        if starts:
            path.append(_Node(0, 0, ROOT, True))
            first_key = key
        for d in range(len(path), len(key) // WIDTH + 1):
            digest = key[(d - 1) * WIDTH : d * WIDTH]
            edge = starts
            path.append(_Node(d, sizes[d - 1], _child_key(path[-1].key, digest), edge))
        if starts:
            first_path = path[:]
        top = path[-1]
        cut = n > top.depth  # the rest of its turns is a chain of its own
        top.adds(conv, 1, int(cut), int(cut), 0)
        if not cut:
            if top.edge:
                out.append(("e", conv, *none[1:], None, top.key, None, None, None, None, None))
            else:
                top.ends.append(conv)
        if len(out) >= 5000:
            yield _batch(out, schema)
            out = []
    parts = lambda nodes: [[-1 if x.first is None else 1, x.first or 0, x.n, x.kids, x.leaves, x.saved, x.size] for x in nodes]
    if path:
        shared = sum(a is b for a, b in zip(first_path, path, strict=False))
        out.append(("p", *none, None, None, None, place, 0, first_key, parts(first_path)))
        if shared < len(path):
            # The last path may go on in the next range.
            blank = [[-1, 0, 0, 0, 0, 0, x.size] for x in path[:shared]]
            for x in path[shared:]:
                out.extend(("n", *row, None, x.key, ends, None, None, None, None) for row, ends in x.children)
                out.extend(("e", i, *none[1:], None, x.key, None, None, None, None, None) for i in x.ends)
            out.append(("p", *none, None, None, None, place, 1, key, blank + parts(path[shared:])))
    if out:
        yield _batch(out, schema)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts along the ranges' paths, in order, as finished nodes."""
    schema = _arrow(STITCHED)
    path: list[_Node] = []
    last = b""
    out: list[tuple] = []

    def shut() -> None:
        node = path.pop()
        row = node.row()
        if path:
            path[-1].adds(row[0], row[2], 1, row[4], row[5])
        out.append((*row, node.key, path[-1].key if path else None))

    for batch in batches:
        for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shared = common_turns(last, key)
            while path and path[-1].depth > shared:
                shut()
            for d, (has, first, n, kids, leaves, saved, size) in enumerate(parts):
                if d == len(path):
                    path.append(_Node(d, size, _child_key(path[-1].key, key[(d - 1) * WIDTH : d * WIDTH]) if d else ROOT, True))
                path[d].adds(first if has > 0 else None, n, kids, leaves, saved)
            last = key
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
    while path:
        shut()
    if out:
        yield _batch(out, schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node_key, conv_id) in order -> node_key, ends_sha256; a node's ids may go on over any number of batches."""
    schema = _arrow("node_key binary, ends_sha256 string")
    now, digest, out = None, None, []
    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield _batch(out, schema)
            out = []
    if now is not None:
        yield _batch([(now, digest.hexdigest())], schema)


def digested_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, digest, size) of conversations (conv_id, turn, role, text): d is a turn's number from 1, size its text's bytes.

    Turns go by `turn`, null first, turns of one number by their digests. Null roles and texts are empty; rows without a conv_id belong to
    no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", nth.alias("d"), "digest", "size")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie over sequences of turns, from (conv_id, d, digest, size), d from 1 without gaps, and all conv_ids.

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (of its
    subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the bytes of the node's last turn)
    and ends_sha256 (digest of the ids that end there, ascending, comma-joined). Members without a turn end at the root.
    Copies of a conversation, whole or of its beginning, are members of the same nodes. An empty table has no node.

    A conversation takes WIDTH bytes for each turn up to the first that no other has at its place, in one row; ranges of at most about
    RANGE_BYTES are merged in memory. The ids that end at a node of a range's edge are read as a stream to one task, since
    a SHA-256 has no parts. The second pass reads one path or two of each range in one task.
    """
    spark = prepared(turns.sparkSession)
    turns = stored(turns, "turns")
    # A turn that nothing else has at its place begins a chain.
    alone = turns.groupBy("d", "digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    cut = stored(turns.groupBy("conv_id").agg(F.max("d").cast("long").alias("n_turns")).join(alone.groupBy("conv_id").agg(F.min("d").alias("cut")), "conv_id", "left"), "cuts")
    with_cut = turns.join(cut, "conv_id")
    reach = F.col("cut").isNull() | (F.col("d") <= F.col("cut"))
    keys = with_cut.where(reach).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", "digest", "size"))).alias("turns"), F.first("n_turns").alias("n_turns"))
    none = F.array().cast(keys.schema["turns"].dataType)
    keys = ids.select("conv_id").join(keys, "conv_id", "left").select("conv_id", F.coalesce("turns", none).alias("turns"), F.coalesce("n_turns", F.lit(0).cast("long")).alias("n_turns"))
    runs = stored(keys.mapInArrow(_runs, RUNS), "runs")
    size = runs.agg(F.sum(F.length("key") + 100)).first()[0] or 0
    ranges = runs.repartitionByRange(max(1, -(-size // RANGE_BYTES)), "key", "conv_id").sortWithinPartitions("run", "pos")
    merged = stored(ranges.mapInArrow(_merged, MERGED), "merged")
    paths = merged.where("kind = 'p'").repartition(1).sortWithinPartitions("place", "nth").select("key", "parts")
    edges = stored(paths.mapInArrow(_stitched, STITCHED), "stitched")
    ends = merged.where("kind = 'e'").select(F.col("parent_key").alias("node_key"), "conv_id").repartition("node_key").sortWithinPartitions("node_key", "conv_id")
    edge_ends = ends.mapInArrow(_ends, "node_key binary, ends_sha256 string")
    inner = merged.where("kind = 'n'")
    names = [f.split()[0] for f in NODE.split(", ")]
    settled = inner.where("parent_key is null").select(*names, F.col("parent_id").alias("parent_conv_id"), "ends_sha256")
    # Few nodes are parents at an edge: one path or two of each range.
    parents = edges.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    hanging = inner.where("parent_key is not null").join(parents, "parent_key").select(*names, "parent_conv_id", "ends_sha256")
    found = edges.join(edge_ends, "node_key", "left").join(parents, "parent_key", "left").select(*names, "parent_conv_id", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    last = F.col("d") == F.col("n_turns")
    one = F.lit(1).cast("long")
    chains = with_cut.where(~reach).select(
        "conv_id", F.col("d").cast("long").alias("depth"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.col("conv_id").alias("parent_conv_id"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return settled.unionByName(hanging).unionByName(found).unionByName(chains)


def head_turns(conv_id: Column) -> Column:
    """How many turns op12's rule takes from another conversation."""
    return crc32_text(conv_id) % 9


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """op12's conversations: the first h turns of conversation c - c % 5, then c's own turns after its first h, numbered anew."""
    h = head_turns(F.col("conv_id"))
    heads = turns.where("conv_id % 5 = 0 and d <= 8").select(F.col("conv_id").alias("base"), "d", "digest", "size")
    heads = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h")).join(heads, "base").where("d <= h").select("conv_id", F.lit(0).alias("part"), "d", "digest", "size")
    own = turns.where(F.col("d") > h).select("conv_id", F.lit(1).alias("part"), "d", "digest", "size")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "d"))
    return heads.unionByName(own).select("conv_id", nth.alias("d"), "digest", "size")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(digested_turns(table(spark, sf_dir, "conversations")), "digested")
    ids = turns.select("conv_id").distinct()
    return prefix_trie(rebuilt(turns, ids), ids)


_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP12_SQL = rf"""
WITH g AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT c, turn, sha256(length(r) || ' ' || r || t) AS x, strlen(t) AS b FROM g),
t AS (SELECT c, x, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS d FROM x),
ids AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
rb AS (SELECT ids.c, 0 AS part, t.d, x, b FROM ids JOIN t ON t.c = ids.base WHERE t.d <= h UNION ALL SELECT ids.c, 1, t.d, x, b FROM ids JOIN t ON t.c = ids.c WHERE t.d > h),
s AS (SELECT c, x, b, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d FROM rb),
p AS (SELECT c, d, b, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM s UNION ALL SELECT c, 0, 0, '' FROM ids),
l AS (SELECT c, max(d) AS n FROM p GROUP BY c),
n AS (SELECT k, p.d, min(p.c) AS conv_id, count(*) AS n_convs, max(b) AS b, sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (l.n = p.d), '')) AS ends_sha256 FROM p JOIN l ON l.c = p.c GROUP BY k, p.d),
up AS (SELECT n.k, q.k AS pk FROM n JOIN p q ON q.c = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT pk, count(*) AS n_children FROM up GROUP BY pk),
below AS (SELECT a.k, sum((n.n_convs - 1) * n.b) AS saved_tokens, count(*) FILTER (kids.pk IS NULL) AS n_leaves FROM n JOIN p a ON a.c = n.conv_id AND a.d <= n.d LEFT JOIN kids ON kids.pk = n.k GROUP BY a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.pk = n.k LEFT JOIN up ON up.k = n.k LEFT JOIN n pn ON pn.k = up.pk
"""
