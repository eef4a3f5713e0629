"""Line dedup by content-defined chunks.

A rolling hash over the hashes of two neighbouring lines sets a boundary before the first of them wherever it is no larger
than the rolling hash one line earlier or later, and at both ends of a text. A boundary depends on four lines at most, so
lines put in or taken out move only those beside them, and of two places one line apart at least one is a boundary. A chunk
reaches from a boundary to the next, two lines at least. Chunks that occur more than once in all documents are kept at
their first occurrence (smallest doc_id, then first in the text) and removed elsewhere; a removed chunk takes the line
before or after with it if these three lines stand earlier too. Candidates meet by hashes, and are removed only if
their bytes equal those of the kept ones.

Each run of three lines holds a boundary that the lines themselves decide, so dedup_lines removes every run of three or
more lines that stands earlier, whatever is around it. Of a run of just two lines the lines around decide whether it is a
chunk. dedup_passages, which the pipeline runs, lets a chunk of two lines begin at every line instead (EVERY_PAIR = 1)
and so finds those too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import SPACES, Pieces, prepared, runs, slices, stored, table, texts_of

#: Of how many pairs of lines one begins a chunk of dedup_passages.
EVERY_PAIR = 1
_NEVER = np.uint64(2**64 - 1)

_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES)] = True


def _blank_lines(found: Pieces) -> np.ndarray:
    full = np.concatenate(([0], np.cumsum(~_BLANK[np.frombuffer(found.data, np.uint8)])))
    return full[found.starts] == full[found.ends]


def _boundaries(found: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the places of the lines that begin a chunk, and whether a line of the same text is before the chunk, and after it."""
    row = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    blank = _blank_lines(found)
    tied = row[1:] == row[:-1]
    value = np.where(blank[1:] & blank[:-1], _NEVER, runs(found.hashes, 2))
    before, after = np.concatenate(([False], tied))[:-1], np.concatenate((tied, [False]))[1:]
    least = ~before | ~after
    least[1:] |= value[1:] <= value[:-1]
    least[:-1] |= value[:-1] <= value[1:]
    at = np.flatnonzero(tied & least & (value != _NEVER))
    return at, before[at], after[at]


def boundaries(text: str) -> list[int]:
    """The lines of one text at which a chunk begins."""
    return _boundaries(Pieces([text.encode()], b"\n", empty=True))[0].tolist()


def _batch(rows: dict[str, tuple[np.ndarray | list, pa.DataType, np.ndarray | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t, mask=m) for x, t, m in rows.values()], list(rows))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk: doc_id, place of its first line, hash, and its hashes with the line before and the line after (null without one)."""
    for batch in slices(batches, "text"):
        found = Pieces(texts_of(batch, "text"), b"\n", empty=True)
        at, before, after = _boundaries(found)
        row = np.searchsorted(found.first, at, side="right") - 1
        pair, triple = runs(found.hashes, 2).view(np.int64), np.concatenate((runs(found.hashes, 3).view(np.int64), [0, 0]))
        yield _batch({
            "doc_id": (batch.column(0).to_numpy(zero_copy_only=False)[row], pa.int64(), None), "at": ((at - found.first[row]).astype(np.int32), pa.int32(), None), "hash": (pair[at], pa.int64(), None),
            "before": (triple[at - 1], pa.int64(), ~before), "after": (triple[at], pa.int64(), ~after)})


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's repeated chunks, and three lines around each; these are wanted where a removed chunk ends and no other goes on."""
    for batch in batches:
        flat = batch.column(1).flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(1))))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
        at, later = flat.field("at").to_numpy(), flat.field("later").to_numpy(zero_copy_only=False)
        line = row * 2**32 + at
        gone = np.concatenate((line[later], line[later] + 1))
        sides = [(at, 2, "hash", np.ones(len(at), bool)), (at - 1, 3, "before", later & ~np.isin(line - 1, gone)), (at, 3, "after", later & ~np.isin(line + 2, gone))]
        for start, lines, name, wanted in sides:
            digest = flat.field(name)
            known = np.flatnonzero(digest.is_valid())
            yield _batch({
                "doc_id": (ids[known], pa.int64(), None), "at": (start[known], pa.int32(), None), "lines": (np.full(len(known), lines), pa.int32(), None),
                "hash": (digest.drop_null().to_numpy(), pa.int64(), None), "wanted": (wanted[known], pa.bool_(), None)})


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks at the places `ats`, with their bytes."""
    for batch in slices(batches, "text"):
        found = Pieces(texts_of(batch, "text"), b"\n", empty=True)
        rows = [(i, d["at"], d["hash"], found.data[found.starts[a + d["at"]] : found.ends[a + d["at"] + d["lines"] - 1]]) for i, ats, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), found.first.tolist(), found.first[1:].tolist(), strict=False) for d in ats if a + d["at"] + d["lines"] <= b]
        yield _batch({k: ([r[j] for r in rows], t, None) for j, (k, t) in enumerate((("doc_id", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("chunk", pa.binary())))})


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with a place (doc_id, at): the keys that stand at more than one, and the first place of each as `one`."""
    place = F.struct("doc_id", "at")
    return rows.groupBy(*keys).agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one < other").drop("other")


def _later(lines: Column) -> Column:
    """Whether a place comes after `one`, without overlap."""
    return (F.col("doc_id") > F.col("one.doc_id")) | (F.col("doc_id") == F.col("one.doc_id")) & (F.col("at") >= F.col("one.at") + lines)


def _left(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents without the chunks `drops` (doc_id, at, lines, chunk)."""
    of = drops.groupBy("doc_id").agg(F.collect_list(F.struct("at", "lines", "chunk")).alias("drops"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    joined = given.join(of, "doc_id", "left").select(F.col("row")[text_col].cast("string").alias("text"), "row", "drops")
    schema = f"row {given.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    return joined.mapInArrow(lambda x: _without(x, ["row", "text", "n_lines", "n_removed"]), schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents (all columns in a struct `row`) with text, n_lines and n_removed after removing repeated chunks.

    Removed are each three neighbouring lines, not all blank, that begin earlier (a smaller doc_id, or three or more lines
    before in the same text), and each two that are a chunk here and at an earlier place. At least the first occurrence of
    each line is kept. Blank lines between removed ones go with them. Lines end at \\n. Null texts stay null and
    have no lines; empty texts too; blank lines alone are left. Rows of the same id count as one document: their
    chunks at the same place are one occurrence, so a repeated row keeps what its twin keeps. Rows with a null id are
    returned as they are and are nobody's first occurrence. A text needs about 30 times its bytes of memory in its
    task, a single line of any length too. Columns may have any names, since they stay in `row`; an empty table gives an
    empty result.
    """
    prepared(docs.sparkSession)
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    chunks = light.mapInArrow(_chunks, "doc_id long, at int, hash long, before long, after long")
    met = stored(_repeated(chunks, "hash"), "met")
    own = chunks.join(met, "hash").groupBy("doc_id").agg(F.collect_set(F.struct("at", "hash", "before", "after", _later(F.lit(2)).alias("later"))).alias("chunks"))
    around = stored(own.mapInArrow(_candidates, "doc_id long, at int, lines int, hash long, wanted boolean"), "around")
    # Stored, so that the join below has an exchange of its own on either side and a very common chunk can be split.
    hot = around.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("one"), F.max(F.struct("doc_id", "at")).alias("other"), F.max("wanted").alias("wanted")).where("one < other and wanted").select("hash")
    hot = stored(hot, "hot")
    places = stored(around.select("doc_id", "at", "lines", "hash").join(hot, "hash"), "places")
    hits = places.groupBy("doc_id").agg(F.collect_set(F.struct("at", "lines", "hash")).alias("ats"))
    compared = light.join(hits, "doc_id").mapInArrow(_bytes, "doc_id long, at int, hash long, chunk binary")
    repeated = stored(_repeated(compared, "hash", "chunk"), "repeated")
    return _left(docs, places.join(repeated, "hash").where(_later(F.col("lines"))), id_col, text_col)


def _pairs(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The chunks of two neighbouring lines, not both blank, that begin where their rolling hash says so: doc_id, place of the first, hash."""
    for batch in slices(batches, "text"):
        found = Pieces(texts_of(batch, "text"), b"\n", empty=True)
        row = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        blank = _blank_lines(found)
        rolled = runs(found.hashes, 2)
        at = np.flatnonzero((row[1:] == row[:-1]) & ~(blank[1:] & blank[:-1]) & (rolled % np.uint64(every) == 0))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[row[at]]
        places = (at - found.first[row[at]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places), pa.array(rolled[at].view(np.int64))], ["doc_id", "at", "hash"])


def _pair_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs at the places `ats`, with their bytes."""
    for batch in slices(batches, "text"):
        found = Pieces(texts_of(batch, "text"), b"\n", empty=True)
        hashes = runs(found.hashes, 2).view(np.int64)
        rows = [(i, at, hashes[a + at], found.data[found.starts[a + at] : found.ends[a + at + 1]]) for i, ats, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), found.first, found.first[1:], strict=False) for at in ats if a + at + 1 < b]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "at", "hash", "pair"])


def _without(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, lines, removed = [], [], []
        given = batch.column(batch.schema.get_field_index("text")).to_pylist()
        drops = batch.column(batch.schema.get_field_index("drops")).to_pylist()
        found = Pieces(texts_of(batch, "text"), b"\n", empty=True)
        blank = _blank_lines(found)
        for old, drop, a, b in zip(given, drops, found.first.tolist(), found.first[1:].tolist(), strict=False):
            lines.append(b - a if old else 0)
            gone = np.zeros(b - a, bool)
            for d in drop or ():
                at = a + d["at"]
                if at + d["lines"] <= b and found.data[found.starts[at] : found.ends[at + d["lines"] - 1]] == d["chunk"]:
                    gone[d["at"] : d["at"] + d["lines"]] = True
            removed.append(0)
            if not gone.any():
                texts.append(old)
                continue
            # Blank lines in between go with the lines around them.
            marked = np.flatnonzero(gone | ~blank[a:b])
            for x, y in zip(marked, marked[1:], strict=False):
                gone[x:y] |= gone[x] & gone[y]
            texts.append(b"\n".join([found.data[found.starts[k] : found.ends[k]] for k in (a + np.flatnonzero(~gone)).tolist()]).decode("utf-8"))
            removed[-1] = int(gone.sum())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names)


def dedup_passages(docs: DataFrame, every: int = EVERY_PAIR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As dedup_lines, but without each run of two or more lines, too, that stands line for line at an earlier place.

    Two neighbouring lines, not both blank, are removed if the same two lines begin earlier (a smaller doc_id, or two or
    more lines before in the same text). At least the first occurrence of each line is kept. Pairs that share a hash with
    others are compared by bytes. With every above 1 only that share of the pairs, chosen by their hash, is looked at. Null and
    empty texts, repeated rows and null ids are treated as in dedup_lines. A text needs about 30 times its bytes of
    memory in its task, a single line of any length too. Columns may have any names, since they stay in `row`; an
    empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    pairs = light.mapInArrow(lambda x: _pairs(x, every), "doc_id long, at int, hash long")
    met = stored(_repeated(pairs, "hash").select("hash"), "met")
    hits = pairs.join(met, "hash").groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    compared = light.join(hits, "doc_id").mapInArrow(_pair_bytes, "doc_id long, at int, hash long, pair binary")
    repeated = stored(_repeated(compared, "hash", "pair"), "repeated")
    return _left(docs, pairs.join(repeated, "hash").where(_later(F.lit(2))).select("doc_id", "at", F.lit(2).alias("lines"), F.col("pair").alias("chunk")), id_col, text_col)


def op9_content_defined_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed lines, kept_sha256 (hex digest of the text that is left)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
