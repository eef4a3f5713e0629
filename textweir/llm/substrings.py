"""Substring dedup by super-k-mers: windows of 50 words that also start in an earlier document are removed.

The minimiser of a window is the smallest hash of its runs of GRAM words. Consecutive windows with one minimiser form a
super-k-mer, which travels as one packed string to its bucket, the minimiser. Minimisers that only one document has are
left out first, by their smallest and largest doc_id, and equal strings become one row on the way. In a bucket all windows
of its strings are sorted, equal ones are told by their words, and each learns the smallest doc_id that holds it; what goes
on is a row for each run of windows that a document may lose. A bucket of more than HOT_STRINGS different strings is not
left to one task: its windows are rows of their own, which are counted with partial sums, by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import Pieces, dropped, mixed, prepared, runs, slices, stored, table, texts_of

WINDOW, GRAM = 50, 8
#: Different strings of a bucket that are sorted in one task (about 10 MB), and bytes of strings that are sorted at once.
HOT_STRINGS, CHUNK_BYTES = 20_000, 1_000_000


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, words) of each super-k-mer of one text's word hashes."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, span = runs(hashes, gram), window - gram + 1
    # The smallest of each `span` consecutive hashes, by doubling.
    low, width = grams, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    least = np.minimum(low[:n], low[span - width : span - width + n])
    first = np.concatenate(([0], np.flatnonzero(np.diff(least) != 0) + 1))
    counts = np.diff(np.append(first, n))
    # Windows of a very repetitive text may share a minimiser on and on; such a run is cut, so no string is long.
    if counts.max() > 4 * window:
        cut = [np.arange(a, a + c, 4 * window) for a, c in zip(first.tolist(), counts.tolist(), strict=True)]
        first = np.concatenate(cut)
        counts = np.diff(np.append(first, n))
    return least[first].view(np.int64), first, counts + window - 1


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Pieces(texts_of(batch, "text"))
        ids, keys = [], []
        for i, a, b in zip(batch.column(0).to_pylist(), words.first, words.first[1:], strict=False):
            own = np.unique(super_kmers(words.hashes[a:b])[0])
            keys.append(own)
            ids.append(np.full(len(own), i, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], ["doc_id", "key"])


PACKED = "key long, sid binary, doc_id long, mark long, at int, words binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, keys, mark) -> their super-k-mers with one of the keys: the words joined by one space, and a digest of these."""
    for batch in slices(batches, "text"):
        words = Pieces(texts_of(batch, "text"))
        rows: list[tuple] = []
        for i, mark, keys, a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2), words.first, words.first[1:], strict=False):
            key, first, count = super_kmers(words.hashes[a:b])
            keep = np.isin(key, np.asarray(keys.values))
            for k, f, c in zip(key[keep].tolist(), first[keep].tolist(), count[keep].tolist(), strict=True):
                packed = b" ".join(words.data[words.starts[a + f] : words.ends[a + f + c - 1]].split())
                rows.append((k, hashlib.blake2b(packed, digest_size=16).digest(), i, mark, f, packed))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "sid", "doc_id", "mark", "at", "words"])


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column, about `least` bytes of the last column at once, no value of the first in two parts."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            size = sum(x.slice(0).column(x.num_columns - 1).nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed strings -> the numbers of their words (equal words, equal numbers), and where each string's begin (one more at the end)."""
    values = words.to_pylist()
    data = b" ".join(values) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = pa.array(np.concatenate(([0], ends)), pa.int64())
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(data)])
    first = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(v) + 1 for v in values]), side="right")))
    return every.dictionary_encode().indices.to_numpy().astype(np.int64), first


def equal_windows(numbers: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows that begin at `at` in which equal ones are neighbours, and where in it each group begins."""
    hashed = runs(mixed(numbers.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    pairs = np.flatnonzero(same)
    a, b = at[order[pairs]], at[order[pairs + 1]]
    if all((numbers[a + j] == numbers[b + j]).all() for j in range(window)):
        return order, np.concatenate(([0], np.flatnonzero(~same) + 1))
    _, of = np.unique(np.lib.stride_tricks.sliding_window_view(numbers, window)[at], axis=0, return_inverse=True)  # two windows share a hash
    order = np.argsort(of.reshape(-1), kind="stable")
    return order, np.concatenate(([0], np.flatnonzero(np.diff(of.reshape(-1)[order])) + 1))


RUNS = "key long, sid binary, lo int, hi int, first long"


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets (key, sid, one, other, words) -> the runs of windows that also start in a document before `other`."""
    for rows in _whole_keys(batches, CHUNK_BYTES):
        key, one, other = (rows.column(c).to_numpy() for c in ("key", "one", "other"))
        numbers, first = _numbered(rows.column("words").combine_chunks())
        counts = np.diff(first) - WINDOW + 1
        of = np.repeat(np.arange(len(counts)), counts)
        off = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, groups = equal_windows(numbers, first[:-1][of] + off)
        least = np.empty(len(of), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(one[of[order]], groups), np.diff(np.append(groups, len(of))))
        lo = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (least[1:] != least[:-1]))))
        hi = np.append(lo[1:], len(of)) - 1
        lost = least[lo] < other[of[lo]]
        lo, hi = lo[lost], hi[lost]
        string = pa.array(of[lo])
        yield pa.RecordBatch.from_arrays([pa.array(key[of[lo]]), rows.column("sid").combine_chunks().take(string), pa.array(off[lo].astype(np.int32)), pa.array(off[hi].astype(np.int32)), pa.array(least[lo])], ["key", "sid", "lo", "hi", "first"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sid, one, other, words) -> a row for each window of a string: key, sid, one, other, off, digest of its words."""
    for batch in batches:
        for part in range(0, batch.num_rows, 64):
            rows = batch.slice(part, 64)
            of, off, digests = [], [], []
            for i, packed in enumerate(rows.column(4).to_pylist()):
                cuts = [0, *(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32) + 1).tolist(), len(packed) + 1]
                for k in range(len(cuts) - WINDOW):
                    of.append(i)
                    off.append(k)
                    digests.append(hashlib.blake2b(packed[cuts[k] : cuts[k + WINDOW] - 1], digest_size=16).digest())
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(rows.column(i).take(at) for i in range(4)), pa.array(off, pa.int32()), pa.array(digests, pa.binary())], ["key", "sid", "one", "other", "off", "digest"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for i, text, spans in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), batch.column(2), strict=True):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            if spans.is_valid and len(spans):
                at = np.array([(s["start"], s["stop"]) for s in spans.as_py()])
                np.add.at(gone, at[:, 0], 1)
                np.add.at(gone, at[:, 1], -1)
            out = np.cumsum(gone)[:-1] > 0
            kept = b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x) if out.any() else b" ".join(words)
            rows.append((i, kept.decode("utf-8", "replace"), len(words), int(out.sum())))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "text", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (kept words joined by one space), n_words, n_removed.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Null texts and texts of fewer than 50 words lose nothing. Of several rows
    with one id none is earlier than another, so each loses only what smaller ids hold. Rows with a null id are returned unchanged and count for nobody. Windows are judged on
    the input. A text needs about 30 times its bytes of memory in its task. Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = given.withColumn("mark", F.xxhash64("text"))  # tells rows of one id apart
    known = given.where("doc_id is not null")
    pairs = stored(known.mapInArrow(_minimisers, "doc_id long, key long"), "minimisers")
    shared = pairs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    wanted = pairs.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    packed = stored(known.join(wanted, "doc_id").select("doc_id", "text", "keys", "mark").mapInArrow(_packed, PACKED), "packed")
    dropped(pairs)
    strings = packed.groupBy("key", "sid", "words").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other"))
    strings = stored(strings.select("key", "sid", "one", "other", "words"), "strings")
    hot = stored(strings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_STRINGS).select("key"), "hot")
    found = strings.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_windows, RUNS)
    if not hot.isEmpty():
        windows = stored(strings.join(hot, "key", "left_semi").select("key", "sid", "one", "other", "words").mapInArrow(_windows, "key long, sid binary, one long, other long, off int, digest binary"), "windows")
        least = windows.groupBy("key", "digest").agg(F.min("one").alias("first"), F.max("other").alias("last")).where("first < last").drop("last")
        found = found.unionByName(windows.join(least, ["key", "digest"]).where("first < other").select("key", "sid", F.col("off").alias("lo"), F.col("off").alias("hi"), "first"))
    found = stored(found, "runs")
    dropped(strings)
    hits = packed.select("key", "sid", "doc_id", "mark", "at").join(found, ["key", "sid"]).where("first < doc_id")
    spans = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct((F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + WINDOW).alias("stop"))).alias("spans"))
    return given.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(_cleaned, "doc_id long, text string, n_words long, n_removed long")


def op10_super_kmer_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT md5(g) AS g, min(doc_id) AS lo FROM w GROUP BY 1),
h AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 50)) AS p FROM w JOIN f ON md5(w.g) = f.g WHERE f.lo < w.doc_id)),
k AS (SELECT doc_id, list(p) AS ps FROM h GROUP BY 1),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
r AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.p) AS kept FROM u LEFT JOIN h ON u.doc_id = h.doc_id AND u.p = h.p WHERE h.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
