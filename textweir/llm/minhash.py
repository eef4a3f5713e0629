"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct shingles of five words; two documents are linked when the Jaccard similarity of
their sets is at least 0.75. Each set is hashed once; the smallest hash of each of BANDS * ROWS bins is its
signature, and an empty bin copies the first full one in a random order of its own. Sets that share a band meet in a
bucket. There each document is compared only with the bucket's centre (the member that meets most others anywhere),
and every comparison is settled on the full sets: a star, so a bucket has fewer pairs than members. What a star leaves
apart may still be linked to other members. The members of buckets that then hold several components are compared
exactly, by their rare shingles (see _rest), so no pair of a bucket is lost and no bucket's pairs are listed.

With 32 bands of 4 rows, a pair of similarity 0.75 meets in no bucket with probability (1 - 0.75**4)**32 = 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import Pieces, components, constants, dropped, mixed, prepared, runs, slices, stored, table, texts_of

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 32, 4
#: Set sizes up to this factor apart form a size class of _rest.
SIZE_CLASS = 1.12


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, those of each text sorted and together, and where each text's begin
    (one more entry at the end); all words are one shingle where there are fewer than k."""
    words = Pieces(texts, lower=True)
    n = np.diff(words.first)
    kept = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    edges = np.concatenate(([0], np.cumsum(kept)))
    found = np.empty(edges[-1], np.uint64)
    whole = runs(words.hashes, k)  # also those that reach into the next text, which are passed over
    for a, b, size, start in zip(edges, edges[1:], n, words.first, strict=False):
        if size >= k:
            found[a:b] = np.sort(whole[start : start + b - a])
        elif size:
            found[a:b] = runs(words.hashes[start : start + size], size, seed=1000 + size)
    fresh = np.ones(len(found), bool)
    fresh[1:] = found[1:] != found[:-1]
    fresh[edges[:-1][kept > 0]] = True
    return found[fresh], np.concatenate(([0], np.cumsum(fresh)))[edges]


@lru_cache(maxsize=4)
def _orders(n: int) -> np.ndarray:
    """For each bin its own random order of all bins."""
    return np.random.default_rng(17).permuted(np.tile(np.arange(n), (n, 1)), axis=1)


def signatures(found: np.ndarray, edges: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash, a row for each non-empty set of shingle_sets; bins is a power of two.

    An empty bin goes through the bins in its own order and takes what the first full one holds."""
    sizes = np.diff(edges)
    sizes = sizes[sizes > 0]
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = row * bins + (found >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)
    least = np.flatnonzero(np.diff(at, prepend=-1))
    full = np.zeros((len(sizes), bins), bool)
    out = np.empty((len(sizes), bins), np.uint64)
    full.reshape(-1)[at[least]] = True
    out.reshape(-1)[at[least]] = found[least]
    row, own = np.nonzero(~full)
    for probe in range(bins):
        if not len(row):
            break
        other = _orders(bins)[own, probe]
        hit = full[row, other]
        out[row[hit], own[hit]] = out[row[hit], other[hit]]
        row, own = row[~hit], own[~hit]
    return out


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    at = constants(bands, 31)
    by = constants(rows, 37)
    for batch in slices(batches, "text"):
        found, edges = shingle_sets(texts_of(batch, "text"), k)
        n = np.diff(edges)
        full = n > 0
        sums = np.zeros((2, len(n)), np.uint64)
        keys = np.empty((0, bands), np.uint64)
        if len(found):
            for i, own in enumerate(sums):
                own[full] = np.add.reduceat(mixed(found + np.uint64(i + 1)), edges[:-1][full])
            keys = mixed((signatures(found, edges, bands * rows).reshape(-1, bands, rows) * by).sum(axis=2, dtype=np.uint64) + at)
        ends = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])


def _hashed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found, edges = shingle_sets(texts_of(batch, "text"), k)
        sets = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(found.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), sets], ["rep", "hashes"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Texts of fewer than k words have one shingle, their whole
    word sequence; null, empty or blank texts have none and are linked with nothing. Rows of the same id count as one
    document, linked by the texts of each: each still gets its own row with its own n_shingles, and all of them the
    same component and kept. A row with a null id is returned with a null component and kept = false. Ties cannot arise: a
    component is its smallest id. A text needs about 30 times its bytes of memory in its task. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(given.mapInArrow(lambda x: _sign(x, k, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signed")
    # Equal sets are one class, stood for by its smallest id.
    own = ["n_shingles", "s1", "s2"]
    classes = stored(signed.where("doc_id is not null and n_shingles > 0").groupBy(own).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    comps = _linked(given, classes, k, percent)
    of = classes.select(*own, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*own, F.coalesce("component", "rep").alias("component"))
    out = signed.drop("bands").join(of, own, "left").withColumn("component", F.coalesce("component", "doc_id"))
    # Rows of one id with different texts belong together, and so do the components that they tie.
    mark = F.struct(*own)
    twice = stored(signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("one"), F.max(mark).alias("other")).where("one <> other").select("doc_id"), "twice")
    if not twice.isEmpty():
        out = stored(out, "rows")
        tied = out.join(twice, "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", "component")
        least = tied.groupBy("doc_id").agg(F.min("component").alias("least"))
        fresh = components(tied.join(least, "doc_id").select("component", "least"), "component", "least").withColumnRenamed("component", "top").withColumnRenamed("node", "component")
        out = out.join(fresh, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")
        # Rows without words share the component of their id.
        of_id = stored(out.where("n_shingles > 0").join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("of_id")), "of_id")
        out = out.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("of_id", "component"))
    return out.withColumn("component", F.when(F.col("doc_id").isNotNull(), F.col("component"))).select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def _linked(given: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of all class representatives that share a bucket."""
    rows = classes.select("rep", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = stored(rows.join(shared, "key"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("m").alias("degree"))
    sets = stored(given.join(degree.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(lambda x: _hashed(x, k), "rep long, hashes array<long>").where("size(hashes) > 0"), "sets")
    # The member that meets most others is the centre of each of its buckets.
    centres = buckets.join(degree, "rep").groupBy("key").agg(F.max_by(F.struct(F.col("rep").alias("c"), F.col("n_shingles").alias("nc")), F.struct("degree", -F.col("rep"))).alias("centre")).select("key", "centre.*")
    star = buckets.join(centres, "key").where((F.col("rep") != F.col("c")) & _sizes_fit(F.col("n_shingles"), F.col("nc"), percent))
    tested = stored(_confirmed(star.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct(), sets, percent), "tested")
    tied = components(tested.where("linked"))
    labels = stored(degree.select(F.col("rep").alias("node")).join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    # Members of buckets that hold several components still.
    apart = buckets.select("key", F.col("rep").alias("node")).join(labels, "node").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = buckets.join(apart.select("key"), "key", "left_semi").select("rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep")
    found = _confirmed(_rest(sets, open_, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, percent).where("linked")
    # The components that these links tie take one label.
    ends = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    fresh = components(found.join(ends[0], "a").join(ends[1], "b").select("ca", "cb"), "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("top"))
    dropped(buckets)
    return labels.join(fresh, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _rest(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members (rep, component) of different components that may be linked; no linked pair is missing.

    Two linked sets of n and m shingles share at least (n + m) * percent / (100 + percent). So with the shingles of each in
    one order that holds for all, they share one that at least as many of either set's shingles follow or are. First in the
    order are shingles of one component only, which no pair asked for shares, then rare ones: what very many
    documents share comes last and is hardly ever looked at. How many shingles must be looked at depends on both sizes,
    so a set is laid out once for each class of sizes it may be linked to. Of the sets that meet in a shingle, those of
    the commonest component there are not compared with each other.
    """
    # Sizes are taken before each explode: what is taken after it would carry the whole array along in every row.
    shingles = sets.withColumn("n", F.size("hashes")).join(members, "rep").select("rep", "component", "n", F.explode("hashes").alias("h"))
    between = shingles.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h", "df")
    ordered = shingles.join(between, "h").groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("last"))
    size_class = lambda n: F.log(n) / F.log(F.lit(SIZE_CLASS))
    share, ratio = percent / (100 + percent), percent / 100
    laid = ordered.withColumn("own", F.floor(size_class(F.col("n")) + 1e-9)).withColumn("other", F.explode(F.sequence(F.floor(size_class(F.col("n") * ratio) - 1e-6), F.floor(size_class(F.col("n") / ratio) + 1e-6))))
    # The smallest size of the other class that fits, and the shingles to share with it, both a little too low for rounding.
    least = F.greatest(F.col("n") * ratio, F.pow(F.lit(SIZE_CLASS), F.col("other")) * (1 - 1e-6))
    need = F.ceil((F.col("n") + least) * share - 0.01).cast("int")
    looked = F.slice("last", 1, F.greatest(F.size("last") - need + 1, F.lit(0)))
    laid = laid.select("rep", "component", "n", "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"), F.size("last").alias("size"), looked.alias("looked"))
    laid = laid.select(*(x for x in laid.columns if x != "looked"), F.posexplode("looked").alias("at", "s"))
    key = ["h", "c1", "c2"]
    laid = stored(laid.select(F.col("s.h").alias("h"), "c1", "c2", "rep", "component", "n", "own", (F.col("size") - F.col("at")).alias("ahead")), "laid")
    counts = laid.groupBy(*key, "component").agg(F.count("*").alias("m")).groupBy(*key).agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("several")).where("several > 1").drop("several")
    right = laid.join(counts, key)
    left = right.where("component != main").select(*key, F.col("rep").alias("c"), F.col("component").alias("cc"), F.col("n").alias("nc"), F.col("own").alias("oc"), F.col("ahead").alias("hc"))
    met = left.join(right, key).where((F.col("component") != F.col("cc")) & ((F.col("c1") == F.col("c2")) | (F.col("own") != F.col("oc"))) & _sizes_fit(F.col("n"), F.col("nc"), percent) & (F.least("ahead", "hc") * (100 + percent) >= (F.col("n") + F.col("nc")) * percent))
    return met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with linked, judged on the full sets."""
    a = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return both.select("a", "b", (F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent).alias("linked"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g
  FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT c.a, c.b FROM c JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, peer) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.peer)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT doc_id, min(peer) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
