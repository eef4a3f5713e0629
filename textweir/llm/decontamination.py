"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides are turned into words and the words into hashes. For windows of L words (10, or all words of a shorter
item) each text keeps, of the k-gram hashes of every L consecutive words, the smallest one and its place: a
fingerprint. Two texts that share L consecutive words keep the same fingerprint there, so a join of fingerprints finds
every shared window; each hit is then extended to the windows around it, which are compared with those of the items.
Fingerprints travel with the few word hashes around them, so a hit is settled without the document's text.

The benchmark's fingerprints, and its windows, are each broadcast only while they are at most BROADCAST_ROWS; beyond that they
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import prepared, stored, table

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIGH = -(1 << 32)


def words_of(text: Column) -> Column:
    """A text's words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    words = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(words, "")


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of words_of()."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose value is worked out once a row: explode() of one element keeps the optimizer from putting
    the expression in the place of each use, which inside a lambda would mean once for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def hashed_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, wh, n): the hashes of each row's words, and how many there are."""
    rows = settled(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("given_text")), "wh", word_hashes(F.col("given_text")))
    return rows.select("id", "wh", F.size("wh").alias("n"))


def _windows(length: int) -> tuple[int, int]:
    """k of the k-grams, and how many of them a window of `length` words has."""
    k = min(GRAM, length)
    return k, length - k + 1


def _grams(k: int) -> Column:
    """Of each k-gram, its hash's upper half over its place, so that the smallest is the leftmost smallest."""
    hashed = lambda i: F.xxhash64(F.slice("wh", i + 1, k)).bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))
    return F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(0), F.col("n") - k), hashed)).otherwise(F.array().cast("array<long>"))


def fingerprints(words: DataFrame, lengths: list[int], wanted: DataFrame | None = None, items: bool = False) -> DataFrame:
    """words (id, wh, n) -> (id, length, fp, pos, lo, around): fingerprints for windows of each length, their place, and the
    words that windows with them span. A row's words are read once for all lengths.

    items: a row has windows of one length only, the largest it can have. wanted: a small table (length, fp) to broadcast; then
    the words around are cut out for its fingerprints only."""
    rows = words
    for k in sorted({_windows(length)[0] for length in lengths}):
        rows = settled(rows, f"g{k}", _grams(k))

    def marks(length: int) -> Column:
        k, w = _windows(length)
        grams = F.col(f"g{k}")
        kept = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - length + 1), lambda j: F.array_min(F.slice(grams, j, w)))) if w > 1 else grams
        has = F.least("n", F.lit(WINDOW)) == length if items else F.col("n") >= length
        return F.when(has, F.transform(kept, lambda p: F.struct(F.lit(length).alias("length"), p.alias("p")))).otherwise(F.array().cast("array<struct<length:int,p:long>>"))

    found = [marks(length) for length in lengths]
    rows = rows.select("id", "wh", F.explode(F.flatten(F.array(*found))).alias("m"))
    pos = F.col("m.p").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = rows.select("id", "wh", "m.length", F.shiftright("m.p", 32).cast("int").alias("fp"), pos.cast("int").alias("pos"))
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted), ["length", "fp"], "left_semi")
    back = F.col("length") - F.least("length", F.lit(GRAM))  # a window has one k-gram more than that
    rows = rows.withColumn("lo", F.greatest(F.col("pos") - back, F.lit(0)))
    return rows.select("id", "length", "fp", "pos", "lo", F.slice("wh", F.col("lo") + 1, F.col("pos") - F.col("lo") + F.col("length")).alias("around"))


def _extended(rows: DataFrame) -> DataFrame:
    """(id, length, start, w1, w2): the windows that a fingerprint's surroundings hold, as two hashes."""
    starts = F.explode(F.sequence(F.lit(0), F.size("around") - F.col("length"))).alias("i")
    rows = rows.where(F.size("around") >= F.col("length")).select("id", "length", "lo", "around", starts)
    window = F.slice("around", F.col("i") + 1, F.col("length"))
    return rows.select("id", "length", (F.col("lo") + F.col("i")).alias("start"), window.alias("window")).select("id", "length", "start", F.xxhash64("window").alias("w1"), F.hash("window").alias("w2"))


def window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start, length, item_id) of every place where a document holds a window of an item, from (id, wh, n) tables."""
    lengths = sorted(r.length for r in items.where("n > 0").select(F.least("n", F.lit(WINDOW)).alias("length")).distinct().collect())  # 10 at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, start int, length int, item_id long")
    marks = fingerprints(items, lengths, items=True)
    fps = stored(marks.select("length", "fp").distinct(), "fingerprints")
    windows = stored(_extended(marks).select("length", "w1", "w2", F.col("id").alias("item_id")).distinct(), "windows")
    hits = fingerprints(docs, lengths, fps) if fps.count() <= BROADCAST_ROWS else fingerprints(docs, lengths).join(fps, ["length", "fp"], "left_semi")
    spans = _extended(hits).distinct()
    return spans.join(F.broadcast(windows) if windows.count() <= BROADCAST_ROWS else windows, ["length", "w1", "w2"]).select(F.col("id").alias("doc_id"), "start", "length", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 10 consecutive words of an item, or all words of an item that has fewer. A document's word inside any
    occurrence of a window counts as hit; n_items counts the items with an occurring window, and items_sha256 is the
    hex digest of their ids, sorted as text and joined by commas. Null texts and texts without words have no words
    and no hits; items without words have no window. Rows of the same doc_id share their hits, as one document with
    several texts (so a repeated row gets the same result); a null id has no hits. Items of the same text count each.
    Other columns are ignored, whatever their names. Empty tables on either side are fine. A text is one row throughout, and
    takes some hundred bytes of memory for each of its words and each length of windows.
    """
    prepared(docs.sparkSession)
    words = hashed_words(docs, id_col, text_col)
    tests = stored(hashed_words(items, item_col, item_text).where("id is not null"), "items")
    hits = stored(window_hits(words.where("id is not null"), tests), "hits")
    # Hit words: windows in order of their starts, each adding what lies beyond the furthest end so far.
    spans = hits.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    covered = spans.groupBy("doc_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("far")),
            lambda acc, x: F.struct((acc["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["far"], x["start"]))).alias("hit"), F.greatest(acc["far"], x["end"]).alias("far")))["hit"].cast("long").alias("n_hit"))
    named = hits.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    found = covered.join(named, "doc_id")
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = counts.join(found, "doc_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("ids", none), ",").cast("binary"), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(len(ws), 10)::INTEGER AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i+l-1], ' ') AS g FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i+l-1], ' ') AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, ls WHERE len(ws) >= l)),
h AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
