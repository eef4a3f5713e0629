"""Which queries match which documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textweir.functions.text import legal_words, words
from textweir.operators.lifecycle import active
from textweir.operators.wordjoin import dictionary, index_thresholds, vocabulary, word_match_table
from textweir.sources.tables import stored

#: Bits of a distance, all set if there is none; words have 31 letters at most.
_BITS = 6
_NONE = (1 << _BITS) - 1
#: Numbered query words that are broadcast, about 10 MB.
BROADCAST_WORDS = 100_000


def query_words(queries: DataFrame) -> DataFrame:
    """A row for each query word: query_id, pos, word, n_words, match_type, match_dist, start_seq, end_seq."""
    own = words(F.col("query_str"))
    return queries.select("query_id", "match_type", "match_dist", "start_seq", "end_seq", own.alias("ws")).select("query_id", F.size("ws").alias("n_words"), "match_type", "match_dist", "start_seq", "end_seq", F.posexplode("ws").alias("pos", "word"))


def doc_words(documents: DataFrame) -> DataFrame:
    """(doc_id, seq, word), each word once a document; made distinct within the row, so nothing is shuffled."""
    return documents.select("doc_id", "seq", F.explode(F.array_distinct(legal_words(F.col("text")))).alias("word"))


def _within(match_type: str = "match_type", match_dist: str = "match_dist"):
    t, d = F.col(match_type), F.col(match_dist)
    return F.when(t == 2, F.col("edit") <= d).otherwise(F.col("hamming") <= d)


def answerable(wanted: DataFrame) -> DataFrame:
    """The rows of wanted (doc_word, query_id, pos, n_words, ...) of queries each of whose words has a match at all.

    Most queries of several rare words fail here, on word pairs, before anything is joined with documents.
    """
    whole = wanted.groupBy("query_id", "n_words").agg(F.bit_or(F.expr("shiftleft(1, pos)")).alias("mask")).where(F.bit_count("mask") == F.col("n_words"))
    return wanted.join(whole.select("query_id"), "query_id", "left_semi")


def _wanted(qwords: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_word, query_id, pos, n_words, start_seq, end_seq): which words of documents match which query words."""
    return matches.join(qwords, matches.query_word == qwords.word).where(_within()).select("doc_word", "query_id", "pos", "n_words", "start_seq", "end_seq")


def _hits(dwords: DataFrame, wanted: DataFrame) -> DataFrame:
    return dwords.join(wanted, dwords.word == wanted.doc_word).where(active(F.col("seq"))).select("doc_id", "query_id", "pos", "n_words")


def word_hits(dwords: DataFrame, qwords: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(doc_id, query_id, pos, n_words): query words that a document has, for queries active at its arrival.

    The word pairs are found once over distinct words and joined with query words first, so that the join with the
    documents, whose frequent words are the skewed side, has one small row for each (word, query, position).
    """
    if matches is None:
        matches = word_match_table(vocabulary(dwords), index_thresholds(dictionary(qwords)))
    return _hits(dwords, _wanted(qwords, matches))


def covered_words(hits: DataFrame) -> DataFrame:
    """(doc_id, query_id, n_words, n_covered)."""
    mask = F.bit_or(F.expr("shiftleft(1, pos)"))
    return hits.groupBy("doc_id", "query_id", "n_words").agg(mask.alias("mask")).select("doc_id", "query_id", "n_words", F.bit_count("mask").alias("n_covered"))


def by_document(rows: DataFrame) -> DataFrame:
    """rows, dealt by doc_id once: what groups by doc_id, alone or with more, needs no further exchange."""
    return rows.repartition("doc_id")


def match_documents(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, query_id): all words of the query are matched by words of the document, and it was active on arrival.

    Hits are dealt by doc_id, so results per document are aggregated where the matches are found.
    """
    dwords, qwords = doc_words(documents), query_words(queries)
    wanted = answerable(stored(_wanted(qwords, word_match_table(vocabulary(dwords), index_thresholds(dictionary(qwords)))), "wanted"))
    return covered_words(by_document(_hits(dwords, wanted))).where("n_covered = n_words").select("doc_id", "query_id")


def match_exact(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact queries only: a plain equi-join on the word."""
    q, d = query_words(queries.where("match_type = 0")), doc_words(documents)
    hits = d.join(q, "word").where(active(F.col("seq"))).select("doc_id", "query_id", "pos", "n_words")
    return covered_words(by_document(hits)).where("n_covered = n_words").select("doc_id", "query_id")


def match_hamming(documents: DataFrame, queries: DataFrame) -> DataFrame:
    return match_documents(documents, queries.where("match_type = 1"))


def match_edit(documents: DataFrame, queries: DataFrame) -> DataFrame:
    return match_documents(documents, queries.where("match_type = 2"))


def union_matches(*matches: DataFrame) -> DataFrame:
    """Matches of several types; a query has one type, so nothing is double."""
    out = matches[0]
    for m in matches[1:]:
        out = out.unionByName(m)
    return out


def first_word_candidates(dwords: DataFrame, qwords: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(doc_id, query_id) whose first query word matched, a superset of the answer."""
    if matches is None:
        matches = word_match_table(vocabulary(dwords), index_thresholds(dictionary(qwords)))
    return word_hits(dwords, qwords.where("pos = 0"), matches).select("doc_id", "query_id").distinct()


def best_distances(dwords: DataFrame, matches: DataFrame) -> DataFrame:
    """Per document and query word the least Hamming and the least edit distance (Hamming at most i implies edit at most i).

    A word of a document meets many query words, so it travels to its document with one list of them, a long each. The
    lists are joined in the order of the words: equal ones lie one behind another, and the exchange, which would hold a row for
    each meeting, is about as large as the documents' words.
    """
    spark = dwords.sparkSession
    matches = stored(matches, "matches")
    numbers = stored(matches.select("query_word").distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    if numbers.count() <= BROADCAST_WORDS:
        numbers = F.broadcast(numbers)
    held = lambda distance: F.coalesce(distance, F.lit(_NONE)).cast("long")
    code = F.col("number") * (1 << 2 * _BITS) + held(F.col("hamming")) * (1 << _BITS) + held(F.least("edit", "hamming"))
    lists = matches.join(numbers, "query_word").groupBy("doc_word").agg(F.collect_list(code).alias("codes"))
    met = dwords.join(lists.hint("merge"), dwords.word == lists.doc_word).select("doc_id", "codes")
    # As many partitions as are set: lists are small on the way and many rows when they are opened, so few partitions would spill.
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", F.explode("codes").alias("code"))
    place = lambda i: F.shiftright("code", i * _BITS).bitwiseAND(F.lit(_NONE))
    best = dealt.groupBy("doc_id", F.shiftright("code", 2 * _BITS).alias("number")).agg(F.min(place(1)).alias("h"), F.min(place(0)).alias("e"))
    found = lambda c: F.when(F.col(c) < _NONE, F.col(c)).cast("int")
    return best.join(numbers, "number").select("doc_id", "query_word", found("h").alias("best_hamming"), found("e").alias("best_edit"))


def document_results(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, num_res, query_ids ascending), documents without a match included."""
    found = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list("query_id")).alias("query_ids"))
    ids = F.coalesce("query_ids", F.array().cast("array<bigint>"))
    return documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.size(ids).alias("num_res"), ids.alias("query_ids"))


def unmatched_documents(documents: DataFrame, matches: DataFrame) -> DataFrame:
    return documents.select("doc_id").join(matches, "doc_id", "left_anti")


def in_arrival_order(results: DataFrame, documents: DataFrame) -> DataFrame:
    return results.join(documents.select("doc_id", "seq"), "doc_id").orderBy("seq")


def undelivered(results: DataFrame, delivered: DataFrame) -> DataFrame:
    return results.join(delivered.select("doc_id"), "doc_id", "left_anti")
