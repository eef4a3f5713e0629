"""Similarity joins between the distinct words of documents and of queries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textweir.functions.distance import letter_mask, packed, packed_hamming
from textweir.functions.text import MOST_DISTANCE
from textweir.sources.tables import spread, stored

#: By distance: each vocabulary word is compared with all dictionary words of about its length while these are at most so
#: many, where both ways took equally long (203,788 words of sf0.1); beyond that words meet in the letters they have in
#: common. A dictionary below the bound has at most 80,000 words, about 5 MB.
BAND_WORDS = {1: 1500, 2: 4500, 3: 18_000}
#: Needed words of one k and length that a vocabulary word is compared with on packed letters; more are met by keys.
HAMMING_WORDS = 2000


def vocabulary(doc_words: DataFrame) -> DataFrame:
    return doc_words.select("word").distinct()


def dictionary(query_words: DataFrame) -> DataFrame:
    """Per word its uses: n_hamming (exact and Hamming), n_edit_0 to n_edit_3, max_edit and max_hamming (null if unused)."""
    edit = F.col("match_type") == 2
    return query_words.groupBy("word").agg(
        F.count_if(~edit).alias("n_hamming"), *(F.count_if(edit & (F.col("match_dist") == i)).alias(f"n_edit_{i}") for i in range(MOST_DISTANCE + 1)),
        F.max(F.when(~edit, F.col("match_dist"))).alias("max_hamming"), F.max(F.when(edit, F.col("match_dist"))).alias("max_edit"))


def index_thresholds(dictionary: DataFrame) -> DataFrame:
    """(word, max_hamming, max_edit): the widest search that each word needs."""
    return dictionary.select("word", "max_hamming", "max_edit")


def exact_word_join(vocab: DataFrame, words: DataFrame) -> DataFrame:
    return vocab.join(words.select("word").distinct(), "word").select(F.col("word").alias("doc_word"), F.col("word").alias("query_word"))


def _cut(word: str, parts: int) -> list[Column]:
    """The word in `parts` near-equal pieces."""
    n = F.length(word)
    start = lambda i: F.floor(n * i / parts).cast("int")
    return [F.substring(F.col(word), start(i) + 1, start(i + 1) - start(i)) for i in range(parts)]


def _piece_pairs(word: str, k: int) -> Column:
    pieces = _cut(word, k + 2)
    return F.array(*(F.concat(F.lit(f"{k}{i}{j}"), pieces[i], F.lit(" "), pieces[j]) for i, j in combinations(range(k + 2), 2)))


def _lengths(need: DataFrame) -> dict[int, dict[int, int]]:
    """By k and length, how many words are needed; a row for each k and length is collected."""
    counts: dict[int, dict[int, int]] = {}
    for r in need.groupBy("k", F.length("word").alias("len")).count().collect():
        counts.setdefault(r.k, {})[r.len] = r["count"]
    return counts


def _some(k: str, length: str, chosen: list[tuple[int, int]]) -> Column:
    """Whether (k, length) is one of the chosen."""
    return reduce(lambda a, b: a | b, (F.col(k).eqNullSafe(x) & F.col(length).eqNullSafe(n) for x, n in chosen), F.lit(False))


def _hamming_pairs(vocab: DataFrame, need: DataFrame, band_words: int | None = None) -> DataFrame:
    """(doc_word, query_word, hamming) of distinct vocabulary words within each needed word's own k, from distinct need (word, k).

    Needed words of one k and length that are at most band_words (HAMMING_WORDS) are broadcast and met by length: with packed
    letters a comparison costs little. More are met by keys: k mismatches leave two of k + 2 pieces untouched, so
    words meet on (length, which two, their letters), and a key has half or a third of a word's letters, far rarer than
    a single piece. A vocabulary word has keys for those k only that a needed word of its length has. Pairs are verified, on packed letters,
    before they are made distinct.
    """
    most = HAMMING_WORDS if band_words is None else band_words
    chosen = [(k, n, c) for k, by in _lengths(need).items() for n, c in by.items()]
    few, many = [(k, n) for k, n, c in chosen if c <= most], [(k, n) for k, n, c in chosen if c > most]
    q = need.select(F.col("word").alias("query_word"), "k", F.length("word").alias("len"), packed(F.col("word")).alias("qp"))
    v = vocab.select(F.col("word").alias("doc_word"), F.length("word").alias("len"), packed(F.col("word")).alias("vp"))
    within = lambda pairs: pairs.select("doc_word", "query_word", packed_hamming(F.col("vp"), F.col("qp")).alias("hamming"), "k").where("hamming <= k").drop("k")
    out = within(v.join(F.broadcast(q.where(_some("k", "len", few))), "len"))
    if many:
        ks = sorted({k for k, _ in many})
        own = v.join(F.broadcast(v.sparkSession.createDataFrame(many, "k int, len int")), "len")
        keys = lambda word: reduce(lambda rest, k: F.when(F.col("k") == k, _piece_pairs(word, k)).otherwise(rest), ks, F.array().cast("array<string>"))
        own = own.select("doc_word", "vp", "len", F.explode(keys("doc_word")).alias("key"))
        other = q.where(_some("k", "len", many)).select("query_word", "qp", "k", "len", F.explode(keys("query_word")).alias("key"))
        out = out.unionByName(within(own.join(other, ["len", "key"])).distinct())
    return out


def hamming_word_join(vocab: DataFrame, words: DataFrame, k: int = MOST_DISTANCE, band_words: int | None = None) -> DataFrame:
    """(doc_word, query_word, hamming) of equal length and at most k mismatches."""
    return _hamming_pairs(spread(vocab.select("word").distinct()), words.select("word", F.lit(k).alias("k")).distinct(), band_words)


def _shorter(word: str, k: int) -> Column:
    """What is left of a word after up to k deletions, as structs (rest, most): most tells whether k letters, or all, are gone."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda p: F.concat(F.substring(s, F.lit(1), p - 1), F.substring(s, p + 1, F.length(s))))
    levels = [F.array(F.col(word))]
    for _ in range(k):
        some = F.filter(levels[-1], lambda s: s != "")
        levels.append(F.array_distinct(F.flatten(F.transform(some, without))))
    tagged = lambda level, i: F.transform(level, lambda s: F.struct(s.alias("rest"), (F.lit(i == k) | (s == "")).alias("most")))
    return F.concat(*(tagged(level, i) for i, level in enumerate(levels)))


def _verified(pairs: DataFrame, k: Column) -> DataFrame:
    """(doc_word, query_word, edit) of the pairs (doc_word, vm, query_word, qm) within k, each once: first by letters, then by distance."""
    near = pairs.where(F.bit_count(F.col("vm").bitwiseXOR(F.col("qm"))) <= 2 * k)
    return near.select("doc_word", "query_word", F.levenshtein("doc_word", "query_word").alias("edit"), k.alias("k")).where("edit <= k").drop("k")


def _band(v: DataFrame, q: DataFrame) -> DataFrame:
    """Pairs within k: q (query_word, qm, len, k) is broadcast at each length within its k, and met by length."""
    near = F.explode(F.sequence(F.col("len") - F.col("k"), F.col("len") + F.col("k"))).alias("len")
    left = v.select("doc_word", "vm", F.length("doc_word").alias("len"))
    pairs = left.join(F.broadcast(q.select("query_word", "qm", "k", near)), "len").where(F.bit_count(F.col("vm").bitwiseXOR(F.col("qm"))) <= 2 * F.col("k"))
    return pairs.select("doc_word", "query_word", F.expr("levenshtein(doc_word, query_word, k)").alias("edit")).where("edit >= 0")


def _by_deletions(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Pairs within k, which have a common rest as long as the longer word without k letters.

    So the longer one loses exactly k letters and the other one k less the difference of their lengths: words meet in a rest
    that is all one of them has after k deletions.
    """
    cut = lambda df, *names: df.select(*names, F.explode(_shorter(names[0], k)).alias("s")).select(*names, "s.rest", "s.most")
    a, b = cut(v, "doc_word", "vm"), cut(q, "query_word", "qm").withColumnRenamed("most", "other_most")
    return _verified(a.join(b, "rest").where("most or other_most"), F.lit(k)).distinct()


def _by_segments(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Pairs within k, which leaves one of the k + 1 pieces of the dictionary word whole, shifted by at most k.

    Of the shifts, those are looked at that leave enough edits for both sides: before piece i (from 0) at most i edits
    can be, so it is shifted by at most i, and by no more than k - i against the difference of lengths, since at most
    k - i edits are behind it (Li et al. 2011, multi-match-aware).
    """
    pieces = F.array(*(F.struct(F.lit(i).alias("no"), p.alias("piece")) for i, p in enumerate(_cut("query_word", k + 1))))
    cut = q.select("query_word", "qm", "len", F.explode(pieces).alias("s")).select("query_word", "qm", "len", "s.no", "s.piece")
    start = lambda i: F.floor(F.col("len") * i / (k + 1)).cast("int")
    left = v.select("doc_word", "vm", F.explode(F.sequence(F.length("doc_word") - k, F.length("doc_word") + k)).alias("len")).where(F.col("len") >= 3 * (k + 1))
    delta = F.length("doc_word") - F.col("len")
    low = lambda i: start(i) + 1 + F.greatest(F.lit(-i), delta - (k - i))
    high = lambda i: start(i) + 1 + F.least(F.lit(i), delta + (k - i))
    shifted = lambda i: F.when(low(i) <= high(i), F.transform(F.sequence(low(i), F.greatest(low(i), high(i))), lambda p: F.struct(F.lit(i).alias("no"), p.alias("p"), (start(i + 1) - start(i)).alias("n")))).otherwise(F.array().cast("array<struct<no:int,p:int,n:int>>"))
    left = left.select("doc_word", "vm", "len", F.explode(F.flatten(F.array(*(shifted(i) for i in range(k + 1))))).alias("a")).where("a.p >= 1 and a.p + a.n - 1 <= length(doc_word)")
    left = left.select("doc_word", "vm", "len", "a.no", F.substring(F.col("doc_word"), F.col("a.p"), F.col("a.n")).alias("piece")).distinct()
    return _verified(left.join(cut, ["len", "no", "piece"]), F.lit(k)).distinct()


def _edit_pairs(vocab: DataFrame, need: DataFrame, band_words: int | None = None) -> DataFrame:
    """(doc_word, query_word, edit) of distinct vocabulary words within each needed word's own k, from distinct need (word, k).

    How many pairs a comparison by length makes is known from the needed words' lengths, a row for each k and length. If it
    is at most band_words (BAND_WORDS of k) for each vocabulary word, the words of that k are broadcast and met by length;
    letter masks and the thresholded distance decide. Otherwise words meet by equi-joins: those whose k + 1 pieces have
    three letters or more by shifted pieces, shorter ones by deletions.
    """
    v = vocab.select(F.col("word").alias("doc_word"), letter_mask(F.col("word")).alias("vm"))
    q = need.select(F.col("word").alias("query_word"), F.length("word").alias("len"), "k", letter_mask(F.col("word")).alias("qm"))
    counts = _lengths(need)
    near = [k for k, n in counts.items() if max(sum(n.get(x + d, 0) for d in range(-k, k + 1)) for x in n) <= (BAND_WORDS.get(k, 0) if band_words is None else band_words)]
    pairs = _band(v, q.where(F.col("k").isin(near)))
    for k in sorted(counts.keys() - {*near}):
        own, short = q.where(F.col("k") == k), 3 * (k + 1)
        keyed = _by_deletions(v.where(F.length("doc_word") < short + k), own.where(F.col("len") < short), k).unionByName(_by_segments(v.where(F.length("doc_word") >= short - k), own.where(F.col("len") >= short), k))
        pairs = pairs.unionByName(keyed)
    return pairs


def edit_word_join(vocab: DataFrame, words: DataFrame, k: int = MOST_DISTANCE, band_words: int | None = None) -> DataFrame:
    """(doc_word, query_word, edit) within edit distance k."""
    return _edit_pairs(spread(vocab.select("word").distinct()), words.select("word", F.lit(k).alias("k")).distinct(), band_words)


def word_match_table(vocab: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(doc_word, query_word, hamming, edit), each distance null beyond what the query word needs.

    Each word is searched at the distance it needs and no wider.
    """
    vocab, thresholds = spread(stored(vocab, "vocabulary")), stored(thresholds, "thresholds")
    need = lambda column: thresholds.select("word", F.col(f"max_{column}").alias("k"))
    same = exact_word_join(vocab, thresholds.where("max_hamming = 0 or max_edit = 0")).join(thresholds.withColumnRenamed("word", "query_word"), "query_word")
    same = same.select("doc_word", "query_word", F.when(F.col("max_hamming") == 0, 0).alias("hamming"), F.when(F.col("max_edit") == 0, 0).alias("edit"))
    none = F.lit(None).cast("int")
    ham = _hamming_pairs(vocab, need("hamming").where("k > 0")).select("doc_word", "query_word", "hamming", none.alias("edit"))
    edit = _edit_pairs(vocab, need("edit").where("k > 0")).select("doc_word", "query_word", none.alias("hamming"), "edit")
    return same.unionByName(ham).unionByName(edit).groupBy("doc_word", "query_word").agg(F.min("hamming").alias("hamming"), F.min("edit").alias("edit"))
