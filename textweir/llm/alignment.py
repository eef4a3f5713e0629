"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte of a text.

Both tokenizers run over a space and the text. Each marks the bytes at which its tokens end in a packed bitset; the AND of
the two holds the shared cuts. The cuts are read out in order (select), and the number of a tokenizer's ends up to a cut
(rank, by popcounts) is the number of its tokens before it, so consecutive cuts give a group: a range of tokens on
either side. A link is a pair of tokens, one of each side, that end together.

Neither of the two lets a token go on over a space that follows a visible character, so a text is aligned in units cut
there, and the units of a batch that a task does not know yet are aligned at once, in one bitset.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.packing import _byte_letters
from textweir.llm.shared import found_path, prepared, slices, stored, table, texts_of

#: Bytes of units that a task keeps the alignment of (it takes about thirty times as much memory).
KEPT_BYTES = 4_000_000
#: New units that are encoded as one text.
JOINED = 1000
#: Pairs of ids with their counts, 24 bytes each, that are broadcast; more are shuffled.
BROADCAST_PAIRS = 500_000

#: A space behind a character that is white space in nobody's eyes. Marks that stand for a space themselves are left out.
_CUT = re.compile("(?<=[!-~\u00a1-\u167f\u1681-\u180d\u180f-\u1fff\u2c00-\u2fff\u3001-\ud7ff]) ")
#: What the piece model writes for a space.
SPACE_MARK = "\u2581"
_PROBE = "\ufb01x  y\tz\n \u00e9 e\u0301 "

ALIGNED = "doc_id long, n_a long, n_b long, links array<long>, groups string"


def _ranks(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits of a packed bitset are set at the places `at` and before."""
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
    byte, bit = at >> 3, at & 7
    return before[byte] + np.bitwise_count(packed[byte] >> (7 - bit).astype(np.uint8))


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From ascending byte offsets at which tokens end: the shared ones, and how many tokens of a and of b end up to each."""
    n = max(ends_a[-1:].tolist() + ends_b[-1:].tolist() + [0]) + 1
    packed = []
    for ends in (ends_a, ends_b):
        marks = np.zeros(n, np.uint8)
        marks[ends] = 1
        packed.append(np.packbits(marks))
    cuts = np.flatnonzero(np.unpackbits(packed[0] & packed[1]))
    return cuts, _ranks(packed[0], cuts), _ranks(packed[1], cuts)


class Aligner:
    """The alignment of texts under a byte-level tokenizer (a) and a piece model with byte fallback (b).

    Texts are cut into units if a splits by a byte-level rule without normalizer and b changes no text and has no piece
    that goes on over a space; else each text is one unit. A unit is the text behind its leading space.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {chr(b): b for b in range(256)} | {chr(c): b for b, c in _byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values(), default=-1) + 2)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(SPACE_MARK)
        rule = self.a.pre_tokenizer
        plain = self.a.normalizer is None and type(rule).__name__ == "ByteLevel" and not rule.add_prefix_space
        kept = b"".join(self.bytes_b[i] for i in self.b.encode(_PROBE)) == f" {_PROBE}".encode()
        self.units = plain and kept and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.size = 0
        self.n_a = self.n_b = self.first = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """The ids of all units under a and b, how many each unit has, and which units' bytes they give back.

        Many units are encoded as one text by a. Units that are not given back have no ids.
        """
        given = [f" {u}".encode() for u in units]
        # An empty unit is the space at the end of a text, which the model would not see.
        of_b = [x if u else [self.space] for u, x in zip(units, self.b.encode(units, num_threads=1), strict=True)]
        b, n_b = np.fromiter(chain.from_iterable(of_b), np.int64), np.fromiter(map(len, of_b), np.int64)
        most = JOINED if self.units else 1
        joined = [" " + " ".join(units[k : k + most]) for k in range(0, len(units), most)]
        a = np.fromiter(chain.from_iterable(self.a.encode(x, add_special_tokens=False).ids for x in joined), np.int64)
        every, sizes = b"".join(given), np.fromiter(map(len, given), np.int64)
        ends = np.cumsum(sizes)
        back = lambda ids, table: b"".join(map(table.__getitem__, ids.tolist())) == every
        upto = np.searchsorted(np.cumsum(self.len_a[a]), ends, "right")
        if back(a, self.bytes_a) and back(b, self.bytes_b) and (np.cumsum(self.len_b[b])[np.cumsum(n_b) - 1] == ends).all():
            return a, np.diff(upto, prepend=0), b, n_b, [True] * len(units)
        of_a = [self.a.encode(" " + u, add_special_tokens=False).ids for u in units]
        good = [b"".join(self.bytes_a[i] for i in x) == g == b"".join(self.bytes_b[i] for i in y) for x, y, g in zip(of_a, of_b, given, strict=True)]
        of_a, of_b = ([x if ok else [] for x, ok in zip(of, good, strict=True)] for of in (of_a, of_b))
        flat = lambda of: (np.fromiter(chain.from_iterable(of), np.int64), np.fromiter(map(len, of), np.int64))
        return *flat(of_a), *flat(of_b), good

    def _learn(self, units: list[str]) -> None:
        """Aligns new units; the groups of one whose tokens' bytes are not its own are None."""
        a, n_a, b, n_b, good = self._ids(units)
        _, upto_a, upto_b = shared_cuts(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        links = a[upto_a - 1] << 32 | b[upto_b - 1]
        last = np.searchsorted(upto_a, np.cumsum(n_a), "right")  # a unit's end is a shared cut, so its groups are done by then
        text_a, text_b = ([*map(str, x.tolist())] for x in (a, b))
        to_a, to_b = upto_a.tolist(), upto_b.tolist()
        groups = [f"{text_a[p] if q - p == 1 else ','.join(text_a[p:q])}|{text_b[r] if s - r == 1 else ','.join(text_b[r:s])}" for p, q, r, s in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        begin = 0
        for u, end, ok in zip(units, last.tolist(), good, strict=True):
            self.known[u] = len(self.groups)
            self.groups.append(";".join(groups[begin:end]).encode() if ok else None)
            begin = end
        self.size += sum(map(len, units)) + 8 * len(units)
        had = len(self.links)
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.first = np.append(self.first, had + np.concatenate(([0], last[:-1])))
        self.links = np.append(self.links, links)
        self.count = np.diff(np.append(self.first, len(self.links)))

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int], np.ndarray, np.ndarray, list[bytes]]:
        """Of each text n_a, n_b and its groups; all links, and of each text where its links begin, with the end of all."""
        cut = [_CUT.split(t) if t and self.units else [t] if t else [] for t in texts]
        wanted = set().union(*cut)
        fresh = wanted - self.known.keys()
        if fresh:
            if self.size > KEPT_BYTES:
                self._forget()
                fresh = wanted
            self._learn(list(fresh))
        groups, places = [], []
        for units in cut:
            own = [*map(self.known.__getitem__, units)]
            found = [*map(self.groups.__getitem__, own)]
            if None in found:
                own, found = [], []
            places.append(own)
            groups.append(b";".join(found))
        at = np.fromiter(chain.from_iterable(places), np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in places], dtype=np.int64)))
        total = lambda x: np.concatenate(([0], np.cumsum(x)))[bounds]
        count = self.count[at] if len(at) else at
        ends = np.cumsum(count)
        of_links = np.arange(ends[-1] if len(ends) else 0) + np.repeat((self.first[at] if len(at) else at) - (ends - count), count)
        return np.diff(total(self.n_a[at])).tolist(), np.diff(total(self.n_b[at])).tolist(), self.links[of_links], total(count), groups


@lru_cache(maxsize=2)
def _aligner(name_a: str, name_b: str) -> Aligner:
    return Aligner(found_path(name_a), found_path(name_b))


def _decoded(text: bytes) -> str:
    """The text; bytes that are no UTF-8 are nothing that tokens could give back, so such a text counts as empty."""
    try:
        return text.decode()
    except UnicodeDecodeError:
        return ""


def _align(batches: Iterator[pa.RecordBatch], name_a: str, name_b: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(name_a, name_b)
    for batch in slices(batches, "text"):
        n_a, n_b, links, bounds, groups = aligner([*map(_decoded, texts_of(batch, "text"))])
        listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(links))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), listed, pa.array([g.decode() for g in groups], pa.string())], ["doc_id", "n_a", "n_b", "links", "groups"])


def align(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a and n_b (tokens), links, groups.

    links holds, for each byte at which a token of a and one of b end together, a's id times 2^32 plus b's. groups lists the
    ids between such bytes: `a1,a2|b1;a3|b2,b3`. Null and empty texts, and texts that the tokens of a or b do not give back
    byte for byte (those that are no UTF-8 among them), have no tokens, no links and empty groups. Repeated rows are aligned each; a null id stays null; other
    columns are ignored, whatever their names; an empty table gives an empty result. A stretch of text without a
    space is aligned whole: it needs about a hundred times its bytes of memory in its task, other text about thirty.
    The tokenizers are file names, looked up where the tasks run.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(lambda x: _align(x, tokenizer_a, tokenizer_b), ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """Rows of `link` -> (link, n, best): how often each pair of ids is linked, and whether no other pair of its b id is more often."""
    counts = links.groupBy("link").agg(F.count("*").alias("n"))
    b = F.col("link").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    counts = stored(counts.select("link", "n", b), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # at most a row for each id of b
    return stored(counts.join(most, "b").select("link", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def scored(aligned: DataFrame) -> DataFrame:
    """The rows of align() (groups may be left out) with n_groups, n_links, n_best and count_sum, without their links.

    n_best counts the links whose pair is linked in all texts as often as any of its b id; count_sum adds up how often
    their pairs are linked in all texts. The pairs' counts, at most one for each two ids, are broadcast up to
    BROADCAST_PAIRS; beyond, each text's distinct pairs are shuffled to them.
    """
    rows = stored(aligned.withColumn("row_id", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row_id", F.explode("links").alias("link"))
    counts = pair_counts(links)
    if counts.count() <= BROADCAST_PAIRS:
        met, times = links.join(F.broadcast(counts), "link"), F.lit(1)
    else:
        met, times = links.groupBy("row_id", "link").agg(F.count("*").alias("times")).join(counts, "link"), F.col("times")
    sums = met.groupBy("row_id").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * times).cast("long").alias("count_sum"))
    n = F.size("links").cast("long")
    out = rows.withColumns({"n_groups": n, "n_links": n}).drop("links").join(sums, "row_id", "left").drop("row_id")
    return out.fillna(0, ["n_best", "count_sum"])


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    return scored(aligned.withColumn("groups_sha256", digest).drop("groups"))
