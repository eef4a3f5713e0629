"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, each a sequence of its own.

A document of n tokens gives n // 2048 pieces of 2048 and one piece for each set bit of n % 2048, longest first. A
sequence holds one piece, so none crosses documents and none needs padding; sequences of one length form a bucket that
batches alike. No row leaves its task: the plan is a scan, one Arrow pass and a running number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.shared import found_path, prepared, slices, table, texts_of

LONGEST, END_ID = 2048, 1
#: Distinct white-space-delimited strings that a task keeps the ids of, and the longest such string.
KEPT_WORDS, KEPT_CHARS = 800_000, 40

#: A word of small ASCII or any Latin-1 letters, perhaps before a comma or stop.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([,.]?)")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes for 256 and on, in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in seen), range(256, 512), strict=False))


_BETWEEN = b"<|startoftext|>"

PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, piece int"


def default_tokenizer() -> str:
    return found_path("word_bpe_49k.json")


def drops_spaces(tokenizer) -> bool:
    """Whether a tokenizer is told by its own rules to lower case and to join nothing across white space, which it drops."""
    rules = json.loads(tokenizer.to_str())
    kinds = {x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])}
    splits = [x for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    kept = any(x["behavior"] == "Removed" and x["invert"] and r"[^\s" in x["pattern"].get("Regex", "") for x in splits)
    return "Lowercase" in kinds and kept and bool(rules["model"].get("end_of_word_suffix"))


class Encoder:
    """Token ids of texts under a tokenizer that drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its white-space-delimited strings one after another, so the ids of a
    string are asked for once and kept. Others, told by drops_spaces(), encode each text at once, as `whole` asks of any.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.whole = whole or not drops_spaces(self.tokenizer)
        self.letters = _byte_letters()
        self.ends = {e: self._whole(e).tolist() for e in (b"", b",", b".")}

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _learn(self, fresh: list[bytes]) -> None:
        """Asks for the ids of new strings: plain words straight from the model, the rest at once, a special token between."""
        model, of, known = self.tokenizer.model.tokenize, self.letters, self.known
        odd = []
        for w in fresh:
            if m := _PLAIN.fullmatch(w):
                word = m[1] if m[1].isascii() else m[1].decode().lower().encode()
                ids = [t.id for t in model(word.decode("latin-1").translate(of))]
                known[w] = np.array(ids + self.ends[m[2]], "<u4").tobytes()
            else:
                odd.append(w)
        ids = self._whole(_BETWEEN.join(odd))
        cuts = [0, *(np.flatnonzero(ids == self.tokenizer.token_to_id(_BETWEEN.decode())) + 1).tolist(), len(ids) + 1]
        raw = ids.tobytes()
        known.update((w, raw[4 * a : 4 * b - 4]) for w, a, b in zip(odd, cuts, cuts[1:], strict=False))

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        # Split at ASCII white space; other white space stays inside the strings. Fewer are distinct in lower case,
        # which the tokenizer sees to itself. Special tokens are told by case, so texts that may hold one go whole.
        words = [None if self.whole or b"<|" in t else t.lower().split() for t in texts]
        used = set().union(*(w for w in words if w))
        if fresh := list(used - self.known.keys()):
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
                fresh = list(used)
            self._learn(fresh)
        of = self.known.__getitem__
        for text, own in zip(texts, words, strict=True):
            yield self._whole(text) if own is None else np.frombuffer(b"".join(map(of, own)), "<u4")
        for w in fresh:
            if len(w) > KEPT_CHARS:
                self.known.pop(w, None)


@lru_cache(maxsize=2)
def _encoder(path: str, whole: bool) -> Encoder:
    return Encoder(found_path(path), whole)


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _cut(batches: Iterator[pa.RecordBatch], path: str, whole: bool, longest: int) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path, whole)
    for batch in slices(batches, "text"):
        rows: list[tuple] = []
        for doc_id, found in zip(batch.column(0).to_pylist(), encode(texts_of(batch, "text")), strict=True):
            ids = np.append(found, np.uint32(END_ID)).astype("<u4")
            at = 0
            for i, length in enumerate(piece_lengths(len(ids), longest)):
                rows.append((doc_id, at, length, ids[at : at + length].tobytes(), len(ids), i))
                at += length
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "start", "length", "tokens", "doc_tokens", "piece"])


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, bucket.

    Each document ends with id 1; a null, empty or blank text is that id alone. longest is a power of two. bucket is
    the binary logarithm of the length. Each piece is a sequence: offset is 0, and sequence_id is unique (a partition's
    number and a row's place in it, so it depends on how the input is split). Repeated rows are packed each; a null id
    stays null; other columns are ignored, whatever their names; an empty table gives an empty result. A text needs some ten
    times its bytes of memory in its task. The tokenizer is a file, or one of the public tokenizers by name, looked up where the tasks
    run; one that joins across white space or keeps case encodes each text at once, which takes longer.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = given.mapInArrow(lambda x: _cut(x, tokenizer, whole, longest), PIECES)
    return pieces.select("doc_id", "start", "length", "tokens", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pack()'s pieces as Parquet in a folder for each bucket, so that a batch reads sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op1_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
