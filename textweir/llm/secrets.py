"""Secret scans: base patterns, and password guess costs for values in credential contexts.

Beside the base kinds (assign, access, hex) the scan looks at values that stand after a credential word and a sign and
estimates how many guesses an attacker needs: a dynamic programme finds the cheapest cut of the value into dictionary
words (the common ones of passwords, then those of a tokenizer's vocabulary by its order, which is that of frequency), dates,
repeats, keyboard walks and brute force. A value that takes at least 10**LEAST_LOG10 guesses is a span of
kind `guess`. Values have at least 6 characters and no upper bound: they end at their quote on the same line, or without
quotes at a space, a quote or an angle bracket.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textweir.llm.packing import default_tokenizer
from textweir.llm.shared import prepared, slices, table, texts_of

KINDS = ("assign", "access", "hex", "guess")
LEAST_LOG10 = 8.0

# Common words of passwords, most frequent first, and keyboard rows.
WORDS = "password secret admin login welcome letmein master dragon monkey qwerty sunshine princess football shadow superman michael jordan hunter ranger buster thomas robert soccer batman test pass hello freedom whatever trust guest root user token key love money summer winter spring autumn example changeme default demo none null true false your here value string placeholder".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")

#: Words of the vocabulary count from so many letters on.
LEAST_LETTERS = 4


@lru_cache(maxsize=2)
def ranks(vocabulary: str | None = None) -> dict[str, float]:
    """log10 of each known word's rank. vocabulary: the file of a tokenizer whose words end in </w>."""
    known = dict.fromkeys(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as file:
            tokens = json.load(file)["model"]["vocab"]
        ended = (t.removesuffix("</w>") for t in sorted(tokens, key=tokens.get) if t.endswith("</w>"))
        known |= dict.fromkeys(w for w in ended if len(w) >= LEAST_LETTERS and w.isascii() and w.isalpha() and w.islower())
    return {w: math.log10(i + 2) for i, w in enumerate(known)}


_WALKS = {r[i : i + 2] for row in ROWS for r in (row, row[::-1]) for i in range(len(r) - 1)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_LEET = str.maketrans("4301$57@", "aeoissta")


def _starts(kept: list[int], best: list[float], i: int) -> list[int]:
    """The starts (ascending) of a run's pieces that may be the cheapest at i or later, the cheapest at i last.

    A piece costs best[start] + log10(i - start): a later start that is no cheaper than an earlier one now never will
    be, since the difference of the logarithms only shrinks; so few starts are kept however long the run is.
    """
    out, least = [], math.inf
    for j in kept:
        if (cost := best[j] + math.log10(i - j)) < least:
            out.append(j)
            least = cost
    return out


@lru_cache(maxsize=2)
def _lengths(vocabulary: str | None) -> tuple[int, int]:
    return max(map(len, ranks(vocabulary))), min(map(len, ranks(vocabulary)))


def guess_cost(value: str, vocabulary: str | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its pieces (start, end, kind)."""
    n, known = len(value), ranks(vocabulary)
    longest, least = _lengths(vocabulary)
    one = math.log10(max(10, 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 32 * bool(re.search("[^A-Za-z0-9]", value))))
    low = value.lower()
    plain = low.translate(_LEET)
    best, last = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    walk = repeat = 0
    walks: list[int] = []
    repeats: list[int] = []
    for i in range(1, n + 1):
        # Pairs of the run up to i, and the starts of its pieces of at least three characters.
        walk = walk + 1 if i > 1 and low[i - 2 : i] in _WALKS else 0
        repeat = repeat + 1 if i > 1 and low[i - 1] == low[i - 2] else 0
        walks = _starts([*walks, i - 3], best, i) if walk >= 2 else []
        repeats = _starts([*repeats, i - 3], best, i) if repeat >= 2 else []
        # A run of brute force costs its characters; each new piece of any other kind also costs a choice of kinds.
        options = [(best[i - 1] + one, i - 1, "brute")]
        options += [(best[j] + one + math.log10(i - j) + 0.3, j, "walk") for j in walks[-1:]]
        options += [(best[j] + one + math.log10(i - j), j, "repeat") for j in repeats[-1:]]
        for j in range(max(0, i - longest), i - least + 1):
            if (rank := known.get(w := plain[j:i])) is not None:
                twist = 0.3 * (value[j:i] != low[j:i]) + 0.6 * (low[j:i] != w)
                options.append((best[j] + rank + twist + 0.3, j, "word"))
        for j in range(max(0, i - 10), i - 3):
            if low[i - 1].isdigit() and _DATE.fullmatch(low, j, i):
                options.append((best[j] + math.log10(365 * 120) * (i - j >= 6) + 2.1 * (i - j < 6), j, "date"))
        best[i], *rest = min(options)
        last[i] = (rest[0], rest[1])
    pieces, i = [], n
    while i:
        j, kind = last[i]
        pieces.append((j, i, kind))
        i = j
    return best[n], pieces[::-1]


_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: In these contexts a scheme word before the value (Authorization: Bearer ...) is no part of it, inside quotes or outside.
_SCHEME = r"(?:(?i:bearer|basic|token|negotiate|ntlm|dpop|api-?key)[\x20\t]+)?+"
_CONTEXT = re.compile(rf"""(?:(?i:password|passwd|passphrase|pwd|secret)|(?P<auth>(?i:token|api[_-]?key|credentials?|auth(?:orization)?)))["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?(auth){_SCHEME})(?:"(?(auth){_SCHEME})(?P<double>[^"\r\n]{{6,}})"|'(?(auth){_SCHEME})(?P<single>[^'\r\n]{{6,}})'|(?P<plain>[^\s"'<>]{{6,}}))""", re.ASCII)
_HINT = re.compile(rb"(?i)pass|secret|token|api|pwd|cred|auth")


def scan(text: bytes, vocabulary: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind in KINDS) in code points, by start, then kind."""
    hint = _HINT.search(text) is not None
    whole = text.decode("utf-8", "replace")
    out = []
    if hint:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(whole) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(whole)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(whole)]
    if hint:
        for m in _CONTEXT.finditer(whole):
            value = next(k for k in ("double", "single", "plain") if m[k] is not None)
            if guess_cost(m[value], vocabulary)[0] >= LEAST_LOG10:
                out.append((m.start(value), m.end(value), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch], vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
    for batch in slices(batches, "text"):
        found = [scan(t, vocabulary) for t in texts_of(batch, "text")]
        counts = [pa.array([sum(s[2] == k for s in x) for x in found], pa.int64()) for k in range(3)]
        base = [hashlib.sha256(said([s for s in x if s[2] < 3]).encode()).hexdigest() for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([said(x) for x in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans (kind:start:end, code points, end exclusive).

    Spans are ordered by start, then kind as in KINDS. vocabulary: see ranks(). Null texts count as empty; null ids stay null;
    repeated rows are scanned each; other columns are ignored, whatever their names; an empty table gives an empty
    result. Texts and values may have any length: a text needs about ten times its bytes of memory, the programme some
    hundred bytes for each character of a value, and time in proportion to both.
    """
    prepared(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(lambda x: _scanned(x, vocabulary), f"doc_id long, {SCANNED}")


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), default_tokenizer())
