"""Word distances as column expressions, all inside generated code."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweir.functions.text import LONGEST

EXACT, HAMMING, EDIT = 0, 1, 2


def exact_match(a: Column, b: Column) -> Column:
    return a == b


def hamming_distance(a: Column, b: Column, longest: int = LONGEST) -> Column:
    """Positions that differ, null for words of different lengths or over `longest` letters."""
    differ = (F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0) for i in range(1, longest + 1))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) <= longest), reduce(lambda x, y: x + y, differ))


#: Letters of a packed long: one byte each, and room above them for a carry.
_LETTERS = 7


def packed(word: Column, longest: int = LONGEST) -> Column:
    """An ASCII word as a struct of longs of seven letters each, a byte a letter, zero behind the last; made once a word, not once a pair."""
    part = lambda i: F.coalesce(F.conv(F.hex(F.rpad(F.substring(word, i + 1, _LETTERS), _LETTERS, "\0")), 16, 10).cast("long"), F.lit(0).cast("long")).alias(f"p{i}")
    return F.struct(*(part(i) for i in range(0, longest, _LETTERS)))


def packed_hamming(a: Column, b: Column, longest: int = LONGEST) -> Column:
    """Positions at which two packed words of equal length differ.

    A byte of the XOR is at most 127; with 127 added to each, its highest bit tells whether it was above 0.
    """
    spread, high = int("7f" * _LETTERS, 16), int("80" * _LETTERS, 16)
    differ = lambda i: F.bit_count((a[f"p{i}"].bitwiseXOR(b[f"p{i}"]) + F.lit(spread)).bitwiseAND(F.lit(high)))
    return reduce(lambda x, y: x + y, map(differ, range(0, longest, _LETTERS)))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Least insertions, deletions and replacements; null above `most`."""
    if most is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def word_matches(a: Column, b: Column, match_type: Column, match_dist: Column) -> Column:
    """Whether a matches b under the type, within the distance."""
    edit = F.levenshtein(a, b) <= match_dist
    return F.when(match_type == EXACT, exact_match(a, b)).when(match_type == HAMMING, F.coalesce(hamming_distance(a, b) <= match_dist, F.lit(False))).when(match_type == EDIT, edit).otherwise(False)


def letter_mask(word: Column) -> Column:
    """Two bits for each letter a to z: it occurs, it occurs twice. One edit changes two bits at most."""
    once = lambda i: F.instr(word, chr(97 + i))
    bits = [F.when(once(i) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(26)]
    bits += [F.when(F.length(word) - F.length(F.translate(word, chr(97 + i), "")) > 1, F.lit(1 << 26 + i)).otherwise(F.lit(0)).cast("long") for i in range(26)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)
