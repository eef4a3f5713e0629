"""Bringing raw text to words of 4 to 31 small letters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of words, queries, distances and documents.
SHORTEST, LONGEST, MOST_WORDS, MOST_DISTANCE, MOST_CHARS = 4, 31, 5, 3, 1 << 22


def normalize_text(text: Column) -> Column:
    """Runs of anything but ASCII letters become one space, then letters become small; null becomes empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " "))


def words(text: Column) -> Column:
    """The space-separated words, in order, without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " +"), lambda w: w != "")


def legal_words(text: Column) -> Column:
    """The words that have 4 to 31 letters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " +"), lambda w: F.length(w).between(SHORTEST, LONGEST))
