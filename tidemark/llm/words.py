"""Word expressions shared by the text operators. A word is a run of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.size(words(text)).cast("long")
