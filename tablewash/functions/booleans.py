"""Boolean semantics of a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.functions.text import strip

# The vocabulary of boolean columns.
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")


def boolean_like(c: Column) -> Column:
    return F.lower(strip(c)).isin(*TRUE_WORDS, *FALSE_WORDS)


def coerce_boolean(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
