"""Terms of texts: maximal runs of letters and numbers after lower-casing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
# In Python's re a word character is a letter, a number or the underscore.
find_terms = re.compile(r"[^\W_]+").findall


def terms_of(text: str | None) -> list[str]:
    return find_terms(text.lower()) if text else []


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def joined(*columns: str) -> Column:
    """Columns joined by line feeds, nulls as empty."""
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def counted(words: Column) -> Column:
    """Each distinct word of an array with its number of occurrences, within the row: sorted, then cut into runs."""
    runs = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    cut = lambda starts: F.transform(
        starts, lambda p, k: F.struct(F.get(words, p).alias("term"), (F.coalesce(F.get(starts, k + 1), F.size(words)) - p).alias("tf"))
    )
    # the one-element array holds the runs, so that they are found once and not for each of them
    return F.when(F.size(words) > 0, F.element_at(F.transform(F.array(runs), cut), 1))
