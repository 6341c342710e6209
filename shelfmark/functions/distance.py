"""Edit distance in which swapping two neighbours is one edit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: str, b: str, most: int) -> int:
    """Least number of insertions, deletions, changes and swaps of neighbours, no part edited twice; ``most + 1`` if it is more.

    Only cells within ``most`` of the diagonal can matter, so only those are kept.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    rows: list[dict[int, int]] = [{j: j for j in range(min(most, len(b)) + 1)}]
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            options = [rows[-1].get(j, far) + 1]
            if j:
                options += [row.get(j - 1, far) + 1, rows[-1].get(j - 1, far) + (x != b[j - 1])]
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                options.append(rows[-2].get(j - 2, far) + 1)
            row[j] = min(options)
        if min(row.values(), default=far) > most:
            return far
        rows = [rows[-1], row]
    return min(rows[-1].get(len(b), far), far)


def near_words(word: str, other: Column, most: int) -> Column:
    """A filter that every word within ``most`` edits passes: a swap is two plain edits, so twice as many are let through."""
    return F.length(other).between(len(word) - most, len(word) + most) & (F.levenshtein(other, F.lit(word), 2 * most) >= 0)


def distance_to(word: str, most: int):
    """A vectorised function of a column of words: their distance to ``word``."""

    @F.pandas_udf("int")
    def distance(others: pd.Series) -> pd.Series:
        return others.map(lambda o: edit_distance(word, o, most))

    return distance
