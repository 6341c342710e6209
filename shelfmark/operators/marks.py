"""Where a text holds the forms of a query: spans in offsets of UTF-16 units, as browsers count."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import word_spans

Forms = list[tuple[tuple[str, ...], bool]]


def marks(text: str | None, forms: Forms) -> list[tuple[int, int]]:
    """(start, length) of each marked part in UTF-16 units, in order, overlapping and touching ones as one. A word that only begins with the typed part is marked that far."""
    if not text:
        return []
    words, found = word_spans(text), []
    for at in range(len(words)):
        for run, grows in forms:
            here = words[at : at + len(run)]
            if len(here) < len(run) or any(w[0] != r for w, r in zip(here[:-1], run[:-1])):
                continue
            word, start, end = here[-1]
            if word == run[-1]:
                found.append((words[at][1], end))
            elif grows and run[-1] and word.startswith(run[-1]):
                found.append((words[at][1], min(end, start + len(run[-1]))))
    out: list[list[int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    units = (lambda i: i) if not text or max(text) < "\U00010000" else (lambda i: i + sum(c >= "\U00010000" for c in text[:i]))
    return [(units(a), units(b) - units(a)) for a, b in out]


def marked(column: Column, forms: Forms) -> Column:
    """Marks of a column of texts, for the rows of a page."""

    @F.pandas_udf("array<struct<start:int,length:int>>")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "length": n} for a, n in marks(t, forms)])

    return mark(column)
