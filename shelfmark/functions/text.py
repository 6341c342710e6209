"""Tokens as an index sees them: folded runs of letters, numbers and private-use characters."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
# Marks, letters of Hangul, and signs whose composed form is another sign.
COMPOSING = r"[\p{M}\u1100-\u11ff\u0374\u037e\u0387\u1fef\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff]"


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics and second forms of letters, and the letters they fold to."""
    odd, plain = [], []
    for code in range(0xC0, 0x1FFF):
        char = chr(code)
        parts = ud.normalize("NFD", char)
        if len(parts) > 1 and "a" <= parts[0] <= "z" and all(ud.combining(p) for p in parts[1:]):
            odd.append(char)
            plain.append(parts[0])
        elif char == char.lower() != (same := char.casefold()) and len(same) == 1:
            odd.append(char)  # another form of the same letter, as the final sigma
            plain.append(same)
    return "".join(odd), "".join(plain)


def fold(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(lower.rlike(r"[^\x00-\x7f]"), F.translate(lower, *fold_map())).otherwise(lower)


def tokens(text: Column) -> Column:
    """The index terms of a text in their order; null for null."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def _normal(value):
    """A text, or the texts of a list or map, in composed form."""
    if isinstance(value, str):
        return ud.normalize("NFC", value)
    if isinstance(value, dict):
        return {_normal(k): _normal(v) for k, v in value.items()}
    return list(map(_normal, value)) if isinstance(value, (list, np.ndarray)) else value


def composed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the texts of some columns, also those in arrays and maps, in composed form. Python gets only the values that hold a composing character."""
    kinds = dict(df.dtypes)

    def form(c: str) -> Column:
        @F.pandas_udf(kinds[c])
        def compose(values: pd.Series) -> pd.Series:
            return values.map(_normal, na_action="ignore")

        fits = lambda x: F.coalesce(x.rlike(COMPOSING), F.lit(False))
        each = F.map_values(c) if kinds[c].startswith("map") else F.col(c)
        odd = fits(F.col(c)) if kinds[c] == "string" else F.coalesce(F.exists(each, fits), F.lit(False))
        return F.when(odd, compose(F.when(odd, F.col(c)))).otherwise(F.col(c))

    return df.withColumns({c: form(c) for c in columns})


_FOLDS = {ord(a): b for a, b in zip(*fold_map())}
_TOKEN = re.compile(r"[^\W_]+")


def fold_word(word: str) -> str:
    """A single word as the index holds it (driver side)."""
    return ud.normalize("NFC", word).lower().translate(_FOLDS)


def fold_tokens(text: str) -> list[str]:
    return _TOKEN.findall(fold_word(text))


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """(folded word, start, end) of the words of a text, in its own offsets; a letter and its marks are one."""
    kept, at = [], []
    for i, char in enumerate(text):
        for c in fold_word(char):
            if not (ud.combining(c) and kept):
                kept.append(c)
                at.append(i)
    flat = "".join(kept)
    ends = [*at[1:], len(text)]
    return [(m[0], at[m.start()], ends[m.end() - 1]) for m in _TOKEN.finditer(flat)]
