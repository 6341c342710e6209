"""Raw values to the types of declared fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]+"
# What reads as a number: decimals with an exponent, single underscores between digits, and the names of the special values.
NUMBER = r"(?i)^[-+]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)$"
# Words for true and false.
TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


def collapsed(text: Column) -> Column:
    """White space trimmed and each run of it one space."""
    return F.btrim(F.regexp_replace(text, WHITE, " "))


def coerce(value: Column, kind: str) -> Column:
    """A text as the type ``kind``; null where it does not read as one (see ``invalid``)."""
    text = collapsed(value)
    match kind:
        case "string":
            return text
        case "integer":
            return F.when(text.rlike(r"^[-+]?\d+$"), F.regexp_replace(text, r"^\+", "")).try_cast("long")
        case "number":
            return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit(""))).try_cast("double")
        case "boolean":
            return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
        case "date":
            return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")
        case "string_array":
            return array_of(value)
        case "json":
            return canonical_json(value)
    raise ValueError(kind)


def invalid(value: Column, kind: str) -> Column:
    """Whether a value that is there does not read as ``kind``."""
    return value.isNotNull() & (collapsed(value) != "") & coerce(value, kind).isNull()


def array_of(value: Column) -> Column:
    """A list with commas as a sorted set of its non-blank parts."""
    parts = F.transform(F.split(value, ","), collapsed)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def canonical_json(value: Column) -> Column:
    """JSON text without needless space, keys in their order; null for what is no JSON. What stands so already passes by Python."""

    def one(text):
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":")) if isinstance(text, str) else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def compact(values: pd.Series) -> pd.Series:
        return values.map(one)

    # no space, no escape, no number that is written in another way, no repeated key
    plain = F.coalesce(value.rlike(r"^[^\s\\]*$") & ~value.rlike(r"\d[.eE]|-0") & F.try_parse_json(value).isNotNull(), F.lit(False))
    return F.when(plain, value).otherwise(compact(F.when(~plain, value)))
