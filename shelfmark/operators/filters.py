"""Filters of a request as columns, and the roles that fields have."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.errors import QueryError


@dataclass(frozen=True)
class Range:
    min: object = None
    max: object = None


@dataclass(frozen=True)
class Field:
    """A declared field: ``role`` is facet, store or sort, ``type`` one of string, string_array, integer, number, boolean, date, json."""

    role: str
    type: str = "string"


class Fields(dict):
    """Declared fields by name."""

    def use(self, name: str, roles: tuple[str, ...], code: str, what: str) -> Field:
        if name not in self:
            raise QueryError(code, f'Unknown {what} field "{name}".')
        if self[name].role not in roles:
            raise QueryError(code, f'Cannot use {what} field "{name}" because it is a {self[name].role} field.')
        return self[name]


def condition(name: str, kind: str, value) -> Column | None:
    """The condition of one filter; None where it demands nothing. An empty list matches nothing, null values match no filter."""
    if kind == "string_array":
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if values else F.lit(False)
    if isinstance(value, (list, tuple)):
        return F.col(name).isin(list(value)) if value else F.lit(False)
    if isinstance(value, Range):
        bounds = [F.col(name) >= value.min] * (value.min is not None) + [F.col(name) <= value.max] * (value.max is not None)
        return reduce(and_, bounds) if bounds else None
    return F.col(name) == value


def conditions(fields: Fields, filters: Mapping | None) -> dict[str, Column]:
    """A condition for each filter that demands something; filters that are None are skipped."""
    out = {}
    for name, value in (filters or {}).items():
        if value is None:
            continue
        kind = fields.use(name, ("facet",), "FILTER_INVALID", "filter").type
        if (c := condition(name, kind, value)) is not None:
            out[name] = F.coalesce(c, F.lit(False))
    return out


def together(parts: Mapping[str, Column], but: str | None = None) -> Column:
    return reduce(and_, [c for n, c in parts.items() if n != but], F.lit(True))
