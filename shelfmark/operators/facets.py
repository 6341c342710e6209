"""Facet counts: every facet under all filters but its own, in one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.filters import Fields, conditions, together


def wanted_facets(fields: Fields, asked: bool | list[str]) -> list[str]:
    """The facets to count: all, scalars first, or those named, each once."""
    if asked is True:
        facets = [n for n, f in fields.items() if f.role == "facet"]
        return sorted(facets, key=lambda n: fields[n].type == "string_array")
    names = list(dict.fromkeys(asked or []))
    for n in names:
        fields.use(n, ("facet",), "QUERY_INVALID", "facet count")
    return names


def _tagged(values: Column, place: int, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(place).alias("ord"), F.lit(name).alias("facet"), v.alias("value")))


def facet_counts(rows: DataFrame, fields: Fields, asked: bool | list[str], filters: Mapping | None = None, named: bool = False) -> DataFrame:
    """(ord, facet, value, n): counts of each value of the asked facets over ``rows``.

    A facet is counted under the filters of all others. Null values are not
    counted; values of arrays count once in each row. Rows are ordered by the
    asked order, then count, then value when the caller sorts by (ord, -n, value).

    With ``named`` each asked facet also has a row of a null value and count 0, so
    that one without any value is seen to have been asked for.

    One scan: a row yields one pair for each facet whose other filters it
    passes, and pairs are counted where they arise before anything is shuffled.
    """
    names = wanted_facets(fields, asked)
    parts = conditions(fields, filters)
    lists = []
    for k, name in enumerate(names):
        shown = F.col(name).cast("int").cast("string") if fields[name].type == "boolean" else F.col(name).cast("string")
        values = F.transform(F.array_distinct(F.col(name)), lambda v: v.cast("string")) if fields[name].type == "string_array" else F.array(shown)
        pairs = _tagged(values, k, name)
        lists.append(F.when(together(parts, but=name), pairs).otherwise(F.array().cast("array<struct<ord:int,facet:string,value:string>>")))
    if not lists:
        return rows.sparkSession.createDataFrame([], "ord int, facet string, value string, n long")
    exploded = rows.select(F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<struct<ord:int,facet:string,value:string>>")) for x in lists])).alias("x")).select("x.*")
    counts = exploded.where("value IS NOT NULL").groupBy("ord", "facet", "value").agg(F.count("*").alias("n"))
    if not named:
        return counts
    return counts.unionByName(rows.sparkSession.createDataFrame([(k, n, None, 0) for k, n in enumerate(names)], "ord int, facet string, value string, n long"))
