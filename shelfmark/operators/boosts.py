"""Boosts: factors on relevance from values and from the age of a date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValueBoost:
    facet: str
    multipliers: tuple[tuple[object, float], ...]

    def factor(self) -> Column:
        chain = F.when(F.lit(False), 1.0)
        for value, multiplier in self.multipliers:
            chain = chain.when(F.col(self.facet) == value, float(multiplier))
        return chain.otherwise(1.0)


@dataclass(frozen=True)
class RecencyBoost:
    """From ``maximum`` on the day ``as_of`` the lift halves every ``half_life`` days; later dates count as that day, missing ones are not lifted."""

    facet: str
    as_of: str
    maximum: float = 2.0
    half_life: float = 730.0

    def factor(self) -> Column:
        age = F.greatest(F.lit(0), F.datediff(F.lit(self.as_of).cast("date"), F.col(self.facet)))
        lift = F.when(F.col(self.facet).isNotNull(), (self.maximum - 1.0) * F.pow(F.lit(2.0), -age / F.lit(float(self.half_life))))
        return F.coalesce(F.lit(1.0) + lift, F.lit(1.0))


def product(boosts) -> Column | None:
    out = None
    for b in boosts:
        out = b.factor() if out is None else out * b.factor()
    return out
