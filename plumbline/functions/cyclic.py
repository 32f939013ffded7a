"""Columns whose values go round: categories in order, or numbers modulo a period."""

from __future__ import annotations

import math
from dataclasses import dataclass
from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.types import typed

#: The cycles known by name, in the order in which ties are decided.
DEFAULT_CYCLES = {
    "month": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    "month_abbreviation": ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    "weekday": ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    "weekday_abbreviation": ("mon", "tue", "wed", "thu", "fri", "sat", "sun"),
    "season": ("spring", "summer", "autumn", "winter"),
    "season_fall": ("spring", "summer", "fall", "winter"),
    "compass_4": ("north", "east", "south", "west"),
    "compass_4_abbreviation": ("n", "e", "s", "w"),
    "compass_8": ("n", "ne", "e", "se", "s", "sw", "w", "nw"),
    "moon_phase": ("new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent"),
    "tide_phase": ("low", "rising", "high", "falling"),
    "zodiac": ("aries", "taurus", "gemini", "cancer", "leo", "virgo", "libra", "scorpio", "sagittarius", "capricorn", "aquarius", "pisces"),
}


@dataclass(frozen=True)
class Cycle:
    """Categories in their order, or a numeric period; exactly one of the two."""

    categories: tuple[str, ...] | None = None
    period: float | None = None

    def __post_init__(self):
        if (self.categories is None) == (self.period is None):
            raise TypeError("a cycle has either categories or a period")
        if self.categories is not None:
            object.__setattr__(self, "categories", tuple(self.categories))
            if len(self.categories) < 2:
                raise ValueError("a cycle needs two categories or more")
            if any(c is None for c in self.categories):
                raise ValueError("a cycle's categories can't be missing")
            if len(set(self.categories)) != len(self.categories):
                raise ValueError("a cycle's categories must be unique")
        elif isinstance(self.period, bool) or not isinstance(self.period, Real) or not math.isfinite(self.period) or self.period <= 0:
            raise ValueError("a period is a finite number above zero")

    @classmethod
    def of(cls, metadata: dict) -> Cycle:
        return cls(categories=tuple(metadata["categories"])) if metadata.get("categories") else cls(period=metadata["period"])

    @property
    def length(self):
        return len(self.categories) if self.categories is not None else self.period

    def metadata(self) -> dict:
        return {"categories": list(self.categories)} if self.categories is not None else {"period": float(self.period)}

    def typed(self, column: Column, name: str) -> Column:
        return typed(column, name, "cyclic", **self.metadata())

    def _labels(self) -> Column:
        return F.array(*[F.lit(c) for c in self.categories])

    # values: labels for categories, numbers in [0, period) else

    def values(self, column: Column) -> Column:
        """The stored form of raw values; unknown labels are missing."""
        if self.categories is None:
            return F.pmod(column.cast("double"), F.lit(float(self.period)))
        return F.when(F.array_contains(self._labels(), column), column)

    def strict(self, column: Column) -> Column:
        """As values, but an unknown label is an error that names it."""
        if self.categories is None:
            return self.values(column)
        message = F.concat(F.lit("value is not in the cycle: "), column.cast("string"))
        return F.when(column.isNull() | F.array_contains(self._labels(), column), column).otherwise(F.raise_error(message))

    def codes(self, column: Column) -> Column:
        """Places from 0 of labels, or the number in [0, period)."""
        if self.categories is None:
            return F.pmod(column.cast("double"), F.lit(float(self.period)))
        return F.nullif(F.array_position(self._labels(), column), F.lit(0)) - 1

    def shift(self, column: Column, steps=1) -> Column:
        """Round the cycle by so many steps; missing stays missing."""
        if self.categories is None:
            return F.pmod(column.cast("double") + steps, F.lit(float(self.period)))
        return F.get(self._labels(), F.pmod(self.codes(column) + steps, F.lit(len(self.categories))).cast("int"))

    def successor(self, column: Column) -> Column:
        return self.shift(column, 1)

    def predecessor(self, column: Column) -> Column:
        return self.shift(column, -1)

    def distance(self, column: Column, other, signed: bool = False) -> Column:
        """Steps to ``other`` (a value or a column), the shorter way: in [-length/2, length/2), or its size."""
        if not isinstance(other, Column):
            if self.categories is not None and other is not None and other not in self.categories:
                raise ValueError(f"value is not in the cycle: {other!r}")
            other = F.lit(other)
        half = self.length / 2
        apart = F.pmod((self.codes(other) - self.codes(column)).cast("double") + half, F.lit(float(self.length))) - half
        return apart if signed else F.abs(apart)

    def equals(self, column: Column, other) -> Column:
        """Equality after wrapping; a literal that isn't of the cycle equals nothing.
        Missing equals missing for categories, not for numbers."""
        if not isinstance(other, Column):
            if self.categories is not None:
                if other is not None and other not in self.categories:
                    return F.lit(False)
            elif isinstance(other, bool) or (other is not None and not isinstance(other, Real)):
                return F.lit(False)
            other = F.lit(other)
        if self.categories is not None:
            return self.codes(column).eqNullSafe(self.codes(other))
        return F.coalesce(self.codes(column) == self.codes(other), F.lit(False))


def normal_label(column: Column) -> Column:
    """Labels as vocabularies compare them: trimmed, lower case, one space for dashes, underscores and gaps."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[_-]+", " "), r"\s+", " ")
