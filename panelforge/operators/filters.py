"""Declarative filters compiled to one predicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.expressions import num
from panelforge.operators.checks import require_columns


@dataclass(frozen=True)
class FilterSpec:
    """categorical: IN (an empty list filters nothing); numeric_ranges: closed, either end open if None, text coerced;
    text_contains: case-insensitive pattern, NULL is no match; drop_missing: all of these must be there."""

    categorical: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    numeric_ranges: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)
    text_contains: Mapping[str, str] = field(default_factory=dict)
    drop_missing: Sequence[str] = ()

    def columns(self) -> list[str]:
        return [*self.categorical, *self.numeric_ranges, *self.text_contains, *self.drop_missing]

    def predicate(self) -> Column:
        parts = [F.col(c).isin(list(v)) for c, v in self.categorical.items() if v]
        for c, (low, high) in self.numeric_ranges.items():
            if low is not None:
                parts.append(num(c) >= low)
            if high is not None:
                parts.append(num(c) <= high)
        parts += [F.coalesce(F.col(c).rlike(f"(?i){p}"), F.lit(False)) for c, p in self.text_contains.items() if p]
        parts += [F.col(c).isNotNull() for c in self.drop_missing]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_frame(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that meet the spec; unknown columns raise KeyError."""
    require_columns(df, spec.columns())
    return df.where(spec.predicate())


def in_period(date: str, start: str, end: str, months: Sequence[int] | None = None) -> Column:
    """Closed date range and, if given, only these months."""
    d = F.to_date(date)
    ok = d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return ok & F.month(d).isin(list(months)) if months else ok
