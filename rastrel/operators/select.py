"""Selections of features by their attributes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_number, first_value

# Tags that make a roof green.
GREEN_MATERIAL = "(?i)^(grass|green_roof|vegetated|vegetation|plants|sedum)$"
GREEN_VALUE = "(?i)^(yes|true|green|extensive|intensive|vegetated)$"
GREEN_KEYS = ("roof:greening", "roof:green", "green_roof", "roof:vegetation")


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises KeyError for columns that df lacks, before any job."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {missing}")


def subset(df: DataFrame, *, material: tuple[str, Iterable[str]] | None = None, shape: tuple[str, Iterable[str]] | None = None, slope: tuple[str, float] | None = None, keep_null: bool = False) -> DataFrame:
    """Rows that meet every criterion given; keep_null admits null materials and shapes, never null slopes."""
    tests: list[Column] = []
    for field, wanted in filter(None, (material, shape)):
        require_columns(df, field)
        value = first_value(F.col(field).cast("string"))
        known = F.coalesce(value.isin([w.strip().lower() for w in wanted]), F.lit(False))
        tests.append(known | value.isNull() if keep_null else known)
    if slope:
        require_columns(df, slope[0])
        tests.append(F.coalesce(first_number(F.col(slope[0]).cast("string")) <= slope[1], F.lit(False)))
    if not tests:
        raise ValueError("at least one criterion is required")
    for test in tests:
        df = df.where(test)
    return df


def is_green(tags: str = "tags") -> Column:
    """Whether a tag map names a green roof."""
    get = lambda k: F.col(tags).getItem(k)
    out = F.coalesce(get("roof:material").rlike(GREEN_MATERIAL), F.lit(False))
    for key in GREEN_KEYS:
        out = out | F.coalesce(get(key).rlike(GREEN_VALUE), F.lit(False))
    return out
