"""Keeping an expensive value from being computed more than once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns that later filters and projections read instead of computing again.

    A filter on a plain computed column is moved below it together with a copy of its expression, so a parsed document
    would be parsed once for the filter and once for the result. Going through a one-row ``inline`` ends that.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = df.columns if keep is None else keep
    return df.select(*kept, F.inline(F.array(row)))
