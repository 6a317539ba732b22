"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added or replaced, each computed once for a row.

    The optimizer merges successive projections by writing an expression out wherever it is used; chains of array
    functions that use an array several times would grow exponentially and be computed as often. A generator of one row
    is what it doesn't merge; its outer form, as for the inner one a filter on the expression would be added.
    """
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    names = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, F.explode_outer(F.array(made)).alias("_once")).select(*names, *(F.col(f"_once.{c}").alias(c) for c in columns))
