"""Logarithms of probabilities as column expressions; minus infinity stands for the impossible."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = float("-inf")


def safe_log(x: Column) -> Column:
    """ln x, and minus infinity for 0 or less."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(NEVER))


def safe_exp(x: Column) -> Column:
    """e^x, and 0 for minus infinity."""
    return F.when(x == NEVER, F.lit(0.0)).otherwise(F.exp(x))


def log_sum_exp(values: Column) -> Column:
    """Of an array: ln of the sum of e^v; minus infinity for an empty array or one of minus infinities only."""
    top = F.coalesce(F.array_max(values), F.lit(NEVER))
    total = F.aggregate(F.transform(values, lambda v: F.when(v == NEVER, F.lit(0.0)).otherwise(F.exp(v - F.coalesce(F.array_max(values), F.lit(NEVER))))), F.lit(0.0), lambda a, v: a + v)
    return F.when(top == NEVER, F.lit(NEVER)).otherwise(F.log(total) + top)


#: Groups that a task has open at once, at most.
_OPEN = 100_000


def _merged(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Pairs (_top, _sum), each standing for _sum * e^_top, as one pair for each group."""
    top = rows.groupby(keys, dropna=False, sort=False)["_top"].transform("max")
    with np.errstate(invalid="ignore"):
        rows = rows.assign(_sum=np.where(np.isneginf(top), 0.0, rows["_sum"] * np.exp(rows["_top"] - top)))
    return rows.groupby(keys, dropna=False, sort=False, as_index=False).agg({"_top": "max", "_sum": "sum"})


def log_sum_exp_by(df: DataFrame, keys: list[str], value: str, name: str = "lse") -> DataFrame:
    """Grouped: a task makes one pair (maximum, sum scaled by it) of a group's values, and pairs, which can be merged in any order, meet after one shuffle.

    Null values are left out; a group of nulls alone has no row.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = None
        for rows in batches:
            new = _merged(rows.assign(_sum=1.0), keys)
            have = new if have is None else _merged(pd.concat([have, new], ignore_index=True), keys)
            if len(have) > _OPEN:
                yield have
                have = None
        if have is not None:
            yield have

    rows = df.select(*keys, F.col(value).cast("double").alias("_top")).where(F.col("_top").isNotNull())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    met = rows.mapInPandas(pairs, f"{kinds}, _sum double").groupBy(*keys).agg(F.max("_top").alias("_most"), F.collect_list(F.struct("_top", "_sum")).alias("_pairs"))
    total = F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p["_sum"] * F.when(p["_top"] == NEVER, F.lit(0.0)).otherwise(F.exp(p["_top"] - F.col("_most"))))
    return met.select(*keys, F.when(F.col("_most") == NEVER, F.lit(NEVER)).otherwise(F.log(total) + F.col("_most")).alias(name))
