"""Features of frames; numpy over Arrow batches, frames of one length at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxplan.functions import kernels
from voxplan.functions.once import once


def _by_length(kernel: Callable[[np.ndarray], np.ndarray], empty: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frames in batches:
            sizes = frames.map(lambda x: 0 if x is None else len(x))
            out = [None] * len(frames)
            for size in set(sizes):
                at = np.flatnonzero(sizes == size)
                made = kernel(np.stack([np.asarray(frames.iloc[i], float) for i in at])) if size else np.zeros((len(at), empty))
                for i, row in zip(at, made):
                    out[i] = row
            yield pd.Series(out)

    return run


def _udf(kernel: Callable[[np.ndarray], np.ndarray], empty: int, column: str) -> Column:
    run = _by_length(kernel, empty)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    return pandas_udf(each, "array<double>")(F.col(column))


def mfcc(df: DataFrame, sample_rate: int = 16000, n_mfcc: int = 13, n_mels: int = 26, column: str = "raw_samples") -> DataFrame:
    """Adds mfcc, n_mfcc coefficients of each frame, with an FFT of the frame's length; zeros for an empty frame."""
    return df.withColumn("mfcc", _udf(lambda x: kernels.mfcc(x, sample_rate, n_mfcc, n_mels), n_mfcc, column))


def autocorrelation(df: DataFrame, order: int = 12, column: str = "raw_samples") -> DataFrame:
    """Adds autocorr: sums of x[n] x[n+k] for k from 0 to order, 0 for lags that the frame doesn't have."""
    x, n = F.col(column), F.size(column)

    def lag(k: Column) -> Column:
        left, right = F.slice(x, 1, F.greatest(n - k, F.lit(0))), F.slice(x, k + 1, F.greatest(n - k, F.lit(0)))
        return F.coalesce(F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))

    return once(df, autocorr=F.transform(F.sequence(F.lit(0), F.lit(order)), lag))


def lpc(df: DataFrame, order: int = 12, column: str = "raw_samples") -> DataFrame:
    """Adds lpc, order + 1 coefficients by Burg's method: for frames of no more than order samples of a lower order and padded; [1, 0, ...] where it fails."""
    return df.withColumn("lpc", _udf(lambda x: kernels.lpc(x, order), order + 1, column))


def lpc_to_lsf(df: DataFrame, order: int = 12) -> DataFrame:
    """Adds lsf: the ascending line spectral frequencies of lpc, zeros after the last."""
    return df.withColumn("lsf", _udf(lambda a: kernels.lpc_to_lsf(a, order), order, "lpc"))


def lsf_to_lpc(df: DataFrame, order: int = 12) -> DataFrame:
    """Adds lpc from lsf."""
    return df.withColumn("lpc", _udf(kernels.lsf_to_lpc, order + 1, "lsf"))
