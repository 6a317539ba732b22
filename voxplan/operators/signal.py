"""Signal operators on one row for each recording (samples as an array), without a shuffle.

Steps that the next one uses several times go through once(), which keeps the optimizer from writing them out each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxplan.functions.once import once

EMPTY = "array<double>"


def with_time_axis(df: DataFrame) -> DataFrame:
    """Long form (word, recording, idx, t, x) of rows (word, recording, framerate, samples): t = idx / framerate."""
    return df.select("word", "recording", "framerate", F.posexplode("samples").alias("idx", "x")).select("word", "recording", F.col("idx").cast("long").alias("idx"), (F.col("idx") / F.col("framerate")).alias("t"), "x")


def to_arrays(df: DataFrame) -> DataFrame:
    """(word, recording, samples) of the long form; the order is that of idx."""
    return df.groupBy("word", "recording").agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("_s")).select("word", "recording", F.col("_s.x").alias("samples"))


def _tail(x: Column) -> Column:
    return F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))


def _lead(x: Column) -> Column:
    return F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))


def preemphasis(df: DataFrame, coef: float = 0.95) -> DataFrame:
    """y[0] = 0, y[n] = x[n] - coef x[n-1]."""
    x = F.col("samples")
    first = F.when(F.size(x) > 0, F.array(F.lit(0.0))).otherwise(F.array().cast(EMPTY))
    return once(df, samples=F.concat(first, F.zip_with(_tail(x), _lead(x), lambda a, b: a - b * coef)))


def frame_count(n: Column, frame: int, hop: int) -> Column:
    """int((n - frame) / hop) + 1, where int cuts towards zero; 0 or less means too short."""
    quotient = (n - frame) / hop
    return (F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)) + 1).cast("int")


def short_time_stats(df: DataFrame, frame: int, hop: int) -> DataFrame:
    """Adds stats, an array of (frame, power, zcr). The last frame runs to the end but for the last sample. Recordings too short for a frame have none."""
    x, n = F.col("samples"), F.size("samples")
    count = frame_count(n, frame, hop)

    def one(i: Column) -> Column:
        part = F.when(i < count - 1, F.slice(x, i * hop + 1, F.lit(frame))).otherwise(F.slice(x, i * hop + 1, F.greatest(n - 1 - i * hop, F.lit(0))))
        power = F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v) / F.size(part)
        turns = F.zip_with(_tail(part), _lead(part), lambda a, b: F.abs(F.signum(a) - F.signum(b)))
        return F.struct(i.alias("frame"), power.alias("power"), (F.aggregate(turns, F.lit(0.0), lambda a, v: a + v) * 0.5).alias("zcr"))

    stats = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), one))
    return once(df, stats=F.coalesce(stats, F.array().cast("array<struct<frame:int,power:double,zcr:double>>")))


def _cut(df: DataFrame, start: Column, stop: Column, hop: int) -> DataFrame:
    """Samples from start's hop up to stop's hop; the whole number of hops if start is null. Too short recordings become empty."""
    df = once(df, _first=F.coalesce(start, F.lit(0)), _last=F.when(start.isNull(), F.size("stats")).otherwise(stop))
    first, last = F.col("_first"), F.col("_last")
    kept = F.slice("samples", first * hop + 1, F.greatest((last - first) * hop, F.lit(0)))
    return once(df, samples=F.when(F.size("stats") > 0, kept).otherwise(F.array().cast(EMPTY))).drop("_first", "_last", "stats", "_power", "_zcr")


def trim_silence(df: DataFrame, frame: int, hop: int, ratio: float = 0.015) -> DataFrame:
    """Keeps the hops from the first frame whose power is over ratio of the recording's largest up to, not with, the last such frame; all hops if none is."""
    df = once(short_time_stats(df, frame, hop), _power=F.array_max(F.col("stats.power")))
    df = once(df, _on=F.filter("stats", lambda s: s["power"] > F.col("_power") * ratio))
    return _cut(df, F.try_element_at("_on", F.lit(1))["frame"], F.try_element_at("_on", F.lit(-1))["frame"], hop).drop("_on")


def trim_silence_two_level(df: DataFrame, frame: int, hop: int, start: tuple[float, float] = (0.08, 0.15), stop: tuple[float, float] = (0.03, 0.10)) -> DataFrame:
    """As trim_silence, with (zero crossings, power) shares that begin and others that end the speech."""
    df = once(short_time_stats(df, frame, hop), _power=F.array_max(F.col("stats.power")), _zcr=F.array_max(F.col("stats.zcr")))
    over = lambda z, p: F.filter("stats", lambda s: (s["zcr"] > F.col("_zcr") * z) & (s["power"] > F.col("_power") * p))
    df = once(df, _on=over(*start), _off=over(*stop))
    return _cut(df, F.try_element_at("_on", F.lit(1))["frame"], F.try_element_at("_off", F.lit(-1))["frame"], hop).drop("_on", "_off")


def hamming_cumulative(df: DataFrame, window: int = 320, hop: int = 128) -> DataFrame:
    """Multiplies each sample by the weights of all windows over it: windows at 0, hop, ..., and a tail to the end but for the last sample."""
    n = F.size("samples")
    count = frame_count(n, window, hop)
    weight = lambda j: F.lit(0.54) - F.cos(j * (6.283185307179586 / (window - 1))) * 0.46

    def one(x: Column, i: Column) -> Column:
        out = x
        for m in range(-(-window // hop)):
            w = F.floor(i / hop).cast("int") - m
            out = out * F.when((w >= 0) & (w < count) & (i - w * hop < window), weight(i - w * hop)).otherwise(F.lit(1.0))
        return out * F.when((count >= 0) & (i >= count * hop) & (i < n - 1), weight(i - count * hop)).otherwise(F.lit(1.0))

    return once(df, samples=F.transform("samples", one))


def drop_leading(df: DataFrame, n: int = 500) -> DataFrame:
    """Without the first n samples; shorter recordings become empty."""
    return once(df, samples=F.slice("samples", n + 1, F.greatest(F.size("samples") - n, F.lit(0))))


def preprocess(df: DataFrame, mode: str = "batch", frame: int = 320, hop: int = 160, window: int = 320, window_hop: int = 128) -> DataFrame:
    """batch: pre-emphasis and trimming; live: pre-emphasis, trimming at two levels, windows."""
    if mode == "batch":
        return trim_silence(preemphasis(df), frame, hop)
    if mode == "live":
        return hamming_cumulative(trim_silence_two_level(preemphasis(df), frame, hop), window, window_hop)
    raise ValueError(f"mode is batch or live, not {mode}")
