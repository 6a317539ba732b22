"""Signal operators on the long form (word, recording, idx, x), for recordings of any length: no row or task holds a whole one.

Rows are dealt by (recording, chunk), a chunk being so many samples in a row. What looks at a neighbouring sample has a halo: the
samples at a chunk's two ends are also rows of the chunks next to it, so lag and lead never look across a key. What holds for
a whole recording (its length, its largest power) is a row for each of its chunks, and joins on the same key, so a recording
that has a third of all samples is as many keys as it has chunks, and samples that are dealt once stay where they are.

The rows equal those of voxplan.operators.signal. idx runs from 0 without gaps; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxplan.operators.signal import frame_count
from voxplan.schema import KEY

CHUNK = 1 << 16
_PART = [*KEY, "chunk"]


def _chunk(idx: Column, chunk: int) -> Column:
    return F.floor(idx / chunk)


def lengths(df: DataFrame) -> DataFrame:
    """(word, recording, n) of the long form."""
    return df.groupBy(*KEY).agg((F.max("idx") + 1).alias("n"))


def _each_chunk(facts: DataFrame, chunk: int) -> DataFrame:
    """facts (word, recording, n, ...) once for each chunk of n samples."""
    return facts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(_chunk(F.col("n") - 1, chunk), F.lit(0)))))


def with_facts(df: DataFrame, facts: DataFrame, chunk: int = CHUNK, at: Column | str = "idx") -> DataFrame:
    """df (word, recording, ...) with the columns of facts (word, recording, n, ...), dealt by the chunk of its sample `at`."""
    at = F.col(at) if isinstance(at, str) else at
    return df.withColumn("chunk", _chunk(at, chunk)).join(_each_chunk(facts, chunk), _PART).drop("chunk")


def with_neighbours(df: DataFrame, facts: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """df (word, recording, idx, x) with the samples before and after each one as `before` and `after`, null at the ends, and the columns of facts."""
    idx, own = F.col("idx"), _chunk(F.col("idx"), chunk)
    there = F.array_compact(F.array(own, F.when((idx + 1) % chunk == 0, own + 1), F.when((idx % chunk == 0) & (idx > 0), own - 1)))
    rows = df.withColumn("chunk", F.explode(there))
    if facts is not None:
        rows = rows.join(_each_chunk(facts, chunk), _PART)
    order = Window.partitionBy(*_PART).orderBy("idx")
    rows = rows.withColumns({"before": F.lag("x").over(order), "after": F.lead("x").over(order)})
    return rows.where(F.col("chunk") == own).drop("chunk")


def preemphasis(df: DataFrame, coef: float = 0.95, chunk: int = CHUNK) -> DataFrame:
    """y[0] = 0, y[n] = x[n] - coef x[n-1]."""
    rows = with_neighbours(df, chunk=chunk)
    return rows.withColumn("x", F.when(F.col("idx") == 0, F.lit(0.0)).otherwise(F.col("x") - F.col("before") * coef)).drop("before", "after")


def short_time_stats(df: DataFrame, frame: int, hop: int, chunk: int = CHUNK) -> DataFrame:
    """(word, recording, n, frames, frame, power, zcr): for each frame its power and zero crossings; recordings too short for a frame have none.

    The interval join of samples and frames: a sample is in ceil(frame / hop) frames at most, and in the last one, which
    runs to the end but for the last sample; so it names them itself. A task adds up what it has of a frame before the shuffle.
    """
    idx, n, last = F.col("idx"), F.col("n"), F.col("frames") - 1
    rows = with_neighbours(df, lengths(df).withColumn("frames", frame_count(F.col("n"), frame, hop).cast("long")).where("frames > 0"), chunk)
    lo, hi = F.greatest(F.lit(0), F.ceil((idx - frame + 1) / hop)), F.least(F.floor(idx / hop), last - 1)
    none = F.array().cast("array<bigint>")
    covering = F.concat(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(none), F.when((idx >= last * hop) & (idx < n - 1), F.array(last)).otherwise(none))
    rows = rows.withColumn("frame", F.explode(covering))
    stop = F.when(F.col("frame") == last, n - 1).otherwise(F.col("frame") * hop + frame)
    turn = F.when(idx + 1 < stop, F.abs(F.signum("after") - F.signum("x"))).otherwise(0.0)
    sums = rows.groupBy(*KEY, "frame").agg(F.first("n").alias("n"), F.first("frames").alias("frames"), (F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("power"), (F.sum(turn) * 0.5).alias("zcr"))
    return sums.select(*KEY, "n", "frames", "frame", "power", "zcr")


def _cut(df: DataFrame, stats: DataFrame, start, stop, hop: int, chunk: int) -> DataFrame:
    """Samples from the hop of the first frame that start() takes up to the hop of the last that stop() takes; all hops if start() takes none."""
    most = stats.groupBy(*KEY).agg(F.max("n").alias("n"), F.max("power").alias("most_power"), F.max("zcr").alias("most_zcr"))
    rows = with_facts(stats.drop("n"), most, chunk, F.col("frame") * hop)
    first, last = F.min(F.when(start(), F.col("frame"))), F.max(F.when(stop(), F.col("frame")))
    bounds = rows.groupBy(*KEY).agg(F.max("n").alias("n"), F.max("frames").alias("frames"), first.alias("first"), last.alias("last"))
    bounds = bounds.select(*KEY, "n", (F.coalesce("first", F.lit(0)) * hop).alias("from"), (F.when(F.col("first").isNull(), F.col("frames")).otherwise(F.col("last")) * hop).alias("to"))
    kept = with_facts(df, bounds, chunk).where((F.col("idx") >= F.col("from")) & (F.col("idx") < F.col("to")))
    return kept.select(*KEY, (F.col("idx") - F.col("from")).alias("idx"), "x")


def trim_silence(df: DataFrame, frame: int, hop: int, ratio: float = 0.015, chunk: int = CHUNK) -> DataFrame:
    """As signal.trim_silence; recordings of which nothing stays have no rows."""
    on = lambda: F.col("power") > F.col("most_power") * ratio
    return _cut(df, short_time_stats(df, frame, hop, chunk), on, on, hop, chunk)


def trim_silence_two_level(df: DataFrame, frame: int, hop: int, start: tuple[float, float] = (0.08, 0.15), stop: tuple[float, float] = (0.03, 0.10), chunk: int = CHUNK) -> DataFrame:
    """As signal.trim_silence_two_level; recordings of which nothing stays have no rows."""
    over = lambda z, p: lambda: (F.col("zcr") > F.col("most_zcr") * z) & (F.col("power") > F.col("most_power") * p)
    return _cut(df, short_time_stats(df, frame, hop, chunk), over(*start), over(*stop), hop, chunk)


def hamming_cumulative(df: DataFrame, window: int = 320, hop: int = 128, chunk: int = CHUNK) -> DataFrame:
    """As signal.hamming_cumulative: the product of the weights of the windows over a sample, of which there are ceil(window / hop) and a tail at most."""
    idx, n = F.col("idx"), F.col("n")
    rows = with_facts(df, lengths(df).withColumn("count", frame_count(F.col("n"), window, hop).cast("long")), chunk)
    count, out = F.col("count"), F.col("x")
    weight = lambda j: F.lit(0.54) - F.cos(j * (6.283185307179586 / (window - 1))) * 0.46
    for m in range(-(-window // hop)):
        w = F.floor(idx / hop) - m
        out = out * F.when((w >= 0) & (w < count) & (idx - w * hop < window), weight(idx - w * hop)).otherwise(1.0)
    out = out * F.when((count >= 0) & (idx >= count * hop) & (idx < n - 1), weight(idx - count * hop)).otherwise(1.0)
    return rows.select(*KEY, "idx", out.alias("x"))


def preprocess(df: DataFrame, mode: str = "batch", frame: int = 320, hop: int = 160, window: int = 320, window_hop: int = 128, chunk: int = CHUNK) -> DataFrame:
    """batch: pre-emphasis and trimming; live: pre-emphasis, trimming at two levels, windows."""
    if mode == "batch":
        return trim_silence(preemphasis(df, chunk=chunk), frame, hop, chunk=chunk)
    if mode == "live":
        return hamming_cumulative(trim_silence_two_level(preemphasis(df, chunk=chunk), frame, hop, chunk=chunk), window, window_hop, chunk)
    raise ValueError(f"mode is batch or live, not {mode}")
