"""Frames of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxplan.operators.features import mfcc

#: Names with a purpose that are sent to every task, at most; beyond it recordings are shuffled once by name.
KNOWN = 1_000_000


def split_frames(df: DataFrame, frame: int = 320, hop: int = 160, min_tail: int = 13) -> DataFrame:
    """Rows' columns with frame_number and raw_samples in place of samples: full frames at 0, hop, ..., then the rest from the next hop on if it has min_tail samples."""
    n = F.size("samples")
    full = F.when(n >= frame, F.floor((n - frame) / hop) + 1).otherwise(0).cast("int")
    numbers = F.when(n - full * hop >= min_tail, F.sequence(F.lit(0), full)).when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.select("*", F.explode(numbers).alias("frame_number"))
    return rows.withColumn("raw_samples", F.slice("samples", F.col("frame_number") * hop + 1, F.lit(frame))).drop("samples")


def build_frames(recordings: DataFrame, assignments: DataFrame, frame: int = 320, hop: int = 160, min_tail: int = 13, sample_rate: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames with purpose, recordings left out with the reason); with mfcc if a sample rate is given.

    Left out are recordings with a problem, too short ones, and those without an assignment. The join is on names, and samples
    stay where they are as long as the names are few enough to go to every task.
    """
    problem = F.col("problem") if "problem" in recordings.columns else F.lit(None).cast("string")
    names = assignments.select("word", "recording", "purpose")
    names = F.broadcast(names) if names.limit(KNOWN + 1).count() <= KNOWN else names
    marked = recordings.join(names, ["word", "recording"], "left")
    marked = marked.withColumn("reason", F.coalesce(problem, F.when(F.coalesce(F.size("samples"), F.lit(0)) < min_tail, "too short"), F.when(F.col("purpose").isNull(), "no purpose")))
    bad = marked.where("reason is not null").select("word", "recording", "reason")
    frames = split_frames(marked.where("reason is null").drop("reason"), frame, hop, min_tail)
    return frames if sample_rate is None else mfcc(frames, sample_rate), bad
