"""Which recordings serve which purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxplan.operators.quality import with_global_index


def assign_purposes(recordings: DataFrame, train: float = 0.3, hmm: float = 0.5) -> DataFrame:
    """(word, recording, purpose): of each word's n recordings in order of name the first floor(n train) train the codebook, the next floor(n hmm) the models, the rest tests. Works on names only."""
    names = with_global_index(recordings.select("word", "recording").distinct(), ["word", "recording"])
    # A word with very many recordings is many ranges; its own numbers start with its least.
    words = names.groupBy("word").agg(F.min("i").alias("_first"), F.count("*").alias("_n"))
    rank, n = F.col("i") - F.col("_first") + 1, F.col("_n")
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(hmm))
    return names.join(words, "word").select("word", "recording", F.when(rank <= a, "train").when(rank <= a + b, "hmm").otherwise("test").alias("purpose"))


def assignment_counts(rows: DataFrame) -> DataFrame:
    """(purpose, word, recordings, frames, level) with totals by purpose (level 1) and over all (level 3)."""
    return rows.rollup("purpose", "word").agg(F.count_distinct("recording").alias("recordings"), F.count("*").alias("frames"), F.grouping_id().cast("int").alias("level")).select("purpose", "word", "recordings", "frames", "level")


def sample_per_group(rows: DataFrame, n: int, seed: str, group: str = "word", key: str = "recording") -> DataFrame:
    """n rows of each group, the same in every run: those of least md5 of key and seed."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
