"""Reports on the quality of frames, assignments and codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxplan.sources.tables import shared_path

#: All components within this of 0 count as zero.
ZERO = 1e-8


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: F.abs(x) <= ZERO)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def mfcc_issues(df: DataFrame, size: int = 13) -> DataFrame:
    """Adds issues: zero_mfcc, wrong_mfcc_size_<n>."""
    n = F.size("mfcc")
    wrong = F.when(n != size, F.concat(F.lit("wrong_mfcc_size_"), n.cast("string")))
    return df.withColumn("issues", F.array_compact(F.array(F.when((n > 0) & is_zero(F.col("mfcc")), "zero_mfcc"), wrong)))


def lpc_issues(df: DataFrame) -> DataFrame:
    """Adds issues: zero_autocorr, zero_lpc, zero_lsf."""
    return df.withColumn("issues", F.array_compact(F.array(*(F.when((F.size(c) > 0) & is_zero(F.col(c)), f"zero_{c}") for c in ("autocorr", "lpc", "lsf")))))


def frame_quality_mfcc(df: DataFrame) -> DataFrame:
    """One row: frames, valid ones, lengths of raw_samples, magnitudes of mfcc."""
    n, m = F.size("raw_samples"), magnitude(F.col("mfcc"))
    stats = [f(x).alias(f"{name}_{what}") for name, x in (("length", n), ("magnitude", m)) for what, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.agg(F.count("*").alias("total_frames"), F.count_if((F.size("mfcc") == 0) | ~is_zero(F.col("mfcc"))).alias("valid_mfcc"), *stats)


def frame_quality_lpc(df: DataFrame) -> DataFrame:
    """One row: frames, and how many have each vector other than zero."""
    return df.agg(F.count("*").alias("total_frames"), *(F.count_if((F.size(c) == 0) | ~is_zero(F.col(c))).alias(f"valid_{c}") for c in ("autocorr", "lpc", "lsf")))


def assignment_report(df: DataFrame) -> DataFrame:
    """(kind, value, n): frames by centroid, generation and recording, and in all, in one pass."""
    kinds = [("centroid", F.col("parent_centroid_id").cast("string")), ("generation", F.col("generation").cast("string")), ("recording", F.concat_ws("/", "word", "recording"))]
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds), F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")))).alias("x"))
    return rows.select("x.*").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def usage_stats(df: DataFrame) -> DataFrame:
    """(per, min, max, mean, std) of frames for each used centroid and each recording; std is that of a population."""
    parts = []
    for per, keys in (("centroid", ["parent_centroid_id"]), ("recording", ["word", "recording"])):
        n = df.groupBy(*keys).agg(F.count("*").alias("n"))
        parts.append(n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std")).select(F.lit(per).alias("per"), "*"))
    return parts[0].union(parts[1])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n): equal widths between least and largest, the last bin closed; equal values spread by half a unit. Empty bins are there."""
    ends = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b"))
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    counts = df.select(column).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends: one row; counts: bins rows
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    width = (F.col("b") - F.col("a")) / bins
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """(with_global_index(df, order, name), how many rows). The sorted ranges are written once to the shared folder."""
    path = shared_path(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    base, at = {}, 0
    for p, n in sorted(ranged.groupBy("_p").agg(F.count("*")).collect()):  # a row for each range
        base[p], at = at, at + n
    starts = F.create_map(*(F.lit(x) for kv in base.items() for x in kv)) if base else F.create_map().cast("map<int,int>")
    return ranged.withColumn(name, F.element_at(starts, F.col("_p")).cast("long") + F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_p", "_m"), at


def with_global_index(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """df with its rows' numbers in the given order, from 0. Ranges are numbered on their own and shifted by the counts before them, one number for each range."""
    return _numbered(df, order, name)[0]


def downsample(df: DataFrame, order: list[str], max_points: int = 1000) -> DataFrame:
    """Every max(1, n // max_points)-th row in order, with its number i."""
    numbered, n = _numbered(df, order, "i")
    return numbered.where(F.col("i") % max(1, n // max_points) == 0)


def codebook_stats(codebook: DataFrame) -> DataFrame:
    """(n, min, max, mean, std) of the centroids' magnitudes; std is that of a population."""
    m = codebook.select(magnitude(F.col("vec")).alias("m"))
    return m.agg(F.count("*").alias("n"), F.min("m").alias("min"), F.max("m").alias("max"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def top_issues(df: DataFrame, n: int = 5) -> DataFrame:
    """(word, recording, frame_number, issues, rest): the first n frames with issues, and how many more there are."""
    bad = df.where(F.size("issues") > 0).select("word", "recording", "frame_number", "issues")
    total = bad.agg(F.count("*").alias("_n"))
    return bad.orderBy("word", "recording", "frame_number").limit(n).crossJoin(F.broadcast(total)).select("word", "recording", "frame_number", "issues", F.greatest(F.col("_n") - n, F.lit(0)).alias("rest"))


def assignment_sets(frames: DataFrame) -> DataFrame:
    """(kind, centroid, generation, word, recording, n, centroids, generations) of assigned frames: all of them, each centroid, each generation and each recording.

    One pass with grouping sets; the last two columns are the sorted distinct centroids and generations, as many as the
    codebook has at most. Frames without a centroid are left out.
    """
    there = frames.where("parent_centroid_id is not null")
    sets = [[], ["parent_centroid_id"], ["generation"], ["word", "recording"]]
    every = F.grouping_id("parent_centroid_id", "generation", "word", "recording")
    out = there.groupingSets(sets, "parent_centroid_id", "generation", "word", "recording").agg(
        every.alias("level"), F.count("*").alias("n"), F.sort_array(F.collect_set(F.col("parent_centroid_id") + 0)).alias("centroids"), F.sort_array(F.collect_set(F.col("generation") + 0)).alias("generations"))
    kind = F.when(F.col("level") == 15, "all").when(F.col("level") == 7, "centroid").when(F.col("level") == 11, "generation").otherwise("recording")
    return out.select(kind.alias("kind"), F.col("parent_centroid_id").alias("centroid"), "generation", "word", "recording", "n", "centroids", "generations")
