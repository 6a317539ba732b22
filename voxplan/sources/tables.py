"""Tables of processed signals, frames, codebooks and models as Parquet, and their JSON interchange."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxplan import schema


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only where that is unset and all run on one machine."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster, steps need one that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="voxplan-")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_processed(df: DataFrame, path: str) -> None:
    """Signals (word, recording, samples, ...), one folder for each word."""
    df.write.mode("overwrite").partitionBy("word").parquet(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_frames(df: DataFrame, path: str) -> None:
    """Frames, one folder for each purpose and word; reading one purpose reads its folders only. How many files a folder gets follows its size: small ones are written by one task, large ones are split."""
    df.hint("rebalance", "purpose", "word").write.mode("overwrite").partitionBy("purpose", "word").parquet(path)


def read_frames(spark: SparkSession, path: str, purpose: str | None = None, word: str | None = None, recording: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    for column, value in (("purpose", purpose), ("word", word), ("recording", recording)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def read_frames_json(spark: SparkSession, path: str, file_name: str = "*.{json,txt}") -> DataFrame:
    """Frames of JSON arrays in <path>/<word>/<recording>/<file>; word and recording come from the folders (whose names may be name=value), stored features are taken as they are."""
    rows = spark.read.schema(schema.FRAME_JSON).option("multiLine", True).option("pathGlobFilter", file_name).option("recursiveFileLookup", "true").json(path)
    folder = lambda up: F.regexp_extract(F.col("_metadata.file_path"), "(?:[^/=]*=)?([^/]+)" + "/[^/]+" * up + "$", 1)
    return rows.select(folder(2).alias("word"), folder(1).alias("recording"), "frame_number", "raw_samples", "sample_rate", "n_channels", "frame_duration_ms", F.col("mfcc_vector").alias("mfcc"), "parent_centroid_id", "generation")


def write_frames_json(df: DataFrame, path: str) -> None:
    """The frames of a recording, by number, as one JSON array in <path>/word=<word>/recording_name=<recording>/; read_frames_json reads it back."""
    one = F.struct("frame_number", "raw_samples", "sample_rate", "n_channels", "frame_duration_ms", F.col("mfcc").alias("mfcc_vector"), "parent_centroid_id", "generation", "recording")
    rows = df.groupBy("word", F.col("recording").alias("recording_name")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))
    rows.write.mode("overwrite").partitionBy("word", "recording_name").text(path)


def write_codebook(df: DataFrame, path: str) -> None:
    df.select("id", "vec").write.mode("overwrite").parquet(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CODEBOOK).parquet(path)


def write_generations(df: DataFrame, path: str) -> None:
    df.select("generation", "id", "vec").write.mode("overwrite").parquet(path)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GENERATIONS).parquet(path)


def generations_nested(df: DataFrame) -> DataFrame:
    """(generation, codebook): each generation's centroids as an array by id."""
    return df.groupBy("generation").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("codebook"))


def generations_flat(df: DataFrame) -> DataFrame:
    return df.select("generation", F.explode("codebook").alias("c")).select("generation", "c.id", "c.vec")


_CENTROIDS = "array<struct<mfcc:array<double>,id:int>>"


def _centroids() -> Column:
    """A codebook (some hundred rows at most) as an array by id."""
    by_id = F.array_sort(F.collect_list(F.struct("id", F.col("vec").alias("mfcc"))))
    return F.transform(by_id, lambda c: F.struct(c["mfcc"].alias("mfcc"), c["id"].alias("id")))


def write_codebook_json(df: DataFrame, path: str) -> None:
    """One JSON array of objects (mfcc, id), by id."""
    df.agg(F.to_json(_centroids()).alias("value")).write.mode("overwrite").text(path)


def read_codebook_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _CENTROIDS)).alias("c"))
    return rows.select("c.id", F.col("c.mfcc").alias("vec"))


def write_generations_json(df: DataFrame, path: str) -> None:
    """One JSON array with an array of objects (mfcc, id) for each generation, in order; generations are numbered from 0 without gaps."""
    each = df.groupBy("generation").agg(_centroids().alias("g"))
    rows = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", "g"))), lambda x: x["g"]).alias("gs"))
    rows.select(F.to_json("gs").alias("value")).write.mode("overwrite").text(path)


def read_generations_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{_CENTROIDS}>")).alias("generation", "g"))
    return rows.select("generation", F.explode("g").alias("c")).select("generation", "c.id", F.col("c.mfcc").alias("vec"))


def write_models(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    out = spark.read.schema(schema.MODELS).parquet(path)
    return out if word is None else out.where(F.col("word") == word)
