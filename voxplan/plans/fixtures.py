"""The driver tables read as signals, frames, features and symbol sequences; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Geometry for the short signals of `events`.
RATE, FRAME, HOP, WINDOW, WINDOW_HOP = 800, 16, 8, 16, 6
SYMBOLS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}

SIG = "sig AS (SELECT 'w' || CAST(user_id % 10 AS VARCHAR) AS word, 'r' || CAST(user_id AS VARCHAR) AS recording, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, value AS x FROM events)"
SIG16 = "sig AS (SELECT 'w' || CAST(l_suppkey % 10 AS VARCHAR) AS word, 's' || CAST(l_suppkey AS VARCHAR) AS recording, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS idx, l_quantity - 25.5e0 AS x FROM lineitem)"
FR64 = "fr AS (SELECT 'w' || CAST(label AS VARCHAR) AS word, 'w' || CAST(label AS VARCHAR) || '-' || CAST(CAST(floor((rn - 1) / 10.0) AS INT) AS VARCHAR) AS recording, CAST((rn - 1) % 10 AS INT) AS frame_number, CAST(embedding AS DOUBLE[]) AS raw_samples, CAST(embedding AS DOUBLE[])[1:13] AS mfcc FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) t)"
SYM = "sym AS (SELECT 'w' || CAST(user_id % 10 AS VARCHAR) AS word, 'r' || CAST(user_id AS VARCHAR) AS recording, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS o FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recording(letter: str, column: str) -> list:
    c = F.col(column)
    return [F.concat(F.lit("w"), (c % 10).cast("string")).alias("word"), F.concat(F.lit(letter), c.cast("string")).alias("recording")]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, recording, framerate, samples): a user's event values in order of time."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("_s"))
    return rows.select(*_recording("r", "user_id"), F.lit(RATE).alias("framerate"), F.col("_s.value").alias("samples"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, recording, idx, x): signals() in long form, numbered without an array."""
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return table(spark, sf_dir, "events").select(*_recording("r", "user_id"), idx.alias("idx"), F.col("value").alias("x"))


def signals16k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, recording, samples): a supplier's line quantities, at full frame size."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_s"))
    rows = rows.select(*_recording("s", "l_suppkey"), F.col("_s.l_quantity").alias("_q"))
    return rows.select("word", "recording", F.transform("_q", lambda q: q - 25.5).alias("samples"))


def frames64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, recording, frame_number, raw_samples, mfcc): embeddings as frames of 64 samples; mfcc their first 13 values."""
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select("label", rank.alias("rn"), F.col("embedding").cast("array<double>").alias("raw_samples"))
    word = F.concat(F.lit("w"), F.col("label").cast("string"))
    return rows.select(word.alias("word"), F.concat(word, F.lit("-"), F.floor(F.col("rn") / 10).cast("string")).alias("recording"), (F.col("rn") % 10).cast("int").alias("frame_number"), "raw_samples", F.slice("raw_samples", 1, 13).alias("mfcc"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, recording, obs): a user's event types in order of time, as symbols."""
    symbol = F.lit(4)
    for name, k in SYMBOLS.items():
        symbol = F.when(F.col("event_type") == name, k).otherwise(symbol)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", symbol.alias("o")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "o"))).alias("_s"))
    return rows.select(*_recording("r", "user_id"), F.col("_s.o").alias("obs"))
