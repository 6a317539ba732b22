"""JSON documents of models, frames and codebooks: one document for each word, recording or codebook, in all the shapes that they come in.

A frame's record is `mfcc` (mfcc_vector), `lpc` (lpc_vector and lsf_vector) or `raw` (neither); a centroid's has mfcc, or lsf and lpc. One
read takes the fields of all shapes and tells them apart by what is there, so folders may mix them. Stored features are taken as
they are. Reading writes no file and collects nothing; what is no such document has a row in the problems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxplan import schema
from voxplan.operators.features import lsf_to_lpc

FRAME = "raw_samples array<double>, autocorrelation_vector array<double>, lpc_vector array<double>, lsf_vector array<double>, mfcc_vector array<double>, sample_rate int, n_channels int, frame_duration_ms double, parent_centroid_id int, generation int, frame_number int, recording string"
CENTROIDS = "array<struct<mfcc:array<double>,lsf:array<double>,lpc:array<double>,id:int>>"
_FILES = "*.{json,txt}"
#: Features of a record and the columns that hold them here.
_FEATURES = {"mfcc_vector": "mfcc", "autocorrelation_vector": "autocorr", "lpc_vector": "lpc", "lsf_vector": "lsf"}
#: What a record of each shape has, in its order.
_RECORD = {
    "mfcc": ("raw_samples", "sample_rate", "n_channels", "frame_duration_ms", "mfcc_vector", "parent_centroid_id", "generation", "frame_number", "recording"),
    "lpc": ("raw_samples", "autocorrelation_vector", "lpc_vector", "lsf_vector", "parent_centroid_id", "generation", "frame_number", "recording"),
    "raw": ("raw_samples", "autocorrelation_vector", "frame_number", "recording"),
}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", _FILES).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _folder(up: int) -> Column:
    """The folder so many levels above a document, without a `name=` before it."""
    return F.regexp_extract("path", "(?:[^/=]*=)?([^/]+)" + "/[^/]+" * up + "$", 1)


# Models


def write_models_json(models: DataFrame, path: str) -> None:
    """A JSON object (states, symbols, A, B, Pi, word) for each word, in <path>/model=<word>/."""
    document = F.to_json(F.struct("states", "symbols", "A", "B", "Pi", "word"))
    models.select(F.col("word").alias("model"), document.alias("value")).repartition("model").write.mode("overwrite").partitionBy("model").text(path)


def _models(spark: SparkSession, path: str, word: str | None) -> DataFrame:
    """(path, word, ..., problem) of the documents below path; with a word, those alone whose file or folder is named after it."""
    rows = _documents(spark, path)
    if word is not None:
        plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  as Spark names folders
        named = (plain(F.regexp_extract("path", r"([^/]+)\.(?:json|txt)$", 1)) == word) | (plain(_folder(1)) == word)
        rows = rows.where(named)
    fields = schema.MODELS.replace("word string, ", "") + ", word string"
    m = rows.withColumn("m", F.from_json("value", fields))
    rows_of = lambda a, n, k: (F.size(a) == n) & F.forall(a, lambda r: F.size(r) == k)
    n, k = F.col("m.states"), F.col("m.symbols")
    fits = rows_of(F.col("m.A"), n, n) & rows_of(F.col("m.B"), n, k) & (F.size("m.Pi") == n)
    problem = F.when(F.col("m.word").isNull(), "no model").when(~F.coalesce(fits, F.lit(False)), "sizes that don't fit")
    return m.select("path", *(F.col(f"m.{c.split(' ')[0]}").alias(c.split(" ")[0]) for c in schema.MODELS.split(", ")), problem.alias("problem"))


def read_models_json(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    """Models of the documents in <path>/<word>.json or <path>/model=<word>/; a word's only, if given. Those that are none are left out, as model_problems() tells."""
    rows = _models(spark, path, word).where("problem is null").drop("path", "problem")
    return rows if word is None else rows.where(F.col("word") == word)


def model_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the documents below path that are no model."""
    return _models(spark, path, None).where("problem is not null").select("path", "problem")


# Frames


def write_frame_records(frames: DataFrame, path: str, shape: str = "mfcc") -> None:
    """The frames of a recording, by number, as one JSON array of records of a shape (mfcc, lpc, raw), in <path>/word=<word>/recording_name=<recording>/."""
    columns = {c: _FEATURES.get(c, c) for c in _RECORD[shape]}
    record = F.struct(*(F.col(own).alias(c) for c, own in columns.items()))
    in_order = F.array_sort(F.collect_list(F.struct("frame_number", record.alias("r"))))
    rows = frames.groupBy("word", F.col("recording").alias("recording_name")).agg(F.to_json(F.transform(in_order, lambda x: x["r"])).alias("value"))
    rows.write.mode("overwrite").partitionBy("word", "recording_name").text(path)


def read_frame_records(spark: SparkSession, path: str, shape: str = "auto") -> DataFrame:
    """Frames of <path>/<word>/<recording>/<file>: (word, recording, shape, frame_number, raw_samples, mfcc, autocorr, lpc, lsf, ...).

    shape: `auto` tells each record's by its fields; mfcc, lpc or raw takes all records as such, without the features that this shape doesn't have.
    An empty array has no frames, nor has a document that is none; frame_problems() tells these.
    """
    if shape != "auto" and shape not in _RECORD:
        raise ValueError(f"shape is auto, {', '.join(_RECORD)}, not {shape}")
    rows = _documents(spark, path).select(_folder(2).alias("word"), _folder(1).alias("recording"), F.explode(F.from_json("value", f"array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>")).alias("r"))
    told = F.when(F.col("r.mfcc_vector").isNotNull(), "mfcc").when(F.col("r.lpc_vector").isNotNull() & F.col("r.lsf_vector").isNotNull(), "lpc").otherwise("raw")
    kept = {c: F.col(f"r.{c}") if shape == "auto" or c in _RECORD[shape] else F.lit(None).cast("array<double>") for c in _FEATURES}
    plain = [f"r.{c}" for c in ("frame_number", "raw_samples", "sample_rate", "n_channels", "frame_duration_ms", "parent_centroid_id", "generation")]
    return rows.select("word", "recording", (told if shape == "auto" else F.lit(shape)).alias("shape"), *plain, *(v.alias(_FEATURES[c]) for c, v in kept.items()))


def frame_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the documents below path that are no array of frames."""
    made = F.from_json("value", "array<struct<raw_samples:array<double>>>")
    bad = made.isNull() | F.exists(made, lambda r: r.isNull() | r["raw_samples"].isNull())
    return _documents(spark, path).where(bad).select("path", F.lit("no frames").alias("problem"))


# Codebooks of line spectral frequencies


def _centroids() -> Column:
    """A codebook (some hundred rows at most) as an array of (lsf, lpc, id) by id."""
    by_id = F.array_sort(F.collect_list(F.struct("id", "lsf", "lpc")))
    return F.transform(by_id, lambda c: F.struct(c["lsf"].alias("lsf"), c["lpc"].alias("lpc"), c["id"].alias("id")))


def with_lpc(book: DataFrame) -> DataFrame:
    """book with lpc, made of lsf where there are 12 of these and the stored lpc is missing or all zero."""
    none = F.col("lpc").isNull() | F.forall("lpc", lambda x: x == 0)
    made = lsf_to_lpc(book.withColumnRenamed("lpc", "_stored")).withColumnRenamed("lpc", "_made").withColumnRenamed("_stored", "lpc")
    return made.withColumn("lpc", F.when(none & (F.size("lsf") == 12), F.col("_made")).otherwise(F.col("lpc"))).drop("_made")


def write_lsf_codebook_json(book: DataFrame, path: str) -> None:
    """(id, lsf, lpc) as one JSON array of objects (lsf, lpc, id), by id."""
    book.agg(F.to_json(_centroids()).alias("value")).write.mode("overwrite").text(path)


def write_lsf_generations_json(book: DataFrame, path: str) -> None:
    """(generation, id, lsf, lpc) as one JSON array with an array for each generation, in order; generations are numbered from 0 without gaps."""
    each = book.groupBy("generation").agg(_centroids().alias("g"))
    rows = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("generation", "g"))), lambda x: x["g"]).alias("gs"))
    rows.select(F.to_json("gs").alias("value")).write.mode("overwrite").text(path)


def read_centroids_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, shape, vec, lpc) of a codebook's array in either shape: vec is a centroid's mfcc or its lsf; lpc goes with the latter alone."""
    return _centroid_rows(spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CENTROIDS)).alias("c")), [])


def read_centroid_generations_json(spark: SparkSession, path: str) -> DataFrame:
    """(generation, id, shape, vec, lpc) of an array of codebooks in either shape."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{CENTROIDS}>")).alias("generation", "g"))
    return _centroid_rows(rows.select("generation", F.explode("g").alias("c")), ["generation"])


def _centroid_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    lsf = with_lpc(rows.where("c.mfcc is null").select(*keys, "c.id", "c.lsf", "c.lpc")).select(*keys, "id", F.lit("lsf").alias("shape"), F.col("lsf").alias("vec"), "lpc")
    return rows.where("c.mfcc is not null").select(*keys, "c.id", F.lit("mfcc").alias("shape"), F.col("c.mfcc").alias("vec"), F.lit(None).cast("array<double>").alias("lpc")).union(lsf)
