"""wav folders as rows."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxplan import schema
from voxplan.functions.kernels import resample


def decode(content: bytes) -> tuple[int, int, int, list[np.ndarray], str | None]:
    """(framerate, nchannels, nframes, samples of each channel, problem) of a wav file with 16-bit samples."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
            if width != 2:
                return rate, channels, n, [], f"sample width {width}"
            pcm = np.frombuffer(w.readframes(n), "<i2").astype(float)
    except (wave.Error, EOFError) as e:
        return 0, 0, 0, [], f"unreadable: {e}"
    if len(pcm) != n * channels:
        return rate, channels, n, [], "cut short"
    if not n:
        return rate, channels, n, [pcm], "empty"
    return rate, channels, n, list(pcm.reshape(n, channels).T), None


def read_wav_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Recordings below <root>/<word>/*.wav: word is the folder, recording the file's stem, samples the first channel in the file's own scale; problem tells what can't be read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return decoded(files, all_channels=False)


def decoded(files: DataFrame, all_channels: bool) -> DataFrame:
    """Files (path, content), of a table or a stream, as rows of read_wav_corpus() or read_wav_channels()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [decode(bytes(c)) for c in rows["content"]]
            out = pd.DataFrame({"path": rows["path"], "framerate": [m[0] for m in made], "nchannels": [m[1] for m in made], "nframes": [m[2] for m in made]})
            out["channels"] = [[c.tolist() for c in m[3]] if all_channels else [m[3][0].tolist()] if m[3] else [] for m in made]
            out["problem"] = [m[4] for m in made]
            yield out

    rows = files.mapInPandas(run, "path string, framerate int, nchannels int, nframes long, channels array<array<double>>, problem string")
    word, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^/.]*$", 1)
    out = rows.select(word.alias("word"), stem.alias("recording"), "path", "framerate", "nchannels", "nframes", "channels", "problem")
    if all_channels:
        return out
    return out.withColumn("samples", F.coalesce(F.try_element_at("channels", F.lit(1)), F.array().cast("array<double>"))).select(*(f.split(" ")[0] for f in schema.RECORDINGS.split(", ")))


def read_wav_channels(spark: SparkSession, root: str) -> DataFrame:
    """As read_wav_corpus, with channels, an array of samples for each, in place of samples."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(root).select("path", "content"), all_channels=True)


def standardize_audio(df: DataFrame, target: int = 16000) -> DataFrame:
    """One channel (the mean of all) at the target rate: rows with channels become rows with samples and reasons, what was changed, comma-joined."""
    reasons = F.concat_ws(",", F.when(F.col("nchannels") != 1, "stereo"), F.when(F.col("framerate") != target, "framerate"))
    n = F.size("channels")
    added = F.aggregate(F.slice("channels", 2, F.greatest(n - 1, F.lit(0))), F.element_at("channels", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    mono = F.when(n > 0, F.transform(added, lambda x: x / n)).otherwise(F.array().cast("array<double>"))
    marked = df.withColumn("reasons", reasons).withColumn("samples", mono).drop("channels")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["samples"] = [resample(np.asarray(x, float), r, target).tolist() if r else [] for x, r in zip(rows["samples"], rows["framerate"])]
            rows["nframes"] = [len(x) for x in rows["samples"]]
            yield rows.assign(framerate=np.int32(target), nchannels=np.int32(1))

    return marked.mapInPandas(run, T.StructType(marked.schema.fields))


def write_wav_corpus(df: DataFrame, root: str, framerate: int = 16000) -> None:
    """Writes rows (word, recording, samples in int16 scale) as <root>/<word>/<recording>.wav, one channel; root is a folder that all executors see under the same path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        n = 0
        for rows in batches:
            for word, recording, samples in zip(rows["word"], rows["recording"], rows["samples"]):
                os.makedirs(f"{root}/{word}", exist_ok=True)
                with wave.open(f"{root}/{word}/{recording}.wav", "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(framerate)
                    w.writeframes(np.clip(np.round(samples), -32768, 32767).astype("<i2").tobytes())
                n += 1
        yield pd.DataFrame({"n": [n]})

    df.select("word", "recording", "samples").mapInPandas(run, "n long").agg(F.sum("n")).collect()
