"""Recognition of arriving clips, and clips from arriving chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxplan.operators import framing, signal
from voxplan.operators.codebook import codebook_array, quantize
from voxplan.operators.features import mfcc
from voxplan.operators.scoring import rank_models, score_all
from voxplan.sources.audio import decoded, standardize_audio

#: How many tasks list files; by default as many as there are files in a micro-batch.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def recognise(clips: DataFrame, codebook: DataFrame, models: DataFrame, sample_rate: int = 16000, skip: int = 500, mode: str = "live") -> DataFrame:
    """(word, recording, model_word, loglik, rank) of clips (word, recording, samples), a batch's worth."""
    frame, hop = sample_rate // 50, sample_rate // 100
    ready = signal.preprocess(signal.drop_leading(clips, skip), mode, frame, hop, frame, max(1, frame * 2 // 5))
    return rank_models(score_all(quantize(mfcc(framing.split_frames(ready, frame, hop), sample_rate), codebook), models))


def stream_recognize(clips: DataFrame, codebook: DataFrame, models: DataFrame, out: str, checkpoint: str, sample_rate: int = 16000, skip: int = 500, mode: str = "live", trigger: dict | None = None) -> StreamingQuery:
    """Starts recognising a stream of clips into Parquet below `out`; each micro-batch has a folder of its own and overwrites it when it is repeated, so results come once.

    trigger: the arguments of DataStreamWriter.trigger, such as {"processingTime": "2 seconds"} for a live stream; by
    default what is there is recognised and the stream ends.
    """
    book, kept = codebook_array(codebook), _held(models)

    def write(rows: DataFrame, batch: int) -> None:
        recognise(rows, book, kept, sample_rate, skip, mode).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return clips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _held(models: DataFrame) -> DataFrame:
    """The models (a row for each word, which scoring brings to the driver anyway) as they are now, with nothing cached that a stream would have to let go."""
    return models.sparkSession.createDataFrame(models.collect(), models.schema)


def stream_recognize_wav(spark: SparkSession, root: str, codebook: DataFrame, models: DataFrame, out: str, problems: str, checkpoint: str, sample_rate: int = 16000, skip: int = 500, mode: str = "live", files: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Starts recognising the wav files that arrive below <root>/<word>/, `files` of them for each core at once at most, into Parquet below `out`.

    A micro-batch costs seconds however few clips it has, so it takes as many as all cores can hold. Each core lists and decodes
    its files in one task, and so does the session list files from now on; the clips are dealt once, by (word, recording), and nothing
    else is shuffled.
    Files are decoded in the stream, brought to one channel and sample_rate, and recognised as stream_recognize() does. A file
    that can't be read has a row (word, recording, path, problem) below `problems`, from the same micro-batch; a clip too short for a
    frame has the problem `too short`. Each micro-batch overwrites its own two folders when it is repeated, so nothing comes twice.
    """
    book, kept, cores = codebook_array(codebook), _held(models), spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, str(min(cores, int(spark.conf.get(_LISTING)))))
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    arriving = arriving.option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files * cores).load(root)
    clips = standardize_audio(decoded(arriving.select("path", "content").coalesce(cores), all_channels=True), sample_rate)

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.repartition(cores, "word", "recording").persist()
        ready = recognise(rows.where("problem is null"), book, kept, sample_rate, skip, mode).persist()
        try:
            ready.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            heard = ready.select("word", "recording").distinct()
            silent = rows.where("problem is null").join(heard, ["word", "recording"], "left_anti").withColumn("problem", F.lit("too short"))
            bad = rows.where("problem is not null").unionByName(silent).select("word", "recording", "path", "problem")
            bad.write.mode("overwrite").parquet(f"{problems}/batch={batch}")
        finally:
            ready.unpersist()
            rows.unpersist()

    return clips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def assemble_clips(chunks: DataFrame, clip_samples: int = 32000, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(recorder, clip, samples): a clip for each clip_samples of a recorder's chunks (recorder, ts, seq, samples), in order of ts and seq within a batch.

    Chunks later than the watermark are dropped, and what a recorder has gathered is let go when it stays idle; its next
    clip's number stays, so (recorder, clip) never repeats.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update(([], state.get[1]))
            return
        have, clip = state.get if state.exists else ([], 0)
        have, last = list(have), 0
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for x in rows["samples"]:
            have.extend(float(v) for v in x)
        last = int(rows["ts"].max().timestamp() * 1000)
        out = []
        while len(have) >= clip_samples:
            out.append((key[0], clip, have[:clip_samples]))
            have, clip = have[clip_samples:], clip + 1
        state.update((have, clip))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["recorder", "clip", "samples"])

    keyed = chunks.withWatermark("ts", late).groupBy("recorder")
    return keyed.applyInPandasWithState(gather, "recorder long, clip long, samples array<double>", "have array<double>, clip long", "append", GroupStateTimeout.EventTimeTimeout).select("recorder", "clip", F.col("samples"))
