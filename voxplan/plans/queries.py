"""One query for each operator, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxplan import schema
from voxplan.functions import logmath
from voxplan.operators import codebook as vq
from voxplan.operators import chunked, features, framing, hmm, quality, scoring, signal, split
from voxplan.plans import fixtures as fx
from voxplan.plans.fixtures import FRAME, HOP, WINDOW, WINDOW_HOP
from voxplan.sources import audio, interchange, tables
from voxplan.streaming import clips as clipping
from voxplan.streaming import recognise as streaming


def r6(x: Column | str) -> Column:
    """Rounded for comparison; adding 0 leaves no negative zero."""
    return F.round(x, 6) + 0.0


def _long(df: DataFrame) -> DataFrame:
    return df.select("word", "recording", F.posexplode("samples").alias("idx", "x")).select("word", "recording", F.col("idx").cast("long").alias("idx"), r6("x").alias("x"))


# Signals


def sg1_time_axis(spark: SparkSession, sf: str) -> DataFrame:
    there = signal.with_time_axis(fx.signals(spark, sf))
    back = signal.to_arrays(there).withColumn("framerate", F.lit(fx.RATE))
    return signal.with_time_axis(back).select("word", "recording", "idx", r6("t").alias("t"), r6("x").alias("x"))


def sg2_preemphasis(spark: SparkSession, sf: str) -> DataFrame:
    return _long(signal.preemphasis(fx.signals(spark, sf)))


def sg3_short_time_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal.short_time_stats(signal.preemphasis(fx.signals(spark, sf)), FRAME, HOP)
    return rows.select("word", "recording", F.explode("stats").alias("s")).select("word", "recording", F.col("s.frame").cast("long").alias("frame"), r6("s.power").alias("power"), r6("s.zcr").alias("zcr"))


def sg4_trim_silence(spark: SparkSession, sf: str) -> DataFrame:
    return _long(signal.trim_silence(signal.preemphasis(fx.signals(spark, sf)), FRAME, HOP, 0.4))


def sg5_trim_two_level(spark: SparkSession, sf: str) -> DataFrame:
    return _long(signal.trim_silence_two_level(signal.preemphasis(fx.signals(spark, sf)), FRAME, HOP, (0.5, 0.5), (0.4, 0.3)))


def sg6_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return _long(signal.hamming_cumulative(fx.signals(spark, sf), WINDOW, WINDOW_HOP))


def sg7_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.signals(spark, sf)
    parts = [_long(signal.preprocess(own, mode, FRAME, HOP, WINDOW, WINDOW_HOP)).select(F.lit(mode).alias("mode"), "*") for mode in ("batch", "live")]
    return parts[0].union(parts[1])


def sg8_drop_leading(spark: SparkSession, sf: str) -> DataFrame:
    return _long(signal.drop_leading(fx.signals(spark, sf), 5))


#: A chunk here has no whole number of frames or hops, so that frames and windows lie across its ends.
CHUNK = 13


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("word", "recording", "idx", r6("x").alias("x"))


def sg2_preemphasis_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(chunked.preemphasis(fx.samples(spark, sf), chunk=CHUNK))


def sg3_short_time_stats_chunked(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunked.short_time_stats(chunked.preemphasis(fx.samples(spark, sf), chunk=CHUNK), FRAME, HOP, CHUNK)
    return rows.select("word", "recording", "frame", r6("power").alias("power"), r6("zcr").alias("zcr"))


def sg4_trim_silence_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(chunked.trim_silence(chunked.preemphasis(fx.samples(spark, sf), chunk=CHUNK), FRAME, HOP, 0.4, CHUNK))


def sg5_trim_two_level_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(chunked.trim_silence_two_level(chunked.preemphasis(fx.samples(spark, sf), chunk=CHUNK), FRAME, HOP, (0.5, 0.5), (0.4, 0.3), CHUNK))


def sg6_hamming_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(chunked.hamming_cumulative(fx.samples(spark, sf), WINDOW, WINDOW_HOP, CHUNK))


def sg7_preprocess_chunked(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.samples(spark, sf)
    parts = [_rounded(chunked.preprocess(own, mode, FRAME, HOP, WINDOW, WINDOW_HOP, CHUNK)).select(F.lit(mode).alias("mode"), "*") for mode in ("batch", "live")]
    return parts[0].union(parts[1])


# Split and frames


def sp1_assign_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return split.assign_purposes(fx.signals(spark, sf))


def sp2_assignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    frames = fx.frames64(spark, sf)
    return split.assignment_counts(frames.join(split.assign_purposes(frames), schema.KEY))


def sp3_sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return split.sample_per_group(fx.signals(spark, sf).select("word", "recording"), 3, "seed7")


def fr1_split_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = framing.split_frames(fx.signals(spark, sf), FRAME, HOP, 9)
    return rows.select("word", "recording", "frame_number", F.size("raw_samples").alias("n"), r6(_sum("raw_samples")).alias("total"))


def _sum(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _frames16k(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.signals16k(spark, sf)
    return framing.build_frames(own, split.assign_purposes(own.select("word", "recording")))[0]


def fr2_build_frames(spark: SparkSession, sf: str) -> DataFrame:
    return _frames16k(spark, sf).select("purpose", "word", "recording", "frame_number", F.size("raw_samples").alias("n"), r6(_sum("raw_samples")).alias("total"))


def _by_position(df: DataFrame, column: str) -> DataFrame:
    return df.select("word", "recording", "frame_number", F.posexplode(column).alias("pos", "v")).select("word", "recording", "frame_number", "pos", r6("v").alias("v"))


def ft1_mfcc(spark: SparkSession, sf: str) -> DataFrame:
    return _by_position(features.mfcc(fx.frames64(spark, sf).drop("mfcc")), "mfcc")


def ft2_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return _by_position(features.autocorrelation(fx.frames64(spark, sf)), "autocorr")


def ft3_lpc(spark: SparkSession, sf: str) -> DataFrame:
    return _by_position(features.lpc(fx.frames64(spark, sf)), "lpc")


def ft4_lsf(spark: SparkSession, sf: str) -> DataFrame:
    there = features.lpc_to_lsf(features.lpc(fx.frames64(spark, sf)))
    back = features.lsf_to_lpc(there.withColumnRenamed("lpc", "before"))
    return back.select("word", "recording", "frame_number", F.transform("lsf", lambda x: F.round(x, 6)).alias("lsf"), F.array_max(F.zip_with("lpc", "before", lambda a, b: F.abs(a - b))).alias("difference"))


# Codebook


def _four(frames: DataFrame) -> DataFrame:
    """A codebook of four: the mean, split twice."""
    return vq.split_codebook(vq.split_codebook(vq.initial_centroid(frames)))


def _book(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("int").alias("id"), F.posexplode("vec").alias("pos", "v")).select("id", "pos", r6("v").alias("v"))


def vq1_initial_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return _book(vq.initial_centroid(fx.frames64(spark, sf)))


def vq2_split_codebook(spark: SparkSession, sf: str) -> DataFrame:
    return _book(_four(fx.frames64(spark, sf)))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    frames = fx.frames64(spark, sf)
    return vq.assign_nearest(frames, _four(frames))


def vq3_assign_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("word", "recording", "frame_number", "parent_centroid_id", r6("distance").alias("distance"))


def vq4_itakura_saito(spark: SparkSession, sf: str) -> DataFrame:
    book = spark.range(4).select(F.col("id").cast("int").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(12)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise((F.col("id") + 1) * 0.1 / n * F.when(n % 2 == 0, 1.0).otherwise(-1.0))).alias("vec"))
    frames = features.autocorrelation(fx.frames64(spark, sf))
    return vq.assign_nearest(frames, book, "autocorr", "itakura_saito").select("word", "recording", "frame_number", "parent_centroid_id", r6("distance").alias("distance"))


def vq5_update_codebook(spark: SparkSession, sf: str) -> DataFrame:
    return _book(vq.update_codebook(_assigned(spark, sf), 4))


def vq6_train_codebook(spark: SparkSession, sf: str) -> DataFrame:
    return _book(vq.train_codebook(fx.frames64(spark, sf), k=2, max_iter=2)["codebook"])


def vq7_quantize(spark: SparkSession, sf: str) -> DataFrame:
    frames = fx.frames64(spark, sf)
    return vq.quantize(frames, vq.update_codebook(vq.assign_nearest(frames, _four(frames)), 4)).select("word", "recording", F.array_join("obs", ",").alias("obs"))


def vq8_training_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = vq.training_summary(_assigned(spark, sf).withColumn("generation", F.lit(2)))
    return rows.select("total_frames", "max_generation", F.explode("centroid_assignments").alias("centroid", "n"))


# Reports


def _faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of which some have a zero or too short mfcc."""
    n = F.col("frame_number")
    return fx.frames64(spark, sf).withColumn("mfcc", F.when(n == 5, F.array_repeat(F.lit(0.0), 13)).when(n == 3, F.slice("mfcc", 1, 12)).otherwise(F.col("mfcc")))


def qa1_frame_quality_mfcc(spark: SparkSession, sf: str) -> DataFrame:
    frames = _faulty(spark, sf)
    issues = quality.mfcc_issues(frames).agg(F.sum(F.size("issues")).alias("issues"))
    out = quality.frame_quality_mfcc(frames)
    return out.select("total_frames", "valid_mfcc", *(r6(c).alias(c) for c in out.columns[2:])).crossJoin(F.broadcast(issues))  # one row each


def qa2_frame_quality_lpc(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("frame_number")
    frames = features.autocorrelation(fx.frames64(spark, sf)).withColumn("lpc", F.when(n % 3 == 0, F.array_repeat(F.lit(0.0), 13)).otherwise(F.col("mfcc"))).withColumn("lsf", F.when(n % 4 == 0, F.array_repeat(F.lit(0.0), 12)).otherwise(F.slice("mfcc", 1, 12)))
    issues = quality.lpc_issues(frames).agg(F.sum(F.size("issues")).alias("issues"))
    return quality.frame_quality_lpc(frames).crossJoin(F.broadcast(issues))  # one row each


def qa3_assignment_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assignment_report(_assigned(spark, sf).withColumn("generation", F.lit(2)))


def qa3_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.assignment_sets(_assigned(spark, sf).withColumn("generation", F.col("frame_number") % 3))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return rows.select("kind", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("centroid", "generation", "word", "recording")), "n", text("centroids"), text("generations"))


def qa4_usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.usage_stats(_assigned(spark, sf)).select("per", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"))


def qa5_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frames64(spark, sf).select(quality.magnitude(F.col("mfcc")).alias("m"))
    return quality.histogram(rows, "m", 30).select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def qa6_downsample(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.frames64(spark, sf).select("word", "recording", "frame_number", quality.magnitude(F.col("mfcc")).alias("m"))
    return quality.downsample(rows, ["word", "recording", "frame_number"], 100).select("i", "word", "recording", "frame_number", r6("m").alias("m"))


def qa7_codebook_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.codebook_stats(_four(fx.frames64(spark, sf))).select("n", *(r6(c).alias(c) for c in ("min", "max", "mean", "std")))


def qa8_top_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.top_issues(quality.mfcc_issues(_faulty(spark, sf))).select("word", "recording", "frame_number", F.array_join("issues", ",").alias("issues"), "rest")


# Hidden Markov models

M = len(fx.SYMBOLS)
WARM_B = [0.4, 0.3, 0.1, 0.1, 0.1]


def _start(seqs: DataFrame) -> DataFrame:
    """The default models, but for word w0, which starts from other symbol probabilities."""
    warm = hmm.initial_model(seqs.where("word = 'w0'"), M).withColumn("B", F.array_repeat(F.array(*map(F.lit, WARM_B)), 4))
    return hmm.initial_model(seqs, M, warm=warm)


def hm1_log_sum_exp(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "events").select("user_id", (-F.col("value")).alias("v"))
    grouped = logmath.log_sum_exp_by(rows, ["user_id"], "v")
    arrays = rows.groupBy("user_id").agg(F.collect_list("v").alias("vs")).select("user_id", logmath.log_sum_exp(F.col("vs")).alias("of_array"))
    return grouped.join(arrays, "user_id").select("user_id", r6("lse").alias("lse"), r6("of_array").alias("of_array"), r6(logmath.safe_exp(logmath.safe_log(-F.col("lse")))).alias("back"))


def hm2_initial_model(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.long_form(_start(fx.sequences(spark, sf))).select("word", "kind", "i", "j", r6("p").alias("p"))


def hm3_forward(spark: SparkSession, sf: str) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    return hmm.forward_loglik(seqs, _start(seqs)).select("word", "recording", "model_word", r6("loglik").alias("loglik"))


def hm4_forward_backward(spark: SparkSession, sf: str) -> DataFrame:
    return _posteriors(spark, sf, None)


def _posteriors(spark: SparkSession, sf: str, block: int | None) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    rows = hmm.forward_backward(seqs, _start(seqs), block).where("kind <> 'loglik'")
    rows = rows.withColumn("t", F.when(F.col("kind") == "gamma", F.col("t")).otherwise(-1)).groupBy("word", "recording", "kind", "t", "i", "j").agg(F.sum(logmath.safe_exp(F.col("v"))).alias("p"))
    return rows.select("word", "recording", "kind", "t", "i", "j", r6("p").alias("p"))


def hm3_forward_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As hm3_forward, by blocks of about three models."""
    seqs = fx.sequences(spark, sf)
    return hmm.forward_loglik_blocks(seqs, _start(seqs), block=3, symbols=1000).select("word", "recording", "model_word", r6("loglik").alias("loglik"))


def hm4_forward_backward_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As hm4_forward_backward, at a block length that divides no sequence evenly."""
    return _posteriors(spark, sf, 3)


def hm5_m_step(spark: SparkSession, sf: str) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    return hmm.m_step(hmm.statistics(seqs, hmm.log_arrays(_start(seqs))), M).select("word", "kind", "i", "j", r6("p").alias("p"))


def _trained(seqs: DataFrame) -> DataFrame:
    return hmm.train_hmms(seqs, M, max_iter=1, warm=_start(seqs))[0]


def hm6_train_hmms(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.long_form(_trained(fx.sequences(spark, sf))).select("word", "kind", "i", "j", r6("p").alias("p"))


# Scores


def sc1_trained_only(spark: SparkSession, sf: str) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    return scoring.trained_only(seqs, _start(seqs).where("word < 'w7'")).select("word", "recording", F.size("obs").alias("n"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    return scoring.score_all(seqs, _trained(seqs))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    seqs = fx.sequences(spark, sf)
    return scoring.predict_sequences(seqs, _trained(seqs))


def sc2_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _predictions(spark, sf).select("word", "recording", "predicted", r6("loglik").alias("loglik"))


def sc2_predict_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As sc2_predict, by blocks of about three models."""
    seqs = fx.sequences(spark, sf)
    return scoring.predict_blocks(seqs, _trained(seqs), 3).select("word", "recording", "predicted", r6("loglik").alias("loglik"))


def sc3_rank_models(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rank_models(_scores(spark, sf)).select("word", "recording", "model_word", "rank", r6("loglik").alias("loglik"))


def sc4_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "labels").select(F.col("quality").cast("string").alias("word"), F.col("toxic").cast("string").alias("predicted"))
    return scoring.confusion_matrix(rows).select("true", "predicted", "n", r6("accuracy").alias("accuracy"))


def sc4_confusion_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents against those that a document of the next id has: a label that never occurs, and those outside the list."""
    rows = fx.table(spark, sf, "documents").select("doc_id", "lang")
    pairs = rows.select("doc_id", F.col("lang").alias("word")).join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("predicted")), "doc_id")
    return scoring.confusion_dense(pairs, ["de", "en", "xx"]).select("place", "true", "de", "en", "xx", "unlisted", r6(F.coalesce("hits", F.lit(-1.0))).alias("hits"))


def sc5_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.classification_report(_predictions(spark, sf))
    return out.select("label", *(r6(c).alias(c) for c in ("precision", "recall", "f1")), "support")


# Sources and sinks


def io1_wav_corpus(spark: SparkSession, sf: str) -> DataFrame:
    root = tables.shared_path(spark, "wav").removeprefix("file://").removeprefix("file:")
    own = fx.signals16k(spark, sf)
    audio.write_wav_corpus(own.withColumn("samples", F.transform("samples", lambda x: x * 100)), root)
    rows = audio.read_wav_corpus(spark, root)
    return rows.where("problem is null").select("word", "recording", "framerate", "nchannels", "nframes", r6(_sum("samples")).alias("total"), r6(F.element_at("samples", -1)).alias("last"))


def io2_standardize(spark: SparkSession, sf: str) -> DataFrame:
    own = fx.signals16k(spark, sf).select("word", "recording", F.lit(16000).alias("framerate"), F.lit(2).alias("nchannels"), F.size("samples").cast("long").alias("nframes"), F.array("samples", F.transform("samples", lambda x: x * 3)).alias("channels"))
    return audio.standardize_audio(own).select("word", "recording", "framerate", "nchannels", "nframes", "reasons", r6(_sum("samples")).alias("total"))


def io3_processed(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "processed")
    tables.write_processed(signal.preprocess(fx.signals(spark, sf), "batch", FRAME, HOP), path)
    return _long(tables.read_processed(spark, path))


def io4_frames(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "frames")
    tables.write_frames(_frames16k(spark, sf), path)
    return tables.read_frames(spark, path, purpose="hmm").select("purpose", "word", "recording", "frame_number", F.size("raw_samples").alias("n"), r6(_sum("raw_samples")).alias("total"))


def io5_codebook(spark: SparkSession, sf: str) -> DataFrame:
    frames = fx.frames64(spark, sf)
    path, past = tables.shared_path(spark, "codebook"), tables.shared_path(spark, "generations")
    tables.write_codebook(_four(frames), path)
    array = tables.shared_path(spark, "codebook-json")
    tables.write_codebook_json(tables.read_codebook(spark, path), array)
    first, second = vq.initial_centroid(frames), vq.split_codebook(vq.initial_centroid(frames))
    tables.write_generations(first.select(F.lit(0).alias("generation"), "*").union(second.select(F.lit(1).alias("generation"), "*")), past)
    nested, arrays = tables.generations_nested(tables.read_generations(spark, past)), tables.shared_path(spark, "generations-json")
    tables.write_generations_json(tables.generations_flat(nested), arrays)
    rows = tables.read_generations_json(spark, arrays).select("generation", "id", "vec").union(tables.read_codebook_json(spark, array).select(F.lit(2).alias("generation"), "id", "vec"))
    return rows.select("generation", "id", F.posexplode("vec").alias("pos", "v")).select("generation", "id", "pos", r6("v").alias("v"))


def io6_models(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "models")
    tables.write_models(_start(fx.sequences(spark, sf)), path)
    one = hmm.long_form(tables.read_models(spark, path, "w0")).select(F.lit("one").alias("read"), "*")
    return one.union(hmm.long_form(tables.read_models(spark, path)).select(F.lit("all").alias("read"), "*")).select("read", "word", "kind", "i", "j", r6("p").alias("p"))


def io4_frames_json(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as JSON of three shapes below one path, by recording; the three shapes are told apart when they are read."""
    path, number = tables.shared_path(spark, "frames-json"), F.regexp_extract("recording", "-([0-9]+)$", 1).cast("int") % 3
    frames = features.autocorrelation(fx.frames64(spark, sf)).withColumns({"lpc": F.reverse("mfcc"), "lsf": F.slice("mfcc", 2, 12), "generation": F.lit(1), "parent_centroid_id": F.col("frame_number"), "sample_rate": F.lit(fx.RATE), "n_channels": F.lit(1), "frame_duration_ms": F.lit(20.0)})
    for k, shape in enumerate(("mfcc", "lpc", "raw")):
        interchange.write_frame_records(frames.where(number == k), f"{path}/{shape}", shape)
    rows = interchange.read_frame_records(spark, path)
    total = {c: r6(_sum(c)) for c in ("raw_samples", "mfcc", "autocorr", "lpc", "lsf")}
    return rows.select("word", "recording", "shape", "frame_number", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("generation", "parent_centroid_id")), *(v.alias(c) for c, v in total.items()))


def io5_codebook_lsf(spark: SparkSession, sf: str) -> DataFrame:
    """Codebooks of line spectral frequencies, alone and as generations, and one of features, read by the same function."""
    four = _four(fx.frames64(spark, sf)).select("id", F.slice("vec", 2, 12).alias("lsf"), F.col("vec").alias("lpc"))
    book, past, plain = (tables.shared_path(spark, x) for x in ("lsf", "lsf-generations", "mfcc"))
    interchange.write_lsf_codebook_json(four, book)
    interchange.write_lsf_generations_json(four.select((F.col("id") % 2).alias("generation"), "*"), past)
    tables.write_codebook_json(four.select("id", F.col("lpc").alias("vec")), plain)
    rows = interchange.read_centroid_generations_json(spark, past)
    for path in (book, plain):
        rows = rows.unionByName(interchange.read_centroids_json(spark, path).withColumn("generation", F.lit(-1)))
    return rows.select("generation", "id", "shape", r6(_sum("vec")).alias("vec"), r6(_sum("lpc")).alias("lpc"))


def io6_models_json(spark: SparkSession, sf: str) -> DataFrame:
    """As io6_models, as one JSON document for each word."""
    path = tables.shared_path(spark, "models-json")
    interchange.write_models_json(_start(fx.sequences(spark, sf)), path)
    parts = [hmm.long_form(interchange.read_models_json(spark, path, word)).select(F.lit(read).alias("read"), "*") for read, word in (("one", "w0"), ("all", None))]
    return parts[0].union(parts[1]).select("read", "word", "kind", "i", "j", r6("p").alias("p"))


# Streams


def _recogniser(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips, codebook of four centroids, models trained on the clips' symbols)."""
    own = fx.signals(spark, sf).select("word", "recording", "samples")
    heard = signal.preprocess(signal.drop_leading(own, 5), "live", FRAME, HOP, WINDOW, WINDOW_HOP)
    frames = features.mfcc(framing.split_frames(heard, FRAME, HOP), fx.RATE)
    book = _four(frames)
    return own, book, hmm.train_hmms(vq.quantize(frames, vq.codebook_array(book)), 4, max_iter=2)[0]


def st1_stream_recognize(spark: SparkSession, sf: str) -> DataFrame:
    clips, out = tables.shared_path(spark, "clips"), tables.shared_path(spark, "recognised")
    own, book, models = _recogniser(spark, sf)
    own.repartition(4, "recording").write.parquet(clips)
    stream = spark.readStream.schema("word string, recording string, samples array<double>").option("maxFilesPerTrigger", 1).parquet(clips)
    streaming.stream_recognize(stream, book, models, out, tables.shared_path(spark, "progress"), fx.RATE, 5).awaitTermination()
    return spark.read.parquet(out).select("word", "recording", "model_word", "rank", r6("loglik").alias("loglik"))


def st1_stream_wav(spark: SparkSession, sf: str) -> DataFrame:
    """Clips that arrive as wav files, of which some are empty: ranks of the heard ones, and the problems of the others."""
    root, out, problems = (tables.shared_path(spark, x).removeprefix("file://").removeprefix("file:") for x in ("arriving", "recognised", "problems"))
    own, book, models = _recogniser(spark, sf)
    silent = F.pmod(F.xxhash64("recording"), F.lit(7)) == 0
    samples = F.when(silent, F.array().cast("array<double>")).otherwise(F.transform("samples", lambda x: x * 100))
    audio.write_wav_corpus(own.withColumn("samples", samples), root, fx.RATE)
    streaming.stream_recognize_wav(spark, root, book, models, out, problems, tables.shared_path(spark, "progress"), fx.RATE, 5, files=100).awaitTermination()
    heard = spark.read.parquet(out).select("word", "recording", "model_word", "rank", r6("loglik").alias("loglik"), F.lit("").alias("problem"))
    return heard.union(spark.read.parquet(problems).select("word", "recording", F.lit(""), F.lit(0), F.lit(0.0), "problem"))


def st2_assemble_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks of one sample, arriving in four parts by time; clips of 16 samples."""
    clips = streaming.assemble_clips(_chunks(spark, sf), 16, idle="3650 days", late="3650 days")
    return _run(spark, clips).select("recorder", "clip", F.size("samples").alias("n"), r6(_sum("samples")).alias("total"))


def st2_clips_by_start(spark: SparkSession, sf: str) -> DataFrame:
    """As st2_assemble_clips; a clip is told by its first sample."""
    clips = clipping.assemble_clips_by_start(_chunks(spark, sf), 16, idle="3650 days", late="3650 days")
    return _run(spark, clips).select("recorder", "us", "seq", "first", F.size("samples").alias("n"), r6(_sum("samples")).alias("total"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.shared_path(spark, "chunks")
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("recorder"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.array("value").alias("samples"))
    cuts = rows.select(F.unix_micros("ts").alias("u")).approxQuantile("u", [0.25, 0.5, 0.75], 0.01)
    part = sum((F.unix_micros("ts") > F.lit(int(c))).cast("int") for c in cuts)
    for k in range(4):
        rows.where(part == k).repartition(4, "recorder").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = tables.shared_path(spark, "assembled")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", tables.shared_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if callable(f) and name[:2] in ("io", "sg", "sp", "fr", "ft", "vq", "qa", "hm", "sc", "st") and name[2:3].isdigit()
}
