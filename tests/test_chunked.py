"""Operators whose input has no bound on one key: long recordings, long sequences, many models, streams without end."""

from __future__ import annotations

import json
import wave
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxplan.functions import kernels, logmath
from voxplan.operators import chunked, hmm, quality, scoring, signal
from voxplan.operators import codebook as vq
from voxplan.sources import audio, interchange
from voxplan.streaming.clips import assemble_clips_by_start
from voxplan.streaming.recognise import recognise, stream_recognize_wav

LONG = "word string, recording string, idx long, x double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def long_rows(spark, **recordings):
    return spark.createDataFrame([("w", name, i, float(v)) for name, x in recordings.items() for i, v in enumerate(x)], LONG)


def arrays(df):
    out = {}
    for r in df.orderBy("recording", "idx").collect():
        out.setdefault(r["recording"], []).append((r["idx"], r["x"]))
    for x in out.values():
        assert [i for i, _ in x] == list(range(len(x)))
    return {k: np.array([v for _, v in x]) for k, x in out.items()}


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_chunks_of_any_size_give_what_arrays_give(spark, chunk):
    rng = np.random.default_rng(3)
    sizes = {"r0": 1, "r1": 2, "r2": 9, "r3": 16, "r4": 17, "r5": 200, "r6": 333}
    own = {k: rng.normal(size=n) * np.where(np.arange(n) % 90 < 40, 0.01, 5) for k, n in sizes.items()} | {"silent": np.zeros(80)}
    whole = spark.createDataFrame([("w", k, 16000, x.tolist()) for k, x in own.items()], "word string, recording string, framerate int, samples array<double>")
    there = long_rows(spark, **own)
    for mode in ("batch", "live"):
        want = {r["recording"]: np.array(r["samples"]) for r in signal.preprocess(whole, mode, 16, 8, 16, 6).collect() if len(r["samples"])}
        got = arrays(chunked.preprocess(there, mode, 16, 8, 16, 6, chunk))
        assert got.keys() == want.keys()
        for k, x in want.items():
            np.testing.assert_allclose(got[k], x, atol=1e-9)


def test_a_long_recording_is_many_tasks_and_no_nested_loop(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("w").alias("word"), F.lit("r").alias("recording"), F.col("id").alias("idx"), F.sin(F.col("id") * 0.05).alias("x"))
    stats = chunked.short_time_stats(chunked.preemphasis(rows, chunk=1 << 14), 320, 160, 1 << 14)
    assert "NestedLoop" not in plan(stats) and "Cartesian" not in plan(stats)
    told = stats.agg(F.count("*").alias("n"), F.max("frames").alias("k"), F.sum("power").alias("p")).first()
    assert told["n"] == told["k"] == (n - 320) // 160 + 1
    parts = chunked.with_neighbours(rows, chunk=1 << 14).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < n / 2  # all tasks of the session have a part of it
    assert chunked.lengths(rows.limit(0)).count() == 0 and chunked.preprocess(rows.limit(0)).count() == 0


def test_log_sums_are_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 1000.0), (1, -1000.0), (1, 1000.0), (2, float("-inf")), (3, None), (None, -5.0), (4, -1e6), (4, -1e6)], "k int, v double")
    out = logmath.log_sum_exp_by(rows.repartition(5), ["k"], "v")
    got = {r["k"]: r["lse"] for r in out.collect()}
    assert got == {1: pytest.approx(1000 + np.log(2)), 2: float("-inf"), None: -5.0, 4: pytest.approx(-1e6 + np.log(2))}
    assert plan(logmath.log_sum_exp_by(spark.range(9).selectExpr("id % 2 as k", "double(id) as v"), ["k"], "v")).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("block", [None, 1, 3, 50, 1000])
def test_posteriors_are_the_same_at_any_block(block):
    rng = np.random.default_rng(5)
    with np.errstate(divide="ignore"):
        a, b, pi = (np.log(x) for x in (rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3) * (np.arange(5) != 4), rng.dirichlet(np.ones(3))))
    obs = rng.integers(0, 4, (4, 50))
    obs[2, 20] = 4  # impossible
    al, be = kernels.forward(obs, a[None], b[None], pi[None])[0], kernels.backward(obs, a[None], b[None])[0]
    p, blocks = kernels.posteriors(obs, a, b, pi, block)
    whole = kernels._lse(al[:, -1], 1)
    np.testing.assert_allclose(p, whole)
    np.testing.assert_allclose(kernels.forward_last(obs, a[None], b[None], pi[None])[0], whole)
    gamma, xi = np.full((4, 50, 3), np.nan), np.full((4, 49, 3, 3), np.nan)
    for first, g, x in blocks:
        gamma[:, first : first + g.shape[1]], xi[:, first : first + x.shape[1]] = g, x
    assert np.isneginf(gamma[2]).all() and np.isneginf(xi[2]).all()
    fine = [0, 1, 3]
    np.testing.assert_allclose(gamma[fine], (al + be)[fine] - whole[fine, None, None], atol=1e-9)
    np.testing.assert_allclose(np.exp(xi[fine]).sum(axis=3), np.exp(gamma[fine, :-1]), atol=1e-9)


def test_a_long_sequence_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    with np.errstate(divide="ignore"):
        a, pi = np.log(np.array(hmm.A)), np.log(np.array(hmm.PI))
    b, obs = np.log(rng.dirichlet(np.ones(16), 4)), rng.integers(0, 16, (1, 40_000))
    tracemalloc.start()
    total = sum(np.exp(g).sum() for _, g, _ in kernels.posteriors(obs, a, b, pi)[1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == pytest.approx(40_000, rel=1e-6) and most < 2 << 20  # all of xi would be 5 MB


def test_many_models_by_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(f"m{i:04}", 4, 6, rng.dirichlet(np.ones(4), 4).tolist(), rng.dirichlet(np.ones(6), 4).tolist(), rng.dirichlet(np.ones(4)).tolist()) for i in range(600)]
    rows += [("twin", *rows[5][1:]), ("small", 2, 6, [[0.5, 0.5], [0.0, 1.0]], [[1 / 6] * 6] * 2, [1.0, 0.0])]
    models = spark.createDataFrame(rows, "word string, states int, symbols int, A array<array<double>>, B array<array<double>>, Pi array<double>")
    seqs = spark.createDataFrame([(f"m{i:04}", f"r{k}", rng.integers(0, 6, n).tolist()) for i in range(4) for k, n in enumerate((1, 5, 5, 30))] + [("m0000", "empty", [])], "word string, recording string, obs array<int>")
    for block, symbols in ((50, 40), (10_000, 1 << 22)):
        got = scoring.predict(hmm.forward_loglik_blocks(seqs, models, False, block, symbols)).collect()
        assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == sorted((r[0], r[1], r[2], round(r[3], 9)) for r in scoring.predict_blocks(seqs, models, block).collect())
        assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got) == sorted((r[0], r[1], r[2], round(r[3], 9)) for r in scoring.predict_sequences(seqs, models).collect())
    assert len(got) == 16
    assert scoring.predict_blocks(seqs.limit(0), models).count() == 0 and scoring.predict_blocks(seqs, models.limit(0)).count() == 0


def test_shortlisted_centroids_are_the_nearest():
    rng, full, all_ = np.random.default_rng(0), 0, 0
    for s in range(40):
        x = rng.normal(size=(300, 13)) * 10.0 ** rng.integers(-6, 6)
        c = x[rng.integers(0, 300, 64)] * (1 if s % 3 else 1 + 1e-12)
        c = np.repeat(c[:8], 8, axis=0) if s % 4 == 0 else c
        if s % 5 == 0:
            x[3], x[4, 2] = np.nan, np.inf
        d = vq.distances(x, c, "euclidean", True)
        d = np.where(np.isnan(d), np.inf, d)
        near, far, compared = vq.nearest(x, c, "euclidean", True)
        assert (near == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        full, all_ = full + compared * (s % 4 != 0), all_ + d.size * (s % 4 != 0)
    assert full < 0.05 * all_


def test_compared_distances_are_logged(spark):
    rng = np.random.default_rng(2)
    frames = spark.createDataFrame([("w", "r", i, rng.normal(size=13).tolist()) for i in range(400)], "word string, recording string, frame_number int, mfcc array<double>")
    log = vq.train_codebook(frames, k=16, max_iter=3)["log"].where("generation = 4").collect()
    assert all(400 <= r["compared"] < 400 * 16 / 4 for r in log)


def test_documents_as_others_write_them(spark, tmp_path):
    models, frames, books = (tmp_path / x for x in ("models", "frames", "books"))
    models.mkdir(), books.mkdir()
    for word, states in (("stop", 2), ("go left", 2)):
        (models / f"{word}.json").write_text(json.dumps({"states": states, "symbols": 3, "A": [[0.5, 0.5], [0.0, 1.0]], "B": [[0.2, 0.3, 0.5]] * 2, "Pi": [1.0, 0.0], "word": word}, indent=2))
    (models / "wrong.json").write_text(json.dumps({"states": 3, "symbols": 3, "A": [[1.0]], "B": [[0.2, 0.3, 0.5]], "Pi": [1.0], "word": "wrong"}))
    (models / "broken.json").write_text('{"states": 2, "sym')
    assert {r["word"]: (r["states"], r["A"][0]) for r in interchange.read_models_json(spark, str(models)).collect()} == {"stop": (2, [0.5, 0.5]), "go left": (2, [0.5, 0.5])}
    assert [r["word"] for r in interchange.read_models_json(spark, str(models), "go left").collect()] == ["go left"]
    assert {r["path"].rsplit("/", 1)[1]: r["problem"] for r in interchange.model_problems(spark, str(models)).collect()} == {"wrong.json": "sizes that don't fit", "broken.json": "no model"}
    interchange.write_models_json(interchange.read_models_json(spark, str(models)), str(tmp_path / "again"))
    assert sorted(map(tuple, interchange.read_models_json(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, interchange.read_models_json(spark, str(models)).collect()))
    assert [r["word"] for r in interchange.read_models_json(spark, str(tmp_path / "again"), "go left").collect()] == ["go left"]

    lpc = {"raw_samples": [1, 2.5], "autocorrelation_vector": [7.25], "lpc_vector": [1.0, -0.5], "lsf_vector": [0.3], "parent_centroid_id": 4, "generation": 2, "frame_number": 0, "recording": "r1"}
    raw = {"raw_samples": [3.0], "autocorrelation_vector": [9.0], "frame_number": 1, "recording": "r2"}
    for name, records in (("r1", [lpc]), ("r2", [raw, {**raw, "frame_number": 2}]), ("r3", [])):
        (frames / "go" / name).mkdir(parents=True)
        (frames / "go" / name / "frames.json").write_text(json.dumps(records, indent=2))
    (frames / "go" / "r4").mkdir()
    (frames / "go" / "r4" / "frames.json").write_text("nothing")
    got = sorted((r["recording"], r["frame_number"], r["shape"], r["raw_samples"], r["autocorr"], r["lpc"], r["lsf"], r["mfcc"], r["generation"]) for r in interchange.read_frame_records(spark, str(frames)).collect())
    assert got == [("r1", 0, "lpc", [1.0, 2.5], [7.25], [1.0, -0.5], [0.3], None, 2), ("r2", 1, "raw", [3.0], [9.0], None, None, None, None), ("r2", 2, "raw", [3.0], [9.0], None, None, None, None)]
    assert {(r["shape"], r["lpc"] is None) for r in interchange.read_frame_records(spark, str(frames), "raw").collect()} == {("raw", True)}
    assert [r["path"].split("/")[-2] for r in interchange.frame_problems(spark, str(frames)).collect()] == ["r4"]
    with pytest.raises(ValueError):
        interchange.read_frame_records(spark, str(frames), "other")

    lsf = np.sort(np.random.default_rng(1).uniform(0.1, 3.0, 12))
    made = kernels.lsf_to_lpc(lsf[None])[0]
    (books / "own.json").write_text(json.dumps([{"lsf": lsf.tolist(), "lpc": [0.0] * 13, "id": 0}, {"lsf": lsf.tolist(), "lpc": [1.0, 0.5], "id": 1}, {"mfcc": [2.0], "id": 2}], indent=2))
    rows = {r["id"]: r for r in interchange.read_centroids_json(spark, str(books / "own.json")).collect()}
    np.testing.assert_allclose(rows[0]["lpc"], made)
    assert rows[1]["lpc"] == [1.0, 0.5] and (rows[2]["shape"], rows[2]["vec"], rows[2]["lpc"]) == ("mfcc", [2.0], None)


def test_wav_stream_recognises_and_reports(spark, tmp_path):
    rng = np.random.default_rng(9)
    tone = lambda w, n=6000: np.sin(2 * np.pi * (300 + 900 * w) * np.arange(n) / 16000) * 8000 + rng.normal(size=n) * 50
    for w in range(2):
        (tmp_path / "in" / f"w{w}").mkdir(parents=True)
        for i in range(3):
            with wave.open(str(tmp_path / "in" / f"w{w}" / f"r{i}.wav"), "wb") as f:
                f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
                f.writeframes(np.r_[np.zeros(900), tone(w), np.zeros(900)].astype("<i2").tobytes())
    (tmp_path / "in" / "w0" / "broken.wav").write_bytes(b"RIFF")
    with wave.open(str(tmp_path / "in" / "w1" / "short.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(np.ones(40, "<i2").tobytes())
    clips = audio.standardize_audio(audio.read_wav_channels(spark, str(tmp_path / "in")).where("problem is null"), 16000)
    ready = signal.preprocess(signal.drop_leading(clips, 500), "live")
    from voxplan.operators import features, framing

    frames = features.mfcc(framing.split_frames(ready)).persist()
    book = vq.train_codebook(frames, k=4, max_iter=3)["codebook"]
    models = hmm.train_hmms(vq.quantize(frames, book), 4, max_iter=2)[0]
    stream_recognize_wav(spark, str(tmp_path / "in"), book, models, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "at"), files=3).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("word", "recording", "model_word", "rank", F.round("loglik", 6)).collect()}
    assert got == {tuple(r) for r in recognise(clips, vq.codebook_array(book), models).select("word", "recording", "model_word", "rank", F.round("loglik", 6)).collect()}
    assert len(got) == 12 and all(g[0] == g[2] for g in got if g[3] == 1)
    bad = {(r["word"], r["recording"]): r["problem"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad[("w1", "short")] == "too short" and bad[("w0", "broken")].startswith("unreadable") and len(bad) == 2


def test_a_batch_of_wav_files_has_some_for_each_core(spark, tmp_path):
    cores, rng = spark.sparkContext.defaultParallelism, np.random.default_rng(9)
    (tmp_path / "in" / "w0").mkdir(parents=True)
    for i in range(2 * cores + 1):
        with wave.open(str(tmp_path / "in" / "w0" / f"r{i}.wav"), "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
            f.writeframes((rng.normal(size=4000 if i % 3 else 40) * 8000).clip(-32768, 32767).astype("<i2").tobytes())
    book = spark.createDataFrame([(k, [float(k)] * 13) for k in range(2)], "id int, vec array<double>")
    models = hmm.train_hmms(spark.createDataFrame([("w0", "r", [0, 1, 0, 1])], "word string, recording string, obs array<int>"), 2, 4, max_iter=1)[0]
    stream_recognize_wav(spark, str(tmp_path / "in"), book, models, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "at"), files=2).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    names = [[r["recording"] for r in spark.read.parquet(str(tmp_path / x)).select("recording").collect()] for x in ("out", "bad")]
    assert sorted(names[0] + names[1]) == sorted(f"r{i}" for i in range(2 * cores + 1)) and {int(x[1:]) % 3 for x in names[1]} == {0}


def test_clips_leave_no_state_behind(spark, tmp_path):
    """Recorder 1 leaves samples behind and stays idle; 2 has whole clips only; late chunks are dropped."""
    start, kind = datetime(2024, 1, 1), "recorder long, ts timestamp, seq long, samples array<double>"
    parts = [[(1, 0, [1.0] * 20), (1, 0, [])], [(2, 100, [2.0] * 16)], [(2, 200, [3.0] * 10), (2, 201, [4.0] * 22)], [(1, 202, [5.0] * 17), (1, 1, [9.0] * 99)], [(2, 400, [6.0] * 16)], [(2, 600, [7.0] * 16)]]
    query = None
    for k, part in enumerate(parts):
        spark.createDataFrame([(r, start + timedelta(minutes=m), k * 10 + i, x) for i, (r, m, x) in enumerate(part)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    chunks = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    clips = assemble_clips_by_start(chunks, 16, idle="10 minutes", late="10 minutes")
    query = clips.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    at = lambda m: int((start + timedelta(minutes=m) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    got = {(r["recorder"], r["us"], r["seq"], r["first"]): r["samples"] for r in rows}
    assert got == {
        (1, at(0), 0, 0): [1.0] * 16, (2, at(100), 10, 0): [2.0] * 16, (2, at(200), 20, 0): [3.0] * 10 + [4.0] * 6, (2, at(201), 21, 6): [4.0] * 16,
        (1, at(202), 30, 0): [5.0] * 16, (2, at(400), 40, 0): [6.0] * 16, (2, at(600), 50, 0): [7.0] * 16,
    }
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_sets_and_dense_counts(spark):
    frames = spark.createDataFrame([("a", "r", 3, 1), ("a", "r", 1, 1), ("a", "q", 3, 2), ("b", "r", None, 1)], "word string, recording string, parent_centroid_id int, generation int")
    rows = {(r["kind"], r["centroid"], r["generation"], r["word"], r["recording"]): (r["n"], r["centroids"], r["generations"]) for r in quality.assignment_sets(frames).collect()}
    assert rows == {
        ("all", None, None, None, None): (3, [1, 3], [1, 2]), ("centroid", 3, None, None, None): (2, [3], [1, 2]), ("centroid", 1, None, None, None): (1, [1], [1]),
        ("generation", None, 1, None, None): (2, [1, 3], [1]), ("generation", None, 2, None, None): (1, [3], [2]),
        ("recording", None, None, "a", "r"): (2, [1, 3], [1]), ("recording", None, None, "a", "q"): (1, [3], [2]),
    }
    told = spark.createDataFrame([("x", "x"), ("x", "z"), ("y", "x"), ("y", "y"), ("z", "x")], "word string, predicted string")
    dense = scoring.confusion_dense(told, ["y", "x", "w"]).orderBy("place").collect()
    assert [(r["true"], r["y"], r["x"], r["w"], r["unlisted"], r["hits"]) for r in dense] == [("y", 1, 1, 0, 0, 50.0), ("x", 0, 1, 0, 1, 50.0), ("w", 0, 0, 0, 0, None)]
