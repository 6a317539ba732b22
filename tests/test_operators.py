from __future__ import annotations

import itertools
import wave

import numpy as np
import pytest

from voxplan.functions import kernels
from voxplan.operators import codebook as vq
from voxplan.operators import features, framing, hmm, quality, scoring, signal, split
from voxplan.plans import queries
from voxplan.sources import audio, tables


def signals(spark, *samples):
    rows = [(f"w{i % 2}", f"r{i}", 16000, [float(v) for v in x]) for i, x in enumerate(samples)]
    return spark.createDataFrame(rows, "word string, recording string, framerate int, samples array<double>")


def arrays(df):
    return {r["recording"]: np.array(r["samples"]) for r in df.collect()}


def window_product(x, window=320, hop=128):
    x, n = np.array(x, float), len(x)
    k = int((n - window) / hop) + 1
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(window) / (window - 1))
    for i in range(k):
        part = x[i * hop : i * hop + window]
        part *= w[: len(part)]
    if k >= 0:
        part = x[k * hop : n - 1]
        part *= w[: len(part)]
    return x


def test_windows_at_the_edges(spark):
    sizes = [0, 1, 64, 65, 159, 192, 193, 319, 320, 321, 700]
    rng = np.random.default_rng(0)
    own = [rng.normal(size=n) for n in sizes]
    got = arrays(signal.hamming_cumulative(signals(spark, *own)))
    for i, x in enumerate(own):
        np.testing.assert_allclose(got[f"r{i}"], window_product(x), atol=1e-9)


def test_trimming_silence_one_loud_frame_and_short_signals(spark):
    loud = np.zeros(1600)
    loud[500:505] = 100
    got = arrays(signal.trim_silence(signals(spark, np.zeros(1600), loud, np.ones(100), np.ones(320)), 320, 160))
    assert len(got["r0"]) == 9 * 160
    assert len(got["r1"]) == 160
    assert len(got["r2"]) == 0
    assert len(got["r3"]) == 0


def test_modes_and_drop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3200) * np.r_[np.full(1600, 0.01), np.full(1600, 5)]
    df = signals(spark, x)
    assert 0 < len(arrays(signal.preprocess(df, "live"))["r0"]) < 3200
    with pytest.raises(ValueError):
        signal.preprocess(df, "other")
    np.testing.assert_allclose(arrays(signal.drop_leading(df))["r0"], x[500:])
    assert len(arrays(signal.drop_leading(df, 4000))["r0"]) == 0


@pytest.mark.parametrize("n", [0, 12, 13, 159, 160, 161, 319, 320, 321, 333, 480, 640])
def test_frame_counts(spark, n):
    rows = framing.split_frames(signals(spark, np.arange(n))).orderBy("frame_number").collect()
    full = (n - 320) // 160 + 1 if n >= 320 else 0
    sizes = [320] * full + ([n - full * 160] if n - full * 160 > 12 else [])
    assert [len(r["raw_samples"]) for r in rows] == sizes
    assert [r["frame_number"] for r in rows] == list(range(len(sizes)))


def test_bad_recordings_are_reported(spark):
    df = signals(spark, np.ones(400), np.ones(5))
    good, bad = framing.build_frames(df, split.assign_purposes(df))
    assert {r["recording"] for r in good.collect()} == {"r0"}
    assert [(r["recording"], r["reason"]) for r in bad.collect()] == [("r1", "too short")]
    good, bad = framing.build_frames(df, split.assign_purposes(df).where("recording <> 'r0'"), sample_rate=16000)
    assert good.count() == 0 and "mfcc" in good.columns
    assert {(r["recording"], r["reason"]) for r in bad.collect()} == {("r0", "no purpose"), ("r1", "too short")}


def test_all_channels_make_the_mean(spark):
    rows = [("w", "three", 16000, 3, 2, [[1.0, 2.0], [2.0, 4.0], [6.0, 0.0]]), ("w", "none", 16000, 0, 0, [])]
    df = spark.createDataFrame(rows, "word string, recording string, framerate int, nchannels int, nframes long, channels array<array<double>>")
    got = {r["recording"]: r["samples"] for r in audio.standardize_audio(df).collect()}
    assert got == {"three": [3.0, 2.0], "none": []}


def test_purposes_by_share(spark):
    rows = [("left", f"a{i:02}", []) for i in range(20)]
    df = spark.createDataFrame(rows, "word string, recording string, samples array<double>")
    got = split.assign_purposes(df).groupBy("purpose").count().collect()
    assert {r["purpose"]: r["count"] for r in got} == {"train": 6, "hmm": 10, "test": 4}


def plain_mfcc(x, rate=16000, n_mfcc=13, n_mels=26):
    n = len(x)
    y = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
    power = np.array([abs(np.sum(y * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2 for k in range(n // 2 + 1)])
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * np.log(f / 1000) / np.log(6.4)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    e = [hz(mel(rate / 2) * i / (n_mels + 1)) for i in range(n_mels + 2)]
    out = []
    for m in range(n_mels):
        total = 0
        for k, p in enumerate(power):
            f = k * rate / n
            total += p * max(0, min((f - e[m]) / (e[m + 1] - e[m]), (e[m + 2] - f) / (e[m + 2] - e[m + 1]))) * 2 / (e[m + 2] - e[m])
        out.append(10 * np.log10(max(total, 1e-10)))
    out = np.maximum(out, max(out) - 80)
    return [np.sum(out * np.cos(np.pi * q * (np.arange(n_mels) + 0.5) / n_mels)) * np.sqrt((1 if q == 0 else 2) / n_mels) for q in range(n_mfcc)]


@pytest.mark.parametrize("n", [160, 320])
def test_mfcc(n):
    x = np.random.default_rng(n).normal(size=(3, n)) * 1000
    np.testing.assert_allclose(kernels.mfcc(x), [plain_mfcc(r) for r in x], atol=1e-4)
    silent = kernels.mfcc(np.zeros((1, n)))[0]
    assert silent[0] < 0 and np.allclose(silent[1:], 0, atol=1e-9)


def test_features_of_mixed_lengths(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=n)]) for i, n in enumerate([320, 160, 0, 5, 320])]
    df = spark.createDataFrame(rows, "i int, raw_samples array<double>")
    got = {r["i"]: r for r in features.lpc(features.autocorrelation(features.mfcc(df))).collect()}
    assert got[2]["mfcc"] == [0.0] * 13 and got[2]["autocorr"] == [0.0] * 13
    assert got[3]["autocorr"][5:] == [0.0] * 8 and got[3]["lpc"][5:] == [0.0] * 8 and got[3]["lpc"][0] == 1
    x = np.array(rows[0][1])
    np.testing.assert_allclose(got[0]["autocorr"], [np.sum(x[: 320 - k] * x[k:]) for k in range(13)], rtol=1e-9)


def test_burg_finds_a_resonance_and_frequencies_go_back_and_forth():
    rng = np.random.default_rng(3)
    x = np.zeros(4000)
    for t in range(2, 4000):
        x[t] = 1.6 * x[t - 1] - 0.8 * x[t - 2] + rng.normal()
    a = kernels.lpc(x[None], 12)
    np.testing.assert_allclose(a[0, :3], [1, -1.6, 0.8], atol=0.1)
    assert kernels.lpc(np.zeros((1, 50)))[0].tolist() == [1.0] + [0.0] * 12
    f = kernels.lpc_to_lsf(a)
    assert (np.diff(f[0]) > 0).all() and f[0, 0] > 0 and f[0, -1] < np.pi
    np.testing.assert_allclose(kernels.lsf_to_lpc(f), a, atol=1e-6)


def test_resampling_keeps_tones():
    for rate in (8000, 44100):
        t = np.arange(rate) / rate
        y = kernels.resample(np.sin(2 * np.pi * 440 * t), rate, 16000)
        want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
        assert len(y) == 16000 and np.abs(y - want)[200:-200].max() < 0.02


def frames_of(spark, vectors):
    rows = [("w", "r", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "word string, recording string, frame_number int, mfcc array<double>")


def test_ties_and_empty_clusters(spark):
    df = frames_of(spark, [[9, 0, 0], [9, 1, 0], [9, 2, 0], [9, float("nan"), 0]])
    book = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [5.0, 2.0, 0.0]), (2, [0.0, 99.0, 0.0])], "id int, vec array<double>")
    got = vq.assign_nearest(df, book)
    assert [r["parent_centroid_id"] for r in got.orderBy("frame_number").collect()] == [0, 0, 1, 0]
    new = {r["id"]: r["vec"] for r in vq.update_codebook(got.where("frame_number < 3"), 3, width=3).collect()}
    assert new == {0: [9.0, 0.5, 0.0], 1: [9.0, 2.0, 0.0], 2: [0.0, 0.0, 0.0]}


def test_codebook_sizes_and_falling_distance(spark):
    rng = np.random.default_rng(5)
    df = frames_of(spark, rng.normal(size=(200, 13)) + rng.integers(0, 4, 200)[:, None] * 5)
    out = vq.train_codebook(df.repartition(3), k=5, max_iter=20)
    assert out["codebook"].count() == 4 and out["generations"].count() == 7
    log = out["log"].orderBy("generation", "iteration").collect()
    for a, b in zip(log, log[1:]):
        assert a["generation"] != b["generation"] or b["distance"] <= a["distance"] * (1 + 1e-6)
    assert vq.train_codebook(df, k=1)["codebook"].count() == 1
    seq = vq.quantize(df, out["codebook"]).collect()
    assert len(seq) == 1 and len(seq[0]["obs"]) == 200


def test_histogram_of_equal_values_and_global_index(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    got = quality.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 0, 5, 0] and got[0]["lo"] == 1.5
    rows = quality.with_global_index(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r["i"] == r["id"] for r in rows)


def likelihood(obs, a, b, pi):
    total = 0.0
    for path in itertools.product(range(4), repeat=len(obs)):
        p = pi[path[0]] * b[path[0]][obs[0]]
        for t in range(1, len(obs)):
            p *= a[path[t - 1]][path[t]] * b[path[t]][obs[t]]
        total += p
    return total


def sequences(spark, rows):
    return spark.createDataFrame(rows, "word string, recording string, obs array<int>")


def test_forward_is_the_sum_over_paths(spark):
    seqs = sequences(spark, [("a", "1", [0]), ("a", "2", [0, 1, 2, 1, 0]), ("b", "1", [2, 2, 1])])
    models = hmm.train_hmms(seqs, 3, max_iter=1)[0]
    got = {(r["word"], r["recording"], r["model_word"]): r["loglik"] for r in hmm.forward_loglik(seqs, models).collect()}
    for m in models.collect():
        for s in seqs.collect():
            want = likelihood(s["obs"], m["A"], m["B"], m["Pi"])
            assert np.exp(got[s["word"], s["recording"], m["word"]]) == pytest.approx(want, rel=1e-9)


def test_shares_of_time_sum_to_one_and_training_gains(spark):
    rng = np.random.default_rng(2)
    rows = [(w, str(i), [int(x) for x in np.clip(np.arange(30) // 8 + rng.integers(0, 2, 30), 0, 4)]) for w in "ab" for i in range(6)]
    seqs = sequences(spark, rows).repartition(3)
    start = hmm.initial_model(seqs, 5)
    gamma = hmm.forward_backward(seqs, start).where("kind = 'gamma'").collect()
    total = {}
    for r in gamma:
        total[r["recording"], r["word"], r["t"]] = total.get((r["recording"], r["word"], r["t"]), 0) + np.exp(r["v"])
    assert np.allclose(list(total.values()), 1)
    models, log = hmm.train_hmms(seqs, 5, max_iter=8)
    for word in "ab":
        gains = [r["total"] for r in log.where(f"word = '{word}'").orderBy("iteration").collect()]
        assert all(b >= a - 1e-6 for a, b in zip(gains, gains[1:]))
    for m in models.collect():
        for c in ("A", "B"):
            sums = np.array(m[c]).sum(axis=1)
            assert ((abs(sums - 1) < 1e-9) | (sums == 0)).all()


def test_unknown_and_ties(spark):
    scores = spark.createDataFrame([("a", "1", "x", float("-inf")), ("a", "1", "y", float("-inf")), ("a", "2", "y", -3.0), ("a", "2", "x", -3.0)], "word string, recording string, model_word string, loglik double")
    assert {r["recording"]: r["predicted"] for r in scoring.predict(scores).collect()} == {"1": "unknown", "2": "x"}


#: Published margins: (true positives, predicted) of 4 recordings each.
MARGINS = {"backward": (4, 4), "begin": (2, 2), "down": (4, 4), "finish": (4, 4), "forward": (4, 5), "left": (2, 2), "right": (3, 4), "rotate": (4, 7), "stop": (4, 5), "up": (3, 3)}


def test_published_report(spark):
    wrong = [w for w, (hit, _) in MARGINS.items() for _ in range(4 - hit)]
    extra = [w for w, (hit, said) in MARGINS.items() for _ in range(said - hit)]
    pairs = [(w, w) for w, (hit, _) in MARGINS.items() for _ in range(hit)]
    extra.sort(key=lambda w: (w == "right", w))
    pairs += list(zip(wrong, reversed(extra)))
    df = spark.createDataFrame(pairs, "word string, predicted string")
    got = {r["label"]: r for r in scoring.classification_report(df).collect()}
    assert round(got["accuracy"]["precision"], 4) == 0.85
    assert [round(got["macro avg"][c], 2) for c in ("precision", "recall", "f1")] == [0.89, 0.85, 0.84]
    assert [round(got["rotate"][c], 2) for c in ("precision", "recall", "f1")] == [0.57, 1.0, 0.73]
    assert got["accuracy"]["support"] == 40


def write(path, rate, channels, data, width=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)


def test_odd_wavs(spark, tmp_path):
    tone = (np.sin(np.arange(8000) * 0.1) * 9000).astype("<i2")
    write(tmp_path / "up" / "a.wav", 16000, 1, tone.tobytes())
    write(tmp_path / "down" / "a.wav", 8000, 2, np.stack([tone, -tone], axis=1).tobytes())
    write(tmp_path / "up" / "none.wav", 16000, 1, b"")
    write(tmp_path / "up" / "wide.wav", 16000, 1, b"\0" * 30, width=3)
    (tmp_path / "up" / "junk.wav").write_bytes(b"not a wav")
    got = {(r["word"], r["recording"]): r for r in audio.read_wav_corpus(spark, str(tmp_path)).collect()}
    assert got["up", "a"]["samples"] == tone.astype(float).tolist() and got["up", "a"]["problem"] is None
    assert got["up", "none"]["problem"] == "empty" and got["up", "wide"]["problem"] == "sample width 3" and got["up", "junk"]["problem"].startswith("unreadable")
    made = {(r["word"], r["recording"]): r for r in audio.standardize_audio(audio.read_wav_channels(spark, str(tmp_path)).where("problem is null")).collect()}
    assert made["down", "a"]["reasons"] == "stereo,framerate" and made["down", "a"]["nframes"] == 16000 and max(map(abs, made["down", "a"]["samples"])) == 0
    assert made["up", "a"]["reasons"] == ""


def test_json_frames_round_trip(spark, tmp_path):
    rows = [("left", "s1", i, [1.0 * i], 16000, 1, 20.0, [0.5] * 13, i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "word string, recording string, frame_number int, raw_samples array<double>, sample_rate int, n_channels int, frame_duration_ms double, mfcc array<double>, parent_centroid_id int, generation int")
    tables.write_frames_json(df, str(tmp_path / "json"))
    back = tables.read_frames_json(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    folder = tmp_path / "plain" / "left" / "s1"
    folder.mkdir(parents=True)
    (folder / "hmm_frames.json").write_text('[{"raw_samples":[1.5],"sample_rate":16000,"mfcc_vector":[0.25],"frame_number":0,"recording":"s1"}]')
    got = tables.read_frames_json(spark, str(tmp_path / "plain")).collect()
    assert len(got) == 1 and got[0]["word"] == "left" and got[0]["recording"] == "s1" and got[0]["mfcc"] == [0.25]


def test_json_codebooks_round_trip(spark, tmp_path):
    book = spark.createDataFrame([(1, [0.5, 2.0]), (0, [1.0, -1.0])], "id int, vec array<double>")
    tables.write_codebook_json(book, str(tmp_path / "book"))
    assert [tuple(r) for r in tables.read_codebook_json(spark, str(tmp_path / "book")).collect()] == [(0, [1.0, -1.0]), (1, [0.5, 2.0])]
    past = spark.createDataFrame([(1, 1, [3.0]), (1, 0, [2.0]), (0, 0, [1.0])], "generation int, id int, vec array<double>")
    tables.write_generations_json(past, str(tmp_path / "past"))
    assert sorted(map(tuple, tables.read_generations_json(spark, str(tmp_path / "past")).collect())) == sorted(map(tuple, past.collect()))
    (tmp_path / "own.json").write_text('[\n  {"mfcc": [1.5],\n "id": 4}\n]')
    assert [tuple(r) for r in tables.read_codebook_json(spark, str(tmp_path / "own.json")).collect()] == [(4, [1.5])]


def test_clips_keep_their_numbers_over_silence(spark, tmp_path):
    """Recorder 1 stays idle until its gathered samples are let go; a chunk behind the watermark is dropped."""
    from datetime import datetime, timedelta

    from voxplan.streaming.recognise import assemble_clips

    start, schema = datetime(2024, 1, 1), "recorder long, ts timestamp, seq long, samples array<double>"
    parts = [[(1, 0, [1.0] * 20)], [(2, 100, [2.0] * 3)], [(2, 200, [2.0] * 3)], [(1, 201, [5.0] * 20), (1, 1, [9.0] * 99)], [(2, 202, [2.0])]]
    for k, part in enumerate(parts):
        rows = [(r, start + timedelta(minutes=m), k, x) for r, m, x in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    clips = assemble_clips(chunks, 16, idle="10 minutes", late="10 minutes")
    clips.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["recorder"], r["clip"]): r["samples"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): [1.0] * 16, (1, 1): [5.0] * 16}


def test_words_as_tones_are_recognised(spark):
    """From signals to a report: ten words are ten tones."""
    rng = np.random.default_rng(8)
    rows = []
    for w in range(10):
        for i in range(10):
            t = np.arange(4000) / 16000
            x = np.sin(2 * np.pi * (300 + 350 * w) * t) * 8000 + rng.normal(size=4000) * 50
            rows.append((f"w{w}", f"r{i}", np.r_[np.zeros(800), x, np.zeros(800)].tolist()))
    own = signal.preprocess(spark.createDataFrame(rows, "word string, recording string, samples array<double>").repartition(4))
    frames = features.mfcc(framing.build_frames(own, split.assign_purposes(own))[0]).select("word", "recording", "purpose", "frame_number", "mfcc").persist()
    book = vq.train_codebook(frames.where("purpose = 'train'"), k=16, max_iter=5)["codebook"].persist()
    models = hmm.train_hmms(vq.quantize(frames.where("purpose = 'hmm'"), book), 16, max_iter=2)[0]
    told = scoring.predict(scoring.score_all(vq.quantize(frames.where("purpose = 'test'"), book), models))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, scoring.predict_sequences(vq.quantize(frames.where("purpose = 'test'"), book), models).collect()))
    report = {r["label"]: r for r in scoring.classification_report(told).collect()}
    assert report["accuracy"]["support"] == 20 and report["accuracy"]["f1"] >= 0.9


def test_stream_gives_what_a_batch_gives(spark, sf_dir):
    from pyspark.sql import functions as F

    from voxplan.plans import fixtures as fx
    from voxplan.streaming.recognise import recognise

    got = {tuple(r) for r in queries.st1_stream_recognize(spark, sf_dir).collect()}
    own, book, models = queries._recogniser(spark, sf_dir)
    batch = recognise(own, vq.codebook_array(book), models, fx.RATE, 5).select("word", "recording", "model_word", "rank", (F.round("loglik", 6) + 0.0).alias("loglik"))
    assert len({r[4] for r in got if r[1] == min(x[1] for x in got)}) > 1
    assert got == {tuple(r) for r in batch.collect()}
