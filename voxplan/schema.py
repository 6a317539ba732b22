"""Schemas of the library's tables."""

from __future__ import annotations

RECORDINGS = "word string, recording string, path string, framerate int, nchannels int, nframes long, samples array<double>, problem string"
FRAMES = "word string, recording string, frame_number int, purpose string, raw_samples array<double>, sample_rate int, n_channels int, frame_duration_ms double, mfcc array<double>, parent_centroid_id int, generation int"
FRAME_JSON = "raw_samples array<double>, sample_rate int, n_channels int, frame_duration_ms double, mfcc_vector array<double>, parent_centroid_id int, generation int, frame_number int, recording string"
CODEBOOK = "id int, vec array<double>"
GENERATIONS = "generation int, id int, vec array<double>"
MODELS = "word string, states int, symbols int, A array<array<double>>, B array<array<double>>, Pi array<double>"
KEY = ["word", "recording"]
