"""Numeric kernels on arrays of frames or sequences of equal length; one row each."""

from __future__ import annotations

import functools

import math
from collections.abc import Iterator

import numpy as np


@functools.lru_cache(maxsize=64)
def _mel_tables(n: int, rate: int, n_mels: int, n_mfcc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, mel weights by bin, cosine transform) for frames of n samples."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    linear, step = 200 / 3, np.log(6.4) / 27  # mel scale: linear to 1000 Hz, then logarithmic
    to_mel = lambda f: np.where(f < 1000, f / linear, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * linear, 1000 * np.exp(step * (m - 15)))
    edges = to_hz(np.linspace(0, to_mel(np.float64(rate / 2)), n_mels + 2))
    bins = np.arange(n // 2 + 1) * rate / n
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    weights = (np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]).astype(np.float32)
    k, m = np.arange(n_mfcc)[:, None], np.arange(n_mels)
    cosine = np.cos(np.pi * k * (m + 0.5) / n_mels) * np.sqrt(2 / n_mels)
    cosine[0] /= np.sqrt(2)
    return window, weights.astype(float), cosine


def mfcc(frames: np.ndarray, rate: int = 16000, n_mfcc: int = 13, n_mels: int = 26) -> np.ndarray:
    window, weights, cosine = _mel_tables(frames.shape[1], rate, n_mels, n_mfcc)
    power = np.abs(np.fft.rfft(frames * window)) ** 2
    decibel = 10 * np.log10(np.maximum(1e-10, power @ weights.T))
    decibel = np.maximum(decibel, decibel.max(axis=1, keepdims=True) - 80)
    out = decibel @ cosine.T
    return np.where(np.isfinite(out).all(axis=1, keepdims=True), out, 0.0)


def lpc(frames: np.ndarray, order: int = 12) -> np.ndarray:
    """Burg's recursion on all frames at once."""
    rows, n = frames.shape
    use = min(order, n - 1)
    out = np.zeros((rows, order + 1))
    out[:, 0] = 1
    if use < 1:
        return out
    forward, backward = frames[:, 1:].copy(), frames[:, :-1].copy()
    a = np.zeros((rows, use + 1))
    a[:, 0] = 1
    with np.errstate(all="ignore"):
        for k in range(use):
            bottom = (forward**2 + backward**2).sum(axis=1)
            reflect = np.where(bottom > 0, -2 * (forward * backward).sum(axis=1) / bottom, np.nan)
            previous = a[:, : k + 2].copy()
            a[:, : k + 2] = previous + reflect[:, None] * previous[:, ::-1]
            forward, backward = (forward + reflect[:, None] * backward)[:, 1:], (backward + reflect[:, None] * forward)[:, :-1]
    good = np.isfinite(a).all(axis=1)
    out[good, : use + 1] = a[good]
    return out


def _root_angles(polynomials: np.ndarray) -> np.ndarray:
    """Angles of the roots of polynomials (highest power first, its coefficient not 0), from stacked companion matrices."""
    n = polynomials.shape[1] - 1
    companion = np.zeros((len(polynomials), n, n))
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1
    companion[:, 0] = -polynomials[:, 1:] / polynomials[:, :1]
    return np.angle(np.linalg.eigvals(companion))


def lpc_to_lsf(a: np.ndarray, order: int = 12) -> np.ndarray:
    """Rows without a leading coefficient or with values that aren't finite have no frequencies: zeros."""
    out = np.zeros((len(a), order))
    good = np.flatnonzero(np.isfinite(a).all(axis=1) & (a[:, 0] != 0))
    if not len(good):
        return out
    longer = np.pad(a[good], ((0, 0), (0, 1)))
    angles = np.concatenate([_root_angles(longer + sign * longer[:, ::-1]) for sign in (1, -1)], axis=1)
    angles = np.sort(np.where((angles > 1e-9) & (angles < np.pi - 1e-9), angles, np.inf), axis=1)[:, :order]
    out[good, : angles.shape[1]] = np.where(np.isfinite(angles), angles, 0)
    return out


def _times(polynomials: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Products of polynomials and factors of three coefficients, row by row."""
    out = np.pad(polynomials, ((0, 0), (0, 2)))
    for k in (1, 2):
        out[:, k : k + polynomials.shape[1]] += polynomials * factors[:, k : k + 1]
    return out


def lsf_to_lpc(frequencies: np.ndarray) -> np.ndarray:
    rows, order = frequencies.shape
    both = [np.ones((rows, 1)), np.ones((rows, 1))]
    for k in range(order):
        both[k % 2] = _times(both[k % 2], np.column_stack([np.ones(rows), -2 * np.cos(frequencies[:, k]), np.ones(rows)]))
    total, difference = both
    if order % 2 == 0:
        total, difference = (np.pad(x, ((0, 0), (0, 1))) + sign * np.pad(x, ((0, 0), (1, 0))) for x, sign in ((total, 1), (difference, -1)))
    else:
        difference = np.pad(difference, ((0, 0), (0, 2))) - np.pad(difference, ((0, 0), (2, 0)))
    return ((total + difference) / 2)[:, : order + 1]


def resample(x: np.ndarray, rate: int, target: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; ceil(n target / rate) samples."""
    if rate == target or not len(x):
        return x
    n, cut = -(-len(x) * target // rate), min(1.0, target / rate)
    reach = int(np.ceil(half / cut))
    out = np.zeros(n)
    for first in range(0, n, 65536):
        at = np.arange(first, min(n, first + 65536)) * (rate / target)
        near = np.floor(at).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
        d = at[:, None] - near
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) <= reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
        values = np.where((near >= 0) & (near < len(x)), x[np.clip(near, 0, len(x) - 1)], 0)
        out[first : first + len(at)] = (values * w).sum(axis=1)
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=axis)) + np.squeeze(safe, axis)


def forward(obs: np.ndarray, a: np.ndarray, b: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """log alpha[model, sequence, time, state] for sequences of one length under stacked log models a[model,i,j], b[model,i,k], pi[model,i]."""
    out = np.empty((len(a), *obs.shape, a.shape[1]))
    emit = b.transpose(0, 2, 1)
    out[:, :, 0] = pi[:, None] + emit[:, obs[:, 0]]
    for t in range(1, obs.shape[1]):
        out[:, :, t] = _lse(out[:, :, t - 1, :, None] + a[:, None], 2) + emit[:, obs[:, t]]
    return out


def backward(obs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log beta, as forward."""
    out = np.zeros((len(a), *obs.shape, a.shape[1]))
    emit = b.transpose(0, 2, 1)
    for t in range(obs.shape[1] - 2, -1, -1):
        out[:, :, t] = _lse(a[:, None] + (emit[:, obs[:, t + 1]] + out[:, :, t + 1])[:, :, None, :], 3)
    return out


def forward_last(obs: np.ndarray, a: np.ndarray, b: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """log P[model, sequence], as the log sum of forward()'s last column, of which alone anything is kept."""
    emit = b.transpose(0, 2, 1)
    now = pi[:, None] + emit[:, obs[:, 0]]
    for t in range(1, obs.shape[1]):
        now = _lse(now[:, :, :, None] + a[:, None], 2) + emit[:, obs[:, t]]
    return _lse(now, 2)


def posteriors(obs: np.ndarray, a: np.ndarray, b: np.ndarray, pi: np.ndarray, block: int | None = None) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """(log P, blocks of (first time, log gamma[r, t, i], log xi[r, t, i, j])) of sequences of one length under one log model.

    Forward variables are kept at the first time of each block only and computed again within it, so what is in memory
    is two blocks' worth, of about the square root of the length by default. Blocks come from the last to the first; xi at t is of
    the step to t + 1, so the last block's ends one time earlier. Impossible sequences have minus infinity.
    """
    n = obs.shape[1]
    step, emit = block or max(1, math.isqrt(n)), b.T
    kept, now = [], pi + emit[obs[:, 0]]
    for t in range(n):
        if t:
            now = _lse(now[:, :, None] + a, 1) + emit[obs[:, t]]
        if t % step == 0:
            kept.append(now)
    p = _lse(now, 1)
    shift = np.where(np.isfinite(p), p, np.inf)[:, None, None]

    def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        after = None  # log beta at the first time of the block behind
        for first in range((len(kept) - 1) * step, -1, -step):
            stop = min(n, first + step)
            al, be = np.empty((len(obs), stop - first, len(pi))), np.empty((len(obs), stop - first, len(pi)))
            al[:, 0] = kept.pop()
            for t in range(1, stop - first):
                al[:, t] = _lse(al[:, t - 1, :, None] + a, 1) + emit[obs[:, first + t]]
            be[:, -1] = 0 if after is None else _lse(a + (emit[obs[:, stop]] + after)[:, None, :], 2)
            for t in range(stop - first - 2, -1, -1):
                be[:, t] = _lse(a + (emit[obs[:, first + t + 1]] + be[:, t + 1])[:, None, :], 2)
            then = be[:, 1:] if after is None else np.concatenate([be[:, 1:], after[:, None]], axis=1)
            m = then.shape[1]
            yield first, al + be - shift, al[:, :m, :, None] + a + (emit[obs[:, first + 1 : first + 1 + m]] + then)[:, :, None, :] - shift[..., None]
            after = be[:, 0]

    return p, blocks()
