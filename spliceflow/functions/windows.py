"""Windows of samples in numpy, for Arrow and pandas functions: arrays (rows, channels, samples) of equal length, all rows at a time."""

from __future__ import annotations

import numpy as np

#: Lengths of silence and the score that stands for it.
SILENT, NONE = 1e-8, -1.0
#: Digits to which rises and scores are compared, so that sums in another order have the same winner.
DIGITS = 9


def tapered(w: np.ndarray) -> np.ndarray:
    """Windows less their means, under a Hann taper."""
    return (w - w.mean(-1, keepdims=True)) * np.hanning(w.shape[-1])


def _cosine(dots: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = (na > SILENT) & (nb > SILENT)
    return np.where(there, dots / np.where(there, na * nb, 1.0), 0.0), there


def _blend(same: np.ndarray, there: np.ndarray, rise: np.ndarray, rises: np.ndarray, axis: int) -> np.ndarray:
    """0.8 of the mean over channels that sound, 0.2 of that of their differences (of themselves where these are flat)."""
    n, m = there.sum(axis), rises.sum(axis)
    s = same.sum(axis) / np.maximum(n, 1)
    d = np.where(m > 0, rise.sum(axis) / np.maximum(m, 1), s)
    return np.where(n > 0, np.clip(0.8 * s + 0.2 * d, -1.0, 1.0), NONE)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of tapered windows and of their differences; -1 where silent or under 16 samples."""
    if a.shape[-1] < 16:
        return np.full(len(a), NONE)
    ta, tb = tapered(a), tapered(b)
    parts = []
    for x, y in ((ta, tb), (np.diff(ta), np.diff(tb))):
        parts.append(_cosine(np.einsum("rcn,rcn->rc", x, y), np.linalg.norm(x, axis=-1), np.linalg.norm(y, axis=-1)))
    (same, there), (rise, rises) = parts
    return _blend(same, there, rise, rises & there, 1)


def level(w: np.ndarray) -> np.ndarray:
    return np.sqrt((w**2).mean((-2, -1)) + 1e-10)


def level_step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Step between two levels in parts of 12 dB, 1 at most."""
    return np.minimum(1.0, np.abs(20.0 * np.log10(a / b)) / 12.0)


def box(x: np.ndarray, k: int) -> np.ndarray:
    """Moving mean over k samples of the last axis, zeros beyond the ends; of an even k the box leans to the left."""
    n, ahead = x.shape[-1], (k - 1) // 2
    total = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, -1)], -1)
    i = np.arange(n)
    return (total[..., np.minimum(n, i + ahead + 1)] - total[..., np.maximum(0, i + ahead - k + 1)]) / k


def onset(w: np.ndarray) -> np.ndarray:
    """Place of the steepest rise of the smoothed level of each window, the first of equals; the middle under 16 samples."""
    n = w.shape[-1]
    if n < 16:
        return np.full(len(w), n // 2)
    smooth = box(np.sqrt((w**2).mean(1)), min(64, max(4, n // 8)))
    rise = np.diff(smooth, prepend=smooth[:, :1])
    return np.round(np.maximum(rise, 0.0), DIGITS).argmax(-1)


def onset_near(energy: np.ndarray, at: int, first: int, before: int, after: int, n: int) -> int:
    """Steepest smoothed rise of the energy in [at - before, at + after) of a track of n samples, of which energy holds those from `first` on;
    `at` itself if fewer than 128 samples are there."""
    lo, hi = max(0, at - before), min(n, at + after)
    if hi - lo < 128:
        return at
    rise = np.diff(box(energy[lo - first : hi - first], min(64, (hi - lo) // 2)))
    return lo + int(np.round(box(rise, min(32, len(rise) // 2)), DIGITS).argmax())


def pair_score(a: np.ndarray, b: np.ndarray, out_shift: np.ndarray, in_shift: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, similarity): similarity less penalties for a level step, shifts, onsets off the centre and off each other; -1 where silent."""
    sim = similarity(a, b)
    return np.where(sim <= -0.99, NONE, sim - _penalties(level(a), level(b), onset(a), onset(b), out_shift, in_shift, most, a.shape[-1])), sim


def _penalties(la, lb, oa, ob, out_shift, in_shift, most: int, n: int) -> np.ndarray:
    centre = 0.5 * max(n - 1, 0)
    shift = np.minimum(1.0, (np.abs(out_shift) + np.abs(in_shift)) / (2.0 * most)) if most > 0 else 0.0
    off = np.minimum(1.0, (np.abs(oa - centre) + np.abs(ob - centre)) / (2.0 * max(1.0, 0.35 * n)))
    apart = np.minimum(1.0, np.abs(oa - ob) / max(1.0, 0.25 * n))
    return 0.10 * level_step(la, lb) + 0.15 * shift + 0.14 * off + 0.10 * apart


def score_grid(a: np.ndarray, b: np.ndarray, out_shift: np.ndarray, in_shift: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """pair_score of every window of a (rows, channels, n) with every one of b: products of matrices, one for each channel."""
    n = a.shape[-1]
    if n < 16:
        return np.full((len(a), len(b)), NONE), np.full((len(a), len(b)), NONE)
    ta, tb = tapered(a), tapered(b)
    parts = []
    for x, y in ((ta, tb), (np.diff(ta), np.diff(tb))):
        nx, ny = np.linalg.norm(x, axis=-1), np.linalg.norm(y, axis=-1)
        parts.append(_cosine(x.swapaxes(0, 1) @ y.transpose(1, 2, 0), nx.T[:, :, None], ny.T[:, None, :]))
    (same, there), (rise, rises) = parts
    sim = _blend(same, there, rise, rises & there, 0)
    less = _penalties(level(a)[:, None], level(b)[None], onset(a)[:, None], onset(b)[None], out_shift[:, None], in_shift[None], most, n)
    return np.where(sim <= -0.99, NONE, sim - less), sim


def correlation_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of every tapered window (rows, n) of a with every one of b; -1 where one is silent."""
    ta, tb = tapered(a), tapered(b)
    na, nb = np.linalg.norm(ta, axis=-1), np.linalg.norm(tb, axis=-1)
    v, there = _cosine(ta @ tb.T, na[:, None], nb[None])
    return np.where(there, v, NONE)


def anchor_quality(a: np.ndarray, b: np.ndarray, anchor: int, vocal: float, radius: int) -> tuple[float, float, float]:
    """(quality, similarity, near similarity), each from 0 to 1, of two windows (channels, n) aligned at `anchor`: the whole, and `radius`
    samples to either side, which weigh more where voices are; less a level step and an anchor near the edge."""
    n = a.shape[-1]
    sim = float(similarity(a[None], b[None])[0])
    if sim <= -0.99:
        return 0.0, 0.0, 0.0
    lo, hi = max(0, anchor - radius), min(n, anchor + radius)
    near = float(similarity(a[None, :, lo:hi], b[None, :, lo:hi])[0]) if hi - lo >= 16 else sim
    unit = lambda x: min(1.0, max(0.0, (x + 1.0) * 0.5))
    weight = min(0.70, 0.40 + 0.25 * min(1.0, max(0.0, vocal)))
    edge = max(0.0, 1.0 - min(anchor, n - anchor) / max(1.0, 0.18 * n))
    q = (1.0 - weight) * unit(sim) + weight * unit(near) - 0.08 * float(level_step(level(a[None]), level(b[None]))[0]) - 0.04 * edge
    return min(1.0, max(0.0, q)), unit(sim), unit(near)
