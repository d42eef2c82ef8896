"""Features of decoded pictures and sound, vectorised with numpy for Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The cloth's range of hue (0 to 180), saturation and value, and that of skin.
CLOTH = ((35, 40, 40), (95, 255, 255))
SKIN = ((0, 30, 60), (20, 150, 255))


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue (0 to 180), saturation and value (0 to 255) of an array (..., 3) of bytes."""
    x = rgb.astype(np.float64)
    top, low = x.max(-1), x.min(-1)
    span = top - low
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        hue = np.select([top == r, top == g], [(g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span)
        saturation = np.where(top > 0, span / top * 255, 0.0)
    hue = np.where(span > 0, (hue * 30) % 180, 0.0)
    return np.stack([hue, saturation, top], -1)


def share_within(h: np.ndarray, low_high: tuple) -> float:
    low, high = (np.array(v) for v in low_high)
    return float(((h >= low) & (h <= high)).all(-1).mean()) if h.size else 0.0


def edge_density(rgb: np.ndarray, threshold: float = 60.0) -> float:
    """Share of pixels whose brightness gradient exceeds a threshold."""
    grey = rgb.astype(np.float64).mean(-1)
    gy, gx = np.gradient(grey) if min(grey.shape) > 1 else (np.zeros_like(grey),) * 2
    return float((np.hypot(gx, gy) * 2 > threshold).mean())


def colour_histogram(h: np.ndarray, bins: int = 32) -> np.ndarray:
    """Normalised joint histogram of hue, saturation and value."""
    edges = [np.linspace(0, top, bins + 1) for top in (180, 256, 256)]
    counts = np.histogramdd(h.reshape(-1, 3), edges)[0].ravel()
    return counts / max(counts.sum(), 1.0)


def histogram_distance(a: np.ndarray, b: np.ndarray) -> float:
    """(1 - correlation) / 2, between 0 and 1."""
    x, y = a - a.mean(), b - b.mean()
    norm = np.sqrt((x @ x) * (y @ y))
    return float(np.clip((1 - (x @ y) / norm) / 2, 0, 1)) if norm > 0 else 0.0


def camera_shift(before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """Whole-picture shift (down, right) between two grey pictures, by phase correlation."""
    cross = np.fft.fft2(after) * np.conj(np.fft.fft2(before))
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-9)))), before.shape)
    return tuple(int(p - n if p > n // 2 else p) for p, n in zip(peak, before.shape))


def residual_motion(before: np.ndarray, after: np.ndarray, spread: float = 3.5) -> dict[str, float]:
    """What moved between two grey pictures beyond the camera's own shift: mean, 95th percentile, share, camera magnitude.

    The share counts pixels over an adaptive threshold: median plus `spread` robust deviations.
    """
    dy, dx = camera_shift(before.astype(np.float64), after.astype(np.float64))
    rest = np.abs(after.astype(np.float64) - np.roll(before.astype(np.float64), (dy, dx), (0, 1)))
    middle = np.median(rest)
    limit = middle + spread * 1.4826 * np.median(np.abs(rest - middle))
    return {"mean": float(rest.mean()), "p95": float(np.percentile(rest, 95)), "area": float((rest > max(limit, 1e-9)).mean()), "camera": float(np.hypot(dy, dx))}


def picture_features(frames: DataFrame) -> DataFrame:
    """Features of raw pictures (`job_id`, `t`, `width`, `height`, `rgb` bytes): shares, edges, histogram."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rgb = np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)
                h = hsv(rgb)
                out.append((row.job_id, row.t, share_within(h, CLOTH), share_within(h, SKIN), edge_density(rgb), colour_histogram(h).tolist()))
            yield pd.DataFrame(out, columns=["job_id", "t", "green", "skin", "edges", "histogram"])

    return frames.select("job_id", "t", "width", "height", "rgb").mapInPandas(describe, "job_id bigint, t double, green double, skin double, edges double, histogram array<double>")


def sound_series(samples: np.ndarray, rate: int, window: int = 2048, hop: int = 512) -> pd.DataFrame:
    """Onset strength, loudness and band energies of a mono signal, each divided by its maximum."""
    if len(samples) < window:
        samples = np.pad(samples, (0, window - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, window)[::hop]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(window), axis=1))
    hertz = np.fft.rfftfreq(window, 1 / rate)
    band = lambda low, high: spectrum[:, (hertz >= low) & (hertz < high)].sum(1)
    rise = np.maximum(np.diff(np.log1p(spectrum), axis=0, prepend=np.log1p(spectrum[:1])), 0).sum(1)
    series = {"onset": rise, "rms": np.sqrt((frames**2).mean(1)), "highband": band(2000, 8000), "midband": band(500, 4000)}
    scaled = {k: v / (v.max() + 1e-8) if v.max() > 0 else v for k, v in series.items()}
    return pd.DataFrame({"t": np.arange(len(frames)) * hop / rate, **scaled})


def sound_features(files: DataFrame) -> DataFrame:
    """Sound series of WAV files (`job_id`, `content`), one row a hop."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with wave.open(io.BytesIO(row.content)) as w:
                    data = np.frombuffer(w.readframes(w.getnframes()), np.int16).reshape(-1, w.getnchannels()).mean(1) / 32768
                    yield sound_series(data, w.getframerate()).assign(job_id=row.job_id)[["job_id", "t", "onset", "rms", "highband", "midband"]]

    return files.select("job_id", "content").mapInPandas(describe, "job_id bigint, t double, onset double, rms double, highband double, midband double")


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected areas of a mask, 0 outside: the smallest label spreads until nothing changes."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(labels, 1)
        around = np.stack([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])
        least = np.where(mask, np.where(around > 0, around, mask.size + 1).min(0), 0)
        if (least == labels).all():
            return np.unique(labels, return_inverse=True)[1].reshape(mask.shape)
        labels = least


def round_objects(rgb: np.ndarray, least_px: int = 12, roundness: float = 0.55) -> list[dict[str, float]]:
    """Bright neutral round areas surrounded by cloth: place, diameter and scores, the best white one first."""
    h = hsv(rgb)
    white = (h[..., 2] >= 180) & (h[..., 1] <= 70)
    labels = components(white)
    low, high = (np.array(v) for v in CLOTH)
    cloth = ((h >= low) & (h <= high)).all(-1)
    out = []
    for k in range(1, labels.max() + 1):
        ys, xs = np.nonzero(labels == k)
        if len(ys) < least_px:
            continue
        tall, wide = np.ptp(ys) + 1, np.ptp(xs) + 1
        shape = len(ys) / (np.pi / 4 * tall * wide) * min(tall, wide) / max(tall, wide)
        top, left = max(ys.min() - 2, 0), max(xs.min() - 2, 0)
        ring = np.zeros_like(white)
        ring[top : ys.max() + 3, left : xs.max() + 3] = True
        ring &= labels != k
        surround = float(cloth[ring].mean()) if ring.any() else 0.0
        neutral = 1 - h[ys, xs, 1].mean() / 255
        colour = float(np.sqrt(h[ys, xs, 2].mean() / 255 * neutral))
        if min(shape, 1.0) >= roundness:
            out.append({"x": float(xs.mean()), "y": float(ys.mean()), "diameter": float((tall + wide) / 2), "shape": float(min(shape, 1.0)), "surround": surround, "colour": colour})
    return sorted(out, key=lambda o: -o["colour"] * o["surround"])
