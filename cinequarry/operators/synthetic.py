"""Small labelled clips, made anew from a seed and an id, and classifiers that read the
labels back from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COLORS = ("red", "green", "blue", "yellow", "cyan", "magenta")
SHAPES = ("circle", "square", "triangle")
MOVES = ("left", "right", "up", "down")
SIDE, FRAMES, RATE, SAMPLES = 32, 5, 8000, 4000


def _clip(seed: int, i: int) -> tuple[tuple[str, str, str], np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, i])
    color, shape, move = (rng.integers(len(x)) for x in (COLORS, SHAPES, MOVES))
    rgb = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 0], [0, 255, 255], [255, 0, 255]], np.uint8)[color]
    frames = np.zeros((FRAMES, SIDE, SIDE, 3), np.uint8)
    y, x = np.mgrid[:SIDE, :SIDE]
    for f in range(FRAMES):
        dx, dy = ((-1, 0), (1, 0), (0, -1), (0, 1))[move]
        u, v = x - 16 - dx * (f - 2) * 2, y - 16 - dy * (f - 2) * 2
        inside = (u * u + v * v <= 64, (abs(u) <= 8) & (abs(v) <= 8), (v >= -8) & (v <= 8) & (2 * abs(u) <= v + 8))[shape]
        frames[f][inside] = rgb
    up = move in (1, 2)
    hz = np.linspace(*((330, 660) if up else (660, 330)), SAMPLES)
    audio = (np.sin(2 * np.pi * np.cumsum(hz) / RATE) * 20000).astype(np.int16)
    return (COLORS[color], SHAPES[shape], MOVES[move]), frames, audio


def classify(frames: np.ndarray) -> tuple[str | None, str | None, str | None]:
    """Colour, shape (by how much of its box and of the box's upper corners it fills), move."""
    places = []
    for frame in frames:
        y, x = np.nonzero(frame.any(axis=2))
        places.append((x.mean(), y.mean()) if len(x) >= 50 else None)
    middle = frames[len(frames) // 2]
    mask = middle.any(axis=2)
    if mask.sum() < 100:
        return None, None, None
    pixel = tuple(np.median(middle[mask], axis=0) > 127)
    color = dict(zip(((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1)), COLORS, strict=True)).get(tuple(map(int, pixel)))
    y, x = np.nonzero(mask)
    box = mask[y.min() : y.max() + 1, x.min() : x.max() + 1]
    fill = box.mean()
    shape = "square" if fill > 0.95 else "circle" if fill > 0.65 else "triangle"
    if places[0] is None or places[-1] is None:
        return color, shape, None
    dx, dy = places[-1][0] - places[0][0], places[-1][1] - places[0][1]
    return color, shape, ("right" if dx > 0 else "left") if abs(dx) > abs(dy) else ("down" if dy > 0 else "up")


def pitch(audio: np.ndarray, rate: int = RATE, seconds: float = 0.1) -> str:
    """up, down or flat, from the strongest frequency of the first and the last moments."""
    n = int(rate * seconds)

    def strongest(x: np.ndarray) -> float:
        power, hz = np.abs(np.fft.rfft(x * np.hanning(len(x)))), np.fft.rfftfreq(len(x), 1 / rate)
        inside = (hz > 100) & (hz < 2000)
        return float(hz[inside][np.argmax(power[inside])])

    first, last = strongest(audio[:n].astype(float)), strongest(audio[-n:].astype(float))
    return "up" if last > 1.25 * first else "down" if first > 1.25 * last else "flat"


def clips(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, color, shape, move, frames, audio): the same clip for an id at every run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *labels, frames.tobytes(), audio.tobytes()) for i in batch["id"] for labels, frames, audio in [_clip(seed, i)]]
            yield pd.DataFrame(rows, columns=["id", "color", "shape", "move", "frames", "audio"])

    return spark.range(n).mapInPandas(run, "id long, color string, shape string, move string, frames binary, audio binary")


def judged(media: DataFrame) -> DataFrame:
    """Labels and what the classifiers read from the media: pred_color, pred_shape, pred_move, pred_pitch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [classify(np.frombuffer(f, np.uint8).reshape(-1, SIDE, SIDE, 3)) for f in batch["frames"]]
            out = batch[["id", "color", "shape", "move"]].copy()
            out[["pred_color", "pred_shape", "pred_move"]] = seen
            out["pred_pitch"] = [pitch(np.frombuffer(a, "<i2")) for a in batch["audio"]]
            yield out

    return media.mapInPandas(run, "id long, color string, shape string, move string, pred_color string, pred_shape string, pred_move string, pred_pitch string")
