"""Registry of vectorised functions, with the encoders and heuristics that come with it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

KINDS = ("encoder", "codec", "metric", "heuristic")
_FACTORIES: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable:
    """Decorator: a factory that takes options and returns a vectorised function."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")

    def add(factory: Callable) -> Callable:
        if name in _FACTORIES[kind]:
            raise ValueError(f"{kind} {name!r} is registered already")
        _FACTORIES[kind][name] = factory
        return factory

    return add


def build(kind: str, name: str, **options):
    try:
        return _FACTORIES[kind][name](**options)
    except KeyError:
        raise ValueError(f"no {kind} {name!r}; there are {', '.join(sorted(_FACTORIES.get(kind, {})))}") from None


def install(spark: SparkSession) -> None:
    """Make everything that is registered callable from SQL as kind_name."""
    for kind, factories in _FACTORIES.items():
        for name, factory in factories.items():
            spark.udf.register(f"{kind}_{name}", factory())


@register("encoder", "hashed")
def hashed_encoder(width: int = 64):
    """Text as a unit vector: every word adds a fixed random direction."""

    @pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = np.zeros(width)
            for word in (text or "").lower().split():
                raw = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v += np.random.default_rng(int.from_bytes(raw, "little")).standard_normal(width)
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one)

    return encode


@register("codec", "pcm16")
def pcm16():
    """Signed 16-bit samples as numbers within [-1, 1]."""

    @pandas_udf("array<double>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else (np.frombuffer(b, "<i2") / 32767.0).tolist())

    return decode


@register("heuristic", "dominant_frequency")
def dominant_frequency(rate: int = 44_100, low: float = 100.0, high: float = 2000.0):
    """Strongest frequency of a signal within a band, under a Hann window."""

    @pandas_udf("double")
    def find(signals: pd.Series) -> pd.Series:
        def one(x) -> float | None:
            if x is None or len(x) < 2:
                return None
            x = np.asarray(x, float)
            power, hz = np.abs(np.fft.rfft(x * np.hanning(len(x)))), np.fft.rfftfreq(len(x), 1 / rate)
            inside = (hz > low) & (hz < high)
            return float(hz[inside][np.argmax(power[inside])]) if inside.any() else None

        return signals.map(one)

    return find


@register("heuristic", "median_mask")
def median_mask(limit: float = 60.0, size: int = 5, width: int = 32):
    """Foreground of a grey image against its border's median, cleaned by a median filter of
    ``size``: number of pixels, and mean place in x and y."""

    @pandas_udf("struct<pixels:long,x:double,y:double>")
    def find(images: pd.Series) -> pd.DataFrame:
        def one(raw):
            if raw is None or not len(raw):
                return (0, None, None)
            image = np.frombuffer(raw, np.uint8).astype(float).reshape(-1, width)
            ground = np.median(np.concatenate([image[0], image[-1], image[:, 0], image[:, -1]]))
            mask = np.pad(np.abs(image - ground) > limit, size // 2, mode="edge")
            whole = np.lib.stride_tricks.sliding_window_view(mask, (size, size)).mean(axis=(2, 3)) > 0.5
            y, x = np.nonzero(whole)
            return (len(x), float(x.mean()), float(y.mean())) if len(x) else (0, None, None)

        return pd.DataFrame(list(map(one, images)), columns=["pixels", "x", "y"])

    return find


@register("metric", "cosine")
def cosine():
    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        one = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1.0))
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return score
