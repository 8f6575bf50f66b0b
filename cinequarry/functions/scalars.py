"""Scalar derivations of clip curation, schedules and metrics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Output sizes in order of preference.
SIZES = ((512, 384), (512, 288), (288, 512))
#: Buckets in output order.
BUCKET_ORDER = ("10s_512x384", "20s_512x384", "10s_512x288", "20s_512x288", "10s_288x512")
MARGIN = 0.2


def aspect_by_threshold(w: Column, h: Column) -> Column:
    """Output size by fixed limits of the aspect ratio."""
    ratio = w / h
    return F.when(ratio < 1.0, "288x512").when(ratio > 1.55, "512x288").otherwise("512x384")


def aspect_by_nearest(w: Column, h: Column) -> Column:
    """Output size whose aspect ratio is nearest on a log scale; the first of equals."""
    options = [F.struct(F.abs(F.ln(w / h / F.lit(a / b))).alias("far"), F.lit(i).alias("at"), F.lit(f"{a}x{b}").alias("size")) for i, (a, b) in enumerate(SIZES)]
    return F.array_min(F.array(*options))["size"]


def bucket_key(duration: Column, size: Column) -> Column:
    return F.concat(duration.cast("int").cast("string"), F.lit("s_"), size)


def normalize_caption(text: Column) -> Column:
    """Folded case, runs of ASCII white space as one space, trimmed. Of the letters that
    case folding changes and lower case doesn't, sharp s, final sigma and long s are told."""
    folded = F.replace(F.translate(F.lower(text), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[ \t\n\x0B\f\r]+", " "))


def collect_captions(*fields: Column) -> Column:
    """Distinct trimmed captions of several array columns, in order; blanks dropped, null arrays skipped."""
    whole = F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in fields]))
    trimmed = F.transform(F.filter(whole, lambda x: x.isNotNull()), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def window_starts(duration: Column, clip_seconds: float, stride: float, max_windows: int, margin: float = MARGIN) -> Column:
    """Starts of the windows that fit into a source, at most ``max_windows``."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(max_windows - 1)), lambda i: i * stride + clip_seconds <= duration - margin)
    return F.transform(fits, lambda i: F.round(i * stride, 3))


def frame_count(seconds: Column, fps: float) -> Column:
    return (seconds * fps).cast("int") + 1


def source_frame(i: Column, start: Column, fps: float, source_fps: float) -> Column:
    """Source frame of output frame ``i``; halves go to the even one."""
    return F.bround((start + i / fps) * source_fps).cast("long")


def timeshift(t: Column, alpha: float) -> Column:
    u = 1 - t
    return t if alpha == 1 else 1 - alpha * u / (1 + (alpha - 1) * u)


def band(t: Column, bands: int = 8) -> Column:
    return F.least(F.floor(t * bands).cast("int"), F.lit(bands - 1))


def band_label(i: Column, bands: int = 8, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f-%.{digits}f", i / bands, (i + 1) / bands)


def blind_error(t: Column) -> Column:
    """Error of a predictor that sees nothing, at noise level ``t``."""
    return 2 - (2 * t - 1) * (2 * t - 1) / (t * t + (1 - t) * (1 - t))


def clean_error(velocity_error: Column, t: Column) -> Column:
    return velocity_error * (1 - t) * (1 - t)


def lr_scale(step: Column, warmup: int, steps: int, floor: float, schedule: str = "cosine") -> Column:
    decayed = F.lit(1.0)
    if schedule == "cosine":
        decayed = floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / max(1, steps - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(decayed) if warmup else decayed


def ema_decay(step: Column, decay: float, warmup: int) -> Column:
    return F.least(F.lit(decay), (1 + step) / (F.lit(float(warmup)) + step)) if warmup else F.lit(decay)


def step_flops(n_params: int, depth: int, width: int, seq: Column, batch: Column) -> Column:
    return (6.0 * n_params + 12.0 * depth * width * seq) * batch * seq


def pack_flops(n_params: int, depth: int, width: int, joint: Column, segments: Column) -> Column:
    """Cost of one packed bin: attention follows the segments, of which the padding is one."""
    pad = joint - F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s)
    square = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + s * s) + pad * pad
    return 6.0 * n_params * joint + 12.0 * depth * width * square


def slug(text: Column, length: int = 50) -> Column:
    return F.substring(F.translate(text, " ", "_"), 1, length)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parse_aspect(spec: Column) -> Column:
    """``16:9`` or ``1.78``; null if it is neither."""
    pair = F.split(spec, ":")
    number = lambda c: F.try_to_number(c, F.lit("999999D999999")).cast("double")
    return F.when(F.contains(spec, F.lit(":")), F.try_divide(number(F.get(pair, F.lit(0))), number(F.get(pair, F.lit(1))))).otherwise(number(spec))


def clip_name(item_id: Column) -> Column:
    return F.format_string("%05d.npz", item_id)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def to_pixel_bytes(x: Column) -> Column:
    """[-1, 1] back to 0 ... 255: clamped, then cut off."""
    return F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) * 127.5).cast("int")


def from_pcm(x: Column) -> Column:
    return x / 32767.0


def destandardize(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def snap_to_bucket(ratio: Column, frames: Column, buckets: list[tuple[str, int, int, int]]) -> Column:
    """struct(name, frames) of the trained bucket (name, frames, width, height) nearest to a
    wanted aspect ratio, then to a wanted number of frames; the first of equals."""
    options = [
        F.struct(F.round(F.abs(F.ln(F.lit(w / h) / ratio)), 6).alias("far"), F.abs(F.lit(t) - frames).alias("late"), F.lit(i).alias("at"), F.lit(name).alias("name"), F.lit(t).alias("frames"))
        for i, (name, t, w, h) in enumerate(buckets)
    ]
    best = F.array_min(F.array(*options))
    return F.struct(best["name"].alias("name"), best["frames"].alias("frames"))


def audio_length(length: Column | int, frames: Column, default_frames: int) -> Column:
    """Audio latents of a bucket, in proportion to its frames after the first."""
    return F.bround(F.lit(length) * (frames - 1) / (default_frames - 1)).cast("long")


def first_contained(name: Column, table: dict[str, float]) -> Column:
    """Value of the first key of ``table`` that stands in ``name``; null if none does."""
    found = F.lit(None).cast("double")
    for key, value in reversed(table.items()):
        found = F.when(F.contains(name, F.lit(key)), F.lit(float(value))).otherwise(found)
    return found


def motion(dx: Column, dy: Column) -> Column:
    """Direction of a displacement: the larger part decides, the vertical one of equals; rows grow downwards."""
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "down").otherwise("up"))
