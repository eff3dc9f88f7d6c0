"""Sound as arrays: mono floats of PCM bytes, sampling rates, levels, languages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what speech recognition takes, and the languages that are understood
RATE = 16_000
UNDERSTOOD = ("en", "ko", "zh")


def mono(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Interleaved little-endian PCM of 1 to 4 bytes a sample as floats from -1 to 1, channels averaged; a torn last frame is left out."""
    frame = width * channels
    raw = np.frombuffer(raw[: len(raw) // frame * frame], np.uint8)
    if width == 1:  # bytes without a sign, 128 is silence
        whole, top = raw.astype(np.int32) - 128, 127
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        whole, top = wide.view("<i4").ravel() >> 8 * (4 - width), (1 << 8 * width - 1) - 1
    return (whole.reshape(-1, channels).mean(axis=1) / top).astype(np.float32)


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """The nearest earlier sample at each tick of the new rate."""
    if rate == to or not len(samples):
        return samples
    step = rate / to
    return samples[(np.arange(int(len(samples) / step)) * step).astype(np.int64)]


def level(samples: np.ndarray) -> float:
    """Mean absolute value; 0 without samples."""
    return float(np.abs(samples).mean()) if len(samples) else 0.0


def mono_column(samples: Column, channels: Column, top: float = 32767.0) -> Column:
    """The same for an array column of interleaved whole samples, in the JVM: array<double>."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    each = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels / top
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), each)).otherwise(F.array().cast("array<double>"))


def resampled_column(samples: Column, rate: Column, to: int = RATE) -> Column:
    """``resampled`` for an array column."""
    step = rate / float(to)
    wanted = F.floor(F.size(samples) / step).cast("int")
    pick = F.transform(F.sequence(F.lit(0), wanted - 1), lambda i: F.get(samples, F.floor(i * step).cast("int")))
    return F.when(rate == to, samples).when(wanted > 0, pick).otherwise(F.slice(samples, 1, 0))


def level_column(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.when(F.size(samples) > 0, total / F.size(samples)).otherwise(0.0)


def best_understood(scores: Column) -> Column:
    """Of a map of languages to scores, the best that is understood; the first of equal ones."""
    each = F.array(*[F.struct(F.coalesce(F.element_at(scores, c), F.lit(0.0)).alias("s"), F.lit(-i).alias("at"), F.lit(c).alias("lang")) for i, c in enumerate(UNDERSTOOD)])
    return F.array_max(each)["lang"]
