"""Pixel kernels. Relational ones are column expressions; those on image bytes are numpy over Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel means and deviations of the supported backbones.
NORMS = {
    "H-optimus-1": ((0.707223, 0.578729, 0.703617), (0.211883, 0.230117, 0.177517)),
    "UNI2-h": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "Virchow2": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_unit(pixels: Column | str) -> Column:
    """0..255 to 0..1."""
    return F.transform(_c(pixels), lambda v: v.cast("double") / F.lit(255.0))


def normalised(pixels: Column | str, mean: tuple[float, ...], std: tuple[float, ...]) -> Column:
    """(v / 255 - mean) / std, channels interleaved."""
    n, m, s = len(mean), F.lit(list(mean)), F.lit(list(std))
    return F.transform(to_unit(pixels), lambda v, i: (v - F.element_at(m, (i % n + 1).cast("int"))) / F.element_at(s, (i % n + 1).cast("int")))


def centre_crop(pixels: Column | str, height: int, width: int, size: int, channels: int = 1) -> Column:
    """The middle size x size pixels of a row-major array."""
    top, left = (height - size) // 2, (width - size) // 2
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(_c(pixels), ((r + top) * width + left) * channels + 1, F.lit(size * channels)))
    return F.flatten(rows)


def chw(pixels: np.ndarray) -> np.ndarray:
    """Height, width, channel of bytes to channel, height, width of floats in 0..1."""
    return np.moveaxis(pixels, -1, 0).astype(np.float32) / 255


def edges(band: np.ndarray) -> np.ndarray:
    """Eight times the pixel less its neighbours, clipped to 0..255; the outermost pixels stay as they are. Further axes are bands."""
    x = band.astype(np.int16 if band.dtype == np.uint8 else np.int32)  # nine bytes' sum fits 16 bits
    out = x.copy()
    if min(x.shape[:2]) > 2:
        rows = x[:-2] + x[1:-1] + x[2:]
        around = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]
        out[1:-1, 1:-1] = np.clip(9 * x[1:-1, 1:-1] - around, 0, 255)
    return out


def edge_value(pixels: np.ndarray, tile_size: int) -> float:
    """Sum of edges a band, mean over the bands, over tile_size squared (not over the pixels at hand)."""
    bands = pixels[..., None] if pixels.ndim == 2 else pixels
    return float(edges(bands).sum(dtype=np.int64) / bands.shape[2] / tile_size**2)


def edge_score(height: int, width: int, channels: int, tile_size: int):
    """A vectorised function of an array or binary column of row-major pixels; null stays null."""

    @F.pandas_udf("double")
    def score(pixels: pd.Series) -> pd.Series:
        own = pixels.dropna()
        if not len(own):
            return pd.Series([None] * len(pixels), dtype="float64")
        first = own.iloc[0]
        stack = np.frombuffer(b"".join(own), np.uint8) if isinstance(first, bytes | bytearray) else np.concatenate(own.to_list())
        x = stack.reshape(len(own), height, width, channels)
        made = pd.Series(edges(np.moveaxis(x, 0, 2)).sum((0, 1)).mean(1) / tile_size**2, index=own.index)  # images and channels are bands of one
        return made.reindex(pixels.index)

    return score


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))


#: Fixed value: bits of a resampling weight behind the point.
WEIGHT_BITS = 22


@lru_cache(64)
def _weights(n: int, m: int) -> np.ndarray:
    """m x n whole numbers: what each of n pixels adds to each of m, in units of 2 ** -WEIGHT_BITS."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m)[:, None] + 0.5) * scale
    x = np.arange(n)[None, :]
    inside = (x >= np.trunc(centre - 2 * wide + 0.5)) & (x < np.trunc(centre + 2 * wide + 0.5))
    w = np.where(inside, _cubic((x - centre + 0.5) / wide), 0.0)
    w = w / w.sum(1, keepdims=True) * 2**WEIGHT_BITS
    return np.trunc(w + np.copysign(0.5, w))


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic, in the fixed-point arithmetic of common imaging libraries: widths first, then heights, each rounded to bytes.

    Shrinking widens the filter, so that no pixel is passed over. Sums stay below 2 ** 53, so doubles hold them exactly.
    """
    if pixels.shape[:2] == (height, width):
        return pixels
    out = pixels.astype(np.float64)
    for axis, m in ((1, width), (0, height)):
        n = out.shape[axis]
        if n != m:
            sums = np.moveaxis(np.tensordot(_weights(n, m), out, (1, axis)), 0, axis)
            out = np.clip(np.floor((sums + 2 ** (WEIGHT_BITS - 1)) / 2**WEIGHT_BITS), 0, 255)
    return out.astype(np.uint8)


def resize(height: int, width: int, to_height: int, to_width: int, channels: int = 1):
    """A vectorised ``resized`` of an array column of row-major pixels; null stays null."""

    @F.pandas_udf("array<int>")
    def run(pixels: pd.Series) -> pd.Series:
        own = pixels.dropna()
        if not len(own):
            return pixels
        stack = np.stack(own.to_list()).astype(np.uint8).reshape(len(own), height, width, channels)
        made = resized(np.moveaxis(stack, 0, 2), to_height, to_width)  # all images of the batch as bands of one
        flat = np.moveaxis(made, 2, 0).reshape(len(own), -1).astype(np.int32)
        return pd.Series(list(flat), index=own.index, dtype=object).reindex(pixels.index)

    return run
