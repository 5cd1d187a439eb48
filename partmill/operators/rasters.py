"""Colour statistics of images held as bytes: blended, reduced to a thumbnail and measured in one pass per image."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partmill.operators.images import HUES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the pass reaches workers that lack the package

# Bytes a pixel of each mode, sides of the thumbnails, bits of a resampling weight.
CHANNELS = {"1": 1, "L": 1, "LA": 2, "RGB": 3, "RGBA": 4}
THUMB, COLOR_THUMB = 120, 150
BITS = 22

STATS = "image_id long, n long, n_colors long, spread double, mean_hue double, is_colored boolean, is_black boolean, hue string, is_photo boolean"


def fitted(width: int, height: int, side: int) -> tuple[int, int]:
    """Size of an image shrunk into a square of `side`, its aspect kept as nearly as whole numbers can; small ones stay."""
    if width <= side and height <= side:
        return width, height
    aspect = width / height

    def nearest(exact: float, error) -> int:
        return max(min((int(np.floor(exact)), int(np.ceil(exact))), key=error), 1)

    if aspect <= 1:
        return nearest(side * aspect, lambda n: abs(aspect - n / side)), side
    return side, nearest(side / aspect, lambda n: abs(aspect - side / n) if n else 0)


def averaged(pixels: np.ndarray, across: int, down: int) -> np.ndarray:
    """Means of boxes of across x down pixels, rounded half up; boxes at the right and lower edge hold what is left."""
    h, w = pixels.shape[:2]
    x, y = np.arange(0, w, across), np.arange(0, h, down)
    total = np.add.reduceat(np.add.reduceat(pixels, y, axis=0, dtype=np.uint32), x, axis=1, dtype=np.uint64)
    n = np.multiply.outer(np.diff(np.append(y, h)), np.diff(np.append(x, w)))[..., None].astype(np.uint64)
    return ((total + n // 2) // n).astype(np.uint8)


def weights(length: int, extent: float, out: int) -> np.ndarray:
    """out x length cubic convolution weights (a = -1/2), widened by the reduction, normalised and held as whole multiples of 2^-BITS."""
    scale = extent / out
    stretch = max(scale, 1.0)
    center = (np.arange(out)[:, None] + 0.5) * scale
    first, last = np.trunc(np.maximum(center - 2 * stretch + 0.5, 0)), np.trunc(np.minimum(center + 2 * stretch + 0.5, length))
    at = np.arange(length)[None, :]
    t = np.abs((at - center + 0.5) / stretch)
    w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, (((t - 5) * t + 8) * t - 4) * -0.5, 0.0))
    w = np.where((at >= first) & (at < last), w, 0.0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << BITS)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5))


def convolved(pixels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted rows of `pixels`; sums of whole numbers under 2^53, so exact in doubles."""
    total = np.tensordot(w, pixels.astype(np.float64), axes=(1, 0))
    return np.clip(np.floor((total + (1 << (BITS - 1))) / (1 << BITS)), 0, 255).astype(np.uint8)


def thumbnail(pixels: np.ndarray, side: int) -> np.ndarray:
    """An RGB image shrunk into a square: whole boxes averaged down to twice the size or more, the rest by cubic convolution, columns first."""
    h, w = pixels.shape[:2]
    to_w, to_h = fitted(w, h, side)
    if (to_w, to_h) == (w, h):
        return pixels
    across, down = max(int(w / to_w / 2), 1), max(int(h / to_h / 2), 1)
    if across > 1 or down > 1:
        pixels = averaged(pixels, across, down)
    wide = convolved(pixels.transpose(1, 0, 2), weights(pixels.shape[1], w / across, to_w)).transpose(1, 0, 2)
    return convolved(wide, weights(pixels.shape[0], h / down, to_h))


def planes(raster: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """RGB without alpha, and RGB laid over white by its alpha."""
    plain = raster[..., :3] if mode in ("RGB", "RGBA") else np.repeat(raster[..., :1], 3, axis=2)
    if mode not in ("LA", "RGBA"):
        return plain, plain
    a = raster[..., -1:].astype(np.uint32)
    mixed = (plain * a + 255 * (255 - a) + 127) // 255  # no sum lies halfway: 255 is odd
    return plain, mixed.astype(np.uint8)


def measured(raster: np.ndarray, mode: str) -> dict:
    """The statistics of one image of height x width x channels."""
    height, width = raster.shape[:2]
    plain, blended = planes(raster, mode)
    flat = lambda p, side: thumbnail(p, side).reshape(-1, 3)
    pale = flat(plain, COLOR_THUMB)
    top, low = pale.max(axis=1).astype(np.float32), pale.min(axis=1).astype(np.float32)
    colored = (np.divide(top - low, top, out=np.zeros_like(top), where=top > 0).astype(np.float64) * 255 >= 18).mean()

    own = flat(plain, THUMB)
    top, low = own.max(axis=1), own.min(axis=1)
    rgb, span = own.astype(np.float64), (top - low).astype(np.float64)
    sat = np.divide(span, top, out=np.zeros_like(span), where=top > 0)
    value = top / 255.0
    vivid = (sat >= 0.18) & (value >= 0.15)
    s242, s240 = low < 242, low < 240
    hued = rgb[s240 & vivid]
    mean_hue, hue = None, ""
    if len(hued):
        (r, g, b), hi = hued.T, hued.max(axis=1)
        d = hi - hued.min(axis=1)
        h = np.where(r == hi, ((g - b) / d) % 6, np.where(g == hi, (b - r) / d + 2, (r - g) / d + 4)) * 60
        mean_hue = round(float(h.mean()), 6)
        if len(hued) / s240.sum() >= 0.02:
            hue = next((name for end, name in HUES if mean_hue < end), "RED")
    black = mode != "1" and bool(s242.any()) and (s242 & vivid).sum() / s242.sum() < 0.05 and (s242 & (value <= 0.45)).sum() / s242.sum() >= 0.35

    laid = own if blended is plain else flat(blended, THUMB)
    codes = laid.astype(np.uint32) @ np.array([65536, 256, 1], dtype=np.uint32)
    n_colors, spread = len(np.unique(codes)), round(float(laid.std(axis=0, dtype=np.float64).mean()), 6)
    white, dark = (laid.min(axis=1) >= 248).mean(), (laid.max(axis=1) <= 15).mean()
    shaped = mode != "1" and width >= 120 and height >= 80 and 0.65 <= width / height <= 3.0
    photo = shaped and n_colors >= 70 and spread >= 18 and white <= 0.88 and not (dark > 0.5 and white > 0.25)
    return {"n": len(own), "n_colors": n_colors, "spread": spread, "mean_hue": mean_hue, "is_colored": bool(colored >= 0.025), "is_black": bool(black), "hue": hue, "is_photo": bool(photo)}


NOTHING = {"n": None, "n_colors": None, "spread": None, "mean_hue": None, "is_colored": False, "is_black": False, "hue": "", "is_photo": False}


def raster_stats(images: DataFrame) -> DataFrame:
    """images(image_id, width, height, mode, raster): `pixel_stats` of thumbnails; raster holds rows of pixels, CHANNELS[mode] bytes each.

    Coloured is read from a thumbnail of 150 pixels, the rest from one of 120;
    colours, spread and the photographic test from the image laid over white,
    the others without its alpha. An image of mode 1 is neither photographic nor
    a black vehicle. A row whose bytes don't make up its size, or whose mode is
    none of these, has null statistics, no hue and false flags; repeated rows
    give repeated results, other columns go. One image is unpacked at a time.
    """
    names = STATS.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        schema = pa.schema([(n.split()[0], types[n.split()[1]]) for n in names])
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key, w, h, mode = (batch.column(c)[i].as_py() for c in ("image_id", "width", "height", "mode"))
                raster, per = batch.column("raster")[i], CHANNELS.get(mode)
                data = np.frombuffer(raster.as_buffer(), dtype=np.uint8) if raster.is_valid else None
                whole = data is not None and per and w and h and w > 0 and h > 0 and len(data) == w * h * per
                out.append({"image_id": key} | (measured(data.reshape(h, w, per), mode) if whole else NOTHING))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return images.select(F.col("image_id").cast("long"), F.col("width").cast("long"), F.col("height").cast("long"), "mode", "raster").mapInArrow(run, STATS)
