"""Image similarity: structure, colour and words of two pictures, and their composite."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import IMAGE_WEIGHTS

SIZE, SIGMA, TRUNCATE, BINS, INK, LEAST_INK = (640, 480), 1.5, 3.5, 8, 240, 50
PARTS = T.StructType([T.StructField(p, T.DoubleType()) for p in ("text_match", "ssim", "color_sim", "composite")])


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of an 8-bit grey, RGB, palette or RGBA PNG; alpha is laid on white. Others raise."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, pixels, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            pixels += body
        at += 12 + size
    width, height, depth, colour, _, _, laced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or laced:
        raise ValueError("only 8-bit PNGs without interlace")
    raw = np.frombuffer(zlib.decompress(pixels), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width * channels, np.int64)
        if kind == 2:
            line = line + up
        elif kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel()
        elif kind in (3, 4):
            left = np.zeros(channels, np.int64)
            diagonal = np.zeros(channels, np.int64)
            for x in range(0, width * channels, channels):
                above = up[x : x + channels]
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - diagonal
                    far = np.stack([abs(p - left), abs(p - above), abs(p - diagonal)])
                    guess = np.choose(far.argmin(axis=0), [left, above, diagonal])
                left = (line[x : x + channels] + guess) & 255
                line[x : x + channels], diagonal = left, above
        out[y] = line & 255
    image = out.reshape(height, width, channels).astype(float)
    if colour == 3:
        return palette[out.reshape(height, width)].astype(float)
    if channels in (2, 4):
        alpha = image[..., -1:] / 255
        image = image[..., :-1] * alpha + 255 * (1 - alpha)
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image


def resized(image: np.ndarray, size=SIZE) -> np.ndarray:
    """Bilinear, to a fixed canvas (width, height)."""
    h, w = image.shape[:2]
    if (w, h) == size:
        return image
    ys = np.clip((np.arange(size[1]) + 0.5) * h / size[1] - 0.5, 0, h - 1)
    xs = np.clip((np.arange(size[0]) + 0.5) * w / size[0] - 0.5, 0, w - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    return top * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def _blur(x: np.ndarray) -> np.ndarray:
    radius = int(TRUNCATE * SIGMA + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / SIGMA) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(k * np.take(padded, range(i, i + x.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return x


def ssim(one: np.ndarray, two: np.ndarray) -> float:
    """Mean structural similarity of two grey pictures, cut to 0..1."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    m1, m2 = _blur(one), _blur(two)
    v1, v2, both = _blur(one * one) - m1 * m1, _blur(two * two) - m2 * m2, _blur(one * two) - m1 * m2
    grid = (2 * m1 * m2 + c1) * (2 * both + c2) / ((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2))
    return float(np.clip(grid.mean(), 0, 1))


def _colours(rgb: np.ndarray) -> np.ndarray:
    flat = rgb.reshape(-1, 3)
    ink = flat[flat.min(axis=1) <= INK]
    used = ink if len(ink) >= LEAST_INK else flat
    cell = np.minimum((used * BINS / 255).astype(int), BINS - 1)
    counts = np.bincount(cell @ np.array([BINS * BINS, BINS, 1]), minlength=BINS**3).astype(float)
    return counts / max(counts.sum(), 1)


def colour_similarity(one: np.ndarray, two: np.ndarray) -> float:
    return float(np.minimum(_colours(one), _colours(two)).sum())


def bag_f1(one: list[str], two: list[str]) -> float:
    """F1 of two bags of words; 1 if both are empty."""
    if not one and not two:
        return 1.0
    both = sum((Counter(one) & Counter(two)).values())
    return 2 * both / (len(one) + len(two)) if both else 0.0


def weighted(parts: dict, weights=IMAGE_WEIGHTS) -> float | None:
    there = {k: v for k, v in parts.items() if v is not None}
    whole = sum(weights[k] for k in there)
    return sum(weights[k] * v for k, v in there.items()) / whole if there else None


def compare(ref: bytes | None, got: bytes | None, words=None) -> dict | None:
    """All parts; null if a picture is missing or can't be read. words: optional reader of the words in a picture."""
    if not ref or not got:
        return None
    try:
        a, b = resized(read_png(ref)), resized(read_png(got))
    except Exception:
        return None
    grey = np.array([0.299, 0.587, 0.114])
    parts = {"text_match": bag_f1(words(ref), words(got)) if words else None, "ssim": ssim(a @ grey, b @ grey), "color_sim": colour_similarity(a, b)}
    return parts | {"composite": weighted(parts)}


@F.pandas_udf(PARTS)
def image_similarity(ref: pd.Series, got: pd.Series) -> pd.DataFrame:
    rows = [compare(a, b) or dict.fromkeys(("text_match", "ssim", "color_sim", "composite")) for a, b in zip(ref, got, strict=True)]
    return pd.DataFrame(rows, columns=["text_match", "ssim", "color_sim", "composite"], dtype="float64")


def composite(parts: dict[str, Column], weights=IMAGE_WEIGHTS) -> Column:
    """Weighted mean of the parts that aren't null; null if all are."""
    total = sum((F.coalesce(v * F.lit(weights[k]), F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    whole = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    return F.try_divide(total, F.nullif(whole, F.lit(0.0)))
