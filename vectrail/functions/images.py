"""Feature kernels over pixel arrays. Pixels are uint8 in the order that the image source gives them (blue first);
colour conversions treat the first channel as red, as the stored results do."""

from __future__ import annotations

import numpy as np

TILE = 100
EPSILON = 1e-7


def luma(pixels: np.ndarray) -> np.ndarray:
    first, second, third = (pixels[..., i].astype(np.float64) for i in range(3))
    return 0.299 * first + 0.587 * second + 0.114 * third


def gray(pixels: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(luma(pixels)), 0, 255).astype(np.uint8)


def yuv(pixels: np.ndarray) -> np.ndarray:
    y = luma(pixels)
    u = 0.492 * (pixels[..., 2] - y) + 128
    v = 0.877 * (pixels[..., 0] - y) + 128
    return np.clip(np.rint(np.stack([y, u, v], axis=-1)), 0, 255).astype(np.uint8)


def tiles(channel: np.ndarray, size: int = TILE) -> list[np.ndarray]:
    """Row by row; tiles at the edges are smaller."""
    height, width = channel.shape[:2]
    return [channel[r : r + size, c : c + size] for r in range(0, height, size) for c in range(0, width, size)]


def moments(values: np.ndarray) -> tuple[float, float, float]:
    """Mean, population standard deviation, and population skew (0 where nothing varies)."""
    x = values.astype(np.float64).ravel()
    mean = x.mean()
    m2, m3 = ((x - mean) ** 2).mean(), ((x - mean) ** 3).mean()
    return float(mean), float(np.sqrt(m2)), float(m3 / m2**1.5) if m2 > 0 else 0.0


def color_moments(pixels: np.ndarray, flat: bool = True) -> list:
    """Channel by channel, tile by tile: mean, deviation, skew. flat: one vector, else a list for each channel."""
    converted = yuv(pixels)
    channels = [[m for t in tiles(converted[..., c]) for m in moments(t)] for c in range(3)]
    return [x for c in channels for x in c] if flat else channels


def local_binary_pattern(image: np.ndarray, points: int = 1, radius: float = 3.0) -> np.ndarray:
    """Codes with bit p set where the sample at angle 2 pi p / points is at least the centre; outside counts as 0."""
    x = image.astype(np.float64)
    height, width = x.shape
    rows, cols = np.mgrid[0:height, 0:width].astype(np.float64)
    code = np.zeros((height, width), dtype=np.int64)
    for p in range(points):
        angle = 2 * np.pi * p / points
        r, c = rows + round(-radius * np.sin(angle), 5), cols + round(radius * np.cos(angle), 5)
        r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
        sample = np.zeros_like(x)
        for i in (0, 1):
            for j in (0, 1):
                weight = np.abs(1 - i - (r - r0)) * np.abs(1 - j - (c - c0))
                inside = (r0 + i >= 0) & (r0 + i < height) & (c0 + j >= 0) & (c0 + j < width)
                sample[inside] += (weight * x[np.clip(r0 + i, 0, height - 1), np.clip(c0 + j, 0, width - 1)])[inside]
        code |= (sample >= x).astype(np.int64) << p
    return code


def histogram(codes: np.ndarray, bins: int = 10, span: tuple[float, float] | None = None) -> list[float]:
    """Shares of equal bins, the last closed, over span or the values' own range."""
    low, high = span if span else (float(codes.min()), float(codes.max()))
    if low == high:
        low, high = low - 0.5, high + 0.5
    counts, _ = np.histogram(codes, bins=bins, range=(low, high))
    return [float(x) for x in counts / (counts.sum() + EPSILON)]


def lbp(pixels: np.ndarray, wide: bool = False, whole_image: bool = False) -> list:
    """Histograms of each tile: 10 bins over its own range in one vector, or wide: a list of 256 bins over 0..255.
    whole_image: every tile has the histogram of the whole image (compatibility form)."""
    image = gray(pixels)
    codes = local_binary_pattern(image)
    parts = [codes] * len(tiles(image)) if whole_image else [local_binary_pattern(t) for t in tiles(image)]
    found = [histogram(c, 256, (0.0, 255.0)) if wide else histogram(c) for c in parts]
    return found if wide else [x for h in found for x in h]


def shrink(pixels: np.ndarray, by: int = 10) -> np.ndarray:
    """Means of blocks; the image is padded with zeros to whole blocks."""
    height, width = pixels.shape[:2]
    padded = np.pad(pixels.astype(np.float64), ((0, -height % by), (0, -width % by), (0, 0)))
    h, w = padded.shape[0] // by, padded.shape[1] // by
    return padded.reshape(h, by, w, by, -1).mean(axis=(1, 3))


def hog(pixels: np.ndarray, orientations: int = 9, cell: int = 8, block: int = 2) -> list[float]:
    """Oriented gradients of the tenth-size image: per pixel the strongest channel, per cell the mean magnitude in each
    of the unsigned directions, per block of cells normalised, clipped at 0.2 and normalised again."""
    x = shrink(pixels)
    height, width, _ = x.shape
    rows, cols = np.zeros_like(x), np.zeros_like(x)
    rows[1:-1] = x[2:] - x[:-2]
    cols[:, 1:-1] = x[:, 2:] - x[:, :-2]
    strength = np.hypot(rows, cols)
    best = strength.argmax(axis=2)[..., None]
    strength, rows, cols = (np.take_along_axis(a, best, axis=2)[..., 0] for a in (strength, rows, cols))
    direction = np.minimum((np.rad2deg(np.arctan2(rows, cols)) % 180) / (180 / orientations), orientations - 1e-9).astype(int)
    down, across = height // cell, width // cell
    cells = np.zeros((down, across, orientations))
    for o in range(orientations):
        held = np.where(direction == o, strength, 0.0)[: down * cell, : across * cell]
        cells[..., o] = held.reshape(down, cell, across, cell).sum(axis=(1, 3)) / (cell * cell)
    out: list[float] = []
    for r in range(down - block + 1):
        for c in range(across - block + 1):
            v = cells[r : r + block, c : c + block].ravel()
            v = np.minimum(v / np.sqrt((v * v).sum() + 1e-10), 0.2)
            out += (v / np.sqrt((v * v).sum() + 1e-10)).tolist()
    return out
