"""Numpy kernels of image differences and masks, after their published definitions."""

from __future__ import annotations

import numpy as np

# sRGB to XYZ (D65) and the white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.95047, 1.0, 1.08883])
_GRAY = np.array([0.2125, 0.7154, 0.0721])


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luminance in [0, 1]."""
    x = rgb.astype(np.float64) / (255.0 if rgb.dtype == np.uint8 else 1.0)
    return x if x.ndim == 2 else x[..., :3] @ _GRAY


def lab(rgb: np.ndarray) -> np.ndarray:
    """CIELAB of 8-bit sRGB."""
    x = rgb[..., :3].astype(np.float64) / 255.0
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def normalized(x: np.ndarray, percentile: float = 99.0) -> np.ndarray:
    """x over its own percentile, clipped to [0, 1]; zeros where that percentile is next to nothing."""
    if not 50 <= percentile <= 100:
        raise ValueError("the percentile must be from 50 to 100")
    top = float(np.percentile(x, percentile)) if x.size else 0.0
    return np.zeros(x.shape, np.float32) if top <= 1e-6 else np.clip(x / top, 0, 1).astype(np.float32)


def _blur(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    for axis in (0, 1):
        padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(k * np.take(padded, np.arange(i, i + x.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return x


def ssim_map(a: np.ndarray, b: np.ndarray, win: int = 7, gaussian: bool = True, sigma: float = 1.5, data_range: float = 1.0) -> np.ndarray:
    """Structural similarity of two gray images, at every pixel."""
    if gaussian:
        r = int(3.5 * sigma + 0.5)
        kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        kernel, unbias = kernel / kernel.sum(), 1.0
    else:
        if win % 2 == 0:
            raise ValueError("the window must be odd")
        kernel, unbias = np.full(win, 1 / win), win * win / (win * win - 1)
    ma, mb = _blur(a, kernel), _blur(b, kernel)
    va, vb = (unbias * (_blur(x * x, kernel) - m * m) for x, m in ((a, ma), (b, mb)))
    vab = unbias * (_blur(a * b, kernel) - ma * mb)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return (2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def ssim(a: np.ndarray, b: np.ndarray, win: int = 7) -> float:
    """Mean similarity with a uniform window, without the border that the window does not fill."""
    r = win // 2
    return float(ssim_map(a, b, win, gaussian=False)[r:-r, r:-r].mean())


def resize(x: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    """Bilinear, with the filter widened when the image shrinks; or the nearest pixel."""
    if x.shape[:2] == (height, width):
        return x
    if nearest:
        rows = np.minimum(((np.arange(height) + 0.5) * x.shape[0] / height).astype(int), x.shape[0] - 1)
        cols = np.minimum(((np.arange(width) + 0.5) * x.shape[1] / width).astype(int), x.shape[1] - 1)
        return x[rows][:, cols]

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        reach = max(scale, 1.0)
        centre = (np.arange(new) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs((np.arange(old)[None, :] + 0.5 - centre[:, None]) / reach))
        return w / w.sum(axis=1, keepdims=True)

    y = np.tensordot(weights(x.shape[0], height), x.astype(np.float64), axes=(1, 0))
    y = np.moveaxis(np.tensordot(weights(x.shape[1], width), y, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(y), 0, 255).astype(np.uint8) if x.dtype == np.uint8 else y


def otsu(x: np.ndarray, bins: int = 256) -> float:
    """The threshold with the largest variance between the two classes of the histogram."""
    if x.min() == x.max():
        raise ValueError("one value has no threshold")
    counts, edges = np.histogram(x, bins)
    centre = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    m1 = np.cumsum(counts * centre) / np.maximum(w1, 1)
    m2 = (np.cumsum((counts * centre)[::-1]) / np.maximum(w2[::-1], 1))[::-1]
    return float(centre[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)])


def disk(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def _spread(mask: np.ndarray, shape: list[tuple[int, int]], outside: bool) -> np.ndarray:
    """Union of the mask's shifts; pixels outside count as ``outside``."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in shape)
    padded = np.pad(mask, r, constant_values=outside)
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy, dx in shape:
        out |= padded[r + dy : r + dy + h, r + dx : r + dx + w]
    return out


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return _spread(mask, disk(r), False)


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    return ~_spread(~mask, disk(r), False)


def opened(mask: np.ndarray, r: int) -> np.ndarray:
    return dilate(erode(mask, r), r)


def closed(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, r), r)


def components(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Labels 1, 2, ... of connected pixels, 0 elsewhere; ``diagonal`` also joins corners.

    Runs of a row are joined with touching runs of the row above.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    root = np.arange(len(row))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    names = np.unique([find(i) for i in range(len(row))], return_inverse=True)[1] + 1 if len(row) else row
    out = np.zeros((h, w), np.int32)
    for y, a, b, name in zip(row, start, end, names, strict=True):
        out[y, a:b] = name
    return out


def areas(labels: np.ndarray) -> np.ndarray:
    return np.bincount(labels.ravel())[1:]


def without_small(mask: np.ndarray, least: int, diagonal: bool = True) -> np.ndarray:
    labels = components(mask, diagonal)
    keep = np.append(False, areas(labels) >= least)
    return keep[labels]


def compactness(mask: np.ndarray) -> float:
    """Root of (area / bounding box) times (largest component / area); 0 for an empty mask."""
    total = int(mask.sum())
    if not total:
        return 0.0
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    box = (rows[-1] - rows[0] + 1) * (cols[-1] - cols[0] + 1)
    return float(np.sqrt(total / box * (areas(components(mask, False)).max() / total)))


def spatial_descriptor(mask: np.ndarray, scope: str, margin: float = 0.25, scattered: float = 0.3) -> str:
    """Where the mask lies, in one of eight words."""
    if scope == "global":
        return "whole_image"
    if scope == "alignment_failed" or not mask.any():
        return "alignment_failed"
    parts = areas(components(mask, False))
    if len(parts) > 1 and parts.max() / mask.sum() < scattered:
        return "scattered"
    y, x = (float(c.mean()) / n for c, n in zip(np.nonzero(mask), mask.shape, strict=True))
    if abs(y - 0.5) <= margin and abs(x - 0.5) <= margin:
        return "centered"
    return ("upper" if y < 0.5 else "lower") + ("_left" if x < 0.5 else "_right")


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """IoU and Dice; b is resized to a. Both are 1 for two empty masks."""
    b = resize(b, *a.shape, nearest=True)
    shared, union, total = int((a & b).sum()), int((a | b).sum()), int(a.sum() + b.sum())
    return (shared / union if union else 1.0), (2 * shared / total if total else 1.0)


def provided_mask(pixels: np.ndarray) -> np.ndarray:
    """Edited pixels of a mask image: transparent ones, black ones of a color image, or bright ones of a gray one."""
    if pixels.ndim == 2:
        return pixels > 127
    return pixels[..., 3] == 0 if pixels.shape[2] == 4 else (pixels == 0).all(axis=2)


def stored_mask(pixels: np.ndarray) -> np.ndarray:
    """A mask as it is stored, white for edited, in gray or color: luminance (ITU-R 601, in whole numbers) over 127."""
    if pixels.ndim == 2:
        return pixels > 127
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16 > 127


def fit_long_side(pixels: np.ndarray, most: int = 448) -> np.ndarray:
    h, w = pixels.shape[:2]
    scale = most / max(h, w)
    return pixels if scale >= 1 else resize(pixels, max(1, round(h * scale)), max(1, round(w * scale)))
