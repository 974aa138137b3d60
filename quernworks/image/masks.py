"""Difference signals, their combination, and masks of image pairs as an Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels, png


class Signal:
    """A map in [0, 1] of how much each pixel differs; subclasses are plug-ins."""

    name = "signal"

    def compute(self, real: np.ndarray, edited: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def compute_batch(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Must equal ``compute`` pair by pair."""
        return [self.compute(*p) for p in pairs]


@dataclass
class LabDifference(Signal):
    percentile: float = 99.0
    name = "lab_pixel"

    def compute(self, real: np.ndarray, edited: np.ndarray) -> np.ndarray:
        return kernels.normalized(np.linalg.norm(kernels.lab(real) - kernels.lab(edited), axis=-1), self.percentile)


@dataclass
class SsimDifference(Signal):
    win: int = 7
    gaussian: bool = True
    sigma: float = 1.5
    percentile: float = 99.0
    name = "ssim"

    def compute(self, real: np.ndarray, edited: np.ndarray) -> np.ndarray:
        similar = kernels.ssim_map(kernels.gray(real), kernels.gray(edited), self.win, self.gaussian, self.sigma)
        return kernels.normalized(np.maximum(1 - similar, 0), self.percentile)


class _NeedsModel(Signal):
    """A signal whose network weights this environment does not have; give a function of two images instead."""

    def __init__(self, model: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, percentile: float = 99.0) -> None:
        if model is None:
            raise ImportError(f"{self.name} needs a model: pass a function from two images to a map of distances")
        self.model, self.percentile = model, percentile

    def compute(self, real: np.ndarray, edited: np.ndarray) -> np.ndarray:
        found = np.asarray(self.model(real, edited), float)
        return kernels.normalized(kernels.resize(found, *real.shape[:2]), self.percentile)


class PerceptualDifference(_NeedsModel):
    name = "lpips"


class PatchDifference(_NeedsModel):
    """model gives a (2, rows, columns, features) array of patch features; the map is 1 - their cosine."""

    name = "dinov2"

    def compute(self, real: np.ndarray, edited: np.ndarray) -> np.ndarray:
        a, b = np.asarray(self.model(real, edited), float)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
        return kernels.normalized(kernels.resize(1 - (unit(a) * unit(b)).sum(axis=-1), *real.shape[:2]), self.percentile)


def combine_max(maps: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum.reduce(list(maps.values()))


def combine_mean(maps: dict[str, np.ndarray]) -> np.ndarray:
    return np.mean(list(maps.values()), axis=0)


COMBINERS = {"max": combine_max, "mean": combine_mean}
SIGNALS = {"lab_pixel": LabDifference, "ssim": SsimDifference, "lpips": PerceptualDifference, "dinov2": PatchDifference}


@dataclass(frozen=True)
class MaskConfig:
    min_side: int = 64
    allow_resize_align: bool = True
    global_area: float = 0.90
    global_mean: float = 0.40
    ambiguous_area: float = 0.005
    disk_radius: int = 2
    least_component: float = 0.001
    skip_refinement_on_global: bool = True
    combiner: str = "max"
    signals: tuple[Signal, ...] = field(default_factory=lambda: (LabDifference(),))


# The mean difference from which a whole image counts as edited, calibrated by signal stack.
GLOBAL_MEAN = {"lab_plus_ssim": 0.52, "lab_plus_lpips": 0.56, "lab_plus_lpips_plus_ssim": 0.62}


def preset(name: str, **models) -> MaskConfig:
    """A named signal stack; those with networks need ``lpips`` or ``dinov2`` functions."""
    stacks = {
        "lab": ("lab_pixel",), "lab_plus_ssim": ("lab_pixel", "ssim"), "lab_plus_lpips": ("lab_pixel", "lpips"),
        "lab_plus_lpips_plus_ssim": ("lab_pixel", "lpips", "ssim"), "lab_lpips_dinov2": ("lab_pixel", "lpips", "dinov2"),
        "lab_lpips_dinov2_mean": ("lab_pixel", "lpips", "dinov2"),
    }
    calibrated = name.endswith("_calibrated")
    base = name.removesuffix("_calibrated")
    made = tuple(SIGNALS[s](models.get(s)) if s in ("lpips", "dinov2") else SIGNALS[s]() for s in stacks[base])
    level = GLOBAL_MEAN[base] if calibrated else 0.15 if base.endswith("_mean") else 0.40
    return MaskConfig(signals=made, combiner="mean" if base.endswith("_mean") else "max", global_mean=level)


def align(real: np.ndarray, edited: np.ndarray, config: MaskConfig) -> tuple[np.ndarray, np.ndarray, bool]:
    """Both images in the real one's size, itself enlarged if small; and whether they may count as aligned."""
    h, w = real.shape[:2]
    if min(h, w) < config.min_side:
        scale = config.min_side / min(h, w)
        real = kernels.resize(real, max(config.min_side, round(h * scale)), max(config.min_side, round(w * scale)))
    same = edited.shape[:2] == real.shape[:2]
    return real, kernels.resize(edited, *real.shape[:2]), same or config.allow_resize_align


def route(combined: np.ndarray, config: MaskConfig) -> tuple[np.ndarray, str, float]:
    """Mask, scope and confidence of a combined map; uniform and widely high maps are not split by a threshold."""
    mean = float(combined.mean())
    flat = float(combined.std()) < 1e-4
    whole, none = np.ones(combined.shape, bool), np.zeros(combined.shape, bool)
    if mean >= (0.5 if flat else config.global_mean):
        return whole, "global", min(max(mean, 0.0), 1.0)
    if flat:
        return none, "ambiguous", 0.0
    mask = combined > kernels.otsu(combined)
    area = float(mask.mean())
    contrast = 0.0 if area in (0.0, 1.0) else float(np.clip(combined[mask].mean() - combined[~mask].mean(), 0, 1))
    if area >= config.global_area:
        return whole, "global", contrast
    return mask, "ambiguous" if area <= config.ambiguous_area else "local", contrast


def refine(mask: np.ndarray, config: MaskConfig) -> np.ndarray:
    """Without speckle, small holes, and components below the least area."""
    clean = kernels.closed(kernels.opened(mask, config.disk_radius), config.disk_radius)
    return kernels.without_small(clean, max(1, int(config.least_component * mask.size)))


def artifact(maps: dict[str, np.ndarray], registered: bool, config: MaskConfig) -> dict:
    """All of a pair's mask columns, with the mask as PNG and its place, so later stages need no images."""
    combined = COMBINERS[config.combiner](maps)
    means = {n: float(m.mean()) for n, m in maps.items()}
    mask, scope, confidence = route(combined, config)
    if not (scope == "global" and config.skip_refinement_on_global):
        mask = refine(mask, config)
        if scope == "local" and mask.mean() < config.ambiguous_area:
            scope = "ambiguous"
    if not registered:
        scope = "alignment_failed"
    return {
        "mask_area_frac": float(mask.mean()), "edit_scope": scope, "registration_ok": registered, "confidence": confidence,
        "diff_strongest_signal": max(means, key=means.get), "combined_diff_mean": float(combined.mean()),
        "mask_compactness": kernels.compactness(mask), "spatial_descriptor": kernels.spatial_descriptor(mask, scope), "mask_png": png.encode(mask),
    }


def structural_change(real: np.ndarray, edited: np.ndarray, side: int = 256) -> float:
    """1 - SSIM of both images in gray at a fixed size, within [0, 1]."""
    a, b = (kernels.resize(kernels.gray(x), side, side) for x in (real, edited))
    return float(np.clip(1 - kernels.ssim(a, b), 0, 1))


_SCHEMA = "triplet_id string, mask_area_frac double, edit_scope string, registration_ok boolean, confidence double, diff_strongest_signal string, combined_diff_mean double, mask_compactness double, spatial_descriptor string, structural_change double, mask_png binary, error string"


def generate_masks(pairs: DataFrame, config: MaskConfig = MaskConfig()) -> DataFrame:
    """Mask artifacts of rows (triplet_id, real, edited), the images as PNG bytes.

    A pair that fails has its message in ``error`` and nulls elsewhere. Signals get whole Arrow batches;
    where a batch fails, its pairs are done one by one.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def one(real: np.ndarray, edited: np.ndarray, maps: dict | None, registered: bool) -> dict:
        maps = maps or {s.name: s.compute(real, edited) for s in config.signals}
        return artifact(maps, registered, config) | {"structural_change": structural_change(real, edited)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ready, out = [], []
            for row in frame.itertuples(index=False):
                try:
                    ready.append((row.triplet_id, *align(color(png.decode(row.real)), color(png.decode(row.edited)), config)))
                except Exception as e:
                    out.append({"triplet_id": row.triplet_id, "error": f"{type(e).__name__}: {e}"})
            try:
                pairs_ = [(r, e) for _, r, e, _ in ready]
                batches = {s.name: s.compute_batch(pairs_) for s in config.signals}
                maps = [{n: m[i] for n, m in batches.items()} for i in range(len(ready))]
            except Exception:
                maps = [None] * len(ready)
            for (name, real, edited, registered), own in zip(ready, maps, strict=True):
                try:
                    out.append({"triplet_id": name} | one(real, edited, own, registered))
                except Exception as e:
                    out.append({"triplet_id": name, "error": f"{type(e).__name__}: {e}"})
            made = pd.DataFrame(out, columns=names).astype(object)
            yield made.where(made.notna(), None)

    return pairs.select("triplet_id", "real", "edited").mapInPandas(run, _SCHEMA)


def color(pixels: np.ndarray) -> np.ndarray:
    return np.repeat(pixels[..., None], 3, axis=2) if pixels.ndim == 2 else pixels[..., :3]


def compare_masks(rows: DataFrame, a: str = "mask_a", b: str = "mask_b") -> DataFrame:
    """(triplet_id, iou, dice, area_a, area_b) of PNG masks; a missing mask gives nulls, another size is resized to a's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, x, y in zip(frame["triplet_id"], frame[a], frame[b], strict=True):
                if x is None or y is None:
                    out.append((name, None, None, None, None))
                    continue
                x, y = (kernels.stored_mask(png.decode(m)) for m in (x, y))
                out.append((name, *kernels.overlap(x, y), float(x.mean()), float(y.mean())))
            yield pd.DataFrame(out, columns=["triplet_id", "iou", "dice", "area_a", "area_b"])

    return rows.select("triplet_id", a, b).mapInPandas(run, "triplet_id string, iou double, dice double, area_a double, area_b double")
