import numpy as np
import pytest

from quernworks.image import kernels, masks, png


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (5, 7, 3), (4, 3, 4)):
        x = rng.integers(0, 256, shape, np.uint8)
        assert (png.decode(png.encode(x)) == x).all()


def filtered_png(x, methods):
    """A PNG whose rows are filtered byte by byte as the format's specification says."""
    import struct
    import zlib

    h, w, n = x.shape
    flat, body = x.reshape(h, w * n).astype(int), bytearray()
    for y in range(h):
        body.append(methods[y])
        for i in range(w * n):
            a = flat[y, i - n] if i >= n else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - n] if y and i >= n else 0
            nearest = min((abs(a + b - c - v), k, v) for k, v in enumerate((a, b, c)))[2]
            body.append((flat[y, i] - (0, a, b, (a + b) // 2, nearest)[methods[y]]) % 256)
    kind = {1: 0, 3: 2, 4: 6}[n]
    return png._MAGIC + png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(bytes(body))) + png._chunk(b"IEND", b"")


def test_png_row_filters():
    rng = np.random.default_rng(1)
    for shape in ((9, 6, 3), (4, 11, 4), (1, 5, 3), (6, 1, 1), (12, 12, 1)):
        x = rng.integers(0, 256, shape, np.uint8)
        for methods in (rng.integers(0, 5, shape[0]), np.full(shape[0], 4), np.full(shape[0], 3)):
            assert (png.decode(filtered_png(x, methods)).reshape(shape) == x).all()
    with pytest.raises(ValueError, match="filter"):
        png.decode(filtered_png(x, np.zeros(12, int)).replace(b"IDAT", b"IDAT")[:33] + png._chunk(b"IDAT", __import__("zlib").compress(bytes([9] + [0] * 12) * 12)) + png._chunk(b"IEND", b""))


def test_stored_masks_are_white_for_edited():
    quarter = np.zeros((8, 8, 3), np.uint8)
    quarter[:4, :4] = 255
    assert kernels.stored_mask(quarter).mean() == 0.25 and kernels.stored_mask(quarter[..., 0]).mean() == 0.25
    assert kernels.stored_mask(np.dstack([quarter, np.zeros((8, 8), np.uint8)])).mean() == 0.25
    assert kernels.provided_mask(quarter).mean() == 0.75  # on ingest, black of a color image is edited
    gray = np.array([[127, 128]], np.uint8)
    assert kernels.stored_mask(gray).tolist() == [[False, True]] == kernels.stored_mask(np.repeat(gray[..., None], 3, axis=2)).tolist()


def box(h, w, y0, y1, x0, x1):
    m = np.zeros((h, w), bool)
    m[y0:y1, x0:x1] = True
    return m


def test_compactness():
    assert kernels.compactness(np.zeros((8, 8), bool)) == 0.0
    assert kernels.compactness(np.ones((8, 8), bool)) == 1.0
    bend = np.ones((8, 8), bool)
    bend[:4, 4:] = False
    assert kernels.compactness(bend) == pytest.approx(0.75**0.5)
    two = box(10, 10, 0, 5, 0, 5) | box(10, 10, 5, 10, 5, 10)
    assert kernels.compactness(two) == pytest.approx((0.5 * 0.5) ** 0.5)
    assert len(kernels.areas(kernels.components(two, False))) == 2 and len(kernels.areas(kernels.components(two, True))) == 1


def test_spatial_descriptors():
    assert kernels.spatial_descriptor(np.ones((8, 8), bool), "global") == "whole_image"
    assert kernels.spatial_descriptor(np.zeros((8, 8), bool), "local") == "alignment_failed"
    assert kernels.spatial_descriptor(box(100, 100, 0, 10, 0, 10), "local") == "upper_left"
    assert kernels.spatial_descriptor(box(100, 100, 90, 100, 0, 10), "local") == "lower_left"
    assert kernels.spatial_descriptor(box(100, 100, 0, 10, 90, 100), "local") == "upper_right"
    assert kernels.spatial_descriptor(box(100, 100, 45, 55, 45, 55), "local") == "centered"
    dots = np.zeros((20, 20), bool)
    dots[::5, ::5] = True
    assert kernels.spatial_descriptor(dots, "local") == "scattered"


def test_overlap():
    a, none = box(8, 8, 0, 4, 0, 8), np.zeros((8, 8), bool)
    assert kernels.overlap(a, a) == (1, 1) and kernels.overlap(none, none) == (1, 1) and kernels.overlap(a, none) == (0, 0)
    assert kernels.overlap(a, box(16, 16, 0, 8, 0, 16)) == (1, 1)


def make(real, edited, config=masks.MaskConfig()):
    r, e, ok = masks.align(real, edited, config)
    return masks.artifact({s.name: s.compute(r, e) for s in config.signals}, ok, config)


def test_corner_edit_is_local():
    real = np.full((64, 64, 3), 128, np.uint8)
    edited = real.copy()
    edited[:24, :24] = (220, 30, 30)
    got = make(real, edited)
    mask = png.decode(got["mask_png"]) > 127
    assert got["edit_scope"] == "local" and mask[:24, :24].mean() > 0.7 and mask[40:, 40:].mean() < 0.05 and got["spatial_descriptor"] == "upper_left"
    both = make(real, edited, masks.preset("lab_plus_ssim"))
    assert both["edit_scope"] == "local" and both["diff_strongest_signal"] in ("lab_pixel", "ssim")


def test_global_identical_and_speckle():
    rng = np.random.default_rng(0)
    real = rng.integers(0, 190, (64, 64, 3), np.uint8)
    got = make(real, real + 60)
    assert got["edit_scope"] == "global" and got["mask_area_frac"] == 1.0
    same = make(real[:32, :32], real[:32, :32])
    assert same["edit_scope"] == "ambiguous" and same["mask_area_frac"] == 0
    flat = np.full((128, 128, 3), 128, np.uint8)
    dot = flat.copy()
    dot[60, 60] = 255
    assert make(flat, dot)["edit_scope"] == "ambiguous"


def test_alignment():
    a, b = np.zeros((64, 64, 3), np.uint8), np.zeros((48, 48, 3), np.uint8)
    assert masks.align(a, b, masks.MaskConfig())[2] and not masks.align(a, b, masks.MaskConfig(allow_resize_align=False))[2]
    assert make(a, b, masks.MaskConfig(allow_resize_align=False))["edit_scope"] == "alignment_failed"


def test_kernels():
    white = kernels.lab(np.full((1, 1, 3), 255, np.uint8))[0, 0]
    assert white == pytest.approx([100, 0, 0], abs=0.02)
    x = np.random.default_rng(1).random((40, 40))
    assert kernels.ssim(x, x) == pytest.approx(1) and kernels.ssim(x, 1 - x) < 0
    assert kernels.otsu(np.array([0.1] * 50 + [0.9] * 50)) == pytest.approx(0.1, abs=0.4)
    assert (kernels.normalized(np.zeros((3, 3))) == 0).all()
    with pytest.raises(ValueError):
        kernels.normalized(x, 20)
    assert kernels.fit_long_side(np.zeros((900, 450, 3), np.uint8)).shape == (448, 224, 3)
    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[0, 0, 3] = 255
    assert kernels.provided_mask(rgba).tolist() == [[False, True], [True, True]]
    with pytest.raises(ImportError):
        masks.PerceptualDifference()
    patches = masks.PatchDifference(lambda r, e: np.stack([np.eye(4).reshape(2, 2, 4), np.eye(4)[::-1].reshape(2, 2, 4)]))
    assert patches.compute(np.zeros((8, 8, 3)), np.zeros((8, 8, 3))).max() == 1


def test_mask_stage_keeps_failures(spark):
    real = np.full((64, 64, 3), 128, np.uint8)
    edited = real.copy()
    edited[:24, :24] = 250
    rows = spark.createDataFrame([("a", bytearray(png.encode(real)), bytearray(png.encode(edited))), ("b", bytearray(b"no image"), bytearray(b""))], "triplet_id string, real binary, edited binary")
    got = {r.triplet_id: r for r in masks.generate_masks(rows).collect()}
    assert got["a"].edit_scope == "local" and got["a"].error is None and 0 <= got["a"].structural_change <= 1 and "ValueError" in got["b"].error
    pair = spark.createDataFrame([("a", bytearray(got["a"].mask_png), bytearray(got["a"].mask_png)), ("x", None, bytearray(b""))], "triplet_id string, mask_a binary, mask_b binary")
    same = {r.triplet_id: r for r in masks.compare_masks(pair).collect()}
    assert same["a"].iou == 1.0 and same["x"].iou is None
