"""Statistics of rasters: equal to the pixel form where nothing is reduced, limits of size and alpha, rows that are no image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partmill.operators import images, rasters

SCHEMA = "image_id long, width int, height int, mode string, raster binary"
NAMES = ["image_id", "n", "n_colors", "spread", "mean_hue", "is_colored", "is_black", "hue"]


def frame(spark, pictures):
    rows = [(k, p.shape[1], p.shape[0], mode, p.astype(np.uint8).tobytes()) for k, mode, p in pictures]
    return spark.createDataFrame(rows, SCHEMA)


def noise(seed, height, width, channels=3, low=0, high=256):
    return np.random.default_rng(seed).integers(low, high, (height, width, channels))


def test_equal_to_the_pixel_form_where_nothing_is_reduced(spark):
    pictures = [(0, "RGB", noise(0, 120, 120)), (1, "RGB", noise(1, 7, 120, 3, 70, 80)), (2, "RGB", noise(2, 80, 3, 3, 235)), (3, "RGB", np.repeat(noise(3, 50, 50, 1), 3, axis=2)), (4, "RGB", noise(4, 1, 1))]
    whole = frame(spark, pictures)
    rows = [(k, int(r), int(g), int(b)) for k, _, p in pictures for r, g, b in p.reshape(-1, 3)]
    pixels = images.pixel_stats(spark.createDataFrame(rows, "image_id long, r int, g int, b int"), whole.select("image_id", "width", "height"))
    want = {r.image_id: r for r in pixels.select(*NAMES, "is_photo").collect()}
    got = {r.image_id: r for r in rasters.raster_stats(whole).collect()}
    for k in want:
        for c in (*NAMES, "is_photo"):
            a, b = got[k][c], want[k][c]
            assert a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b), (k, c)
    assert got[0].is_photo and got[1].is_black


def test_a_thumbnail_by_definition():
    """Against the convolution written out for every pixel, sizes on both sides of the limit and of the box means."""
    for h, w in ((121, 120), (120, 121), (300, 40), (37, 500), (1, 1000)):
        p = noise(h, h, w).astype(np.uint8)
        to_w, to_h = rasters.fitted(w, h, 120)
        across, down = max(int(w / to_w / 2), 1), max(int(h / to_h / 2), 1)
        boxes = [[[int(np.mean(p[y : y + down, x : x + across, c].astype(float)) + 0.5) for c in range(3)] for x in range(0, w, across)] for y in range(0, h, down)]

        def line(values, extent, out):
            scale = extent / out
            z, found = max(scale, 1), []
            for o in range(out):
                c = (o + 0.5) * scale
                taps = range(int(max(c - 2 * z + 0.5, 0)), int(min(c + 2 * z + 0.5, len(values))))
                t = [abs((i - c + 0.5) / z) for i in taps]
                k = [1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0 for x in t]
                k = [round(x / sum(k) * 2**22) for x in k]
                found.append([min(max((sum(a * values[i][ch] for a, i in zip(k, taps)) + 2**21) >> 22, 0), 255) for ch in range(3)])
            return found

        rows = [line(r, w / across, to_w) for r in boxes]
        columns = [line([r[x] for r in rows], h / down, to_h) for x in range(to_w)]
        assert (rasters.thumbnail(p, 120) == np.array(columns).transpose(1, 0, 2)).all(), (h, w)


@pytest.mark.parametrize("width, height, want", [(119, 80, False), (120, 79, False), (120, 80, True), (120, 185, False), (120, 184, True), (480, 160, True), (481, 160, False)])
def test_limits_of_size(spark, width, height, want):
    smooth = np.stack(np.broadcast_arrays(np.arange(width) * 255 // width, (np.arange(height) * 255 // height)[:, None], 90), axis=2)
    assert rasters.raster_stats(frame(spark, [(1, "RGB", smooth)])).first().is_photo is want


def test_alpha_lays_an_image_over_white():
    for a, want in ((0, 255), (128, 255 - round(255 * 128 / 255)), (255, 0)):
        plain, laid = rasters.planes(np.array([[[0, 0, 0, a]]], dtype=np.uint8), "RGBA")
        assert laid[0, 0].tolist() == [want] * 3 and plain[0, 0].tolist() == [0] * 3
    plain, laid = rasters.planes(np.array([[[10, 128]]], dtype=np.uint8), "LA")
    assert plain[0, 0].tolist() == [10] * 3 and laid[0, 0].tolist() == [132] * 3
    every = np.stack(np.meshgrid(np.arange(256), np.arange(256)), axis=2).astype(np.uint8)
    exact = np.round((every[..., 0] * (every[..., 1] / 255.0) + (255.0 - every[..., 1])))
    assert (rasters.planes(every, "LA")[1][..., 0] == exact).all()


def test_modes_and_rows_that_are_no_image(spark):
    dark = np.full((80, 120, 1), 20)
    clear = np.concatenate([noise(5, 100, 140), np.zeros((100, 140, 1))], axis=2)
    good = frame(spark, [(1, "L", dark), (2, "1", dark * 0), (3, "RGBA", clear)])
    bad = spark.createDataFrame([(4, 2, 2, "RGB", b"123"), (5, None, 2, "L", b"12"), (6, 1, 1, "CMYK", b"1234"), (7, 0, 0, "L", b""), (8, 1, 1, "L", None), (None, 1, 1, None, b"1")], SCHEMA)
    got = {r.image_id: r for r in rasters.raster_stats(good.unionByName(bad).withColumn("n", F.lit("clash"))).collect()}
    assert got[1].is_black and not got[2].is_black and not got[2].is_photo
    assert got[3].is_colored and got[3].n_colors == 1 and not got[3].is_photo  # nothing is left of it over white
    for k in (4, 5, 6, 7, 8, None):
        assert got[k].n is None and got[k].hue == "" and not (got[k].is_photo or got[k].is_black or got[k].is_colored)
    assert rasters.raster_stats(good.limit(0)).count() == 0
    assert rasters.raster_stats(good.unionByName(good)).count() == 6
