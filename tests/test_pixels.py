"""Reading and shrinking of uncompressed rasters, against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from twinsift.functions import fingerprint as fp
from twinsift.functions import pixels

RASTER = "id long, width int, height int, raster binary"


def brute(w, h, data, size):
    step = 1
    while (h // 2) // step >= size and (w // 2) // step >= size:
        step *= 2
    cw, ch = max(1, w // step), max(1, h // step)
    tw, th = cw, ch
    if max(cw, ch) > size:
        factor = np.float32(size) / np.float32(max(cw, ch))
        tw, th = (max(1, int(np.float32(s) * factor)) for s in (cw, ch))
    out = []
    for j in range(th):
        for i in range(tw):
            x, y = max(0, (2 * i + 1) * cw - tw), max(0, (2 * j + 1) * ch - th)
            x0, u, y0, v = x // (2 * tw), x % (2 * tw), y // (2 * th), y % (2 * th)
            x1, y1 = min(x0 + 1, cw - 1), min(y0 + 1, ch - 1)
            value = 0
            for c in range(3):
                p = lambda a, b, c=c: data[(b * step * w + a * step) * 3 + c]
                upper, lower = (p(x0, r) * (2 * tw - u) + p(x1, r) * u for r in (y0, y1))
                value = value << 8 | (upper * (2 * th - v) + lower * v + 2 * tw * th) // (4 * tw * th)
            out.append(value)
    return step, tw, th, out


def test_pictures_shrink_in_proportion(spark):
    rng = random.Random(3)
    sides = [(1, 1), (16, 16), (17, 16), (1, 90), (90, 1), (31, 32), (32, 32), (33, 64), (64, 65), (200, 37), (300, 130), (3, 7)]
    rows = [(i, w, h, rng.randbytes(w * h * 3)) for i, (w, h) in enumerate(sides)]
    for size in (1, 8, 16):
        found = pixels.shrink(spark.createDataFrame(rows, RASTER).withColumn("step_of", F.lit(0)), size)
        got = {r["id"]: (r["step"], r["width"], r["height"], list(r["raster"])) for r in found.collect()}
        assert got == {i: brute(w, h, data, size) for i, w, h, data in rows}
        assert "step_of" in found.columns and "to_width" not in found.columns
    # A picture of one colour keeps it, and a ramp keeps its order: its hash has no falling step.
    flat = spark.createDataFrame([(1, 300, 200, bytes([9, 200, 31]) * 60_000)], RASTER)
    assert set(pixels.shrink(flat).first()["raster"]) == {9 << 16 | 200 << 8 | 31}
    ramp = spark.createDataFrame([(1, 250, 100, bytes(v for _ in range(100) for x in range(250) for v in (x, x, x)))], RASTER)
    assert pixels.shrink(ramp, 64).select(fp.difference_hash(F.col("raster"), F.col("width"), F.col("height"))).first()[0] == 0


def test_rows_without_a_picture(spark):
    rows = [(1, None, 4, b"x" * 48), (2, 4, 4, None), (3, 4, 4, b"x" * 47), (4, 0, 4, b""), (5, 4, -1, b"x" * 48), (6, 4, 4, b"x" * 49)]
    got = {r["id"]: (r["step"], r["width"], r["height"], r["raster"] is None) for r in pixels.shrink(spark.createDataFrame(rows, RASTER), 2).collect()}
    assert got == {i: (0, 0, 0, True) for i in range(1, 6)} | {6: (2, 2, 2, False)}
    assert pixels.shrink(spark.createDataFrame([], RASTER)).count() == 0


def test_pixel_maps_are_read(spark, tmp_path):
    body = bytes(range(256)) * 3
    files = {
        "a.ppm": b"P6\n16 16\n255\n" + body,
        "sub/b.ppm": b"P6 # made by hand\n# twice\n 4\t2\n255 " + b"\n\r  P6" + b"z" * 18,
        "short.ppm": b"P6\n16 16\n255\n" + body[:-1],
        "text.ppm": b"P3\n1 1\n255\n1 2 3\n",
        "deep.ppm": b"P6\n1 1\n65535\n123456",
        "empty.ppm": b"",
        "none.txt": b"P6\n1 1\n255\nabc",
    }
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], None if r["raster"] is None else bytes(r["raster"])) for r in pixels.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {"a.ppm": (16, 16, body), "b.ppm": (4, 2, b"\n\r  P6" + b"z" * 18), "short.ppm": (None,) * 3, "text.ppm": (None,) * 3, "deep.ppm": (None,) * 3}  # files without bytes are not listed
    assert pixels.shrink(pixels.read_rasters(spark, str(tmp_path))).where("raster is not null").count() == 2
