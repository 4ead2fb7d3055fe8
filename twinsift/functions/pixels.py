"""Uncompressed rasters: reading, power-of-two subsampling and shrinking to a largest side, before fingerprints are taken.

A raster is binary, three bytes (red, green, blue) for each pixel, row by row. Decoding of compressed formats is left to the caller.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def sample_step(width: Column, height: Column, size: int) -> Column:
    """The first power of two at which half of the width or of the height has fewer than `size` samples; 1 for small pictures."""
    most = F.floor(F.floor(F.least(width, height) / 2) / size).cast("long")
    return F.when(most < 1, 1).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(most)))).cast("int")


def shrunk_side(side: Column, largest: Column, size: int) -> Column:
    """A side after the largest was brought down to `size`; the factor is a single-precision number, as its cut-off matters."""
    factor = (F.lit(float(size)).cast("float") / largest.cast("float")).cast("float")
    return F.when(largest <= size, side).otherwise(F.greatest(F.lit(1), (side.cast("float") * factor).cast("int"))).cast("int")


def _resampled(picture, step: int, width: int, height: int):
    """height by width pixels between those of every step-th row and column; whole-number arithmetic, halves go up."""
    import numpy as np

    rows, columns = (max(1, n // step) for n in picture.shape[:2])
    picture = picture[::step, ::step][:rows, :columns].astype(np.int64)

    def places(n: int, to: int):
        at = np.maximum((2 * np.arange(to) + 1) * n - to, 0)
        first = np.minimum(at // (2 * to), n - 1)
        return first, np.minimum(first + 1, n - 1), at % (2 * to), 2 * to

    y0, y1, v, tall = places(rows, height)
    x0, x1, u, wide = places(columns, width)
    u, v = u[None, :, None], v[:, None, None]
    upper, lower = (picture[y][:, x0] * (wide - u) + picture[y][:, x1] * u for y in (y0, y1))
    mixed = (upper * (tall - v) + lower * v + tall * wide // 2) // (tall * wide)
    return (mixed[..., 0] << 16 | mixed[..., 1] << 8 | mixed[..., 2]).ravel()


def shrink(rasters: DataFrame, size: int = 256) -> DataFrame:
    """rasters (width, height, raster, other columns) with step, and with raster as 0xRRGGBB numbers whose larger side is at most `size`.

    Pictures are first cut to every step-th pixel, then brought down in proportion, between pixels where a place falls between;
    small ones stay as they are. Rows without pixels, or with fewer bytes than their sides say, have null raster, sides 0 and step 0.
    Pictures go to Python in Arrow batches, whose bytes spark.sql.execution.arrow.maxBytesPerBatch bounds."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<int>")
    def resampled(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for raster, w, h, step, to_w, to_h in parts:
            out = [None if b is None else _resampled(np.frombuffer(b, np.uint8, 3 * x * y).reshape(y, x, 3), k, i, j) for b, x, y, k, i, j in zip(raster, w, h, step, to_w, to_h, strict=True)]
            yield pd.Series(out, dtype=object)

    width, height = F.col("width"), F.col("height")
    good = F.coalesce((width > 0) & (height > 0) & (F.octet_length("raster") >= width.cast("long") * height * 3), F.lit(False))
    whole = lambda c: F.when(good, c).otherwise(0)
    rows = rasters.withColumns({"raster": F.when(good, F.col("raster")), "width": whole(width), "height": whole(height), "step": whole(sample_step(width, height, size))})
    cut = lambda side: F.greatest(F.lit(1), F.floor(side / F.col("step"))).cast("int")
    largest = F.greatest(cut(width), cut(height))
    to = lambda side: F.when(F.col("step") > 0, shrunk_side(cut(side), largest, size)).otherwise(0)
    rows = rows.withColumns({"to_width": to(width), "to_height": to(height)})
    rows = rows.withColumn("raster", resampled("raster", "width", "height", "step", "to_width", "to_height"))
    return rows.withColumns({"width": F.col("to_width"), "height": F.col("to_height")}).drop("to_width", "to_height")


def read_rasters(spark: SparkSession, path: str, pattern: str = "*.ppm") -> DataFrame:
    """(path, width, height, raster) of binary pixel maps: `P6`, width, height and 255, parted by white space, then the bytes.

    Comments may stand in the head. Files of another form, or cut off, have null sides and raster; those without bytes are not listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    gap = r"(?:\s|#[^\n]*\n)+"
    # One byte is one letter of this charset, so places in the head are places in the file.
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    form = rf"^P6{gap}(\d{{1,5}}){gap}(\d{{1,5}}){gap}255\s"
    found = files.select("path", "content", F.regexp_substr(head, F.lit(form)).alias("h"))
    side = lambda i: F.regexp_extract("h", form, i).try_cast("int")
    rows = found.select("path", side(1).alias("width"), side(2).alias("height"), F.expr("substring(content, length(h) + 1)").alias("raster"))
    good = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("raster") >= F.col("width").cast("long") * F.col("height") * 3), F.lit(False))
    return rows.select("path", *(F.when(good, F.col(c)).alias(c) for c in ("width", "height", "raster")))
