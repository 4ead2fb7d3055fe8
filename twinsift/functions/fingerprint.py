"""Fingerprint kernels as column expressions: difference hash, colour histogram, distances, quality, sample times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift import schema


def channel(pixel: Column, shift: int) -> Column:
    return F.shiftright(pixel, shift).bitwiseAND(F.lit(255))


def gray(pixel: Column) -> Column:
    return F.lit(0.299) * channel(pixel, 16) + F.lit(0.587) * channel(pixel, 8) + F.lit(0.114) * channel(pixel, 0)


def _sampled(luma: Column, width: Column, height: Column) -> Column:
    """The 9 by 8 grid of gray levels, between pixels where it falls between."""

    def at(x: Column, y: Column) -> Column:
        x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
        x1, y1 = F.least(x0 + 1, width - 1), F.least(y0 + 1, height - 1)
        u, v = x - x0, y - y0
        p = lambda i, j: F.get(luma, j * width + i)
        upper = p(x0, y0) * (1 - u) + p(x1, y0) * u
        lower = p(x0, y1) * (1 - u) + p(x1, y1) * u
        return upper * (1 - v) + lower * v

    return F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: at((width - 1) * (k % 9) / F.lit(8.0), (height - 1) * F.floor(k / 9) / F.lit(7.0)))


def difference_hash(raster: Column, width: Column, height: Column) -> Column:
    """64 bits, row by row, first bit highest: 1 where a sample is brighter than its right neighbour; -1 if there is no image.

    raster: array of 0xRRGGBB or ARGB numbers. Nested transforms bind each step once.
    """

    def folded(grid: Column) -> Column:
        bit = lambda i: F.when(F.get(grid, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(grid, F.floor(i / 8).cast("int") * 9 + i % 8 + 1), 1).otherwise(0).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))

    grids = F.transform(F.array(F.transform(raster, gray)), lambda luma: _sampled(luma, width, height))
    good = raster.isNotNull() & (width > 0) & (height > 0) & (width <= 16384) & (height <= 16384)
    return F.when(good, F.transform(grids, folded)[0]).otherwise(F.lit(schema.INVALID_HASH).cast("long"))


def color_histogram(raster: Column) -> Column:
    """24 numbers: for each of 8 levels its share of red, green and blue, each channel's sum being 16."""
    cells = F.sequence(F.lit(0), F.lit(23))

    def share(cell: Column) -> Column:
        level, which = F.floor(cell / 3), cell % 3
        value = lambda p: F.when(which == 0, channel(p, 16)).when(which == 1, channel(p, 8)).otherwise(channel(p, 0))
        return F.size(F.filter(raster, lambda p: F.floor(value(p) / 32) == level)) / (F.size(raster) / F.lit(16.0))

    return F.when(F.size(raster) > 0, F.transform(cells, share))


def is_valid(image_hash: Column, color: Column) -> Column:
    return image_hash.isNotNull() & (image_hash != schema.INVALID_HASH) & color.isNotNull() & (F.size(color) > 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def color_distance(a: Column, b: Column) -> Column:
    """Sum of the 24 differences, cut to whole numbers; written out, so that it is compiled."""
    return sum((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(24)), F.lit(0.0)).cast("long")


def is_similar(kind: str, distance: Column, color: Column) -> Column:
    """The ranges include both ends and any of them is enough. The colour distance stands last and once, as it is dear."""
    most, direct, ranges = schema.LIMITS[kind]
    limit = F.lit(-1)
    for low, high, c in sorted(ranges, key=lambda r: r[2]):
        limit = F.when(distance.between(low, high), c).otherwise(limit)
    return (distance < most) & ((distance <= direct) | (color <= limit))


def same_looks(a: Column, b: Column, color_a: Column, color_b: Column) -> Column:
    return (a == b) & (color_distance(color_a, color_b) == 0)


def low_information(raster: Column) -> Column:
    """Frames with little contrast and few edges."""
    luma = F.transform(raster, lambda p: F.floor((channel(p, 16) * 299 + channel(p, 8) * 587 + channel(p, 0) * 114) / 1000).cast("int"))

    def flat(y: Column) -> Column:
        steps = F.transform(F.slice(y, F.lit(2), F.size(y)), lambda v, i: F.abs(v - F.get(y, i)))
        edges = F.aggregate(steps, F.lit(0).cast("long"), lambda s, v: s + v) / F.greatest(F.lit(1), F.size(y) - 1)
        return (F.array_max(y) - F.array_min(y) < 8) & (edges < 2.0)

    return F.when(F.size(raster) > 0, F.transform(F.array(luma), flat)[0]).otherwise(F.lit(True))


def metadata_quality(width: Column, height: Column, favorite: Column, edited: Column) -> Column:
    """Megapixels up to 12 for 15 points; a favourite is worth 8, or else an edited picture 3."""
    pixels = width.cast("double") * height.cast("double") / 1_000_000.0
    return F.least(F.lit(1.0), pixels / 12.0) * 15.0 + F.when(favorite, 8.0).when(edited, 3.0).otherwise(0.0)


def full_quality(raster: Column, width: Column, height: Column, metadata: Column) -> Column:
    """Sharpness, exposure and clipping of 64 by 64 samples, with the metadata's points."""
    n = 64

    def sample(k: Column) -> Column:
        x = F.least(F.greatest(F.floor((k % n + 0.5) * width / n), F.lit(0)), width - 1)
        y = F.least(F.greatest(F.floor((F.floor(k / n) + 0.5) * height / n), F.lit(0)), height - 1)
        p = F.get(raster, (y * width + x).cast("int"))
        return F.floor((channel(p, 16) * 299 + channel(p, 8) * 587 + channel(p, 0) * 114) / 1000).cast("double")

    def points(y: Column) -> Column:
        across = F.aggregate(F.transform(y, lambda v, i: F.when(i % n > 0, F.abs(v - F.get(y, i - 1))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        down = F.aggregate(F.transform(y, lambda v, i: F.when(i >= n, F.abs(v - F.get(y, i - n))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
        mean = F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / (n * n)
        clipped = F.size(F.filter(y, lambda v: (v < 8) | (v > 247))) / F.lit(float(n * n))
        sharp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (across + down) / (n * n * 80.0)))
        return sharp * 50.0 + (1.0 - F.abs(mean - 128.0) / 128.0) * 18.0 + (1.0 - clipped) * 12.0

    samples = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), sample)
    return F.transform(F.array(samples), points)[0] + metadata


def buckets(image_hash: Column, width: Column, height: Column, duration_ms: Column, size_bytes: Column) -> dict[str, Column]:
    return {
        "hash_prefix": F.shiftrightunsigned(image_hash, 48).bitwiseAND(F.lit(65535)).cast("int"),
        "aspect_bucket": aspect_bucket(width, height),
        "duration_bucket": F.floor(duration_ms / 1000).cast("long"),
        "size_bucket": F.floor(size_bytes / (1 << 20)).cast("long"),
        "potential_identifier": F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit("_"), size_bytes.cast("string")),
    }


def aspect_bucket(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), (width.cast("double") / height.cast("double") * 100).cast("int")).otherwise(0)


# Sampled places of a video, by mode.
POSITIONS = {
    "FAST": [0.10, 0.50, 0.90],
    "BALANCED": [0.12, 0.38, 0.64, 0.88],
    "ADAPTIVE_BALANCED": [0.12, 0.38, 0.64, 0.88],
    "ACCURATE": [0.08, 0.22, 0.36, 0.50, 0.64, 0.78, 0.92],
}
REFERENCE_FRAMES, REFERENCE_MOST, REFERENCE_SHORT_MS, REFERENCE_LONG_MS = 7, 13, 2_000, 10_000


def reference_times(duration_ms: Column) -> Column:
    """Sample times in ms: 7 even ones, every 2 s of a short or every 10 s of a long video, 13 at most."""
    even = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.rint(i * (duration_ms / F.lit(n - 1.0))).cast("long"), duration_ms))
    steps = lambda ms: F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), duration_ms, F.lit(ms).cast("long")), F.array(duration_ms)))
    gap = duration_ms / F.lit(REFERENCE_FRAMES - 1.0)
    long_ = F.when(F.size(steps(REFERENCE_LONG_MS)) <= REFERENCE_MOST, steps(REFERENCE_LONG_MS)).otherwise(even(REFERENCE_MOST))
    times = F.when(gap < REFERENCE_SHORT_MS, steps(REFERENCE_SHORT_MS)).when(gap <= REFERENCE_LONG_MS, even(REFERENCE_FRAMES)).otherwise(long_)
    return F.when(duration_ms > 0, F.array_distinct(times)).otherwise(F.array(F.lit(0).cast("long")))


def sample_times(duration_ms: Column, mode: str) -> Column:
    """Sample times of a mode, in ms."""
    if mode == "REFERENCE_COMPAT":
        return F.transform(reference_times(duration_ms), lambda t: t.cast("double"))
    places = F.array_distinct(F.array(*(duration_ms * p for p in POSITIONS[mode])))
    return F.when(duration_ms > 0, places).otherwise(F.array(F.lit(0.0)))


def frame_source(mode: str, has_thumbnail: Column, valid_extracted: Column) -> Column:
    """Where a video's frames are from. valid_extracted: valid frames besides the thumbnail."""
    if mode == "REFERENCE_COMPAT":
        return F.lit("REFERENCE_FRAMES")
    balanced = mode in ("BALANCED", "ADAPTIVE_BALANCED")
    mixed = F.lit("HYBRID_THUMBNAIL_AND_FRAMES" if balanced else "MMR_FRAMES")
    return F.when(has_thumbnail & (valid_extracted == 0), "SYSTEM_THUMBNAIL").when(has_thumbnail, mixed).otherwise("MMR_FRAMES")


def color_from_text(text: Column) -> Column:
    """24 numbers from "a,b,c;..."; what is no number is 0."""
    return F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def color_to_text(color: Column) -> Column:
    rows = F.transform(F.sequence(F.lit(0), (F.size(color) / 3).cast("int") - 1), lambda i: F.array_join(F.transform(F.slice(color, i * 3 + 1, F.lit(3)), lambda x: x.cast("string")), ","))
    return F.array_join(rows, ";")


def size_text(size: Column) -> Column:
    """1023 B, 1.3 KB, ... GB."""
    x = size.cast("double")
    scaled = lambda power: F.format_string("%.1f", x / float(1 << power))
    return F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(scaled(10), F.lit(" KB"))).when(size < 1 << 30, F.concat(scaled(20), F.lit(" MB"))).otherwise(F.concat(scaled(30), F.lit(" GB")))


def day_text(ms: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """In the session's time zone."""
    return F.date_format(F.timestamp_millis(ms), pattern)


def clock_text(ms: Column) -> Column:
    """Minutes and seconds as m:ss."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def elapsed_text(ms: Column) -> Column:
    """Hours, minutes and seconds of a run; leading zero parts are left out."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
