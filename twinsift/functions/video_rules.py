"""Whether two videos' frames are alike: the rules as column expressions over the similar pairs of frames.

A match is a similar pair of frames: distance, colour distance, how far apart their numbers are, and the numbers i and j.
Frames are used up in the order of the rule; which are used is held in bits, as a video has at most 13 frames (62 are possible).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.functions import fingerprint as fp

SPREAD = 2  # frames between matches


def matches(kind: str, hashes_a: Column, colors_a: Column, hashes_b: Column, colors_b: Column) -> Column:
    """All similar pairs of valid frames of two videos."""
    frames = lambda h, c: F.filter(F.transform(F.arrays_zip(h.alias("h"), c.alias("c")), lambda x, i: F.struct(x["h"].alias("h"), x["c"].alias("c"), i.alias("i"))), lambda x: x["h"] != schema.INVALID_HASH)

    def pair(x: Column, y: Column) -> Column:
        d, c = fp.hamming(x["h"], y["h"]), fp.color_distance(x["c"], y["c"])
        return F.struct(d.alias("distance"), c.alias("colors"), F.abs(x["i"] - y["i"]).alias("gap"), x["i"].alias("i"), y["i"].alias("j"))

    every = F.flatten(F.transform(frames(hashes_a, colors_a), lambda x: F.transform(frames(hashes_b, colors_b), lambda y: pair(x, y))))
    return F.filter(every, lambda m: fp.is_similar(kind, m["distance"], m["colors"]))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _used(ordered: Column) -> Column:
    """Bits of the frames of either video that are used when matches are taken in order while both frames are free."""
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    free = lambda s, m: (s["a"].bitwiseAND(_bit(m["i"])) == 0) & (s["b"].bitwiseAND(_bit(m["j"])) == 0)
    return F.aggregate(ordered, none, lambda s, m: F.when(free(s, m), F.struct(s["a"].bitwiseOR(_bit(m["i"])).alias("a"), s["b"].bitwiseOR(_bit(m["j"])).alias("b"))).otherwise(s))


def _span(bits: Column) -> Column:
    """From the first to the last frame that is used."""
    return F.length(F.bin(bits)) - F.length(F.bin(bits.bitwiseAND(-bits)))


def bounds(kind: Column, good_a: Column, good_b: Column) -> tuple[Column, Column]:
    """How many frames of either video must be used, and how far apart they must lie; good: numbers of valid frames."""
    comparable = F.least(good_a, good_b)
    percent = F.when(kind == "SCREEN_RECORDING", 45).otherwise(35)
    needed = F.when(comparable <= 2, 1).when(comparable <= 5, 2).otherwise(F.greatest(F.lit(3), F.ceil(comparable * percent / 100)))
    return needed, F.when(comparable <= 2, 0).when(comparable <= 5, 1).otherwise(SPREAD)


def alike(kind: Column, source_a: Column, good_a: Column, source_b: Column, good_b: Column, found: Column) -> Column:
    """a is the later scanned; good: its number of valid frames; found: the matches of a's frames with b's."""
    needed, span = bounds(kind, good_a, good_b)
    # The closest matches first; more matches only widen both spans, so the end decides.
    best = _used(F.sort_array(found))
    reference = (F.bit_count(best["a"]) >= needed) & (F.least(_span(best["a"]), _span(best["b"])) >= span)
    # Frame by frame, each with the first free one.
    turn = _used(F.sort_array(F.transform(found, lambda m: F.struct(m["i"].alias("i"), m["j"].alias("j")))))
    general = (F.bit_count(turn["a"]) >= 2) & (_span(turn["a"]) >= SPREAD)
    single_a, single_b = ((s == "SYSTEM_THUMBNAIL") & (g == 1) for s, g in ((source_a, good_a), (source_b, good_b)))
    rule = F.when((source_a == "REFERENCE_FRAMES") & (source_b == "REFERENCE_FRAMES"), reference).when(single_a | single_b, single_a & single_b).otherwise(general)
    return (F.size(found) > 0) & rule
