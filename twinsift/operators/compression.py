"""Which videos are worth compressing, and to what: buckets by expected saving, and a plan for each video.

Bit rates are computed in 32-bit floats, each product cut to a whole number, as devices do; a rate beyond 32
bits (clips of a split second) counts as the largest 32-bit number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
# Fixed values.
BUCKETS = [("EXTREME", 150 * MIB), ("MODERATE", 40 * MIB), ("LIGHT", 0)]
OPTIONS = {"LOW": 70, "MEDIUM": 50, "HIGH": 30}
LEAST_BITRATE, DEFAULT_BITRATE, LARGEST = 350_000, 2_000_000, (1 << 31) - 1
FLOORS = {"4K": 6_000_000, "1080": 4_500_000, "720": 2_500_000, "540": 1_400_000, "LOW": 800_000}
KEEP_AT_MOST, RESULT_AT_MOST = 0.92, 0.98
SHORT_MS, SHORT_PENALTY_MS, POOR_BITRATE, SMALL_BYTES, SMALL_SAVING = 3_000, 10_000, 900_000, 3 * MIB, MIB
REJECTIONS = ["HDR", "TOO_SHORT", "LOW_BITRATE", "SMALL_FILE", "SMALL_SAVING"]
AUDIO_BITRATE, MARGIN = 192_000, 32 * MIB


def clamp(x: Column, low: int | Column, high: int | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, as_column(low)), as_column(high))


def times(x: Column, factor: float | Column) -> Column:
    """x times factor in 32-bit floats, cut to a whole number."""
    by = factor if isinstance(factor, Column) else F.lit(factor)
    return (x.cast("float") * by.cast("float")).cast("float").cast("long")


def saving(rate: int) -> Column:
    """Bytes of size_bytes that a rate (in percent) is expected to free."""
    return F.expr(f"size_bytes * {min(max(rate, 0), 95)} div 100")


def bucketed(videos: DataFrame, rate: int = OPTIONS["MEDIUM"]) -> DataFrame:
    """videos with saving and bucket: the first whose least saving is reached."""
    out = F.lit(None).cast("string")
    for name, least in reversed(BUCKETS):
        out = F.when(F.col("saving") >= least, name).otherwise(out)
    return videos.withColumn("saving", saving(rate)).withColumn("bucket", out)


def bucket_totals(videos: DataFrame, rate: int = OPTIONS["MEDIUM"]) -> DataFrame:
    """Buckets that hold any video, in order."""
    position = F.when(F.col("bucket") == BUCKETS[0][0], 0).when(F.col("bucket") == BUCKETS[1][0], 1).otherwise(2)
    return bucketed(videos, rate).groupBy("bucket").agg(F.count("*").alias("videos"), F.sum("size_bytes").alias("bytes"), F.sum("saving").alias("saving")).withColumn("position", position)


def options(spark) -> DataFrame:
    return spark.createDataFrame(list(OPTIONS.items()), "option string, rate int")


def source_bitrate(profile: Column, listed: Column, size: Column, duration_ms: Column) -> Column:
    guessed = F.least(F.floor(size * 8000 / duration_ms).cast("long"), F.lit(LARGEST))
    return F.when(profile > 0, profile.cast("long")).when(listed > 0, listed.cast("long")).when(duration_ms > 0, guessed).otherwise(F.lit(DEFAULT_BITRATE).cast("long"))


def simple_target(source: Column, rate: int) -> Column:
    """Target bit rate by the option alone."""
    keep = ((F.lit(100 - min(max(rate, 0), 95))).cast("float") / F.lit(100.0).cast("float")).cast("float")
    return F.greatest(times(source, keep), F.lit(LEAST_BITRATE).cast("long"))


def simple_output(size: Column, rate: int) -> Column:
    return F.greatest(F.floor(size * (100 - min(max(rate, 0), 95)) / 100), F.lit(0)).cast("long")


def plan(videos: DataFrame, profiles: DataFrame, rate: int = OPTIONS["MEDIUM"]) -> DataFrame:
    """A plan for each video (id, size_bytes, duration_ms, width, height, bitrate). profiles: measured track data, may lack videos."""
    p = profiles.select("id", "is_hevc", "is_hdr", *(F.col(c).alias(f"p_{c}") for c in ("bitrate", "frame_rate", "width", "height", "rotation_degrees")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = videos.join(p, "id", "left").withColumns({"is_hevc": F.coalesce("is_hevc", F.lit(False)), "is_hdr": F.coalesce("is_hdr", F.lit(False))})
    w, h = (F.when(zero(f"p_{c}") > 0, F.col(f"p_{c}")).otherwise(F.col(c)) for c in ("width", "height"))
    turned = zero("p_rotation_degrees") % 180 != 0
    rows = rows.withColumns(
        {
            "source_bitrate": source_bitrate(zero("p_bitrate"), F.col("bitrate"), F.col("size_bytes"), F.col("duration_ms")),
            "source_width": F.when(turned, h).otherwise(w),
            "source_height": F.when(turned, w).otherwise(h),
            "fps": F.when(zero("p_frame_rate").between(1, 240), F.col("p_frame_rate")).otherwise(30),
        }
    )
    long_, short = F.greatest("source_width", "source_height"), F.least("source_width", "source_height")
    b = F.col("source_bitrate")
    by_size = F.when(long_ >= 3840, 12).when(long_ >= 2560, 8).when(long_ >= 1920, 4).otherwise(0)
    by_rate = F.when(b > 20_000_000, 12).when(b > 12_000_000, 8).when(b > 8_000_000, 4).when(b.between(1, 2_500_000), -18).when(b.between(2_500_001, 4_000_000), -8).otherwise(0)
    by_fps = F.when(F.col("fps") >= 60, -6).when(F.col("fps") >= 45, -3).otherwise(0)
    by_codec, by_length = F.when(F.col("is_hevc"), -5).otherwise(0), F.when(F.col("duration_ms").between(1, SHORT_PENALTY_MS - 1), -10).otherwise(0)
    rows = rows.withColumns(
        {
            "dynamic_rate": clamp(F.lit(min(max(rate, 10), 85)) + by_size + by_rate + by_fps + by_codec + by_length, 10, 85),
            "target_height": F.when((long_ >= 2560) & (short > 1080), 1080).when((long_ >= 1920) & (short > 720), 720),
        }
    )
    out_short = F.coalesce("target_height", F.greatest(short, F.lit(1)))
    floor = F.when(long_ >= 3840, FLOORS["4K"]).when(out_short >= 1080, FLOORS["1080"]).when(out_short >= 720, FLOORS["720"]).when(out_short >= 540, FLOORS["540"]).otherwise(FLOORS["LOW"]).cast("long")
    rows = rows.withColumn("floor_0", floor)
    rows = rows.withColumn("floor_1", F.when(F.col("fps") >= 60, times(F.col("floor_0"), 1.35)).when(F.col("fps") >= 45, times(F.col("floor_0"), 1.18)).otherwise(F.col("floor_0")))
    rows = rows.withColumn("quality_floor", F.greatest(F.when(F.col("is_hevc"), times(F.col("floor_1"), 1.15)).otherwise(F.col("floor_1")), F.lit(LEAST_BITRATE).cast("long"))).drop("floor_0", "floor_1")
    keep = ((F.lit(100) - F.col("dynamic_rate")).cast("float") / F.lit(100.0).cast("float")).cast("float")
    rows = rows.withColumns({"requested": F.greatest(times(b, keep), F.lit(LEAST_BITRATE).cast("long")), "most": F.greatest(times(b, KEEP_AT_MOST), F.lit(LEAST_BITRATE).cast("long"))})
    rows = rows.withColumn("target_bitrate", clamp(F.col("requested"), F.least("quality_floor", "most"), F.col("most"))).drop("requested", "most")
    by_bits = F.when(b > 0, F.col("target_bitrate").cast("double") / b.cast("double")).otherwise(1.0)
    scale = F.when(F.col("target_height").isNotNull(), F.least(F.col("target_height").cast("double") / F.greatest(short, F.lit(1)).cast("double"), F.lit(1.0))).otherwise(1.0)
    rows = rows.withColumn("estimated_bytes", F.greatest((F.col("size_bytes").cast("double") * by_bits * scale).cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("estimated_saving", F.greatest(F.col("size_bytes") - F.col("estimated_bytes"), F.lit(0).cast("long")))
    tests = [F.col("is_hdr"), F.col("duration_ms").between(1, SHORT_MS - 1), b.between(1, POOR_BITRATE - 1), F.col("size_bytes").between(1, SMALL_BYTES - 1), F.col("estimated_saving") < SMALL_SAVING]
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REJECTIONS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return rows.withColumn("reject_reason", reason)


def validated(results: DataFrame) -> DataFrame:
    """Finished files (size_bytes, output_bytes) with the reason to discard them, if any."""
    out = F.coalesce("output_bytes", F.lit(0))
    return results.withColumn("problem", F.when(out <= 0, "EMPTY").when(out.cast("double") >= F.col("size_bytes") * RESULT_AT_MOST, "NOT_SMALLER"))


def required_bytes(estimated: Column, source: Column) -> Column:
    return F.when(estimated > 0, estimated).when(source > 0, source).otherwise(F.lit(MIB)) + MARGIN


def output_by_bitrate(size: Column, duration_ms: Column, target: Column) -> Column:
    """Bytes of video and audio at the target bit rate."""
    both = F.floor(target * duration_ms / 8000) + F.floor(duration_ms * AUDIO_BITRATE / 8000)
    return F.when((duration_ms <= 0) | (target <= 0), size).otherwise(F.greatest(both, F.lit(MIB))).cast("long")


def storage_check(plans: DataFrame, cache_bytes: int, library_bytes: int) -> DataFrame:
    """The first place without room for a plan's output, or null."""
    need = required_bytes(F.col("estimated_bytes"), F.col("size_bytes"))
    return plans.withColumn("required_bytes", need).withColumn("no_room_in", F.when(F.col("required_bytes") > cache_bytes, "TEMP_CACHE").when(F.col("required_bytes") > library_bytes, "MEDIA_LIBRARY"))


def queue_totals(outcomes: DataFrame) -> DataFrame:
    """Of a queue's outcomes (queue_id, position, status, active_percent): done, failed and percent. A cancel ends the queue."""
    from pyspark.sql import Window

    stop = F.min(F.when(F.col("status") == "CANCELLED", F.col("position"))).over(Window.partitionBy("queue_id"))
    rows = outcomes.withColumn("q_stop", stop).where(F.col("q_stop").isNull() | (F.col("position") < F.col("q_stop")))
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    done = n("SUCCESS") + n("FAILED")
    active = F.coalesce(F.sum(F.when(F.col("status") == "ACTIVE", F.col("active_percent"))), F.lit(0))
    percent = clamp(F.floor((done * 100 + active) / F.greatest(F.count("*"), F.lit(1))), 0, 100)
    return rows.groupBy("queue_id").agg(n("SUCCESS").alias("succeeded"), n("FAILED").alias("failed"), percent.alias("percent"))


def quota(outcomes: DataFrame, limit: int = 10) -> DataFrame:
    """Compressions left by user and day (user_id, finished_ms)."""
    return outcomes.groupBy("user_id", F.date_format(F.timestamp_millis("finished_ms"), "yyyyMMdd").alias("day")).agg(F.count("*").alias("used")).withColumn("left", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))
