"""Media rows: enumeration, normalisation, classification, access levels, versions of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift import schema


def read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Raw media rows of a table with the fixed schema (never inferred); columns that are not there are null."""
    return spark.read.format(form).schema(schema.RAW).load(path)


def read_pixels(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content_sha256) of media files; decoding pixels is left to the caller."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", content_digest(F.col("content")).alias("content_sha256"))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


# What each access level lets one read.
ACCESS = {
    "NONE": set(),
    "IMAGES_ONLY": {"image"},
    "VIDEOS_ONLY": {"video"},
    "PARTIAL_VISUAL": {"image", "video"},
    "FULL_VISUAL": {"image", "video"},
    "LEGACY_FULL": {"image", "video"},
}
FULL_ACCESS = {"FULL_VISUAL", "LEGACY_FULL"}


def access_level(images: bool, videos: bool, partial: bool, legacy: bool, api_level: int) -> str:
    """Level from what was granted; partial access exists from API level 34, split access from 33."""
    if api_level < 33:
        return "LEGACY_FULL" if legacy else "NONE"
    if images and videos:
        return "FULL_VISUAL"
    if api_level >= 34 and partial:
        return "PARTIAL_VISUAL"
    return "IMAGES_ONLY" if images else "VIDEOS_ONLY" if videos else "NONE"


def enumerate_media(raw: DataFrame, access: str = "FULL_VISUAL", image_cursor: int = 0, video_cursor: int = 0, api_level: int = 30) -> DataFrame:
    """Readable rows with a size, newer than the cursor of their type (from API level 30). Filters reach the scan."""
    rows = raw.where(F.col("size_bytes") > 0).where(F.col("media_type").isin(sorted(ACCESS[access])))
    if api_level >= 30 and (image_cursor > 0 or video_cursor > 0):
        newer = F.when(F.col("media_type") == "image", F.col("generation_modified") > image_cursor if image_cursor > 0 else F.lit(True)).otherwise(F.col("generation_modified") > video_cursor if video_cursor > 0 else F.lit(True))
        rows = rows.where(newer)
    return rows


def count_estimate(raw: DataFrame, **scope) -> DataFrame:
    """Rows by type that a scan would see."""
    return enumerate_media(raw, **scope).groupBy("media_type").agg(F.count("*").alias("n"))


def limited(raw: DataFrame, n: int) -> DataFrame:
    """The n newest rows of each type's scan."""
    order = [F.desc("date_added_s"), F.desc("media_store_id")]
    images = enumerate_media(raw, "IMAGES_ONLY").orderBy(*order).limit(n)
    return images.unionByName(enumerate_media(raw, "VIDEOS_ONLY").orderBy(*order).limit(n))


def kind_of(media_type: Column, name: Column) -> Column:
    """Kind by name; parts of longer words count."""
    low = F.lower(name)
    shot = low.rlike("screen[_-]?shot") | low.startswith("screen_")
    recorded = low.rlike("screen[_-]?record|recording|capture|mirror|cast")
    return F.when(media_type == "image", F.when(shot, "SCREENSHOT").otherwise("PHOTO")).otherwise(F.when(recorded, "SCREEN_RECORDING").otherwise("VIDEO"))


def chat_source(name: Column, bucket: Column, path_hint: Column) -> Column:
    """The first messenger named in name, bucket or path; null if none."""
    text = F.lower(F.concat_ws(" ", name, bucket, path_hint))
    return F.when(text.contains("whatsapp"), "WHATSAPP").when(text.contains("telegram"), "TELEGRAM").when(text.contains("snapchat"), "SNAPCHAT").when(text.rlike("messenger|facebook"), "MESSENGER")


def created_at(taken_ms: Column, added_s: Column) -> Column:
    return F.when(taken_ms > 0, taken_ms).otherwise(added_s * 1000)


def normalise(raw: DataFrame) -> DataFrame:
    """Assets from raw rows: defaults for what is missing, kind, creation time, chat source."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    default = F.concat(F.when(F.col("media_type") == "image", "Image ").otherwise("Video "), F.col("media_store_id").cast("string"))
    named = raw.withColumn("name", F.when(F.trim(text("name")) == "", default).otherwise(F.col("name")))
    added = zero("date_added_s").cast("long")
    return named.select(
        F.col("media_store_id").cast("long").alias("asset_id"),
        F.col("media_store_id").cast("long").alias("media_store_id"),
        kind_of(F.col("media_type"), F.col("name")).alias("kind"),
        "name",
        zero("width").cast("int").alias("width"),
        zero("height").cast("int").alias("height"),
        zero("duration_ms").cast("long").alias("duration_ms"),
        zero("size_bytes").cast("long").alias("size_bytes"),
        created_at(zero("date_taken_ms"), added).cast("long").alias("created_at_ms"),
        (zero("date_modified_s") * 1000).cast("long").alias("updated_at_ms"),
        added.alias("date_added_s"),
        text("bucket").alias("bucket"),
        text("path_hint").alias("path_hint"),
        text("mime_type").alias("mime_type"),
        F.coalesce("is_favorite", F.lit(False)).alias("is_favorite"),
        F.lit(False).alias("is_edited"),
        zero("generation_added").cast("long").alias("generation_added"),
        zero("generation_modified").cast("long").alias("generation_modified"),
        chat_source(F.col("name"), text("bucket"), text("path_hint")).alias("chat_source"),
    )


def signature() -> Column:
    """What a later scan compares to see whether the file changed."""
    parts = ["media_store_id", "kind", "size_bytes", "width", "height", "duration_ms", "updated_at_ms", "generation_modified", "mime_type", "is_favorite", "is_edited"]
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts))


def algorithm_version(image_size: int, video_mode: str) -> Column:
    """Of a row's kind: images by fingerprint size, videos by mode."""
    image = schema.ALGORITHM_BASE * 10_000 + min(max(image_size, 1), 9_999)
    video = schema.ALGORITHM_BASE * 100 + schema.VIDEO_MODES.index(video_mode)
    return F.when(F.col("kind").isin("PHOTO", "SCREENSHOT"), image).otherwise(video).cast("int")


def contacts(raw: DataFrame) -> DataFrame:
    """Contact rows, one for each id and digits of the phone: the first by name."""
    from pyspark.sql import Window

    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), r"[^\p{Nd}]", "")
    first = F.row_number().over(Window.partitionBy("id", digits).orderBy("name", "phone"))
    return raw.withColumn("q_n", first).where("q_n = 1").drop("q_n")


def videos(raw: DataFrame) -> DataFrame:
    """Videos to compress: with a size, negatives as 0, a default name."""
    at_least = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    rows = raw.where("size_bytes > 0")
    return rows.withColumns({c: at_least(c).cast(raw.schema[c].dataType) for c in ("duration_ms", "width", "height")} | {"display_name": F.when(F.trim(F.coalesce("display_name", F.lit(""))) == "", F.concat(F.lit("Video-"), F.col("id").cast("string"), F.lit(".mp4"))).otherwise(F.col("display_name")), "bitrate": F.lit(0)})
