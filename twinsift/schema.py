"""Record types, enumerations and fixed numbers of the media engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of kinds, categories, states and stages, in their order.
KINDS = ["PHOTO", "SCREENSHOT", "VIDEO", "SCREEN_RECORDING"]
GROUP_CATEGORIES = ["DUPLICATE", "SIMILAR", "OTHER"]
STATES = ["ACTIVE", "DELETE_PENDING", "DELETED"]
PRODUCT_CATEGORIES = ["SIMILAR", "DUPLICATES", "SIMILAR_SCREENSHOTS", "SIMILAR_VIDEOS", "OTHER_SCREENSHOTS", "OTHER_VIDEOS", "OTHER"]
FRAME_SOURCES = ["REFERENCE_FRAMES", "SYSTEM_THUMBNAIL", "HYBRID_THUMBNAIL_AND_FRAMES", "MMR_FRAMES"]
VIDEO_MODES = ["FAST", "BALANCED", "ADAPTIVE_BALANCED", "ACCURATE", "REFERENCE_COMPAT"]

# Similarity limits. (largest distance, exclusive; direct up to; ranges of distance with a colour limit)
LIMITS = {
    "PHOTO": (18, 4, [(4, 10, 7), (10, 18, 5)]),
    "SCREENSHOT": (16, 2, [(2, 10, 5), (10, 16, 2)]),
    "VIDEO": (16, 2, [(2, 10, 5), (10, 16, 2)]),
    "SCREEN_RECORDING": (16, 2, [(2, 10, 5), (10, 16, 2)]),
}
ALGORITHM_BASE = 28
ASPECT_TOLERANCE = 8
INVALID_HASH = -1

#: Kinds that are compared with each other, and the kind their groups have.
FAMILIES = {"PHOTO": ["PHOTO"], "SCREENSHOT": ["SCREENSHOT"], "VIDEO": ["VIDEO", "SCREEN_RECORDING"]}

TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}


def struct(fields: str) -> T.StructType:
    """From "name type, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


RAW = struct(
    "media_store_id long, media_type string, name string, size_bytes long, width int, height int, duration_ms long, date_added_s long,"
    "date_taken_ms long, date_modified_s long, bucket string, path_hint string, mime_type string, is_favorite boolean, generation_added long,"
    "generation_modified long"
)
ASSET = struct(
    "asset_id long, media_store_id long, kind string, name string, width int, height int, duration_ms long, size_bytes long, created_at_ms long,"
    "updated_at_ms long, date_added_s long, bucket string, path_hint string, mime_type string, is_favorite boolean, is_edited boolean,"
    "generation_added long, generation_modified long, chat_source string, state string, revision long, fingerprint_status string,"
    "last_seen_scan string, source_signature string, algorithm_version int"
)
FINGERPRINT = struct("asset_id long, image_hash long, color_hash array<double>")
EDGE = struct("category string, kind string, first_asset_id long, second_asset_id long")
CONTACT = struct("id long, name string, phone string")
VIDEO = struct("id long, display_name string, size_bytes long, duration_ms long, width int, height int, date_added_s long, date_modified_s long, bitrate int")
PROFILE = struct("id long, is_hevc boolean, is_hdr boolean, bitrate int, frame_rate int, width int, height int, rotation_degrees int")
