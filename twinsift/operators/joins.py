"""Duplicate keys, the Hamming and colour join of images, and the band join of videos."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import schema
from twinsift.functions import fingerprint as fp
from twinsift.functions import video_rules as rules
from twinsift.operators import compare, covering
from twinsift.storage import kept

#: Rows from which the axes of colour cells are chosen, their number, and most and least rows of a tile; none changes a result.
SAMPLE, AXES, TILE, LEAST = 2048, 2, 8192, 256
DUPLICATE_KEY = ["kind", "size_bytes", "width", "height", "is_edited", "image_hash"]


def duplicate_groups(assets: DataFrame) -> DataFrame:
    """Assets (with image_hash) whose key another asset shares; group_id is the smallest asset_id of the key.

    Equality is transitive: one aggregation and one join back, no pairs. Invalid hashes, videos and assets that are not
    active take no part; the algorithm's version does not count.
    """
    good = (assets.where("state = 'ACTIVE'") if "state" in assets.columns else assets).where(F.col("kind").isin("PHOTO", "SCREENSHOT") & F.col("image_hash").isNotNull() & (F.col("image_hash") != schema.INVALID_HASH))
    keys = good.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("members"), F.min("asset_id").alias("group_id")).where("members > 1")
    return good.join(keys, DUPLICATE_KEY).select("kind", "group_id", "asset_id", "members")


def duplicate_edges(assets: DataFrame) -> DataFrame:
    """A star for each duplicate key: each member with the smallest; the groups are the same as of all pairs."""
    rows = duplicate_groups(assets).where("asset_id <> group_id")
    return rows.select(F.lit("DUPLICATE").alias("category"), "kind", F.col("group_id").alias("first_asset_id"), F.col("asset_id").alias("second_asset_id"))


def content_duplicates(assets: DataFrame) -> DataFrame:
    """Assets of one kind with equal content digests."""
    keys = assets.where("content_sha256 is not null").groupBy("kind", "content_sha256").agg(F.count("*").alias("members"), F.min("asset_id").alias("group_id")).where("members > 1")
    return assets.join(keys, ["kind", "content_sha256"]).select("kind", "group_id", "asset_id", "members")


def comparable(assets: DataFrame) -> DataFrame:
    """Assets that may be compared: active and with a finished fingerprint. A column that is not there excludes none."""
    for column, value in (("state", "ACTIVE"), ("fingerprint_status", "DONE")):
        if column in assets.columns:
            assets = assets.where(F.col(column) == value)
    return assets


def _version(df: DataFrame) -> Column:
    """Fingerprints of different algorithm versions never meet."""
    return (F.col("algorithm_version") if "algorithm_version" in df.columns else F.lit(0)).cast("int").alias("version")


def _axes(rows: DataFrame) -> list[list[int]]:
    """Sets of colour shares along which pictures differ most, by at most SAMPLE rows; any sets give the same pairs."""
    import numpy as np

    found = rows.select("color_hash").orderBy(F.xxhash64("image_hash", "color_hash")).limit(SAMPLE).collect()
    x = np.array([(r["color_hash"] + [0.0] * 24)[:24] for r in found] or [[0.0] * 24])
    directions = np.linalg.svd(x - x.mean(axis=0), full_matrices=True)[2][:AXES]
    return [np.flatnonzero(v > 0).tolist() or [0] for v in directions]


def _joined(a: DataFrame, b: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    on = condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    return a.join(b, on).drop(*keys, *(f"b_{k}" for k in keys))


def _close(a: DataFrame, b: DataFrame, kind: str, which: Column, distance: Column) -> DataFrame:
    """Pairs whose hashes differ so little that colours don't count: of direct + 1 segments one is equal (pigeonhole).

    A pair is taken under the first segment it shares."""
    direct = schema.LIMITS[kind][1]
    cuts = [i * 64 // (direct + 1) for i in range(direct + 2)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = lambda df, p: df.withColumn("x", F.explode(F.array(*(F.struct(F.lit(i).alias("s"), F.col(f"{p}image_hash").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks))))).select("*", F.col("x.s").alias(f"{p}s"), F.col("x.v").alias(f"{p}v")).drop("x")
    first = F.lit(direct)
    for i in range(direct - 1, -1, -1):
        first = F.when(F.col("image_hash").bitwiseXOR(F.col("b_image_hash")).bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(first)
    return _joined(keyed(a, ""), keyed(b, "b_"), ["version", "s", "v"], which & (distance <= direct) & (first == F.col("s")))


def _far(left: DataFrame, right: DataFrame | None, kind: str) -> DataFrame:
    """The other pairs: all are close in colour.

    Each channel's shares sum to 16, so the sum over any set of shares moves by less than half of the colour limit + 1:
    cells of that width along each axis, one side in its own, the other in its own and its neighbours, so a pair meets
    once. Where both sides are the same rows only half of the neighbours are taken, and of two rows of one cell only one
    asks. Crowded cells are cut into tiles of at most about TILE rows by TILE rows, less where tasks would be idle; a
    tile is compared as arrays.
    """
    width = (max(limit for *_, limit in schema.LIMITS[kind][2]) + 1) / 2 * (1 + 1e-9)
    axes, spark = _axes(left), left.sparkSession
    names = [f"c{i}" for i in range(len(axes))]
    own = ["version", *names]
    cells = [F.floor(sum((F.coalesce(F.get("color_hash", F.lit(i)), F.lit(0.0)) for i in axis), F.lit(0.0)) / width).cast("int").alias(n) for n, axis in zip(names, axes, strict=True)]
    row = ["id", "image_hash", "color_hash"]
    steps = list(itertools.product((-1, 0, 1), repeat=len(axes)))
    if right is None:
        steps = [step for step in steps if step > (0,) * len(axes)]
    asks = left.select("version", *row, *cells)
    around = (left if right is None else right).select("version", *row, *cells).withColumn("step", F.explode(F.array(*(F.array(*map(F.lit, step)) for step in steps))))
    around = around.select("version", *row, *((F.col(n) + F.col("step")[i]).alias(n) for i, n in enumerate(names)))
    # One row a cell: their number is bounded by the range of the shares.
    inside = {tuple(r[: len(own)]): r["n"] for r in asks.groupBy(*own).agg(F.count("*").alias("n")).collect()}
    beside = {tuple(r[: len(own)]): r["n"] for r in around.groupBy(*own).agg(F.count("*").alias("n")).collect()}
    work = sum(n * beside.get(c, 0) + (n * n // 2 if right is None else 0) for c, n in inside.items())
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    side = max(1, min(TILE, max(LEAST, math.isqrt(work // tasks))))
    kinds = ", ".join(f"{n} int" for n in own)
    sizes = F.broadcast(spark.createDataFrame([(*c, -(-n // side), -(-beside.get(c, 0) // side)) for c, n in inside.items()], f"{kinds}, m long, b_m long"))
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*own, "part", "tile", "other_tile"]
    put = lambda df, part, tile, other, role: df.select(*own, F.lit(part).alias("part"), tile.alias("tile"), other.alias("other_tile"), role.alias("role"), *row)
    asks, around = asks.join(sizes, own), around.join(sizes, own)
    t, o = F.col("t"), F.col("o")
    a = asks.where("b_m > 0").select("*", number("m").alias("t"), every("b_m").alias("o"))
    b = around.select("*", number("b_m").alias("o"), every("m").alias("t"))
    rows = put(a, 1, t, o, F.lit(1)).unionByName(put(b, 1, t, o, F.lit(2)))
    if right is None:
        c = asks.select("*", number("m").alias("t"), every("m").alias("o"))
        rows = rows.unionByName(put(c, 0, F.least(t, o), F.greatest(t, o), F.when(t == o, 0).when(t < o, 1).otherwise(2)))
    return compare.tiles(rows, keys, kind)


def near(left: DataFrame, right: DataFrame | None, kind: str) -> DataFrame:
    """(id, b_id, distance, colors) of rows of left (id, version, image_hash, color_hash) and of right that look alike.

    Without right: the pairs within left, each once, in any order. No pair is lost. ids are unique on each side."""
    first = left.select(*(F.col(c) for c in ("id", "version", "image_hash", "color_hash")))
    second = (left if right is None else right).select(*(F.col(c).alias(f"b_{c}") for c in ("id", "version", "image_hash", "color_hash")))
    distance, colors = fp.hamming(F.col("image_hash"), F.col("b_image_hash")), fp.color_distance(F.col("color_hash"), F.col("b_color_hash"))
    close = _close(first, second, kind, F.col("id") < F.col("b_id") if right is None else F.lit(True), distance)
    return close.select("id", "b_id", distance.alias("distance"), colors.alias("colors")).unionByName(_far(left, right, kind))


LOOK = ["version", "image_hash", "color_hash"]


def looks(rows: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """Rows that look the same are one: (id, version, image_hash, color_hash), and the members (id, and rows' columns)."""
    found = kept(rows.groupBy(*LOOK).agg(F.min(member).alias("id")).select("id", *LOOK), "looks")
    return found, kept(rows.join(found, LOOK).drop(*LOOK), "members")


def similar_pairs(left: DataFrame, right: DataFrame, kind: str, ordered: bool = True) -> DataFrame:
    """(first, second) asset ids of similar images of one kind, each pair once. Both: asset_id, image_hash, color_hash.

    ordered: right has the same rows as left. Equal looks are compared as one and get their members back at the end."""
    good = lambda df: comparable(df).where(fp.is_valid(F.col("image_hash"), F.col("color_hash"))).select("asset_id", _version(df), "image_hash", "color_hash")
    seen, members = looks(good(left), "asset_id")
    others, other_members = (None, members) if ordered else looks(good(right), "asset_id")
    b = other_members.select(F.col("id").alias("b_id"), F.col("asset_id").alias("b_asset_id"))
    found = near(seen, others, kind).select("id", "b_id").join(members, "id").join(b, "b_id").select("asset_id", "b_asset_id")
    if ordered:
        same = members.join(b, F.col("id") == F.col("b_id")).where("asset_id < b_asset_id").select("asset_id", "b_asset_id")
        found = found.unionByName(same)
    found = found.where("asset_id <> b_asset_id")
    pairs = found.select(F.least("asset_id", "b_asset_id").alias("first_asset_id"), F.greatest("asset_id", "b_asset_id").alias("second_asset_id"))
    return pairs if ordered else pairs.distinct()


def similar_edges(assets: DataFrame, kind: str) -> DataFrame:
    """Similar images of a kind, without assets that are duplicates of others."""
    own = assets.where(F.col("kind") == kind)
    rest = own.join(duplicate_groups(own).select("asset_id"), "asset_id", "left_anti")
    return similar_pairs(rest, rest, kind).select(F.lit("SIMILAR").alias("category"), F.lit(kind).alias("kind"), "first_asset_id", "second_asset_id")


def _tiled(rows: DataFrame, group: list[str], member: str, side: int) -> DataFrame:
    """rows with tile and other_tile: any two rows of a group are in exactly one tile of it, which holds about 2 * side rows.

    role: 0 in a tile of a group with itself, else 1 or 2 for the side. Large groups are spread over many tasks."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("t_n")).where("t_n > 1").select(*group, F.ceil(F.col("t_n") / side).alias("t_m"))
    t, o = F.col("t_own"), F.col("t_other")
    cut = rows.join(sizes, group).withColumn("t_own", F.pmod(F.xxhash64(member), F.col("t_m")))
    cut = cut.withColumn("t_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_m") - 1)))
    return cut.withColumns({"tile": F.least(t, o), "other_tile": F.greatest(t, o), "role": F.when(t == o, 0).when(t < o, 1).otherwise(2)}).drop("t_own", "t_other", "t_m")


def stored_members(items: DataFrame, assets: DataFrame, kinds: list[str]) -> DataFrame:
    """(group_id, asset_id) of the active members, of the kinds, of stored similar groups that have two of them or more."""
    own = assets.where((F.col("state") == "ACTIVE") & F.col("kind").isin(kinds)).select("asset_id")
    rows = items.where((F.col("category") == "SIMILAR") & F.col("kind").isin(kinds)).select("group_id", "asset_id").distinct().join(own, "asset_id", "left_semi")
    several = rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return rows.join(several, "group_id", "left_semi").select("group_id", "asset_id")


def verified_edges(members: DataFrame, assets: DataFrame, kind: str, side: int = TILE) -> DataFrame:
    """Similar images of a kind among the members (group_id, asset_id) of each stored group; stored groups are candidates only.

    Members are verified by their fingerprints as in similar_edges, so no stale pair stays. An asset may be in several groups; a
    pair is one edge. Groups of any size are compared in tiles."""
    held = members.select("group_id", "asset_id").distinct().join(candidates(assets, kind), "asset_id").withColumnRenamed("asset_id", "id")
    found = placed_pairs(held, ["group_id", "version"], kind, side)
    return canonical(found.select(F.lit("SIMILAR").alias("category"), F.lit(kind).alias("kind"), "first_asset_id", "second_asset_id"))


def candidates(assets: DataFrame, kind: str) -> DataFrame:
    """(asset_id, version, image_hash, color_hash) of a kind's assets that may be similar to others: no duplicates of others."""
    own = assets.where(F.col("kind") == kind)
    rows = comparable(own.join(duplicate_groups(own).select("asset_id"), "asset_id", "left_anti"))
    return rows.where(fp.is_valid(F.col("image_hash"), F.col("color_hash"))).select("asset_id", _version(rows), "image_hash", "color_hash")


def placed_pairs(held: DataFrame, group: list[str], kind: str, side: int = TILE) -> DataFrame:
    """Similar pairs of rows (group, id, image_hash, color_hash) of one group, in any order; a pair of several groups comes for each."""
    held = kept(held.select(*group, "id", "image_hash", "color_hash"), "held")
    found = compare.tiles(_tiled(held, group, "id", side), [*group, "tile", "other_tile"], kind, direct=True)
    return found.select(F.col("id").alias("first_asset_id"), F.col("b_id").alias("second_asset_id"))


def stored_pairs(members: DataFrame, videos: DataFrame, side: int = LEAST) -> DataFrame:
    """Pairs (later, earlier) in scan order of videos that share a stored group: what video_edges verifies instead of its candidates."""
    rows = members.select("group_id", "asset_id").distinct().join(comparable(videos).select("asset_id", "media_store_id", "date_added_s"), "asset_id")
    tiled = _tiled(kept(rows, "held"), ["group_id"], "asset_id", side)
    a = tiled.where("role <= 1").select("group_id", "tile", "other_tile", "role", "asset_id", "media_store_id", "date_added_s")
    b = tiled.where("role <> 1").select(*(F.col(c).alias(f"b_{c}") for c in a.columns))
    same = (F.col("group_id") == F.col("b_group_id")) & (F.col("tile") == F.col("b_tile")) & (F.col("other_tile") == F.col("b_other_tile"))
    # Within a tile of its own a pair meets in both orders.
    once = F.when(F.col("role") == 0, F.col("asset_id") < F.col("b_asset_id")).otherwise(F.lit(True))
    ends = F.when(_later(), F.struct(F.col("asset_id").alias("l"), F.col("b_asset_id").alias("e"))).otherwise(F.struct(F.col("b_asset_id").alias("l"), F.col("asset_id").alias("e")))
    return a.join(b, same & once).select(ends.alias("p")).select(F.col("p.l").alias("later_id"), F.col("p.e").alias("earlier_id")).distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with the smaller id first, once each, none to itself."""
    first, second = F.least("first_asset_id", "second_asset_id"), F.greatest("first_asset_id", "second_asset_id")
    return edges.where("first_asset_id <> second_asset_id").select("category", "kind", first.alias("first_asset_id"), second.alias("second_asset_id")).distinct()


def live_edges(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges both of whose ends are active."""
    active = assets.where("state = 'ACTIVE'").select(F.col("asset_id").alias("id"))
    return edges.join(active, F.col("first_asset_id") == F.col("id"), "left_semi").join(active, F.col("second_asset_id") == F.col("id"), "left_semi")


def duration_tolerance(bucket: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(bucket / 10)).cast("long")


def _later() -> Column:
    """Whether a row comes after the other (b_) in scan order, which is newest first."""
    same = F.col("date_added_s") == F.col("b_date_added_s")
    return (F.col("date_added_s") < F.col("b_date_added_s")) | (same & (F.col("media_store_id") < F.col("b_media_store_id")))


def frame_matches(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """The similar pairs of frames of two videos, whatever their durations: distance, colors, and for the later and the
    earlier the id, source, number of valid frames and number of the frame (i, j); kind of the pair.

    Every rule for alike videos asks for one such pair at least, so none is lost. Frames meet as images do, equal ones
    as one; recordings have the same limits."""
    rows = comparable(videos)
    good = F.size(F.filter("hashes", lambda h: h != schema.INVALID_HASH)).alias("good")
    own = ["asset_id", "media_store_id", "date_added_s", "kind", "source", "good"]
    each = frames.select("asset_id", "source", good, F.arrays_zip("hashes", "colors").alias("fs")).join(rows.select("asset_id", "media_store_id", "date_added_s", "kind", _version(rows)), "asset_id")
    each = each.select(*own, "version", F.posexplode("fs").alias("frame", "f"))
    each = each.select(*own, "version", "frame", F.col("f.hashes").alias("image_hash"), F.col("f.colors").alias("color_hash")).where(F.col("image_hash") != schema.INVALID_HASH)
    # A video has at most 62 frames.
    seen, members = looks(each.withColumn("member", F.col("asset_id") * 64 + F.col("frame")), "member")
    side = [*own, "frame"]
    b = members.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in side))
    pairs = near(seen, None, "VIDEO")
    equal = seen.select("id", F.col("id").alias("b_id"), F.lit(0).alias("distance"), F.when(F.size("color_hash") >= compare.CHANNELS, F.lit(0).cast("long")).alias("colors"))
    both = pairs.join(members.select("id", *side), "id").join(b, "b_id").where("asset_id <> b_asset_id")
    same = equal.join(members.select("id", *side), "id").join(b, "b_id").where("asset_id < b_asset_id")
    found = both.unionByName(same)
    later = _later()
    pick = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
    recording = (F.col("kind") == "SCREEN_RECORDING") | (F.col("b_kind") == "SCREEN_RECORDING")
    ends = [c for name, out in (("asset_id", "id"), ("source", "source"), ("good", "good")) for c in (pick(name, f"b_{name}").alias(f"later_{out}"), pick(f"b_{name}", name).alias(f"earlier_{out}"))]
    return found.select(*ends, F.when(recording, "SCREEN_RECORDING").otherwise("VIDEO").alias("kind"), "distance", "colors", pick("frame", "b_frame").alias("i"), pick("b_frame", "frame").alias("j"))


def clips(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Videos that may be compared, with their frames: asset_id, version, and the columns of covering.Clips."""
    rows = comparable(videos)
    own = rows.select("asset_id", _version(rows), (F.col("kind") == "SCREEN_RECORDING").cast("int").alias("recording"), "date_added_s", "media_store_id")
    return own.join(frames.select("asset_id", "hashes", "colors"), "asset_id").select("asset_id", "version", *covering.Clips.columns)


def _by_frames(found: DataFrame) -> DataFrame:
    """(kind, later_id, earlier_id) of videos that are alike by their similar pairs of frames."""
    pair, spark = ["kind", "later_id", "earlier_id"], found.sparkSession
    reference = (F.col("later_source") == "REFERENCE_FRAMES") & (F.col("earlier_source") == "REFERENCE_FRAMES")
    needed, spread = rules.bounds(F.col("kind"), F.col("later_good"), F.col("earlier_good"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first = compare.alike_videos(found.where(reference).withColumns({"needed": needed, "spread": spread}), tasks)
    match = F.struct("distance", "colors", F.abs(F.col("i") - F.col("j")).alias("gap"), "i", "j")
    ends = ["later_source", "later_good", "earlier_source", "earlier_good"]
    if not hasattr(found, "kept_at"):
        return first
    other = found.where(~reference).groupBy(*pair, *ends).agg(F.collect_list(match).alias("matches")).where(rules.alike(F.col("kind"), *map(F.col, ends), F.col("matches")))
    return first.unionByName(other.select(*first.columns))


#: Pairs that may meet in one part of a cell of durations and aspects; it changes no result.
PART = 1 << 20


def _duration_cell(seconds: Column) -> Column:
    """The power of two of a duration, then sixteenths of it: a cell is no wider than its durations' tolerance."""
    power = F.length(F.bin(F.greatest(seconds, F.lit(1))))
    return (power * 64 + F.floor(seconds * 16 / F.pow(F.lit(2.0), power))).cast("int")


def video_cells(videos: DataFrame, most: int = PART) -> tuple[DataFrame, DataFrame]:
    """Asking and held videos with the keys of the parts in which they meet: cell, aspect_cell, part, b_part.

    videos: asset_id, media_store_id, date_added_s, duration_ms, width, height. A held video lies in one cell of durations and
    aspects; one that asks looks into all cells that its band of durations (by its own tolerance) and of aspects touches, so two
    videos meet in one cell at most. A cell in which more than `most` pairs could meet is cut: its askers into parts of at most
    the root of that number, its held rows so that a part's pairs are about `most`; either side is copied to the other's parts.
    """
    seconds, wide = F.col("seconds"), 2 * schema.ASPECT_TOLERANCE + 1
    rows = videos.select("asset_id", "media_store_id", "date_added_s", F.floor(F.col("duration_ms") / 1000).cast("long").alias("seconds"), fp.aspect_bucket(F.col("width"), F.col("height")).alias("aspect"))
    aspect_cell = lambda a: F.floor(a / wide).cast("int")
    tolerance = duration_tolerance(seconds)
    low, high = F.greatest(seconds - tolerance, F.lit(0)), seconds + tolerance
    step = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.length(F.bin(F.greatest(low, F.lit(1))))) / 16)).cast("long")
    cells = F.array_distinct(F.concat(F.transform(F.sequence(low, high, step), _duration_cell), F.array(_duration_cell(high))))
    around = F.sequence(aspect_cell(F.col("aspect") - schema.ASPECT_TOLERANCE), aspect_cell(F.col("aspect") + schema.ASPECT_TOLERANCE))
    keys = ["cell", "aspect_cell"]
    asks = rows.withColumn("cell", F.explode(cells)).withColumn("aspect_cell", F.explode(around))
    held = rows.withColumns({"cell": _duration_cell(seconds), "aspect_cell": aspect_cell(F.col("aspect"))})
    number = held.groupBy(*keys).agg(F.count("*").alias("n")).join(asks.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    parts = F.when(F.col("n") * F.col("m") > most, F.ceil(F.col("m") / max(1, math.isqrt(most)))).otherwise(1).cast("long")
    b_parts = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("m") / (F.col("parts") * most))).cast("long")
    sizes = number.withColumn("parts", parts).withColumn("b_parts", b_parts).select(*keys, "parts", "b_parts")
    own = lambda n: F.pmod(F.xxhash64("asset_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = asks.join(sizes, keys).withColumn("part", own("parts")).withColumn("b_part", every("b_parts"))
    held = held.join(sizes, keys).withColumn("b_part", own("b_parts")).withColumn("part", every("parts"))
    return asks.drop("parts", "b_parts"), held.drop("parts", "b_parts")


def video_candidates(videos: DataFrame, most: int = PART) -> DataFrame:
    """Pairs (later, earlier) of videos worth a frame comparison; the later in scan order (newest first) asks, by its own tolerance.

    The band on duration and aspect is an equality join of video_cells. Videos without a size have aspect 0."""
    asks, held = video_cells(videos, most)
    keys = ["cell", "aspect_cell", "part", "b_part"]
    held = held.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("asset_id", "media_store_id", "date_added_s", "seconds", "aspect")))
    close = (F.abs(F.col("seconds") - F.col("b_seconds")) <= duration_tolerance(F.col("seconds"))) & (F.abs(F.col("aspect") - F.col("b_aspect")) <= schema.ASPECT_TOLERANCE)
    return asks.join(held, keys).where(_later() & close).select(F.col("asset_id").alias("later_id"), F.col("b_asset_id").alias("earlier_id"))


def has_band(assets: DataFrame) -> Column:
    """Whether a video is compared in its band of durations and aspects: all but those of REFERENCE_COMPAT's versions."""
    version = F.col("algorithm_version") if "algorithm_version" in assets.columns else F.lit(0)
    return version % 10 != schema.VIDEO_MODES.index("REFERENCE_COMPAT")


def video_edges(videos: DataFrame, frames: DataFrame, band: bool | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Similar videos and recordings. frames: asset_id, hashes, colors, source; a pair with a recording is held to its limits.

    band: whether durations and aspects must be near; by default the videos' versions say so.
    candidates (later_id, earlier_id): the pairs to verify, by their frames only."""
    if candidates is None and band is None:
        parts = [video_edges(videos.where(has_band(videos)), frames, True), video_edges(videos.where(~has_band(videos)), frames, False)]
        return parts[0].unionByName(parts[1])
    side = lambda name, *more: frames.join(videos.select("asset_id", "kind", _version(videos)), "asset_id").select(F.col("asset_id").alias(f"{name}_id"), F.col("kind").alias(f"{name}_kind"), F.col("version").alias(f"{name}_version"), F.col("source").alias(f"{name}_source"), F.size(F.filter("hashes", lambda h: h != schema.INVALID_HASH)).alias(f"{name}_good"), *(F.col(c).alias(f"{name}_{c}") for c in more))
    if band or candidates is not None:
        own = ("hashes", "colors")
        pairs = (video_candidates(comparable(videos)) if candidates is None else candidates).join(side("later", *own), "later_id").join(side("earlier", *own), "earlier_id").where("later_version = earlier_version")
        pairs = pairs.withColumn("matches", rules.matches("VIDEO", *(F.col(f"{n}_{c}") for n in ("later", "earlier") for c in own)))
    else:
        if frames.where("source <> 'REFERENCE_FRAMES'").isEmpty():
            rows = kept(clips(videos, frames), "clips")
            tasks, n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), rows.count()
            found = covering.clip_pairs(rows, max(LEAST, min(TILE // 2, math.isqrt(n * n // (2 * tasks)))))
            kind = F.when(F.col("recording") == 1, "SCREEN_RECORDING").otherwise("VIDEO").alias("kind")
            return canonical(found.select(F.lit("SIMILAR").alias("category"), kind, F.col("id").alias("first_asset_id"), F.col("b_id").alias("second_asset_id")))
        found = frame_matches(videos, frames)
        if not frames.where("source <> 'REFERENCE_FRAMES'").isEmpty():
            found = kept(found, "matches")  # read by both rules
        return canonical(_by_frames(found).select(F.lit("SIMILAR").alias("category"), "kind", F.col("later_id").alias("first_asset_id"), F.col("earlier_id").alias("second_asset_id")))
    kind = F.when((F.col("later_kind") == "SCREEN_RECORDING") | (F.col("earlier_kind") == "SCREEN_RECORDING"), "SCREEN_RECORDING").otherwise("VIDEO")
    alike = rules.alike(kind, F.col("later_source"), F.col("later_good"), F.col("earlier_source"), F.col("earlier_good"), F.col("matches"))
    found = pairs.withColumn("kind", kind).where(alike)
    return canonical(found.select(F.lit("SIMILAR").alias("category"), "kind", F.col("later_id").alias("first_asset_id"), F.col("earlier_id").alias("second_asset_id")))
