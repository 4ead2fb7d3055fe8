"""Rules of the media engine on hand-made rows, and its properties on the small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from twinsift.functions import fingerprint as fp
from video_brute import alike
from twinsift.operators import categories, compression, contacts, grouping, joins, lifecycle
from twinsift.plans import fixtures
from twinsift.sources import media
from twinsift.streaming import incremental
from twinsift.streaming.incremental import Cursor, needs_full_scan


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    "kind, d, c, want",
    [("PHOTO", 10, 7, True), ("PHOTO", 11, 6, False), ("PHOTO", 17, 5, True), ("PHOTO", 18, 0, False), ("PHOTO", 5, 7, True), ("PHOTO", 5, 8, False)]
    + [("SCREENSHOT", 2, 99, True), ("SCREENSHOT", 3, 6, False), ("SCREENSHOT", 10, 5, True), ("SCREENSHOT", 11, 3, False), ("SCREENSHOT", 15, 2, True), ("SCREENSHOT", 16, 0, False)],
)
def test_limits(spark, kind, d, c, want):
    assert one(spark, x=fp.is_similar(kind, F.lit(d), F.lit(c)))["x"] is want


def test_kernels(spark):
    a = F.array(*[F.lit(0.0)] * 24)
    b = F.array(F.lit(7.99), *[F.lit(0.0)] * 23)
    falling = F.array(*(F.lit(200 - 20 * x) * 65793 for _ in range(8) for x in range(9)))
    r = one(
        spark,
        cut=fp.color_distance(a, b),
        all_ones=fp.difference_hash(falling, F.lit(9), F.lit(8)),
        none=fp.difference_hash(F.lit(None).cast("array<int>"), F.lit(9), F.lit(8)),
        far=fp.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")),
        low=fp.low_information(F.array_repeat(F.lit(0x808080), 72)),
        high=fp.low_information(falling),
        favorite=fp.metadata_quality(F.lit(0), F.lit(0), F.lit(True), F.lit(True)),
        text=fp.color_from_text(F.lit("1.5,x,2;0,0,1")),
        s1=fp.size_text(F.lit(1023).cast("long")),
        s2=fp.size_text(F.lit(1280).cast("long")),
        s3=fp.size_text(F.lit(1 << 40).cast("long")),
        e=fp.elapsed_text(F.lit(3_723_000).cast("long")),
        clock=fp.clock_text(F.lit(65_000).cast("long")),
    )
    assert r["cut"] == 7 and r["all_ones"] == -1 and r["none"] == -1 and r["far"] == 64
    assert r["low"] and not r["high"] and r["favorite"] == 8.0 and r["text"] == [1.5, 0.0, 2.0, 0.0, 0.0, 1.0]
    assert (r["s1"], r["s2"], r["s3"], r["e"], r["clock"]) == ("1023 B", "1.3 KB", "1024.0 GB", "1h 02m 03s", "1:05")
    flat = F.array_repeat(F.lit(0x808080), 64 * 64)
    assert one(spark, q=fp.full_quality(flat, F.lit(64), F.lit(64), F.lit(0.0)))["q"] == pytest.approx(30.0)


def test_hash_of_larger_rasters(spark):
    """Samples between pixels are interpolated."""
    rng = random.Random(4)
    w, h = 23, 17
    px = [rng.randrange(1 << 24) for _ in range(w * h)]
    gray = [0.299 * (p >> 16 & 255) + 0.587 * (p >> 8 & 255) + 0.114 * (p & 255) for p in px]

    def sample(i, j):
        x, y = (w - 1) * i / 8, (h - 1) * j / 7
        x0, y0 = int(x), int(y)
        x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
        top = gray[y0 * w + x0] * (1 - (x - x0)) + gray[y0 * w + x1] * (x - x0)
        low = gray[y1 * w + x0] * (1 - (x - x0)) + gray[y1 * w + x1] * (x - x0)
        return top * (1 - (y - y0)) + low * (y - y0)

    want = 0
    for j in range(8):
        for i in range(8):
            want = want << 1 | (sample(i, j) > sample(i + 1, j))
    got = spark.createDataFrame([(px,)], "r array<int>").select(fp.difference_hash(F.col("r"), F.lit(w), F.lit(h)).alias("x")).first()["x"]
    assert got % (1 << 64) == want


def test_classifiers(spark):
    names = [("video", "forecast.mp4", "SCREEN_RECORDING"), ("image", "screen_1.png", "SCREENSHOT"), ("image", "my_screen_1.png", "PHOTO"), ("image", "My Screen-Shot.png", "SCREENSHOT"), ("video", "holiday.mp4", "VIDEO")]
    rows = spark.createDataFrame(names, "t string, n string, want string").select("want", media.kind_of(F.col("t"), F.col("n")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)
    assert one(spark, x=media.chat_source(F.lit("a"), F.lit("Facebook"), F.lit("")))["x"] == "MESSENGER"


def test_access():
    assert media.access_level(True, False, False, False, 33) == "IMAGES_ONLY"
    assert media.access_level(False, False, True, False, 34) == "PARTIAL_VISUAL"
    assert media.access_level(True, True, True, False, 34) == "FULL_VISUAL"
    assert media.access_level(False, False, False, True, 30) == "LEGACY_FULL"


def frames(n, bad=()):
    return [-1 if i in bad else (0x9E3779B97F4A7C15 * (i + 1)) % (1 << 62) for i in range(n)], [[0.0] * 24] * n


def test_video_rules():
    h, c = frames(7)
    other = [x ^ ((1 << 62) - 1) for x in h]
    rule = lambda kind, b: alike(kind, "REFERENCE_FRAMES", h[: len(b)], c[: len(b)], "REFERENCE_FRAMES", b, c[: len(b)])
    assert rule("VIDEO", [h[0], other[1]]) and not rule("VIDEO", other[:2])
    assert rule("VIDEO", [h[0], h[1], *other[2:5]]) and not rule("VIDEO", [h[0], *other[1:5]])
    assert rule("VIDEO", [h[0], h[1], h[2], *other[3:]]) and not rule("VIDEO", [h[0], h[1], *other[2:]])
    assert not rule("VIDEO", [h[0], h[0], h[0], *other[3:]])
    h, c = frames(13)
    other = [x ^ ((1 << 62) - 1) for x in h]
    five = [*h[:5], *other[5:]]
    assert alike("VIDEO", "REFERENCE_FRAMES", h, c, "REFERENCE_FRAMES", five, c)
    assert not alike("SCREEN_RECORDING", "REFERENCE_FRAMES", h, c, "REFERENCE_FRAMES", five, c)
    assert not alike("VIDEO", "SYSTEM_THUMBNAIL", h[:1], c[:1], "MMR_FRAMES", h, c)
    assert alike("VIDEO", "SYSTEM_THUMBNAIL", h[:1], c[:1], "SYSTEM_THUMBNAIL", h[:1], c[:1])
    assert alike("VIDEO", "MMR_FRAMES", h[:4], c[:4], "MMR_FRAMES", h[:4], c[:4])
    assert not alike("VIDEO", "MMR_FRAMES", h[:2], c[:2], "MMR_FRAMES", h[:2], c[:2])


def sequential(order, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, out = set(), set()
    for a in order:
        if a in taken:
            continue
        mine = near.get(a, set()) - taken
        taken |= {a} | mine
        if mine:
            out |= {(a, a)} | {(a, b) for b in mine}
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_anchor_groups_are_the_sequential_ones(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(110)}
    order = list(range(n))
    rng.shuffle(order)
    ranks = spark.createDataFrame([(a, (i, 0, a)) for i, a in enumerate(order)], "asset_id long, order struct<a:long,b:long,c:long>")
    found = grouping.anchor_groups(ranks, spark.createDataFrame(list(edges), "first_asset_id long, second_asset_id long")).collect()
    assert {(r["group_id"], r["asset_id"]) for r in found} == sequential(order, edges)
    assert all(r["is_anchor"] == (r["group_id"] == r["asset_id"]) for r in found)


def test_similar_pairs_lose_none(spark):
    """The keyed join finds what comparing all pairs finds."""
    rng = random.Random(9)
    rows = []
    for i in range(150):
        h = rng.getrandbits(63) if i % 5 == 0 or not rows else rows[rng.randrange(len(rows))][1]
        for _ in range(rng.randrange(20)):
            h ^= 1 << rng.randrange(63)
        cuts = [sorted(rng.choices(range(17), k=7)) for _ in range(3)]
        color = [float(([0, *cut, 16][level + 1]) - ([0, *cut, 16][level])) for level in range(8) for cut in cuts]
        if rows and rng.random() < 0.6:
            color = list(rows[rng.randrange(len(rows))][2])
        rows.append((i, h, color))
    df = spark.createDataFrame(rows, "asset_id long, image_hash long, color_hash array<double>")

    def similar(kind, a, b):
        most, direct, ranges = joins.schema.LIMITS[kind]
        d, c = (a[1] ^ b[1]).bit_count(), int(sum(abs(x - y) for x, y in zip(a[2], b[2], strict=True)))
        return d < most and (d <= direct or any(lo <= d <= hi and c <= limit for lo, hi, limit in ranges))

    for kind in ("PHOTO", "SCREENSHOT"):
        want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(kind, a, b)}
        got = {tuple(r) for r in joins.similar_pairs(df, df, kind).collect()}
        assert got == want and want


@pytest.fixture(scope="module")
def library(spark, small):
    return fixtures.library(spark, small)


def test_every_photo_is_in_one_place(spark, library):
    items = grouping.image_items(library, "PHOTO").cache()
    photos = library.where("kind = 'PHOTO' and state = 'ACTIVE'")
    rest = categories.ungrouped(library, items, ["PHOTO"], ["SIMILAR", "DUPLICATE"])
    assert items.count() == items.select("asset_id").distinct().count()
    assert items.count() + rest.count() == photos.count()
    similar = items.where("category = 'SIMILAR'")
    anchors = similar.where("is_anchor").select("asset_id").collect()
    edges = {tuple(r) for r in joins.similar_edges(library, "PHOTO").select("first_asset_id", "second_asset_id").collect()}
    ids = sorted(r[0] for r in anchors)
    assert not any((a, b) in edges for i, a in enumerate(ids) for b in ids[i + 1 :])
    for r in similar.where("not is_anchor").collect():
        assert tuple(sorted((r["group_id"], r["asset_id"]))) in edges


def test_rollup_has_seven_rows(spark, library):
    items = grouping.image_items(library, "PHOTO").unionByName(grouping.image_items(library, "SCREENSHOT"))
    rows = categories.category_rollup(items, library).orderBy("position").collect()
    assert [r["product"] for r in rows] == joins.schema.PRODUCT_CATEGORIES
    assert sum(r["items"] for r in rows if r["product"].startswith("OTHER")) + items.count() == library.where("state = 'ACTIVE'").count()
    live = categories.category_rollup(items, library).where("position < 2")
    assert categories.merged(live, categories.category_rollup(items, library)).count() == 7


def test_increments_equal_a_full_scan(spark, library):
    photos = library.where("kind = 'PHOTO'")
    full = {tuple(r) for r in joins.similar_pairs(photos, photos, "PHOTO").collect()}
    found = set()
    for g in (1, 2, 3):
        part = incremental.incremental_edges(library.where(F.col("generation_modified") == g), library.where(F.col("generation_modified") < g), "PHOTO")
        found |= {(r["first_asset_id"], r["second_asset_id"]) for r in part.collect()}
    assert found == full


def test_stream_of_assets(spark, library, tmp_path):
    photos = library.where("kind = 'PHOTO'").select("asset_id", "kind", "image_hash", "color_hash")
    for g in range(2):
        photos.where(F.col("asset_id") % 2 == g).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    paths = {n: str(tmp_path / n) for n in ("in", "state", "edges", "checkpoint")}
    incremental.stream_edges(spark, paths["in"], paths["state"], paths["edges"], paths["checkpoint"]).awaitTermination()
    got = {(r[0], r[1]) for r in spark.read.parquet(paths["edges"]).select("first_asset_id", "second_asset_id").collect()}
    assert got == {tuple(r) for r in joins.similar_pairs(photos, photos, "PHOTO").collect()}


def test_lifecycle(spark):
    state = spark.createDataFrame([(1, 1, "PHOTO", "ACTIVE", 1, "DONE", "a", "s", 5), (2, 2, "PHOTO", "DELETE_PENDING", 2, "DONE", None, "s", 5), (3, 3, "PHOTO", "ACTIVE", 2, "DONE", "b", "s", 5)], "asset_id long, media_store_id long, kind string, state string, revision long, fingerprint_status string, last_seen_scan string, source_signature string, algorithm_version int")
    results = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "asset_id long, revision long")
    assert [r["asset_id"] for r in lifecycle.committed(results, state).collect()] == [1]
    for full, access, want in ((True, True, [2, 3]), (True, False, [1, 2, 3]), (False, True, [1, 2, 3])):
        assert sorted(r["asset_id"] for r in lifecycle.sweep(state, "b", full, access, {})[0].collect()) == want
    items = spark.createDataFrame([("SIMILAR", "PHOTO", 1, 1, True), ("SIMILAR", "PHOTO", 1, 2, False)], "category string, kind string, group_id long, asset_id long, is_anchor boolean")
    edges = spark.createDataFrame([("SIMILAR", "PHOTO", 1, 2), ("SIMILAR", "PHOTO", 1, 3)], "category string, kind string, first_asset_id long, second_asset_id long")
    left, tables = lifecycle.finalize(state, spark.createDataFrame([(2,)], "asset_id long"), {"items": items, "edges": edges})
    assert left.count() == 2 and tables["items"].count() == 0 and tables["edges"].count() == 1
    assert joins.live_edges(edges, state).count() == 1
    scanned = state.where("asset_id in (1, 3)").withColumn("source_signature", F.when(F.col("asset_id") == 1, "new").otherwise("s"))
    after = {r["asset_id"]: r for r in lifecycle.upsert(state, scanned, "c").collect()}
    assert after[1]["revision"] == 2 and after[1]["fingerprint_status"] == "PENDING" and after[3]["revision"] == 2 and after[2]["state"] == "DELETE_PENDING"
    marked = lifecycle.request_states(state, spark.createDataFrame([(1, "mark_pending"), (1, "restore"), (3, "mark_pending")], "asset_id long, action string"))
    assert {(r["asset_id"], r["state"], r["revision"]) for r in marked.collect()} == {(1, "ACTIVE", 3), (2, "DELETE_PENDING", 2), (3, "DELETE_PENDING", 3)}
    assert lifecycle.is_stale(None, "s", "s", 0) and lifecycle.is_stale("o", "x", "s", 0) and not lifecycle.is_stale("o", "s", "s", 1)


def test_group_that_shrinks_to_one_is_hidden(spark, library):
    two = library.where("kind = 'PHOTO'").orderBy("asset_id").limit(2).select("asset_id").collect()
    a, b = two[0][0], two[1][0]
    items = spark.createDataFrame([("SIMILAR", "PHOTO", a, a, True), ("SIMILAR", "PHOTO", a, b, False)], "category string, kind string, group_id long, asset_id long, is_anchor boolean")
    pending = library.withColumn("state", F.when(F.col("asset_id") == b, "DELETE_PENDING").otherwise(F.col("state")))
    assert categories.group_stats(items, pending).count() == 0
    assert categories.ungrouped(pending, items, ["PHOTO"], ["SIMILAR"]).where(F.col("asset_id").isin(a, b)).count() == 0


def test_contacts(spark):
    rows = spark.createDataFrame([(1, "Ann", "--"), (2, " ann ", "n/a"), (3, "", "+1 (2)"), (4, "Bo", "12"), (5, "Cy", "")], "id long, name string, phone string")
    assert sorted(r["id"] for r in contacts.duplicate_phones(rows).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in contacts.same_names(rows).collect()) == [1, 2]
    assert sorted(r["id"] for r in contacts.incomplete(rows).collect()) == [3, 5]
    assert [r["items"] for r in contacts.summary(rows).orderBy("position").collect()] == [4, 2, 2]


def test_compression(spark):
    mib = 1 << 20
    sizes = [(1, 300 * mib), (2, 300 * mib - 2), (3, 80 * mib), (4, 80 * mib - 2), (5, 1)]
    rows = spark.createDataFrame([(i, None, s, 60_000, 1280, 720, 0) for i, s in sizes], "id long, display_name string, size_bytes long, duration_ms long, width int, height int, bitrate int")
    assert {r["id"]: r["bucket"] for r in compression.bucketed(rows).collect()} == {1: "EXTREME", 2: "MODERATE", 3: "MODERATE", 4: "LIGHT", 5: "LIGHT"}
    cases = [(1, True, 2999, 9_000_000, mib, "HDR"), (2, False, 2999, 9_000_000, 50 * mib, "TOO_SHORT"), (3, False, 60_000, 899_999, 50 * mib, "LOW_BITRATE"), (4, False, 60_000, 9_000_000, 3 * mib - 1, "SMALL_FILE"), (5, False, 60_000, 9_000_000, 500 * mib, None)]
    clips = spark.createDataFrame([(i, s, d, 1280, 720, 0) for i, _, d, _, s, _ in cases], "id long, size_bytes long, duration_ms long, width int, height int, bitrate int")
    tracks = spark.createDataFrame([(i, False, hdr, b, 30, 1280, 720, 0) for i, hdr, _, b, _, _ in cases], "id long, is_hevc boolean, is_hdr boolean, bitrate int, frame_rate int, width int, height int, rotation_degrees int")
    assert {r["id"]: r["reject_reason"] for r in compression.plan(clips, tracks).collect()} == {c[0]: c[5] for c in cases}
    done = spark.createDataFrame([(1, 100, 97), (2, 100, 98), (3, 100, 0)], "id long, size_bytes long, output_bytes long")
    assert [r["problem"] for r in compression.validated(done).orderBy("id").collect()] == [None, "NOT_SMALLER", "EMPTY"]
    queue = spark.createDataFrame([(1, 0, "SUCCESS", 0), (1, 1, "FAILED", 0), (1, 2, "ACTIVE", 50), (1, 3, "WAITING", 0)], "queue_id long, position int, status string, active_percent int")
    assert tuple(compression.queue_totals(queue).first()) == (1, 1, 1, 62)


def test_scan_policy():
    good = Cursor(1, 1, 1_000, "v")
    assert not needs_full_scan(good, 2_000, "v", 5, "FULL_VISUAL")
    assert needs_full_scan(good, 2_000, "w", 5, "FULL_VISUAL") and needs_full_scan(good, 2_000, "v", 0, "FULL_VISUAL")
    assert needs_full_scan(good, 2_000, "v", 5, "PARTIAL_VISUAL") and needs_full_scan(good, 1_000 + incremental.DAY_MS, "v", 5, "FULL_VISUAL")


def test_cursor(spark, tmp_path):
    seen = spark.createDataFrame([("image", 4), ("image", 9), ("video", 3)], "media_type string, generation_modified long")
    after = incremental.advanced(Cursor(), seen, 50, "v", True, True)
    incremental.save_cursor(spark, after, str(tmp_path / "cursor"))
    assert incremental.read_cursor(spark, str(tmp_path / "cursor")) == Cursor(9, 3, 50, "v")


def test_stream_and_its_replay(spark, tmp_path):
    """Two files, two micro-batches: together the edges of all pictures; a replay from the start gives them again."""
    rng = random.Random(9)
    color = [2.0] * 24
    base = [rng.getrandbits(60) for _ in range(4)]
    rows = [(i, "PHOTO", base[i % 4] ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)), color) for i in range(40)]
    fields = "asset_id long, kind string, image_hash long, color_hash array<double>"
    for i, part in enumerate((rows[:25], rows[25:])):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    where = {n: str(tmp_path / n) for n in ("state", "edges", "counts")}
    everything = spark.createDataFrame(rows, fields)
    want = sorted(tuple(r) for r in joins.similar_pairs(everything, everything, "PHOTO").collect())
    for run in ("first", "replay"):
        incremental.stream_edges(spark, str(tmp_path / "in"), where["state"], where["edges"], str(tmp_path / run), kinds=("PHOTO",), counts=where["counts"]).awaitTermination(120)
        got = spark.read.parquet(where["edges"]).select("first_asset_id", "second_asset_id").collect()
        assert sorted(map(tuple, got)) == want and len(want) > 100
        counts = spark.read.parquet(where["counts"]).groupBy().sum("assets", "edges").first()
        assert tuple(counts) [:2] == (40, len(want))


def test_queries_match_their_sql(spark, small):
    """A few cheap ones; the rest are compared by the driver."""
    import duckdb

    from twinsift.plans import catalog

    con = duckdb.connect()
    for t in ("documents", "customer", "orders", "events"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name in ("media_normalise", "source_signature", "asset_buckets", "compress_plan", "contact_summary", "reference_sample_times", "video_band_candidates"):
        df = catalog.QUERIES[name](spark, small)
        cols = sorted(df.columns)
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
        assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want, name


@pytest.mark.parametrize("rounds, together", [(3, 500_000), (1, 3), (50, 0)])
def test_anchor_rounds(spark, rounds, together):
    """A chain in rank order, stars and random edges; whatever is finished in one task, the groups are the same."""
    rng = random.Random(8)
    edges = {(i, i + 1) for i in range(40)} | {(100, i) for i in range(101, 110)} | {tuple(sorted(rng.sample(range(200, 240), 2))) for _ in range(60)}
    rows = spark.createDataFrame(sorted(edges), "first_asset_id long, second_asset_id long")
    ranks = spark.createDataFrame([(i, (i * 7919 % 1000 if i >= 100 else i, 0, i)) for i in range(240)], "asset_id long, order struct<a long, b long, c long>")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    taken, want = set(), set()
    for i in sorted(near, key=lambda i: (i * 7919 % 1000 if i >= 100 else i, 0, i)):
        if i not in taken:
            mine = near[i] - taken
            taken |= mine | {i}
            want |= {(i, j, j == i) for j in mine | {i}} if mine else set()
    assert {tuple(r) for r in grouping.anchor_groups(ranks, rows, rounds, together).collect()} == want


def test_long_chain_ends(spark):
    """10,000 assets, each like the next: one round settles one anchor, so they are finished in one task."""
    from pyspark.sql import functions as F

    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("first_asset_id"), (F.col("id") + 1).alias("second_asset_id"))
    ranks = spark.range(n).select(F.col("id").alias("asset_id"), F.struct(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("order"))
    got = grouping.anchor_groups(ranks, edges)
    assert got.count() == n and got.where("is_anchor and asset_id % 2 = 0").count() == n // 2


def test_only_comparable_assets_meet(spark):
    """Inactive assets, unfinished fingerprints and other versions are in no pair or similar group; versions don't matter to duplicates."""
    color = [2.0] * 24
    rows = [(i, "PHOTO", 10, 5, 5, False, 7 if i < 6 else 7 ^ (1 << i), color, state, status, version, i, i) for i, (state, status, version) in enumerate([("ACTIVE", "DONE", 1), ("DELETE_PENDING", "DONE", 1), ("ACTIVE", "DONE", 2)] * 2 + [("ACTIVE", "DONE", 1), ("ACTIVE", "DONE", 1), ("ACTIVE", "PENDING", 1), ("DELETE_PENDING", "DONE", 1), ("ACTIVE", "DONE", 2)])]
    assets = spark.createDataFrame(rows, "asset_id long, kind string, size_bytes long, width int, height int, is_edited boolean, image_hash long, color_hash array<double>, state string, fingerprint_status string, algorithm_version int, created_at_ms long, media_store_id long")
    assert {r["asset_id"] for r in joins.duplicate_groups(assets).collect()} == {0, 2, 3, 5}
    assert {(r["first_asset_id"], r["second_asset_id"]) for r in joins.similar_edges(assets, "PHOTO").collect()} == {(6, 7)}
    assert {r["asset_id"] for r in grouping.groups_of(assets, "PHOTO").collect()} == {6, 7}


def test_spread_pictures_meet_rarely(spark, monkeypatch):
    """Pictures whose colours are spread out: every similar pair is found, and few pairs are compared."""
    rng = random.Random(5)

    def color():
        out = [0.0] * 24
        for c in range(3):
            cuts = sorted(rng.choices(range(17), k=2))
            levels = rng.sample(range(8), 3)
            for level, n in zip(levels, (cuts[0], cuts[1] - cuts[0], 16 - cuts[1]), strict=True):
                out[3 * level + c] += float(n)
        return out

    rows = []
    for i in range(400):
        if rows and rng.random() < 0.3:
            _, h, c = rng.choice(rows)
            for _ in range(rng.choice((1, 5, 12, 16))):
                h ^= 1 << rng.randrange(62)
            c = list(c)
            k = rng.randrange(3)
            full = [i for i in range(k, 24, 3) if c[i] >= 2]
            c[full[0]] -= 2.0
            c[(full[0] + 3) % 24] += 2.0
        else:
            h, c = rng.getrandbits(62), color()
        rows.append((i, h, c))
    df = spark.createDataFrame(rows, "asset_id long, image_hash long, color_hash array<double>")
    most, direct, ranges = joins.schema.LIMITS["PHOTO"]

    def similar(x, y):
        d = (x[1] ^ y[1]).bit_count()
        c = int(sum(abs(p - q) for p, q in zip(x[2], y[2], strict=True)))
        return d <= direct or any(low <= d <= high and d < most and c <= limit for low, high, limit in ranges)

    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and similar(x, y)}
    for tile in (8192, 16):
        monkeypatch.setattr(joins, "TILE", tile)
        monkeypatch.setattr(joins, "LEAST", min(tile, 256))
        assert sorted(tuple(r) for r in joins.similar_pairs(df, df, "PHOTO").collect()) == sorted(want) and len(want) > 50
    # Meetings, with the tests on hashes and colours left out.
    met = []
    monkeypatch.setattr(joins, "_joined", lambda a, b, keys, condition: met.append(a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.b_{k}") for k in keys]).where("a.asset_id < b.b_asset_id").count()) or a.crossJoin(b.limit(0)).drop(*keys, *(f"b_{k}" for k in keys)))
    joins.similar_pairs(df, df, "PHOTO")
    assert sum(met) < 0.25 * len(rows) * (len(rows) - 1) / 2


def test_pictures_follow_the_tables(spark, small, tmp_path):
    """A table that changes between two calls is drawn anew."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert fixtures.library(spark, str(tmp_path)).count() == docs.where("n_chars > 0").count()
    docs.where("doc_id % 10 = 0").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert fixtures.library(spark, str(tmp_path)).count() == docs.where("n_chars > 0 and doc_id % 10 = 0").count()


def test_wide_videos_get_the_lower_height(spark):
    rows = spark.createDataFrame([(1, 2560, 1080), (2, 3440, 1000), (3, 3440, 1440), (4, 1920, 1080), (5, 2560, 720), (6, 1080, 2560)], "id long, width int, height int")
    videos = rows.selectExpr("*", "100000000L size_bytes", "60000L duration_ms", "0 bitrate")
    tracks = videos.limit(0).selectExpr("id", "true is_hevc", "true is_hdr", "bitrate", "1 frame_rate", "width", "height", "0 rotation_degrees")
    got = {r["id"]: r["target_height"] for r in compression.plan(videos, tracks).collect()}
    assert got == {1: 720, 2: 720, 3: 1080, 4: 720, 5: None, 6: 720}
