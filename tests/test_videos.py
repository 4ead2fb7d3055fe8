"""Videos without a band: candidates by frames against all pairs, and the roll-up against the groups."""

from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from video_brute import alike
from twinsift.operators import joins


def some_videos(rng, n):
    """(asset_id, added, kind, source, hashes, colors): copies with changed bits and colours, lost and single frames."""
    def color():
        cuts = [sorted(rng.choices(range(17), k=7)) for _ in range(3)]
        return [float([0, *cut, 16][i + 1] - [0, *cut, 16][i]) for i in range(8) for cut in cuts]

    rows = []
    for i in range(n):
        if rows and rng.random() < 0.8:
            *_, h, c = rng.choice(rows)
            h, c = list(h), [list(x) for x in c]
            for k in range(len(h)):
                for _ in range(rng.choice((0, 1, 4, 9, 20))):
                    h[k] ^= 1 << rng.randrange(62)
                if rng.random() < 0.3:
                    c[k] = color()
        else:
            h, c = [rng.getrandbits(62) for _ in range(rng.choice((1, 2, 5, 7)))], None
            c = [color() for _ in h]
        if rng.random() < 0.1:
            h[0] = -1
        source = "SYSTEM_THUMBNAIL" if len(h) == 1 else rng.choice(("REFERENCE_FRAMES", "MMR_FRAMES"))
        rows.append((i, rng.randrange(20), rng.choice(("VIDEO", "SCREEN_RECORDING")), source, h, c))
    return rows


def test_frame_candidates_lose_no_video(spark):
    rows = some_videos(random.Random(6), 90)
    # Durations and aspects far apart: no band.
    videos = spark.createDataFrame([(i, i, t, k, 1000 * i * i, 100 + 50 * i, 400) for i, t, k, *_ in rows], "asset_id long, media_store_id long, date_added_s long, kind string, duration_ms long, width int, height int")
    frames = spark.createDataFrame([(i, h, c, s) for i, _, _, s, h, c in rows], "asset_id long, hashes array<long>, colors array<array<double>>, source string")
    want = set()
    for x, y in permutations(rows, 2):
        if (x[1], x[0]) < (y[1], y[0]):  # x is scanned later
            kind = "SCREEN_RECORDING" if "SCREEN_RECORDING" in (x[2], y[2]) else "VIDEO"
            if alike(kind, x[3], x[4], x[5], y[3], y[4], y[5]):
                want.add((kind, min(x[0], y[0]), max(x[0], y[0])))
    edges = joins.video_edges(videos, frames, band=False)
    assert {tuple(r)[1:] for r in edges.collect()} == want and len(want) > 30
    # Fewer than all pairs are compared.
    assert joins.frame_matches(videos, frames).select("later_id", "earlier_id").distinct().count() < len(rows) * (len(rows) - 1) // 4


def test_rollup_has_the_video_groups(spark, small):
    from twinsift.plans import catalog

    groups = catalog.QUERIES["video_groups"](spark, small).agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("items")).first()
    row = catalog.QUERIES["category_rollup"](spark, small).where("product = 'SIMILAR_VIDEOS'").first()
    assert (row["groups"], row["items"]) == tuple(groups) and groups["items"]


def test_a_common_frame_is_compared_once(spark):
    """A black frame in every video is one look, and does not make videos alike."""
    rng = random.Random(8)
    color = [2.0] * 24
    rows = [(i, [0, *(rng.getrandbits(62) for _ in range(6))], [color] * 7, "REFERENCE_FRAMES") for i in range(40)]
    rows += [(100 + i, rows[i][1][:3] + [rng.getrandbits(62) for _ in range(4)], [color] * 7, "REFERENCE_FRAMES") for i in range(5)]
    frames = spark.createDataFrame(rows, "asset_id long, hashes array<long>, colors array<array<double>>, source string")
    videos = frames.selectExpr("asset_id", "asset_id media_store_id", "asset_id date_added_s", "'VIDEO' kind", "1000L duration_ms", "100 width", "100 height")
    each = frames.selectExpr("asset_id", "0 version", "posexplode(hashes) AS (frame, image_hash)").selectExpr("asset_id * 64 + frame AS member", "version", "image_hash", "array_repeat(2.0D, 24) AS color_hash")
    seen, members = joins.looks(each, "member")
    assert seen.where("image_hash = 0").count() == 1 and members.count() == 45 * 7
    got = {(r["first_asset_id"], r["second_asset_id"]) for r in joins.video_edges(videos, frames, band=False).collect()}
    assert got == {(i, 100 + i) for i in range(5)}


def test_tiles_give_the_numbers_of_the_columns(spark):
    """Distances by arrays and by column expressions are the same, also where sums of ninths come near a whole number."""
    from twinsift.functions import fingerprint as fp

    rng = random.Random(4)
    rows = [(i, 0, rng.getrandbits(10), [rng.randrange(10) * 2 / 9 for _ in range(24 if i % 9 else 20)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, version int, image_hash long, color_hash array<double>")
    b = df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))
    distance, colors = fp.hamming(F.col("image_hash"), F.col("b_image_hash")), fp.color_distance(F.col("color_hash"), F.col("b_color_hash"))
    want = df.crossJoin(b).where((F.col("id") < F.col("b_id")) & fp.is_similar("PHOTO", distance, colors)).select("id", "b_id", distance, colors)
    order = lambda r: (min(r[0], r[1]), max(r[0], r[1]), *r[2:])
    got = [order(r) for r in joins.near(df, None, "PHOTO").collect()]
    assert sorted(got, key=str) == sorted((order(r) for r in want.collect()), key=str) and len(got) > 50
    both = joins.near(df, df, "PHOTO").where("id < b_id").collect()
    assert sorted(map(order, both), key=str) == sorted(got, key=str)


CLIP = "asset_id long, media_store_id long, date_added_s long, duration_ms long, width int, height int"


def test_band_loses_no_pair_however_cells_are_cut(spark):
    rng = random.Random(8)
    rows = [(i, i, rng.randrange(30), rng.choice((0, 900, 15_000, rng.randrange(200_000))), rng.choice((0, 320, 640, rng.randrange(200, 2000))), rng.choice((240, 480, rng.randrange(200, 2000)))) for i in range(150)]
    videos = spark.createDataFrame(rows, CLIP)
    aspect = lambda r: int(r[4] / r[5] * 100) if r[4] > 0 and r[5] > 0 else 0
    want = set()
    for x, y in permutations(rows, 2):
        s, t = x[3] // 1000, y[3] // 1000
        if (x[2], x[1]) < (y[2], y[1]) and abs(s - t) <= max(2, s // 10) and abs(aspect(x) - aspect(y)) <= 8:
            want.add((x[0], y[0]))
    for most in (1, 60, joins.PART):
        found = [tuple(r) for r in joins.video_candidates(videos, most).collect()]
        assert len(found) == len(set(found)) and set(found) == want  # each pair once, without distinct


def test_clips_of_one_duration_are_spread_by_aspect_and_parts(spark):
    n = 10_000
    varied = spark.range(n).selectExpr("id AS asset_id", "id AS media_store_id", "id AS date_added_s", "15000L AS duration_ms", "CAST(300 + id % 900 AS INT) AS width", "300 AS height")
    keys = ["cell", "aspect_cell", "part", "b_part"]

    def most_met(videos, most=joins.PART):
        asks, held = (x.groupBy(*keys).agg(F.count("*").alias(c)) for x, c in zip(joins.video_cells(videos, most), "mn", strict=True))
        return asks.join(held, keys).agg(F.max(F.col("m") * F.col("n")), F.sum(F.col("m") * F.col("n"))).first()

    largest, met = most_met(varied)
    assert largest <= 1.5 * joins.PART and met < 0.2 * n * n
    # The same clip ten thousand times: all pairs are in the band, in parts of a bounded size.
    largest, met = most_met(varied.withColumn("width", F.lit(300)))
    assert largest <= 1.5 * joins.PART and met == n * n
    assert joins.video_candidates(varied.where("asset_id < 0")).count() == 0
