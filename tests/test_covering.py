"""Groups by blocks of anchors against the groups by all edges."""

from __future__ import annotations

import random

import pytest

from twinsift.operators import grouping, joins

ASSET = "asset_id long, media_store_id long, kind string, state string, fingerprint_status string, algorithm_version int, created_at_ms long, date_added_s long, size_bytes long, width int, height int, is_edited boolean, image_hash long, color_hash array<double>"


def pictures(spark, seed, n):
    """Families of changed copies, some of them large, in a random order of ranks; some not active, unfinished or of another version."""
    rng = random.Random(seed)
    rows, looks = [], []
    for i in range(n):
        if looks and rng.random() < 0.7:
            h, c = rng.choice(looks[-30:])
            for _ in range(rng.choice((0, 1, 3, 7, 12))):
                h ^= 1 << rng.randrange(62)
            c = [x + rng.choice((0, 0, 0, 1)) * 2 / 9 for x in c]
        else:
            h, c = rng.getrandbits(62), [rng.randrange(10) * 2 / 9 for _ in range(24)]
        looks.append((h, c))
        rows.append((i, i, "PHOTO", rng.choice(["ACTIVE"] * 9 + ["DELETE_PENDING"]), rng.choice(["DONE"] * 9 + ["PENDING"]), rng.choice((1, 1, 1, 2)), rng.randrange(n // 2), i, rng.randrange(3), 1, 1, False, h, c))
    return spark.createDataFrame(rows, ASSET)


@pytest.mark.parametrize(("seed", "block", "sparse"), [(1, 4096, 32), (2, 20, 0), (3, 50, 2), (4, 20, 10**9)])
def test_blocks_give_the_groups_of_all_edges(spark, seed, block, sparse):
    assets = pictures(spark, seed, 300)
    ranks = grouping.scan_rank(assets, "PHOTO")
    want = grouping.anchor_groups(ranks, joins.similar_edges(assets, "PHOTO")).collect()
    found = grouping.compared(assets, ranks, "PHOTO", None, block, sparse).collect()
    assert sorted(found) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("sparse", [0, 10**9])
def test_blocks_within_stored_groups(spark, sparse):
    assets = pictures(spark, 5, 300)
    members = assets.selectExpr("image_hash & 3 AS group_id", "asset_id")
    ranks = grouping.scan_rank(assets, "PHOTO")
    want = grouping.anchor_groups(ranks, joins.verified_edges(members, assets, "PHOTO")).collect()
    assert sorted(grouping.compared(assets, ranks, "PHOTO", members, 20, sparse).collect()) == sorted(want) and len(want) > 50


def test_a_crowd_makes_no_pairs(spark, monkeypatch):
    """Five thousand pictures that all look alike: 12 million pairs, but one anchor."""
    n = 5000
    crowd = spark.range(n).selectExpr("id AS asset_id", "id AS media_store_id", "'PHOTO' AS kind", "'ACTIVE' AS state", "'DONE' AS fingerprint_status", "1 AS algorithm_version", "-id AS created_at_ms", "id AS date_added_s", "id AS size_bytes", "1 AS width", "1 AS height", "false AS is_edited", "id % 16 AS image_hash", "array_repeat(1.0D, 24) AS color_hash")

    def pairs(*_):
        raise AssertionError("pairs were made")

    for name in ("near", "placed_pairs"):
        monkeypatch.setattr(joins, name, pairs, raising=False)
    found = grouping.groups_of(crowd, "PHOTO")
    assert found.count() == n and [r["group_id"] for r in found.select("group_id").distinct().collect()] == [n - 1]
    assert grouping.snapshot_groups(crowd).select("group_id").distinct().first()["group_id"] == 0


def test_pictures_are_drawn_where_texts_are_read(spark):
    """Without a shuffle of words; odd texts give the same rasters as word by word."""
    import re

    from twinsift.plans import fixtures

    texts = [None, "", " \n\t", "a", "  One two\tthree\r\nthree  ", "naïve 𝒳yz \x0b\x0c é", "x " * 3000, "y" * 5000, *(" ".join(f"w{i * k % 13}" for i in range(k)) for k in range(1, 20))]
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")

    def raster(words):
        values = [0] * 216
        for w in words:
            a, z, n = ord(w[0]), ord(w[-1]), len(w)
            for channel, cell in enumerate(((a * 31 + n) % 72, (z * 7 + n) % 72, (a * 13 + z) % 72)):
                values[cell * 3 + channel] += 1
        values = [min(255, v * 2550 // max(1, len(words))) for v in values]
        return [values[3 * i] * 65536 + values[3 * i + 1] * 256 + values[3 * i + 2] for i in range(72)]

    cut = [[w for w in re.split("[ \n\t\r]+", t or "") if w] for t in texts]
    found = fixtures.image_rasters(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["raster"] for r in found.collect()} == {i: raster(w) for i, w in enumerate(cut)}
    slices = {(i, 7 * p // len(w)): [] for i, w in enumerate(cut) for p in range(len(w))}
    for i, w in enumerate(cut):
        for p, word in enumerate(w):
            slices[i, 7 * p // len(w)].append(word)
    frames = fixtures._painted(docs.select("doc_id", "text"), 7).collect()
    assert {(r["doc_id"], r["frame"]): r["raster"] for r in frames} == {k: raster(w) for k, w in slices.items()} and len(frames) == len(slices)


@pytest.mark.parametrize(("block", "sparse"), [(1024, 32), (10, 0), (10, 10**9)])
def test_videos_of_reference_frames(spark, monkeypatch, block, sparse):
    """Edges and groups without a table of similar frames, against the rule in plain Python."""
    from itertools import permutations

    from test_videos import some_videos
    from video_brute import alike

    rows = [(i, t, k, "REFERENCE_FRAMES", h, c) for i, t, k, _, h, c in some_videos(random.Random(11), 90)]
    videos = spark.createDataFrame([(i, i, t, k) for i, t, k, *_ in rows], "asset_id long, media_store_id long, date_added_s long, kind string")
    frames = spark.createDataFrame([(i, h, c, s) for i, _, _, s, h, c in rows], "asset_id long, hashes array<long>, colors array<array<double>>, source string")
    want = set()
    for x, y in permutations(rows, 2):
        if (x[1], x[0]) < (y[1], y[0]):
            kind = "SCREEN_RECORDING" if "SCREEN_RECORDING" in (x[2], y[2]) else "VIDEO"
            if alike(kind, x[3], x[4], x[5], y[3], y[4], y[5]):
                want.add((kind, min(x[0], y[0]), max(x[0], y[0])))

    def matches(*_):
        raise AssertionError("similar frames were written")

    monkeypatch.setattr(joins, "frame_matches", matches)
    edges = joins.video_edges(videos, frames, band=False)
    assert {tuple(r)[1:] for r in edges.collect()} == want and len(want) > 30
    groups = grouping.anchor_groups(grouping.scan_rank(videos, "VIDEO"), edges).collect()
    assert sorted(grouping.videos_compared(videos, frames, False, block, sparse).collect()) == sorted(groups) and len(groups) > 20
