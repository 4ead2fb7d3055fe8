"""Places by ranges against a sorted list, pages that seek, and groups that are rebuilt from stored groups."""

from __future__ import annotations

import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from test_videos import some_videos
from video_brute import _alike, alike
from twinsift.operators import categories, grouping, joins, ranks

LISTED = "kind string, t long, asset_id long"


@pytest.mark.parametrize("rows_a_task", [10, 2_000_000])
def test_places_are_those_of_a_sorted_list(spark, rows_a_task):
    """One key holds most rows, one is null, times are tied or null; many tasks or few."""
    rng = random.Random(4)
    rows = [(rng.choice(["PHOTO"] * 8 + ["VIDEO", None]), rng.choice([None, 1, 2, 3, rng.randrange(1000)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, LISTED).repartition(5)
    want = {}
    for kind in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1] is None, -(r[1] or 0), -r[2]))
        want |= {r: n + 1 for n, r in enumerate(own)}
    made = ranks.listing(df, ["kind"], [F.desc("t"), F.desc("asset_id")], rows_a_task=rows_a_task)
    assert {tuple(r)[:3]: r["place"] for r in made.all().collect()} == want
    assert {tuple(r)[:3]: r["place"] for r in made.between(21, 40).collect()} == {r: n for r, n in want.items() if 21 <= n <= 40}
    parts = made.spans.where("r_key0 = 'PHOTO'").count()
    assert parts > 20 if rows_a_task == 10 else parts <= 4  # the hot key is spread


def test_no_window_sorts_a_kind(spark):
    df = spark.createDataFrame([("PHOTO", 1, 1)], LISTED)
    made = ranks.listing(df, ["kind"], [F.desc("t"), F.desc("asset_id")])
    plan = made.between(1, 20)._jdf.queryExecution().optimizedPlan().toString()
    # Windows are over the counts of parts only, and the parts that are read are picked by them.
    assert "row_number" not in plan and plan.count("Window [") == plan.count("Window [sum(r_n") and "dynamicpruning" in plan.lower()
    assert made.all().collect()[0]["place"] == 1
    assert ranks.listing(df.limit(0), ["kind"], [F.desc("t")]).all().collect() == []
    with pytest.raises(ValueError):
        ranks.listing(df.withColumn("r_at", F.lit(1)), ["kind"], [F.desc("t")])
    again = ranks.listing(df.withColumn("place", F.lit("x")), ["kind"], [F.desc("t")]).all()
    assert again.collect()[0]["place"] == 1


def test_pages_by_seeking_are_the_pages_by_number(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(5), rng.randrange(3), i) for i in range(95)]
    df = spark.createDataFrame(rows, "created_at_ms long, date_added_s long, media_store_id long")
    last, got = None, []
    for number in range(11):
        page = categories.page_after(df, 10, last).collect()
        assert page == categories.page(df, 10, number).collect()
        got += [tuple(r) for r in page]
        last = page[-1].asDict() if page else last
    assert got == sorted(rows, reverse=True)


def pictures(rng, n):
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            h, c = rng.choice(rows)[2:]
            for _ in range(rng.choice((0, 1, 3, 8, 14))):
                h ^= 1 << rng.randrange(62)
            c = [max(0.0, x + rng.choice((0, 0, 0.3, -0.2))) for x in c]
        else:
            h, c = rng.getrandbits(62), [float(rng.randrange(4)) for _ in range(24)]
        rows.append((i, rng.choice([300, 301, 301, 302]), h, c))
    return rows


@pytest.mark.parametrize("side", [3, 8192])
def test_stored_groups_are_verified_again(spark, side):
    """Pairs of one stored group that are alike, and no others; groups overlap, one is hot, tiles are small or large."""
    rng = random.Random(side)
    rows = pictures(rng, 80)
    group = {i: {0 if rng.random() < 0.4 else rng.randrange(1, 6), rng.randrange(6)} for i, *_ in rows}
    assets = spark.createDataFrame([(i, i, "PHOTO", "PENDING" if i == 7 else "DONE", "DELETE_PENDING" if i == 11 else "ACTIVE", v, h, c, i, i, i, False) for i, v, h, c in rows], "asset_id long, media_store_id long, kind string, fingerprint_status string, state string, algorithm_version int, image_hash long, color_hash array<double>, created_at_ms long, size_bytes long, width long, is_edited boolean").withColumn("height", F.lit(1))
    items = spark.createDataFrame([("SIMILAR", "PHOTO", g, i) for i in group for g in group[i]] * 2 + [("DUPLICATE", "PHOTO", 99, i) for i in group], "category string, kind string, group_id long, asset_id long")
    members = joins.stored_members(items, assets, ["PHOTO"])
    want, dropped = set(), 0
    for (i, v, h, c), (j, w, g, d) in combinations(rows, 2):
        if group[i] & group[j] and v == w and not {i, j} & {7, 11}:
            alike_ = _alike("PHOTO", h, c, g, d) is not None
            dropped += not alike_
            want |= {(i, j)} if alike_ else set()
    found = joins.verified_edges(members, assets, "PHOTO", side).select("first_asset_id", "second_asset_id").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 20 and dropped > 100
    # Without edges the stored groups are used, without groups all are compared.
    none = items.limit(0)
    edges = spark.createDataFrame([], "category string, kind string, first_asset_id long, second_asset_id long")
    by_groups = grouping.groups_of(assets, "PHOTO", edges, items).collect()
    wanted = grouping.anchor_groups(grouping.scan_rank(assets, "PHOTO"), spark.createDataFrame(sorted(want), "first_asset_id long, second_asset_id long")).collect()
    assert sorted(by_groups) == sorted(wanted)
    anew = sorted(grouping.groups_of(assets, "PHOTO").collect())
    assert sorted(grouping.groups_of(assets, "PHOTO", edges, none).collect()) == anew != sorted(by_groups)


@pytest.mark.parametrize("side", [4, 256])
def test_stored_groups_of_videos(spark, side):
    rng = random.Random(side)
    rows = some_videos(rng, 60)
    videos = spark.createDataFrame([(i, i, t, k, "ACTIVE") for i, t, k, *_ in rows], "asset_id long, media_store_id long, date_added_s long, kind string, state string")
    frames = spark.createDataFrame([(i, h, c, s) for i, _, _, s, h, c in rows], "asset_id long, hashes array<long>, colors array<array<double>>, source string")
    group = {i: 0 if rng.random() < 0.6 else rng.randrange(1, 4) for i, *_ in rows}
    items = spark.createDataFrame([("SIMILAR", "VIDEO", g, i) for i, g in group.items()], "category string, kind string, group_id long, asset_id long")
    members = joins.stored_members(items, videos, ["VIDEO", "SCREEN_RECORDING"])
    want, pairs = set(), set()
    for x, y in permutations(rows, 2):
        if group[x[0]] == group[y[0]] and (x[1], x[0]) < (y[1], y[0]):
            pairs.add((x[0], y[0]))
            kind = "SCREEN_RECORDING" if "SCREEN_RECORDING" in (x[2], y[2]) else "VIDEO"
            if alike(kind, x[3], x[4], x[5], y[3], y[4], y[5]):
                want.add((kind, min(x[0], y[0]), max(x[0], y[0])))
    candidates = joins.stored_pairs(members, videos, side)
    assert sorted(map(tuple, candidates.collect())) == sorted(pairs)
    assert {tuple(r)[1:] for r in joins.video_edges(videos, frames, candidates=candidates).collect()} == want and len(want) > 10
    assert grouping.video_groups_of(videos, frames, items).count() > 0
