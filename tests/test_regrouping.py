"""Groups kept up to date against full rebuilds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from twinsift.operators import categories, grouping
from twinsift.plans import fixtures
from twinsift.streaming import regrouping


def grouped(nodes, edges):
    """asset: group of the sequential rule in the order of ids; every node has one."""
    beside = {n: set() for n in nodes}
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)
    group = {}
    for n in sorted(nodes):
        if n not in group:
            group[n] = n
            for m in sorted(beside[n]):
                group.setdefault(m, n)
    return group


@pytest.mark.parametrize("seed, rounds", [(1, 20), (2, 0), (3, 2)])
def test_changes_give_the_groups_of_a_rebuild(spark, seed, rounds):
    """Sparse pairs, a chain in the order of ranks, and a star; nodes come and go."""
    rng = random.Random(seed)
    all_edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(60)} | {(i, i + 1) for i in range(120, 132)} | {(140, i) for i in range(141, 150)}
    old = set(range(150)) - {5, 6, 140}
    new = old - {120, 7, 30} | {5, 140}
    live = lambda nodes: sorted((a, b) for a, b in all_edges if a in nodes and b in nodes)
    before, want = grouped(old, live(old)), grouped(new, live(new))
    moved = old ^ new
    touched = moved | {x for e in all_edges for x in e if set(e) & moved}
    rows = spark.createDataFrame([(n, before.get(n) == n if n in old else None, before.get(n)) for n in sorted(new)], "asset_id long, is_anchor boolean, group_id long")
    nodes = rows.join(grouping.first_seen(rows), "asset_id")
    edges = spark.createDataFrame(live(new), "first_asset_id long, second_asset_id long")
    found = regrouping.regrouped(nodes, edges, spark.createDataFrame([(t,) for t in touched], "asset_id long"), rounds).collect()
    assert {r["asset_id"]: r["group_id"] for r in found} == want
    assert all(r["is_anchor"] == (r["group_id"] == r["asset_id"]) for r in found)
    visited = {r["asset_id"] for r in found if r["visited"]}
    assert {n for n in new if want[n] != before.get(n)} <= visited
    if rounds == 20:
        assert len(visited) < len(new)  # what no change reaches is left alone


def test_stream_of_inserts_and_deletes(spark, small, tmp_path):
    rows = fixtures.library(spark, small).withColumn("state", F.lit("ACTIVE")).select(*(f.split()[0] for f in regrouping.ASSET.split(", "))).where("kind = 'PHOTO'").orderBy("asset_id").collect()
    cut = len(rows) // 2
    gone = [r for r in rows[:cut] if r["asset_id"] % 4 == 0]
    deleted = [tuple("DELETE_PENDING" if f == "state" else r[f] for f in r.__fields__) for r in gone]
    batches = [rows[:cut], deleted + rows[cut : cut + 20] * 2, rows[cut + 20 :] + gone[:3], []]
    state, source = {}, str(tmp_path / "in")
    for n, batch in enumerate(batches):
        if not batch:
            continue
        spark.createDataFrame(batch, regrouping.ASSET).coalesce(1).write.mode("append").parquet(source)
        state |= {r[0]: tuple(r) for r in batch}
        regrouping.stream_groups(spark, source, str(tmp_path / "out"), str(tmp_path / "check"), kinds=("PHOTO",)).awaitTermination()
        # The same groups and category rows as of everything anew.
        now = spark.read.schema(regrouping.STATE).parquet(str(tmp_path / "out" / "state" / f"batch={n}"))
        whole = spark.createDataFrame(sorted(state.values()), regrouping.ASSET)
        from twinsift.operators import joins

        live = whole.where("state = 'ACTIVE'")
        want = grouping.anchor_groups(grouping.first_seen(live), joins.similar_edges(live, "PHOTO")).collect()
        assert sorted(map(tuple, regrouping.groups(now).select("group_id", "asset_id", "is_anchor").collect())) == sorted(map(tuple, want)) and len(want) > 3
        wanted = categories.category_rollup(regrouping.items(now), whole).collect()
        assert sorted(spark.read.parquet(str(tmp_path / "out" / "categories" / f"batch={n}")).collect()) == sorted(wanted)
        assert now.count() == len(state)
    assert not (tmp_path / "out" / "state" / "batch=0").exists()
